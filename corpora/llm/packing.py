"""Packing of tokenized documents into sequences by exact-complement hashing, then best fit.

Texts are encoded where they are read; a longer document is cut into pieces of ``size``
tokens. What is left to decide depends only on how many pieces have each length, a table of
at most ``size`` rows. On it the plan is made: the lengths of single pieces, pairs and triples
are indexed by their sum, combinations that fill the gap beside a longer piece exactly are
consumed as often as their counts allow, and the rest goes best fit, longest first. The plan
gives, for each length, runs of ranks and the sequence and place of the first rank. Pieces
are ranked within their length in hashed buckets, so a length that a third of all pieces share
is spread over many tasks, and look their place up in the broadcast plan (a few rows per length).

Nulls: a null text is empty, so its document is one piece with the closing id. Null ids and
repeated rows are packed like any other rows. An empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpora.llm.tokens import packing_encoder
from corpora.session import materialize

Run = tuple[int, int, int, int]  # length, first rank, first sequence, offset


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 0,
    id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32`` and, if asked, ``ids``."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    closing = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = packing_encoder(tokenizer)
        for batch in batches:
            row, out = [], []
            for at, t in enumerate(batch.column("t")):
                ids = encoder.value(t.as_py()) + closing
                for piece, start in enumerate(range(0, len(ids), 4 * size)):
                    own = ids[start : start + 4 * size]
                    row.append(at)
                    out.append((piece, start // 4, len(own) // 4, zlib.crc32(own), own))
            piece, start, length, crc, own = zip(*out) if out else [()] * 5
            columns = [batch.column("id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(c, pa.int64()) for c in (start, length, crc)]
            columns += [pa.array(own, pa.binary())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "piece", "start", "length", "crc"] + ["ids"] * with_ids
    kind = rows.schema["id"].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""
    return rows.mapInArrow(
        cut, f"id {kind}, piece int, start bigint, length bigint, crc bigint{extra}"
    )


class _Plan:
    """Runs of ranks by length, from how many pieces have each length."""

    def __init__(self, counts: dict[int, int], size: int):
        self.size = size
        self.left = np.zeros(size + 1, dtype=np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.next_rank = np.zeros(size + 1, dtype=np.int64)
        self.sequences = 0
        self.runs: list[Run] = []
        self.open: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, how many)

    def place(self, length: int, n: int, first: int, offset: int) -> None:
        """The next ``n`` pieces of ``length`` go to the sequences from ``first`` on."""
        self.runs.append((length, int(self.next_rank[length]), first, offset))
        self.next_rank[length] += n
        self.left[length] -= n

    def fill(self, lengths: tuple[int, ...]) -> None:
        """Build sequences of just these lengths while there are pieces for them."""
        n = min(int(self.left[l]) // lengths.count(l) for l in lengths)
        first, offset = self.sequences, 0
        self.sequences += n
        for l in lengths:
            self.place(l, n, first, offset)
            offset += l

    def there(self, *lengths: int) -> bool:
        return all(self.left[l] >= lengths.count(l) for l in lengths)

    def pair(self, total: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """Two lengths of that sum, as even as can be (short pieces fill the last gaps best), beside those taken."""
        if total < 2:
            return None
        a = np.arange(total // 2, 0, -1)
        a = a[total - a < self.size]
        ok = a[(self.left[a] > 0) & (self.left[total - a] > 0)]
        for short in ok:
            both = (int(short), int(total - short))
            if self.there(*taken, *both):
                return both
        return None

    def pair_sums(self) -> int:
        """Bit ``t`` is set if some two lengths that are left have the sum ``t``."""
        lengths = [int(l) for l in np.flatnonzero(self.left)]
        has = sum(1 << l for l in lengths)
        sums = 0
        for l in lengths:
            sums |= has << l
        return sums

    def exact(self, most: int = 3) -> None:
        """Complements that fill the gap beside each length: single, pair, then triple."""
        while self.left[self.size]:
            self.fill((self.size,))
        for how_many in range(1, most + 1):
            for length in range(self.size - 1, 0, -1):
                sums = self.pair_sums() if how_many > 1 and self.left[length] else 0
                while self.left[length]:
                    found = self.complement(length, how_many, sums)
                    if found is None:
                        break
                    self.fill((length, *found))

    def complement(self, length: int, how_many: int, sums: int):
        gap = self.size - length
        if how_many == 1:
            return (gap,) if self.there(length, gap) else None
        if how_many == 2:
            return self.pair(gap, (length,)) if sums >> gap & 1 else None
        longest = np.flatnonzero(self.left[: max(gap - 1, 0)])[::-1]
        for first in map(int, longest):
            if sums >> (gap - first) & 1 and self.there(length, first):
                rest = self.pair(gap - first, (length, first))
                if rest is not None:
                    return (first, *rest)
        return None

    def best_fit(self) -> None:
        """What is left, longest first, each into the smallest gap that holds it."""
        gaps: list[int] = []

        def keep(gap: int, first: int, n: int) -> None:
            if gap and n:
                if gap not in self.open:
                    self.open[gap] = []
                    insort(gaps, gap)
                self.open[gap].append((first, n))

        for length in range(self.size - 1, 0, -1):
            while self.left[length]:
                at = bisect_left(gaps, length)
                if at < len(gaps):
                    gap = gaps[at]
                    first, n = self.open[gap].pop()
                    if not self.open[gap]:
                        del self.open[gap]
                        gaps.pop(at)
                    use = min(n, int(self.left[length]))
                    self.place(length, use, first, self.size - gap)
                    keep(gap, first + use, n - use)
                    keep(gap - length, first, use)
                    continue
                per, n = self.size // length, int(self.left[length])
                full, rest = divmod(n, per)
                first, start = self.sequences, int(self.next_rank[length])
                if full:  # as many of this length to a sequence as it holds
                    for slot in range(per):
                        self.place(length, full, first, slot * length)
                    self.sequences += full
                    keep(self.size - per * length, first, full)
                if rest:
                    first = self.sequences
                    self.sequences += 1
                    for slot in range(rest):
                        self.place(length, 1, first, slot * length)
                    keep(self.size - rest * length, first, 1)


def packing_plan(counts: dict[int, int], size: int) -> list[Run]:
    """Runs (length, first rank, first sequence, offset) that place all counted pieces.

    Exact complements of up to one, two and three pieces are tried; the fewest sequences win.
    """
    plans = []
    for most in (3, 2, 1):
        plan = _Plan(counts, size)
        plan.exact(most)
        plan.best_fit()
        plans.append(plan)
    return sorted(min(plans, key=lambda plan: plan.sequences).runs)


def ranked(pieces: DataFrame, buckets: int = 256) -> DataFrame:
    """``pieces`` with ``rank``, from 0 within each length; no length meets in one task."""
    order = [c for c in ("id", "piece", "crc") if c in pieces.columns]
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    own = Window.partitionBy("length", "bucket").orderBy(*order)
    placed = spread.withColumn("own", F.row_number().over(own))
    sizes = spread.groupBy("length", "bucket").count()  # at most size x buckets rows
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        F.col("length").alias("l"), F.col("bucket").alias("b"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"),
    )
    both = placed.join(sizes, (F.col("length") == F.col("l")) & (F.col("bucket") == F.col("b")))
    return both.withColumn("rank", F.col("before") + F.col("own") - 1).drop(
        "l", "b", "before", "own", "bucket"
    )


def packed(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` (with ``length`` in 1..size) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    runs = np.array(packing_plan(counts, size), dtype=np.int64).reshape(-1, 4)
    shared = spark.sparkContext.broadcast(runs)
    rows = ranked(pieces)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        by_length = {int(l): own[own[:, 0] == l] for l in np.unique(own[:, 0])}
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(length), np.zeros_like(length)
            for l in np.unique(length):
                at = np.flatnonzero(length == l)
                run = by_length[int(l)]
                hit = np.searchsorted(run[:, 1], rank[at], side="right") - 1
                sequence[at] = run[hit, 2] + rank[at] - run[hit, 1]
                offset[at] = run[hit, 3]
            columns = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    kept = [c for c in rows.columns if c != "rank"]
    fields = ", ".join(f"`{c}` {k}" for c, k in rows.dtypes if c != "rank")
    return rows.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    size: int = 2048,
    end_id: int = 0,
    id: str = "doc_id",
    text: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their sequence and offset.

    Encoded pieces are written once, since the plan and the placing both read them.
    """
    made = token_pieces(docs, tokenizer, size, end_id, id, text, with_ids)
    pieces = materialize(made, "pieces")
    out = packed(pieces, size)
    last = [F.col("ids")] if with_ids else []
    return out.select(
        F.col("id").alias(id), "piece", "start", "length", F.col("crc").alias("ids_crc32"),
        "sequence_id", "offset", *last,
    )
