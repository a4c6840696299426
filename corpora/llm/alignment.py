"""Alignment of two tokenizers' tokens by diagonal run skipping, and links by corpus-wide counts.

A byte-level BPE (A, of a text after a blank) and a sentencepiece model (B, which puts the blank
there itself) cut the same bytes. Where tokens of both end at one byte a group ends. Within a text
the two arrays of ends are walked at the present shift of their indexes: probes of doubling length
compare whole stretches and jump over those where tokens stand one to one; at an irregular place the
lesser end moves on until both agree, which is a group of its own and changes the shift.

A link is a pair of tokens, one of each, whose byte ranges share a group. The number of texts
that hold an id pair linked is counted over the corpus: tasks keep the distinct pairs of each text,
Spark adds them up before its shuffle. Scores then come from two tiers: the counts of the most
frequent pairs (at most ``table_size``, found by a histogram) are broadcast and looked up where the
texts' pairs are read; only the rare rest is shuffled and joined. The greatest count of each A
id is one row for an id of the vocabulary, at most.

Nulls: a text that is null, empty, or whose tokens' bytes are not those of the blank and the text
has no tokens: zeros, and ``groups_sha256`` is ''. Null ids stay. Repeated rows are texts of their
own. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.llm.tokens import _byte_letters
from corpora.session import materialize

# Fixed value: how byte-level tokenizers part a text.
_BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

def irregular_groups(a: list[int], b: list[int]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Groups of more than two tokens, as first and last index in ``a`` and first and last in ``b``.

    Both lists of ends ascend and share their last one. Tokens outside these groups stand one to one.
    """
    first_a, last_a, first_b, last_b = [], [], [], []
    i, j, n = 0, 0, len(a)
    while i < n:
        width = 1
        while i < n and a[i : i + width] == b[j : j + width]:
            step = min(width, n - i)
            i, j, width = i + step, j + step, 2 * width
        while width > 1 and i < n:  # the mismatch lies within the last probe
            width //= 2
            if a[i : i + width] == b[j : j + width]:
                i, j = i + width, j + width
        if i < n:
            first_a.append(i)
            first_b.append(j)
            one, two = a[i], b[j]
            while one != two:
                if one < two:
                    i += 1
                    one = a[i]
                else:
                    j += 1
                    two = b[j]
            last_a.append(i)
            last_b.append(j)
            i, j = i + 1, j + 1
    return first_a, last_a, first_b, last_b


class _Cut:
    """A tokenizer with the bytes of its tokens; ``encode`` gives the ids of a whole text."""

    def __init__(self, spelled: list[bytes]):
        self.spelled, self.sizes = spelled, np.array(list(map(len, spelled)), dtype=np.int64)

    def encode(self, text: str) -> list[int]:
        raise NotImplementedError

    def tokens(self, text: str, whole: bytes) -> np.ndarray | None:
        """Ids of a text, or None if their bytes are not ``whole``."""
        ids = self.encode(text)
        return np.array(ids, dtype=np.int64) if b"".join(map(self.spelled.__getitem__, ids)) == whole else None

    def ends(self, ids: np.ndarray) -> list[int]:
        return self.sizes[ids].cumsum().tolist()


class ByteTokens(_Cut):
    """Tokens of a byte-level BPE file, of a blank and the text; special strings are ordinary text.

    Where the ids of its merged tokens rise in the order of merges, ``tiktoken`` gives the same ids for the same
    table in a seventh of the time. Only texts of plain characters without very long runs go there.
    """

    #: Others than those of old Unicode blocks, which both libraries class alike.
    _other = re.compile("[^\t\n\r -~\xa1-\u024f‐-‧‰-⁞€]")
    _run = re.compile(r"\S{10000}|\s{10000}")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as file:
            config = json.load(file)
        bytes_of = {c: b for b, c in _byte_letters().items()}
        names = self.tokenizer.get_vocab(with_added_tokens=True)
        special = {t["content"] for t in config.get("added_tokens") or []}
        spelled = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            spelled[i] = name.encode() if name in special else bytes(map(bytes_of.__getitem__, name))
        super().__init__(spelled)
        ranks = {spelled[i]: i for name, i in names.items() if name not in special}
        self.fast = tiktoken.Encoding("byte-level", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}) if _is_ranked(config) else None

    def encode(self, text: str) -> list[int]:
        text = " " + text
        if self.fast is None or self._other.search(text) or len(text) > 10000 and self._run.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def _is_ranked(config: dict) -> bool:
    """Whether a file is plain byte-level BPE whose merges give the ids after the 256 bytes' in their order."""
    model, split = config["model"], config.get("pre_tokenizer") or {}
    vocab = model["vocab"]
    merged = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return (
        config.get("normalizer") is None
        and (split.get("type"), split.get("use_regex"), split.get("add_prefix_space")) == ("ByteLevel", True, False)
        and sorted(vocab[c] for c in _byte_letters().values()) == list(range(256))
        and all(vocab.get(name) == 256 + i for i, name in enumerate(merged))
        and not model.get("dropout") and not model.get("ignore_merges")
    )


class PieceTokens(_Cut):
    """Tokens of a sentencepiece model, which puts a blank before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = library = SentencePieceProcessor(model_file=path)
        spelled = [library.id_to_piece(i).replace("▁", " ").encode() for i in range(library.vocab_size())]
        for b in range(256):
            spelled[library.piece_to_id(f"<0x{b:02X}>")] = bytes([b])
        super().__init__(spelled)

    def encode(self, text: str) -> list[int]:
        return self.library.encode(text)


def _ends_group(size: int, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which of ``size`` tokens are the last of their group."""
    inside = np.zeros(size + 1, dtype=np.int64)
    inside[first] += 1
    inside[last] -= 1
    return inside[:-1].cumsum() == 0


class Groups:
    """The groups of two arrays of ids: ``closes_a``, ``closes_b`` mark the last tokens."""

    def __init__(self, a: np.ndarray, b: np.ndarray, ends_a: list[int], ends_b: list[int]):
        self.a, self.b = a, b
        self.irregular = [np.array(x, dtype=np.int64) for x in irregular_groups(ends_a, ends_b)]
        p, q, r, s = self.irregular
        self.closes_a, self.closes_b = _ends_group(len(a), p, q), _ends_group(len(b), r, s)
        self.to_a, self.to_b = np.flatnonzero(self.closes_a) + 1, np.flatnonzero(self.closes_b) + 1

    def __len__(self) -> int:
        return len(self.to_a)

    def linked_pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct id pairs (A above B in 64 bits) of the groups, and the links of each."""
        p, q, r, s = self.irregular
        wide, high = q - p + 1, s - r + 1
        single = [np.ones(len(x), dtype=bool) for x in (self.a, self.b)]
        for mask, first, last in ((single[0], p, q), (single[1], r, s)):
            mask[~_ends_group(len(mask), first, last)] = False
            mask[last] = False
        short = wide * high <= 64
        n = (wide * high)[short]
        place = np.arange(n.sum()) - np.repeat(n.cumsum() - n, n)
        rows, columns = place // np.repeat(high[short], n), place % np.repeat(high[short], n)
        some_a, some_b = self.a[np.repeat(p[short], n) + rows], self.b[np.repeat(r[short], n) + columns]
        # tokens that stand one to one follow each other alike on both sides
        pairs = np.concatenate([self.a[single[0]] << 32 | self.b[single[1]], some_a << 32 | some_b])
        found, links = np.unique(pairs, return_counts=True)
        more = [self._long(*group) for group in zip(*(x[~short].tolist() for x in self.irregular))]
        if more:
            found, place = np.unique(np.concatenate([found, *[x for x, _ in more]]), return_inverse=True)
            weights = np.concatenate([links, *[n for _, n in more]])
            links = np.bincount(place, weights, len(found)).astype(np.int64)
        return found, links

    def _long(self, p: int, q: int, r: int, s: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the distinct ids of a long group, and their links."""
        x, n = np.unique(self.a[p : q + 1], return_counts=True)
        y, m = np.unique(self.b[r : s + 1], return_counts=True)
        return (x[:, None] << 32 | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()

    def text(self, names: list[str], first_of_b: int) -> str:
        """All groups in order: ids of A, a bar and ids of B each, with semicolons between.

        ``names`` holds for each id of A its text with a comma and with a bar, and from ``first_of_b``
        on each id of B with a comma and with a semicolon.
        """
        before_a = np.concatenate([[0], self.to_a[:-1]])
        before_b = np.concatenate([[0], self.to_b[:-1]])
        order = np.empty(len(self.a) + len(self.b), dtype=np.int64)
        order[np.arange(len(self.a)) + np.repeat(before_b, self.to_a - before_a)] = 2 * self.a + self.closes_a
        order[np.arange(len(self.b)) + np.repeat(self.to_a, self.to_b - before_b)] = first_of_b + 2 * self.b + self.closes_b
        return "".join(map(names.__getitem__, order.tolist()))[:-1]


class Aligner:
    """Both tokenizers of a worker."""

    def __init__(self, tokenizer: str, model: str):
        self.first, self.second = ByteTokens(tokenizer), PieceTokens(model)
        sizes = len(self.first.spelled), len(self.second.spelled)
        self.names = [f"{i}{end}" for size, ends in zip(sizes, (",|", ",;")) for i in range(size) for end in ends]

    def align(self, text: str) -> tuple:
        """``n_a``, ``n_b``, ``n_groups``, ``n_links``, the groups' digest, pairs and their links."""
        whole = (" " + text).encode()
        a = self.first.tokens(text, whole) if text else None
        b = self.second.tokens(text, whole) if a is not None else None
        if b is None:
            return 0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64)
        groups = Groups(a, b, self.first.ends(a), self.second.ends(b))
        pairs, links = groups.linked_pairs()
        named = groups.text(self.names, 2 * len(self.first.spelled))
        return len(a), len(b), len(groups), int(links.sum()), hashlib.sha256(named.encode()).hexdigest(), pairs, links


_aligners: dict[tuple[str, str], Aligner] = {}


_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


def aligned_tokens(docs: DataFrame, tokenizer: str, model: str, id: str, text: str) -> DataFrame:
    """Per row: ``id``, ``row`` (a name of its own), counts, ``groups_sha256``, distinct ``pairs`` and their ``links``."""
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, model) not in _aligners:
            _aligners[tokenizer, model] = Aligner(tokenizer, model)
        aligner = _aligners[tokenizer, model]
        for batch in batches:
            name = uuid.uuid4().hex
            for at in range(0, batch.num_rows, 512):  # results are wider than texts
                part = batch.slice(at, 512)
                made = list(zip(*[aligner.align(t.as_py()) for t in part.column("t")]))
                columns = [part.column("id"), pa.array([f"{name}{at + i}" for i in range(part.num_rows)])]
                columns += [pa.array(x, pa.int64()) for x in made[:4]]
                columns += [pa.array(made[4], pa.string())]
                columns += [pa.array(x, pa.list_(pa.int64())) for x in made[5:]]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "row", *_COUNTS, "groups_sha256", "pairs", "links"])

    kind = rows.schema["id"].dataType.simpleString()
    counts = ", ".join(f"{c} bigint" for c in _COUNTS)
    fields = f"id {kind}, row string, {counts}, groups_sha256 string, pairs array<bigint>, links array<bigint>"
    return rows.mapInArrow(align, fields)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``pair``, ``n`` (texts that hold it linked) and ``best`` (no pair of its A id has more)."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "pair-counts")
    first = F.shiftright("pair", 32)
    most = counts.groupBy(first.alias("a")).agg(F.max("n").alias("most"))  # a row for each id of the vocabulary
    joined = counts.join(F.broadcast(most), first == F.col("a"))
    return joined.select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def frequent_from(counts: DataFrame, size: int) -> int:
    """The least power of two such that at most ``size`` pairs have that count or more."""
    level = F.floor(F.log2(F.col("n").cast("double"))).cast("int")
    rows = counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()  # 64 at most
    kept, level = 0, 64
    for r in sorted(rows, key=lambda r: -r.level):
        kept += r.n
        if kept > size:
            break
        level = r.level
    return 1 << min(level, 62)


def _scored(aligned: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """Rows with ``n_best`` and ``count_sum`` of their frequent pairs, and the others as ``missed``."""
    spark = aligned.sparkSession
    least = frequent_from(counts, size)
    table = counts.where(F.col("n") >= least).toArrow()  # ``size`` rows at most
    keys = table.column("pair").to_numpy()
    order = np.argsort(keys)
    given = [keys[order], table.column("n").to_numpy()[order], table.column("best").to_numpy(zero_copy_only=False)[order]]
    shared = spark.sparkContext.broadcast(given)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = shared.value
        for batch in batches:
            pairs, links = batch.column("pairs"), batch.column("links")
            ends = np.cumsum([len(x) for x in pairs], dtype=np.int64)
            owner = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            pair, link = (x.flatten().to_numpy(zero_copy_only=False) for x in (pairs, links))
            place = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
            known = keys[place] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
            sums, bests = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            np.add.at(sums, owner[known], counts[place[known]] * link[known])
            np.add.at(bests, owner[known], best[place[known]] * link[known])
            missed = np.searchsorted(owner[~known], np.arange(batch.num_rows + 1)).astype(np.int32)
            columns = [batch.column(c) for c in ("id", "row", *_COUNTS, "groups_sha256")]
            columns += [pa.array(bests), pa.array(sums)]
            columns += [pa.ListArray.from_arrays(missed, pa.array(x[~known], pa.int64())) for x in (pair, link)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["id", "row", *_COUNTS, "groups_sha256", "n_best", "count_sum", "missed", "missed_links"]
    kinds = dict(aligned.dtypes) | {"missed": "array<bigint>", "missed_links": "array<bigint>"}
    return aligned.mapInArrow(score, ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names))


def token_alignment(
    docs: DataFrame, tokenizer: str, model: str, id: str = "doc_id", text: str = "text", table_size: int = 1 << 18
) -> DataFrame:
    """``id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum`` and ``groups_sha256``.

    ``tokenizer`` (a tokenizers file, byte-level) and ``model`` (sentencepiece) are paths on every
    machine. ``n_best`` counts links of an id pair that no other pair of its A id exceeds;
    ``count_sum`` adds the counts of all links' pairs.
    """
    aligned = materialize(aligned_tokens(docs, tokenizer, model, id, text), "aligned")
    counts = materialize(pair_counts(aligned), "linked-pairs")
    scored = materialize(_scored(aligned, counts, table_size), "scored")
    whole = scored.where(F.size("missed") == 0)
    partly = scored.where(F.size("missed") > 0)
    rare = partly.select("row", F.inline(F.arrays_zip("missed", "missed_links"))).join(counts, F.col("missed") == F.col("pair"))
    times = F.col("missed_links")
    added = rare.groupBy(F.col("row").alias("r")).agg(
        F.sum(F.col("n") * times).alias("more"), F.sum(F.when(F.col("best"), times).otherwise(F.lit(0))).alias("more_best")
    )
    rest = partly.join(added, F.col("row") == F.col("r"))
    rest = rest.withColumns({"count_sum": F.col("count_sum") + F.col("more"), "n_best": F.col("n_best") + F.col("more_best")})
    names = [F.col("id").alias(id), *_COUNTS, "n_best", "count_sum", "groups_sha256"]
    return whole.select(*names).unionByName(rest.select(*names))
