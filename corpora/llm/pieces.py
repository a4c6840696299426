"""SentencePiece encoding and decoding of whole texts, giant ones in parallel chunks.

The model's pieces come from the library's file. Its BPE result for a text is the one path of
pieces from start to end on which every piece, and every two pieces that follow each other, are
the result for their own letters. So encoding is a best path in the max-plus algebra: a step to a
piece that fits the one before it weighs 0, any other is impossible.

Ordinary texts are cut where no piece can cross (before a run of blanks, around line ends), and
each worker keeps the ids of the units it met. A giant text is dealt out as chunks of ``chunk``
characters. The state at a boundary is the piece that covers the last character before it. Each
chunk yields the matrix of best weights from the states at its left to those at its right; the
matrices of a text are multiplied as a tree, the states of all boundaries follow, and then every
chunk traces its own pieces back by itself.

Nulls: a null text is empty, with no ids; null ids stay. Repeated rows give repeated rows. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.session import materialize

BLANK = "▁"
#: Units that no piece crosses: a run of blanks and what follows it, or a line end.
_UNITS = re.compile("▁*[^▁\n]+|▁+|\n")
_NEVER = -np.inf
#: Entries of a worker's caches, and about how many bytes of results it holds before it hands them on.
_KEPT = 100_000
_HELD = 4 << 20
#: Ids that are spelled at once.
_BLOCK = 1 << 16

State = tuple[int, int]


class Pieces:
    """Pieces of a model file and what follows from their scores alone."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        names = [self.library.id_to_piece(i) for i in range(self.library.vocab_size())]
        special = [
            self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_byte(i)
            for i in range(len(names))
        ]
        self.ids = {n: i for i, (n, s) in enumerate(zip(names, special)) if not s}
        self.scores = {n: self.library.get_score(i) for n, i in self.ids.items()}
        self.bytes = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.longest = max(map(len, self.ids))
        if any(BLANK in n.lstrip(BLANK) or "\n" in n for n in self.ids):
            raise ValueError("a piece of this model crosses blanks or line ends")
        self.spelled = [n.replace(BLANK, " ").encode() for n in names]
        for i, s in enumerate(special):
            if s:
                self.spelled[i] = b""
        for b, i in enumerate(self.bytes):
            self.spelled[i] = bytes([b])
        self.units: dict[str, bytes] = {}
        self.alone: dict[str, bool] = {}
        self.fitting: dict[tuple[str, str], bool] = {}

    def merged(self, letters: str) -> list[str]:
        """Pieces of a string by merging, best score first and leftmost among equals."""
        parts: list[str | None] = list(letters)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(left: int) -> None:
            right = after[left]
            if left >= 0 and right < len(parts):
                both = parts[left] + parts[right]
                if both in self.scores:
                    heapq.heappush(heap, (-self.scores[both], left, both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, left, both = heapq.heappop(heap)
            right = after[left] if parts[left] is not None else len(parts)
            if right >= len(parts) or parts[left] + parts[right] != both:
                continue
            parts[left], parts[right] = both, None
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [p for p in parts if p is not None]

    def is_alone(self, piece: str) -> bool:
        """Whether a piece is the result for its own letters."""
        if len(piece) == 1:
            return True
        if piece not in self.alone:
            self.alone[piece] = piece in self.ids and self.merged(piece) == [piece]
        return self.alone[piece]

    def fits(self, one: str, two: str) -> bool:
        """Whether two pieces are the result for their letters together."""
        if two[0] == BLANK and one[-1] != BLANK or "\n" in (one, two):
            return True
        if (one, two) not in self.fitting:
            if len(self.fitting) > _KEPT:
                self.fitting.clear()
            self.fitting[one, two] = self.merged(one + two) == [one, two]
        return self.fitting[one, two]

    def packed(self, pieces: list[str]) -> bytes:
        """Ids as little-endian 32-bit numbers; letters without a piece become bytes."""
        ids: list[int] = []
        for p in pieces:
            own = self.ids.get(p)
            ids.extend([own] if own is not None else [self.bytes[b] for b in p.encode()])
        return np.array(ids, dtype="<u4").tobytes()

    def unit(self, unit: str) -> bytes:
        value = self.units.get(unit)
        if value is None:
            if unit[0] == BLANK:  # the library puts the first blank there itself
                value = np.array(self.library.encode(unit[1:]) if len(unit) > 1 else self.ids_of_blank(), dtype="<u4").tobytes()
            else:
                value = self.packed(self.merged(unit))
            if len(unit) <= 64:
                self.units[unit] = value
        return value

    def ids_of_blank(self) -> list[int]:
        return [self.ids[BLANK]]

    def encoded(self, plain: str) -> bytes:
        """Ids of a string that begins and ends where no piece crosses."""
        if len(self.units) > _KEPT:
            self.units.clear()
        units, known = _UNITS.findall(plain), self.units
        try:
            return b"".join([known[u] for u in units])
        except KeyError:
            return b"".join(map(self.unit, units))

    def decoded(self, ids: bytes) -> str:
        """The text of packed ids, without the blank put before it."""
        every, spell = np.frombuffer(ids, dtype="<u4"), self.spelled.__getitem__
        blocks = [b"".join(map(spell, every[at : at + _BLOCK].tolist())) for at in range(0, len(every), _BLOCK)]
        return b"".join(blocks).decode(errors="replace").removeprefix(" ")


_loaded: dict[str, Pieces] = {}


def load(path: str) -> Pieces:
    """This worker's pieces of a model file."""
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def plain_form(text: str) -> str:
    """A text as the model sees it: blanks as letters, one before the first word."""
    return BLANK + text.replace(" ", BLANK) if text else ""


def is_cut(s: str, at: int) -> bool:
    """Whether no piece can cross this place of the string."""
    if at <= 0 or at >= len(s):
        return True
    return s[at] == BLANK and s[at - 1] != BLANK or s[at] == "\n" or s[at - 1] == "\n"


class Chunk:
    """A stretch ``a``..``b`` of a string ``s`` (its characters and as many around as a piece has)."""

    def __init__(self, pieces: Pieces, s: str, a: int, b: int):
        self.pieces, self.s, self.a, self.b = pieces, s, a, b
        self.first = next((i for i in range(a, b + 1) if is_cut(s, i)), None)
        self.last = next((i for i in range(b - 1, a - 1, -1) if is_cut(s, i)), None)
        if self.first is None or self.last is None or self.first > self.last:
            self.first = self.last = None

    def states(self, at: int) -> list[State]:
        """Pieces that cover the character before a boundary; one empty state at the start."""
        if at == 0:
            return [(0, 0)]
        s, most = self.s, self.pieces.longest
        found = []
        for start in range(max(0, at - most), at):
            for end in range(at, min(len(s), start + most) + 1):
                if self._is_step(start, end):
                    found.append((start, end))
        return found

    def _is_step(self, start: int, end: int) -> bool:
        piece = self.s[start:end]
        if end - start > 1 and piece not in self.pieces.ids:
            return False
        return self.pieces.is_alone(piece)

    def _flow(self, sources: dict[State, np.ndarray], limit: int):
        """Best weights of the pieces that cover the character before ``limit``, and where from."""
        s, most = self.s, self.pieces.longest
        best, came = dict(sources), {}
        ends: dict[int, list[State]] = {}
        for state in sources:
            ends.setdefault(state[1], []).append(state)
        heap = list(ends)
        heapq.heapify(heap)
        final = {state: v for state, v in sources.items() if state[1] >= limit}
        while heap:
            at = heapq.heappop(heap)
            if at >= limit:
                continue
            here = ends.pop(at)
            for end in range(at + 1, min(len(s), at + most) + 1):
                if not self._is_step(at, end):
                    continue
                step = (at, end)
                for state in here:
                    one = s[state[0] : state[1]]
                    if one and not self.pieces.fits(one, s[at:end]):
                        continue
                    if step in best:
                        best[step] = np.maximum(best[step], best[state])
                    else:
                        best[step], came[step] = best[state], state
                        if end >= limit:
                            final[step] = best[step]
                        else:
                            if end not in ends:
                                ends[end] = []
                                heapq.heappush(heap, end)
                            ends[end].append(step)
                if step in final:
                    final[step] = best[step]
        return final, came

    def _from_cut(self, at: int) -> dict[State, np.ndarray]:
        return {(at, at): np.zeros(1)}

    def transfer(self) -> tuple[list[State], list[State], np.ndarray]:
        """States at the left and right boundary, and the best weight from each to each."""
        into = self.states(self.a)
        unit = np.where(np.eye(len(into), dtype=bool), 0.0, _NEVER)
        sources = {state: unit[i] for i, state in enumerate(into)}
        if self.first is None:
            final, _ = self._flow(sources, self.b)
            out = [state for state in final if state[0] < self.b]
            return into, out, np.stack([final[state] for state in out], axis=1)
        left, _ = self._flow(sources, self.first)
        right, _ = self._flow(self._from_cut(self.last), self.b)
        out = [state for state in right if state[0] < self.b]
        arrive = np.max(np.stack(list(left.values())), axis=0)
        return into, out, arrive[:, None] + np.array([right[state][0] for state in out])[None, :]

    def _path(self, source: State, limit: int, goal: State | None) -> list[str]:
        final, came = self._flow({source: np.zeros(1)}, limit)
        state, found = goal if goal is not None else next(iter(final)), []
        while state != source:
            found.append(self.s[state[0] : state[1]])
            state = came[state]
        return found[::-1]

    def traced(self, into: State, out: State) -> bytes:
        """Ids of the pieces after the left state up to the right one."""
        p = self.pieces
        if self.first is None:
            return p.packed(self._path(into, self.b, out))
        left = self._path(into, self.first, None) if into[1] < self.first else []
        right = self._path((self.last, self.last), self.b, out)
        return p.packed(left) + p.encoded(self.s[self.first : self.last]) + p.packed(right)


def product(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Max-plus product of two matrices."""
    return (one[:, :, None] + two[None, :, :]).max(axis=1)


def boundary_states(matrices: list[np.ndarray]) -> list[int]:
    """The state at each boundary of the best path, the outer ones included.

    Products over stretches are made as a tree; the best outer states fix the middle one, and
    so on down, so the depth is the logarithm of the number of chunks.
    """
    made: dict[tuple[int, int], np.ndarray] = {}

    def over(a: int, b: int) -> np.ndarray:
        if (a, b) not in made:
            half = (a + b) // 2
            made[a, b] = matrices[a] if b - a == 1 else product(over(a, half), over(half, b))
        return made[a, b]

    def fix(a: int, b: int, left: int, right: int) -> list[int]:
        if b - a == 1:
            return []
        half = (a + b) // 2
        middle = int((over(a, half)[left] + over(half, b)[:, right]).argmax())
        return [*fix(a, half, left, middle), middle, *fix(half, b, middle, right)]

    whole = over(0, len(matrices))
    left, right = np.unravel_index(whole.argmax(), whole.shape)
    return [int(left), *fix(0, len(matrices), int(left), int(right)), int(right)]


def _rows(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=names)


def _portions(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """The batches in portions of about ``_HELD`` bytes of a column, of a row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for row, size in enumerate(sizes.tolist()):
            if held and held + size > _HELD:
                yield batch.slice(start, row - start)
                start, held = row, 0
            held += size
        if batch.num_rows > start:
            yield batch.slice(start)


def _tasks(chunks: int) -> int:
    """A task for each chunk, or for a few if there are thousands."""
    return max(1, min(chunks, 2000), chunks // 16)


def _giant(rows: DataFrame, model: str, chunk: int) -> DataFrame:
    """``id``, ``ids`` of the texts in ``rows`` (``id``, ``t``), each dealt out as chunks."""
    kind = rows.schema["id"].dataType.simpleString()
    wide = 64  # characters around a chunk, more than a piece has

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in enumerate(batch.column("t")):
                s, name = plain_form(t.as_py()), uuid.uuid4().hex
                starts = list(range(0, max(1, len(s) - wide), chunk))
                for n, a in enumerate(starts):
                    b = len(s) if n == len(starts) - 1 else a + chunk
                    low, high = max(0, a - wide), min(len(s), b + wide)
                    columns = [batch.column("id").slice(row, 1), pa.array([name]), pa.array([n], pa.int32())]
                    columns += [pa.array([x], pa.int64()) for x in (low, a, b, len(s))]
                    yield _rows([*columns, pa.array([s[low:high]])], names)

    names = ["id", "name", "n", "low", "a", "b", "size", "s"]
    fields = f"id {kind}, name string, n int, low bigint, a bigint, b bigint, size bigint, s string"
    chunks = materialize(rows.mapInArrow(cut, fields), "chunks")
    tasks = _tasks(chunks.count())
    dealt = chunks.repartition(tasks, "name", "n")

    def opened(row: dict) -> Chunk:
        # one character of padding keeps a chunk's own start from looking like the text's
        s, low = row["s"], row["low"]
        if low:
            s, low = "\0" + s, low - 1
        if row["low"] + len(row["s"]) < row["size"]:
            s += "\0"
        return Chunk(load(model), s, row["a"] - low, row["b"] - low)

    def chosen(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("n")
        states = [json.loads(x) for x in frame["states"]]
        shaped = [
            np.frombuffer(w, dtype="<f8").reshape(len(into), len(out))
            for w, (into, out) in zip(frame["weights"], states)
        ]
        aligned = [shaped[0]]
        for (_, out), (into, _), m in zip(states, states[1:], shaped[1:]):
            # both sides name the states of a boundary by places relative to it
            place = {tuple(x): i for i, x in enumerate(into)}
            aligned.append(m[[place[tuple(x)] for x in out]])
        best = boundary_states(aligned)
        first = [states[0][0][best[0]], *[out[i] for (_, out), i in zip(states, best[1:])]]
        pairs = [json.dumps([one, two]) for one, two in zip(first, first[1:])]
        return pd.DataFrame({"name2": frame["name"], "n2": frame["n"], "ends": pairs})

    made = dealt.mapInArrow(
        lambda batches: _matrices(batches, opened), "name string, n int, states string, weights binary"
    )
    ends = made.groupBy("name").applyInPandas(chosen, "name2 string, n2 int, ends string")
    same = (F.col("name") == F.col("name2")) & (F.col("n") == F.col("n2"))
    known = chunks.join(ends, same).drop("name2", "n2").repartition(tasks, "name", "n")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own = opened(row)
                (i, j), (k, l) = json.loads(row["ends"])
                found.append(own.traced((own.a + i, own.a + j), (own.b + k, own.b + l)))
            columns = [batch.column("id"), batch.column("name"), batch.column("n"), pa.array(found, pa.binary())]
            yield _rows(columns, ["id", "name", "n", "ids"])

    traced = known.mapInArrow(trace, f"id {kind}, name string, n int, ids binary")
    whole = F.expr("listagg(ids) within group (order by n)").alias("ids")  # joined at once
    return traced.groupBy("name").agg(F.first("id").alias("id"), whole).select("id", F.coalesce("ids", F.lit(b"")).alias("ids"))


def _matrices(batches: Iterator[pa.RecordBatch], opened) -> Iterator[pa.RecordBatch]:
    """Matrices of chunks, with states as places relative to their boundary."""
    for batch in batches:
        states, weights = [], []
        for row in batch.to_pylist():
            own = opened(row)
            into, out, matrix = own.transfer()
            states.append(
                json.dumps([[(i - own.a, j - own.a) for i, j in into], [(i - own.b, j - own.b) for i, j in out]])
            )
            weights.append(matrix.astype("<f8").tobytes())
        columns = [batch.column("name"), batch.column("n")]
        columns += [pa.array(states, pa.string()), pa.array(weights, pa.binary())]
        yield _rows(columns, ["name", "n", "states", "weights"])


def encode(
    docs: DataFrame, model: str, id: str = "doc_id", text: str = "text", chunk: int = 1 << 16
) -> DataFrame:
    """``id`` and ``ids`` (packed little-endian 32-bit numbers) of every row.

    ``model`` is the path of a sentencepiece BPE model on every machine. Texts longer than
    ``chunk`` characters are encoded in chunks.
    """
    rows = docs.select(F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in _portions(batches, "t"):
            ids = [pieces.encoded(plain_form(t.as_py())) for t in batch.column("t")]
            yield _rows([batch.column("id"), pa.array(ids, pa.binary())], ["id", "ids"])

    short = rows.where(F.length("t") <= chunk).mapInArrow(whole, f"id {kind}, ids binary")
    out = short.unionByName(_giant(rows.where(F.length("t") > chunk), model, chunk))
    return out.withColumnRenamed("id", id)


def decode(encoded: DataFrame, model: str, id: str = "doc_id") -> DataFrame:
    """``encoded`` (``id``, ``ids``) with ``n_tokens``, ``ids_crc32`` and the decoded ``text``."""
    rows = encoded.select(F.col(id).alias("id"), "ids")
    kind = rows.schema["id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        for batch in _portions(batches, "ids"):
            ids = [i.as_py() for i in batch.column("ids")]
            columns = [batch.column("id"), pa.array([len(i) // 4 for i in ids], pa.int64())]
            columns += [pa.array([zlib.crc32(i) for i in ids], pa.int64())]
            columns += [pa.array([pieces.decoded(i) for i in ids], pa.string()), batch.column("ids")]
            yield _rows(columns, ["id", "n_tokens", "ids_crc32", "text", "ids"])

    fields = f"id {kind}, n_tokens bigint, ids_crc32 bigint, text string, ids binary"
    return rows.mapInArrow(read, fields).withColumnRenamed("id", id)
