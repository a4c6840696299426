"""Join of near-duplicate documents by the Jaccard similarity of their word shingles.

Documents with the same words are one class from the start. Each class gets a signature of
min-hashes, cut into trees of a prefix trie each. Classes that share a prefix in some tree meet
there; prefixes are shortened, from the longest, until pairs at the threshold meet with the
wanted probability. What meets is first compared by signature and then verified exactly on the
shingle sets, which are made only for the classes that are left.

A prefix that many classes share is dealt out as pairs of blocks of about ``block`` classes, so
no task holds all of them, and a pair counts only in the first tree where it meets. Tasks return
a row per class - its number of links and the least class it hangs together with - never pairs.

Nulls: a null text is empty. Documents without words have no shingles: each is a class of its
own. Documents of fewer words than a shingle have one shingle, of all their words. Null ids are
never a class id unless all ids of a class are null. Repeated rows are copies of each other. An
empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.llm.components import components
from corpora.llm.lookup import document_key, texts_of
from corpora.llm.shingles import mixed, shingle_hashes, word_hashes
from corpora.session import materialize


def prefix_depth(threshold: float, trees: int, recall: float, longest: int = 8) -> int:
    """The longest prefix at which pairs at the threshold meet in some tree often enough."""
    depth = longest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def least_matches(threshold: float, hashes: int, lost: float = 1e-5) -> int:
    """Equal min-hashes that pairs at the threshold have, but for a share of ``lost``."""
    tail, least = 0.0, 0
    while least < hashes:
        tail += math.comb(hashes, least) * threshold**least * (1 - threshold) ** (hashes - least)
        if tail > lost:
            break
        least += 1
    return least


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """Least hash of the shingles under each hash function."""
    least = np.full(hashes, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        for j in range(hashes):
            least[j] = min(least[j], mixed(part, j + 1).min())
    return least


def _print_of(words: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(words.tobytes())


def signatures(docs: DataFrame, trees: int, depth: int, id: str, text: str) -> DataFrame:
    """Per row: ``id``, ``k`` (hash of id and text), ``f`` (print of its words; null without words),
    ``keys`` (a prefix hash per tree) and ``sig`` (16 bits of each min-hash)."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("id"), document_key(id, body).alias("k"), body.alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, keys, sigs = [], [], []
            for t in batch.column("t"):
                words = word_hashes(t.as_py())
                if not len(words):
                    prints.append(None), keys.append([]), sigs.append(None)
                    continue
                least = signature(np.unique(shingle_hashes(words)), trees * depth)
                parts = least.reshape(trees, depth)
                own = [xxhash.xxh64_intdigest(p.tobytes(), seed=i) for i, p in enumerate(parts)]
                prints.append(_print_of(words))
                keys.append(np.array(own, dtype=np.uint64).view(np.int64))
                sigs.append((least & np.uint64(0xFFFF)).astype(np.uint16).tobytes())
            columns = [batch.column("id"), batch.column("k"), pa.array(prints, pa.binary())]
            columns += [pa.array(keys, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "f", "keys", "sig"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(sign, f"id {kind}, k bigint, f binary, keys array<bigint>, sig binary")


def _meetings(classes: DataFrame, block: int) -> DataFrame:
    """``key``, blocks ``i`` <= ``j`` and class ``f`` for prefixes that more than one class has."""
    rows = classes.select("f", F.explode("keys").alias("key"))
    shared = rows.groupBy(F.col("key").alias("s")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(shared, F.col("key") == F.col("s"))
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = met.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.select("key", "f", "own", other.alias("other"))
    return met.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "f", "own")


def _binned(rows: DataFrame, per_bin: int = 4096) -> DataFrame:
    """``rows`` with ``bin``: block pairs are dealt to groups of about ``per_bin`` rows."""
    bins = max(1, -(-rows.count() // per_bin))
    return rows.withColumn("bin", F.pmod(F.xxhash64("key", "i", "j"), F.lit(bins)).cast("int"))


def _groups(frame: pd.DataFrame) -> Iterator[np.ndarray]:
    """Places of the rows of each block pair that has two rows or more."""
    order = np.lexsort((frame["j"], frame["i"], frame["key"]))
    names = frame[["key", "i", "j"]].to_numpy()[order]
    cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
    for group in np.split(order, cuts):
        if len(group) > 1:
            yield group


def _to_compare(frame: pd.DataFrame, at: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which pairs of a group belong here: across its two blocks, and met in no earlier tree."""
    own, i, j = frame["own"].to_numpy()[at], frame["i"].iat[at[0]], frame["j"].iat[at[0]]
    same = keys[at][:, None, :] == keys[at][None, :, :]
    tree = int(np.flatnonzero(keys[at[0]] == frame["key"].iat[at[0]])[0])
    here = same.argmax(axis=2) == tree
    np.fill_diagonal(here, False)
    if i != j:
        here &= (own[:, None] == i) != (own[None, :] == i)
    return here


def _likely(least: int):
    """Rows of block pairs that have a partner with enough equal min-hashes."""

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.stack(frame["keys"].to_numpy())
        sigs = np.stack([np.frombuffer(s, dtype=np.uint16) for s in frame["sig"]])
        keep = []
        for at in _groups(frame):
            equal = (sigs[at][:, None, :] == sigs[at][None, :, :]).sum(axis=2)
            partner = (_to_compare(frame, at, keys) & (equal >= least)).any(axis=1)
            keep.extend(at[partner])
        return frame.iloc[keep][["key", "i", "j", "f", "own"]]

    return check


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets with each other."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], dtype=np.float64)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    values, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    column = np.cumsum(shared) - 1
    use = shared[place]
    owner, place = owner[use], column[place[use]]
    out, width = np.zeros((n, n)), 4096
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    for start in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(place, [start, start + width])
        part = np.zeros((n, width), dtype=np.float32)
        part[owner[a:b], place[a:b] - start] = 1
        out += part @ part.T
    return out


def _verified(threshold: float):
    """Per class of each block pair: documents it is linked to and the least class around it."""

    def check(frame: pd.DataFrame) -> pd.DataFrame:
        keys = np.stack(frame["keys"].to_numpy())
        sets = [np.frombuffer(s, dtype=np.uint64) for s in frame["shingles"]]
        copies, names = frame["n"].to_numpy(), frame["f"].to_numpy()
        found: list[tuple] = []
        for at in _groups(frame):
            own = [sets[x] for x in at]
            sizes = np.array([len(s) for s in own], dtype=np.float64)
            both = _overlaps(own)
            alike = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
            alike &= _to_compare(frame, at, keys)
            links = alike @ copies[at]
            label, spread = np.argsort(np.argsort(names[at])), alike | np.eye(len(at), dtype=bool)
            by_rank = np.sort(names[at])
            while True:  # the least rank reaches all that hang together
                least = np.where(spread, label[None, :], len(at)).min(axis=1)
                if (least == label).all():
                    break
                label = least
            found.extend(
                (names[x], int(n), by_rank[l]) for x, n, l in zip(at, links, label) if n
            )
        return pd.DataFrame(found, columns=["f", "links", "label"])

    return check


def _shingle_sets(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """``f`` and ``shingles`` of the classes in ``wanted`` (``f``, ``k`` of one of its rows)."""
    exact = texts_of(docs, wanted, id, text).select("t")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, made = [], []
            for t in batch.column("t"):
                words = word_hashes(t.as_py())
                prints.append(_print_of(words))
                made.append(np.unique(shingle_hashes(words)).tobytes())
            columns = [pa.array(prints, pa.binary()), pa.array(made, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["f", "shingles"])

    return exact.mapInArrow(sets, "f binary, shingles binary").dropDuplicates(["f"])


def near_duplicates(
    docs: DataFrame,
    threshold: float = 0.8,
    id: str = "doc_id",
    text: str = "text",
    trees: int = 12,
    recall: float = 0.999,
    block: int = 512,
) -> DataFrame:
    """``id``, ``class_id`` and ``n_links`` of every row.

    ``n_links`` counts the other documents whose shingle sets have a Jaccard similarity of at
    least ``threshold``; ``class_id`` is the least id among all that such links join.
    """
    depth = prefix_depth(threshold, trees, recall)
    least = least_matches(threshold, trees * depth)
    rows = materialize(signatures(docs, trees, depth, id, text), "signatures")
    classes = rows.where("f is not null").groupBy("f").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first"), F.min("k").alias("k"),
        F.first("keys").alias("keys"), F.first("sig").alias("sig"),
    )
    classes = materialize(classes, "classes")
    met = materialize(_meetings(classes, block), "meetings")
    signed = _binned(met).join(classes.select("f", "keys", "sig"), "f")
    kinds = "key bigint, i int, j int, f binary, own int"
    likely = materialize(signed.groupBy("bin").applyInPandas(_likely(least), kinds), "likely")
    wanted = materialize(classes.join(likely.select("f").distinct(), "f", "left_semi").select("f", "k", "n", "keys"), "wanted")
    sets = materialize(_shingle_sets(docs, wanted, id, text).join(wanted.drop("k"), "f"), "shingle-sets")
    together = _binned(likely).join(sets, "f").groupBy("bin")
    verified = materialize(together.applyInPandas(_verified(threshold), "f binary, links bigint, label binary"), "links")
    links = verified.groupBy("f").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("f").alias("a"), F.col("label").alias("b")))
    firsts = classes.select("f", "first").join(joined, F.col("f") == F.col("node"))
    of_component = firsts.groupBy("component").agg(F.min("first").alias("least"))
    found = joined.join(of_component, "component").select(F.col("node").alias("f"), "least")
    summed = classes.select("f", "n", "first").join(found, "f", "left").join(links, "f", "left")
    summed = summed.select(
        "f", F.coalesce("least", "first").alias("class"),
        (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
    )
    out = rows.select("id", "f").join(summed, "f", "left")
    return out.select(
        F.col("id").alias(id), F.when(F.col("f").isNull(), F.col("id")).otherwise(F.col("class")).alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
    )
