"""Near-duplicate documents by one-permutation hashing, banded buckets and stars of candidates.

A document's set holds its distinct two-word shingles; documents of equal sets are one class from
the start, named by the key of one of their rows. One hash of each shingle gives the whole signature: the range of hashes is cut into
``bands * rows`` bins and a bin's value is the least hash in it. An empty bin copies the bin that
its own random order of all bins meets first among the filled ones (optimal densification), so two
signatures agree in a bin with a chance of the sets' similarity, whatever the sizes.

Classes that agree in all values of a band share a bucket. A bucket gives a star of candidates, from
one member to each other, not all pairs. The centre is the member that meets most others in all its
buckets: what a group was copied from, as a rule, and then the same one in most of them, so a group
of near copies costs about an edge for each. Edges are confirmed on full sets. A star misses a link
between two members that its centre is not linked to. So in buckets whose members do not hang
together yet, a member outside the largest component is compared with those of all others, another
one in each bucket and round, for ``rounds`` rounds or until there is none. Each round gives at most an
edge for each member. Buckets of up to ``rounds`` such members are compared in full; pairs at the
threshold share 13 buckets on average, each with centres of its own. Links within one component
change nothing and are never looked at.

At similarity 0.8 the chance that no band agrees is (1 - 0.8 ** rows) ** bands, 3 in ten million.

Nulls: a null text is empty. Documents without words have an empty set and are linked with nothing;
one of a single word has one shingle, that word. Null ids are never the least id unless all ids of a
component are null. Repeated rows have equal sets and are linked. An empty table gives an empty
table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.llm.components import components
from corpora.llm.lookup import document_key, texts_of
from corpora.llm.shingles import mixed, shingle_hashes
from corpora.session import materialize

#: Members of one star that meet their centre's set in one task, about.
_STAR = 256

_hashes: dict[bytes, int] = {}


def shingle_set(text: str, width: int = 2, limit: int = 100_000) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: A-Z lowered, words split at ASCII blanks."""
    if len(_hashes) > limit:
        _hashes.clear()
    found = []
    for word in text.encode().lower().split():
        value = _hashes.get(word)
        if value is None:
            value = xxhash.xxh64_intdigest(word)
            if len(word) <= 64:
                _hashes[word] = value
        found.append(value)
    return np.unique(shingle_hashes(np.array(found, dtype=np.uint64), width))


def densification_order(bins: int, seed: int = 7) -> np.ndarray:
    """For each bin (row) the places of all bins in its random order."""
    rng = np.random.default_rng(seed)
    return rng.permuted(np.tile(np.arange(bins, dtype=np.uint16), (bins, 1)), axis=1)


def one_permutation_signature(shingles: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The least hash of each bin; empty bins take the value of the first filled one in their order."""
    bins = len(order)
    hashes = np.sort(mixed(shingles, 41))
    at = (hashes >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)  # rises with the hash
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    filled = at[first].astype(np.int64)
    out = np.empty(bins, dtype=np.uint64)
    out[filled] = hashes[first]
    if len(filled) < bins:
        empty = np.ones(bins, dtype=bool)
        empty[filled] = False
        out[empty] = hashes[first[order[empty][:, filled].argmin(axis=1)]]
    return out


def band_keys(signature: np.ndarray, bands: int) -> np.ndarray:
    """One hash for each band of a signature."""
    values = signature.reshape(bands, -1)
    out = mixed(np.arange(bands, dtype=np.uint64), 43)
    for column in values.T:
        out = mixed(out ^ column, 47)
    return out


def signatures(docs: DataFrame, bands: int, rows: int, width: int, id: str, text: str) -> DataFrame:
    """Per row: ``id``, ``k`` (hash of id and text), ``n_shingles``, ``f`` (print of its set; null if
    empty) and ``keys`` (a hash for each band)."""
    body = F.coalesce(F.col(text), F.lit(""))
    given = docs.select(F.col(id).alias("id"), document_key(id, body).alias("k"), body.alias("t"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = densification_order(bands * rows)
        for batch in batches:
            sizes, prints, keys = [], [], []
            for t in batch.column("t"):
                own = shingle_set(t.as_py(), width)
                sizes.append(len(own))
                prints.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                made = band_keys(one_permutation_signature(own, order), bands) if len(own) else own
                keys.append(made.view(np.int64))
            columns = [batch.column("id"), batch.column("k"), pa.array(sizes, pa.int64())]
            columns += [pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "k", "n_shingles", "f", "keys"])

    kind = given.schema["id"].dataType.simpleString()
    return given.mapInArrow(sign, f"id {kind}, k bigint, n_shingles bigint, f binary, keys array<bigint>")


def buckets(classes: DataFrame) -> DataFrame:
    """``key``, ``k``, ``size`` and ``met``, the members of all buckets that ``k`` is in, of shared buckets.

    Keys are dealt out once, and a bucket is counted where its members lie.
    """
    members = classes.select(F.explode("keys").alias("key"), "k", F.col("size").cast("int").alias("size"))
    counted = members.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key")))
    shared = materialize(counted.where("n > 1"), "minhash-shared")
    met = shared.groupBy(F.col("k").alias("g")).agg(F.sum("n").alias("met"))
    return shared.join(met, F.col("k") == F.col("g")).select("key", "k", "size", "met")


def _comparable(percent: int) -> Column:
    """Whether sets of ``size`` and of ``centre_size`` can be similar enough at all."""
    return 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")


def star_edges(members: DataFrame, percent: int) -> DataFrame:
    """``_edges`` of each bucket's star about the member that meets most others.

    What a group was copied from shares more buckets than its copies do, so it is their centre in
    all buckets that it is in.
    """
    most = F.max(F.struct("met", "k", "size")).over(Window.partitionBy("key"))
    met = members.withColumn("m", most).select("k", "size", F.col("m.k").alias("centre"), F.col("m.size").alias("centre_size"))
    return _edges(met.where((F.col("k") != F.col("centre")) & _comparable(percent)))


def _edges(met: DataFrame) -> DataFrame:
    """``a`` and ``b``, the lesser first, and which of them is the ``centre``: each pair once."""
    return met.groupBy(F.least("k", "centre").alias("a"), F.greatest("k", "centre").alias("b")).agg(F.min("centre").alias("centre"))


def centres_outside(members: DataFrame, joined: DataFrame) -> DataFrame:
    """``members`` (``key``, ``k``, ``size``, ``was``) of buckets that do not hang together, with ``c`` (component) and
    their bucket's new ``centre``, ``centre_size`` and ``cc`` (its component).

    A centre is a member outside the bucket's largest component that ``was`` none yet, another one in each bucket;
    null if there is none. Each row meets one centre, that of its bucket, so there are as many as members.
    """
    labels = joined.select(F.col("node").alias("m"), "component")
    placed = members.select("key", "k", "size", "was").join(labels, F.col("k") == F.col("m"), "left")
    placed = placed.select("key", "k", "size", "was", F.coalesce("component", "k").alias("c")).repartition("key")
    bucket = Window.partitionBy("key")
    counted = placed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key", "c")))
    parted = counted.withColumn("largest", F.max(F.struct("n", "c")).over(bucket)["c"])
    parted = parted.withColumn("mixed", F.min("c").over(bucket) != F.max("c").over(bucket)).where("mixed")
    order = F.struct(F.xxhash64("key", "k").alias("h"), "k", "size", "c")
    chosen = parted.withColumn("x", F.min(F.when((F.col("c") != F.col("largest")) & ~F.col("was"), order)).over(bucket))
    return chosen.select(
        "key", "k", "size", (F.col("was") | F.col("k").eqNullSafe(F.col("x.k"))).alias("was"), "c",
        F.col("x.k").alias("centre"), F.col("x.size").alias("centre_size"), F.col("x.c").alias("cc"),
    )


def confirmed(edges: DataFrame, docs: DataFrame, percent: int, width: int, id: str, text: str) -> DataFrame:
    """The ``a`` and ``b`` of ``edges`` whose full sets are similar enough.

    Texts are moved, not sets, which are larger: a member's once for each edge, to its centre. A centre of many
    edges is repeated for each ``_STAR`` of them, so a large star is many tasks' work.
    """
    degrees = edges.groupBy(F.col("centre").alias("c")).agg(F.ceil(F.count(F.lit(1)) / _STAR).alias("salts"))
    other = F.when(F.col("centre") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("node")
    salted = edges.select("centre", other).join(degrees, F.col("centre") == F.col("c"))
    salts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("salts") - 1)).alias("salt")
    ends = salted.select("centre", "node", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"))
    ends = materialize(ends.unionByName(degrees.select(F.col("c").alias("centre"), F.col("c").alias("node"), salts)), "minhash-ends")
    texts = texts_of(docs, ends.select(F.col("node").alias("k")).distinct(), id, text).select("k", "t")
    rows = ends.join(texts, F.col("node") == F.col("k")).select("centre", "salt", "node", "t").repartition("centre", "salt")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, own = None, None  # a centre comes before its members
        for batch in batches:
            links = []
            for centre, salt, node, t in zip(*(batch.column(c) for c in ("centre", "salt", "node", "t"))):
                centre, salt, node, its = centre.as_py(), salt.as_py(), node.as_py(), shingle_set(t.as_py(), width)
                if node == centre:
                    known, own = (centre, salt), its
                elif known == (centre, salt):
                    both = int((own[np.minimum(np.searchsorted(own, its), len(own) - 1)] == its).sum())
                    if 100 * both >= percent * (len(own) + len(its) - both):
                        links.append((min(centre, node), max(centre, node)))
            columns = [pa.array(c, pa.int64()) for c in (zip(*links) if links else ((), ()))]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    ordered = rows.sortWithinPartitions("centre", "salt", F.col("node") != F.col("centre"))
    return ordered.mapInArrow(compare, "a bigint, b bigint")


def minhash_near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    width: int = 2,
    bands: int = 64,
    rows: int = 7,
    rounds: int = 2,
    id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id`` and ``kept`` of every row.

    Rows are linked if 100 * intersection >= ``percent`` * union of their sets; ``component_id`` is
    the least id that such links reach and ``kept`` says whether it is the row's own.
    """
    signed = materialize(signatures(docs, bands, rows, width, id, text), "minhash-signatures")
    classes = signed.where("f is not null").groupBy("f").agg(
        F.min("id").alias("first"), F.min("k").alias("k"), F.any_value("keys").alias("keys"),
        F.any_value("n_shingles").alias("size"),
    )
    classes = materialize(classes, "minhash-classes")
    members = materialize(buckets(classes), "minhash-buckets")

    def linked(pairs: DataFrame) -> DataFrame:
        return materialize(confirmed(pairs, docs, percent, width, id, text), "minhash-links")

    edges = materialize(star_edges(members, percent), "minhash-stars")
    links = linked(edges)
    joined = materialize(components(links), "minhash-components")
    open_members = members.withColumn("was", F.lit(False))
    for _ in range(rounds):
        open_members = materialize(centres_outside(open_members, joined), "minhash-centres")
        met = open_members.where("centre is not null")
        if met.isEmpty():
            break
        fresh = _edges(met.where((F.col("c") != F.col("cc")) & _comparable(percent)))
        fresh = materialize(fresh.join(edges, ["a", "b"], "left_anti"), "minhash-stars")
        found = linked(fresh)
        edges = edges.unionByName(fresh)
        if not found.isEmpty():  # else the components stay
            links = links.unionByName(found)
            joined = materialize(components(links), "minhash-components")
    firsts = classes.select("k", "first").join(joined, F.col("k") == F.col("node"))
    least = firsts.groupBy("component").agg(F.min("first").alias("least"))
    found = joined.join(least, "component").select(F.col("node").alias("k"), "least")
    of_class = classes.select("k", "f", "first").join(found, "k", "left").select("f", F.coalesce("least", "first").alias("least"))
    alone = signed.where("f is null").select("id", "n_shingles", F.col("id").alias("c"))
    others = signed.where("f is not null").select("id", "n_shingles", F.col("f").alias("own"))
    # a set that a third of all rows share is one row of `of_class`: rows of it meet it salted
    salts = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
    spread = of_class.select(F.col("f").alias("own"), "least", salts)
    salt = F.pmod(F.xxhash64("id") + F.spark_partition_id(), F.lit(16)).cast("int").alias("salt")
    linked = others.select("*", salt).join(spread, ["own", "salt"]).select("id", "n_shingles", F.col("least").alias("c"))
    out = linked.unionByName(alone)
    return out.select(
        F.col("id").alias(id), "n_shingles", F.col("c").alias("component_id"), F.col("id").eqNullSafe(F.col("c")).alias("kept")
    )
