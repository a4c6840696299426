"""Exact search for the highest integer inner products by ball trees, one to a shard.

Vectors are hashed to shards; each shard builds a tree of balls (a centre and a radius) over
its rows. A block of queries walks it together: at each node the queries whose bound
``q . centre + |q| * radius`` is below their current k-th score are dropped, and the others go
first to the child of the higher bound. The k-th scores are shared: every query is searched
in one shard first, and the score found there prunes all shards of the second round. Results
are merged per query from at most ``k`` rows of each shard.

Components become ``floor(scale * x)`` of the double. Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id; queries meet vectors of their
own dimension only. A query's own id is no candidate. Repeated rows: equal query rows are one
query; equal candidate rows are candidates each. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import operator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.session import materialize

_LEAF = 64
#: Inner products below this are exact in doubles.
_EXACT = 2.0**52


class _Node:
    __slots__ = ("centre", "radius", "rows", "left", "right")

    def __init__(self, vectors: np.ndarray, rows: np.ndarray):
        own = vectors[rows]
        self.centre = own.mean(axis=0)
        away = np.sqrt(((own - self.centre) ** 2).sum(axis=1))
        self.radius = float(away.max())
        self.rows, self.left, self.right = rows, None, None
        if len(rows) <= _LEAF or self.radius == 0:
            return
        one = own[away.argmax()]
        two = own[((own - one) ** 2).sum(axis=1).argmax()]
        order = np.argsort(own @ (one - two), kind="stable")
        half = len(rows) // 2
        self.left = _Node(vectors, rows[order[:half]])
        self.right = _Node(vectors, rows[order[half:]])


class BallTree:
    """Rows of one shard: integer vectors (as doubles) and their ids."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray):
        self.vectors, self.ids = vectors, ids
        self.top = _Node(vectors, np.arange(len(ids)))

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray):
        """Ids and scores (int64; -1 and the least int where none) of each query's k best rows.

        ``least`` holds a score that k candidates elsewhere reach at least: rows below it may
        be left out. Rows that equal it are kept, since smaller ids win ties.
        """
        n = len(queries)
        self.queries, self.own, self.k, self.least = queries, own, k, least.astype(np.float64)
        self.norms = np.sqrt((queries**2).sum(axis=1))
        self.scores = np.full((n, k), -np.inf)
        self.found = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self._visit(self.top, np.arange(n), self._bound(self.top, np.arange(n)))
        return self.found, self.scores

    def _bound(self, node: _Node, active: np.ndarray) -> np.ndarray:
        high = self.queries[active] @ node.centre + self.norms[active] * node.radius
        return high + 1e-9 * np.abs(high) + 1e-6  # rounding never hides a row

    def _visit(self, node: _Node, active: np.ndarray, bound: np.ndarray) -> None:
        going = bound >= np.maximum(self.scores[active, -1], self.least[active])
        active = active[going]
        if not len(active):
            return
        if node.left is None:
            self._scan(node, active)
            return
        low, high = self._bound(node.left, active), self._bound(node.right, active)
        first = low >= high
        for some, order in ((first, "lr"), (~first, "rl")):
            for side in order:
                child, bounds = (node.left, low) if side == "l" else (node.right, high)
                self._visit(child, active[some], bounds[some])

    def _scan(self, node: _Node, active: np.ndarray) -> None:
        ids = self.ids[node.rows]
        scores = self.queries[active] @ self.vectors[node.rows].T
        scores[ids[None, :] == self.own[active][:, None]] = -np.inf
        both = np.concatenate([self.scores[active], scores], axis=1)
        names = np.concatenate([self.found[active], np.broadcast_to(ids, scores.shape)], axis=1)
        order = np.lexsort((names, -both), axis=1)[:, : self.k]
        self.scores[active] = np.take_along_axis(both, order, 1)
        self.found[active] = np.take_along_axis(names, order, 1)


def quantized(vectors: DataFrame, scale: int, id: str, vector: str) -> DataFrame:
    """``id``, ``v`` (floor of ``scale`` times each component, whole doubles) and ``dim`` of the valid rows."""
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    wide = F.lit(np.inf).cast("double")
    valid = F.forall(F.col("x"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < wide))
    rows = vectors.select(F.col(id).alias("id"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & valid)
    # from 2 ** 52 on a double is whole as it is
    def whole(c: Column) -> Column:
        y = c * F.lit(float(scale))
        return F.when(F.abs(y) < _EXACT, F.floor(y).cast("double")).otherwise(y)

    made = F.transform("x", whole)
    return rows.select("id", made.alias("v"), F.size("x").alias("dim"))


def _matrix(frame: pd.DataFrame) -> np.ndarray:
    return np.stack(frame["v"].to_numpy()).astype(np.float64)


def _large(points, ids, asked, names, numbers, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the query, id and score of each query's ``k`` best points, by Python's integers.

    Scores past the range of a long are given as its ends.
    """
    exact = [[int(c) for c in p] for p in points.tolist()]
    out = []
    for own, name, query in zip(numbers.tolist(), names.tolist(), asked.tolist()) if exact else ():
        q = [int(c) for c in query]
        scored = ((-sum(map(operator.mul, q, p)), i) for p, i in zip(exact, ids.tolist()) if i != name)
        out += [(own, i, max(-(2**63), min(2**63 - 1, -s))) for s, i in heapq.nsmallest(k, scored)]
    return tuple(np.array(x, dtype=np.int64) for x in (zip(*out) if out else ((), (), ())))


def _searched(k: int):
    """Cogrouped search of a block of queries in a shard."""

    def search(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"q": [], "qn": [], "vec": [], "score": []})
        if rows.empty or queries.empty:
            return empty
        points, asked = _matrix(rows), _matrix(queries)
        ids, names = rows["id"].to_numpy(), queries["id"].to_numpy()
        most = np.sqrt(_EXACT / max(1, points.shape[1])) - 1
        plain_rows, plain_queries = (np.abs(m).max(axis=1, initial=0) <= most for m in (points, asked))
        least = queries["least"].fillna(-np.inf).to_numpy(dtype=np.float64)
        parts = []
        if plain_rows.any() and plain_queries.any():
            tree = BallTree(points[plain_rows], ids[plain_rows])
            found, scores = tree.search(asked[plain_queries], names[plain_queries], k, least[plain_queries])
            query, place = np.nonzero(np.isfinite(scores))
            parts.append((np.flatnonzero(plain_queries)[query], found[query, place], scores[query, place].astype(np.int64)))
        # rows or queries with large entries: whole numbers of any size
        parts.append(_large(points[~plain_rows], ids[~plain_rows], asked, names, np.arange(len(names)), k))
        if not plain_queries.all():
            large = np.flatnonzero(~plain_queries)
            parts.append(_large(points[plain_rows], ids[plain_rows], asked[large], names[large], large, k))
        query, vec, score = (np.concatenate(x) for x in zip(*parts))
        return pd.DataFrame({"q": names[query], "qn": queries["n"].to_numpy()[query], "vec": vec, "score": score})

    return search


def top_inner_products(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    scale: int = 256,
    id: str = "vec_id",
    vector: str = "embedding",
    shard_rows: int = 8192,
    block_queries: int = 4096,
) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score``: each query's ``k`` highest scores.

    ``is_query`` is a condition on the id column. The number of shards and of blocks follows
    the counts of rows and queries; a task holds one shard and one block.
    """
    rows = materialize(quantized(vectors, scale, id, vector), "vectors")
    asked = rows.withColumnRenamed("id", id).where(is_query).withColumnRenamed(id, "id").distinct()
    total, queries = rows.count(), asked.count()
    shards, blocks = max(1, -(-total // shard_rows)), max(1, -(-queries // block_queries))
    number = F.xxhash64("id", "v")  # tells queries of one id apart
    asked = asked.withColumn("n", number).withColumn("block", F.pmod("n", F.lit(blocks)).cast("int"))
    asked = materialize(asked.withColumn("home", F.pmod(F.xxhash64("n"), F.lit(shards)).cast("int")), "queries")
    placed = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    tiled = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    tiled = tiled.select("dim", "shard", "block", "id", "v")
    kinds = "q bigint, qn bigint, vec bigint, score bigint"

    def search(asking: DataFrame) -> DataFrame:
        key = ["dim", "shard", "block"]
        pairs = tiled.groupBy(key).cogroup(asking.select(*key, "id", "v", "n", "least").groupBy(key))
        return pairs.applyInPandas(_searched(k), kinds)

    at_home = asked.withColumn("shard", F.col("home")).withColumn("least", F.lit(None).cast("double"))
    first = materialize(search(at_home), "first")
    kth = first.groupBy("q", "qn").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c"))
    kth = kth.where(F.col("c") >= k).select("q", "qn", F.col("s").cast("double").alias("least"))
    same = (F.col("id") == F.col("q")) & (F.col("n") == F.col("qn"))
    known = asked.join(kth, same, "left").drop("q", "qn")
    others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("home"))
    away = known.withColumn("shard", F.explode(others))
    found = first.unionByName(search(away))
    best = Window.partitionBy("q", "qn").orderBy(F.desc("score"), "vec")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select(F.col("q").alias("query_id"), "rank", F.col("vec").alias("vec_id"), "score")
