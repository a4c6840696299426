"""Connected components of a table of edges, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.session import materialize


def _checksum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).collect()[0]
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node about it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    larger = both.join(least, F.col("a") == F.col("n")).where(F.col("b") > F.col("a"))
    return larger.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    joined = down.join(least, F.col("a") == F.col("n"))
    around = joined.select(F.col("b").alias("a"), F.col("m").alias("b"))
    itself = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return around.unionByName(itself).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least node) of all nodes that the edges ``a``, ``b`` name.

    Edges stay a table that is written between the steps; nothing but a count and a checksum
    comes to the driver. Null ends are ignored.
    """
    start = edges.where("a is not null and b is not null")
    nodes = start.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    now = materialize(start.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while (check := _checksum(now)) != before:
        before = check
        now = materialize(_small_star(_large_star(now)), "edges")
    found = nodes.join(now, F.col("node") == F.col("a"), "left")
    return found.select("node", F.coalesce("b", "node").alias("component"))
