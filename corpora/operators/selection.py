"""Exact selection by rank or by running total, without sorting the rows globally.

A cut is found in two narrow steps. A histogram over leading digits of the order
hash has a fixed maximum size whatever the number of rows; it tells which bucket
holds the wanted rank. Only the rows of that one bucket are then ordered. The cut
is one hash value, so applying it to the wide rows is a filter, not a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.functions.ordering import hash_bucket
from corpora.session import materialize

Ranks = Callable[[Column], Sequence[Column]]


def _cumulated(rows: DataFrame, by: Sequence[str], amount: Column) -> DataFrame:
    """Amount per bucket with running and whole totals per group.

    The windows run over bucket rows: at most 16**digits of them per group.
    """
    histogram = rows.groupBy(*by, "_bucket").agg(amount.alias("_n"))
    group = Window.partitionBy(*by)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return histogram.withColumns(
        {"_upto": F.sum("_n").over(running), "_total": F.sum("_n").over(group)}
    )


def cut_points(
    rows: DataFrame, order: Column, ranks: Ranks | DataFrame, by: Sequence[str] = ()
) -> DataFrame:
    """Order hash found at given ranks: ``(*by, cut, at)``.

    ``ranks`` is either a function from the number of rows (per group) to a list of
    ranks, or a short table ``(*by, cut, rank)`` with one row per wanted cut. A rank
    of zero yields no row. Order hashes must be unique per group.
    """
    by = list(by)
    keyed = rows.select(*by, order.alias("_order")).withColumn("_bucket", hash_bucket(F.col("_order")))
    buckets = _cumulated(keyed, by, F.count(F.lit(1)))
    if isinstance(ranks, DataFrame):
        wanted = buckets.join(ranks.withColumnRenamed("rank", "_rank"), by)
    else:
        wanted = buckets.select(
            "*", F.posexplode(F.array(*ranks(F.col("_total")))).alias("cut", "_rank")
        )
    before = F.col("_upto") - F.col("_n")
    bounds = wanted.where((F.col("_rank") > before) & (F.col("_rank") <= F.col("_upto"))).select(
        *by, "_bucket", "cut", (F.col("_rank") - before).alias("_offset")
    )
    if not by or isinstance(ranks, DataFrame):
        bounds = F.broadcast(bounds)  # one row per cut that the caller lists
    inside = keyed.join(bounds, [*by, "_bucket"])
    position = F.row_number().over(Window.partitionBy(*by, "cut").orderBy("_order"))
    return (
        inside.withColumn("_position", position)
        .where(F.col("_position") == F.col("_offset"))
        .select(*by, "cut", F.col("_order").alias("at"))
    )


def cuts_as_column(cuts: DataFrame) -> Column:
    """The cuts of one ungrouped selection as a scalar map ``cut -> hash``."""
    entries = F.collect_list(F.struct("cut", "at"))
    return cuts.agg(F.map_from_entries(entries).alias("cuts")).scalar()


def up_to(order: Column, cuts: Column, cut: int) -> Column:
    """Whether a row lies at or before a cut; a cut at rank zero admits none."""
    return order <= F.coalesce(F.element_at(cuts, F.lit(cut)), F.lit(""))


def first_rows(rows: DataFrame, order: Column, ranks: Ranks) -> DataFrame:
    """Rows at or before the single rank that ``ranks`` gives."""
    cuts = cuts_as_column(cut_points(rows, order, ranks))
    return rows.where(up_to(order, cuts, 0))


def overflow_point(rows: DataFrame, order: Column, amount: Column, cap: int) -> DataFrame:
    """Order hash of the first row at which the running total would pass ``cap``.

    One row ``(at)``; NULL when the total never does. Amounts must be positive.
    """
    keyed = rows.select(order.alias("_order"), amount.cast("bigint").alias("_amount")).where(
        F.col("_amount") > 0
    )
    keyed = keyed.withColumn("_bucket", hash_bucket(F.col("_order")))
    buckets = _cumulated(keyed, [], F.sum("_amount"))
    before = F.col("_upto") - F.col("_n")
    bound = buckets.where((F.col("_upto") > cap) & (before <= cap)).select(
        "_bucket", before.alias("_before")
    )
    running = Window.partitionBy("_bucket").orderBy("_order")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = keyed.join(F.broadcast(bound), "_bucket")  # totals rise, so one bucket row
    passed = inside.withColumn("_upto", F.col("_before") + F.sum("_amount").over(running))
    return passed.where(F.col("_upto") > cap).agg(F.min("_order").alias("at"))


def within_budget(rows: DataFrame, order: Column, amount: Column, cap: int) -> DataFrame:
    """Prefix of the rows, in hash order, whose total stays within ``cap``.

    The prefix ends at the first overflow; a later smaller row is not taken. A cap
    of zero or less means no cap.
    """
    if cap <= 0:
        return rows
    at = overflow_point(rows, order, amount, cap).scalar()
    # No hex digest reaches "g": without an overflow every row stays.
    return rows.where((amount > 0) & (order < F.coalesce(at, F.lit("g"))))


def numbered_by_key(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Rank 1..n in the order of a unique key.

    Only the keys are ordered: they are written once, in ranges that Spark balances
    by sampling; each range is numbered on its own and shifted by the rows before it.
    The ranges are part of the written table, so a repeated task finds the same ones.
    The rows get their number by a join on the key and are written nowhere; they are
    read twice, the first time without the columns that their selection does not need.
    A row without a key has no place and fails.
    """
    missing = F.raise_error(F.lit(f"a row has no {key} to be numbered by")).cast(dict(rows.dtypes)[key])
    ranges = rows.select(F.coalesce(F.col(key), missing).alias(key)).repartitionByRange(F.col(key))
    placed = materialize(ranges.withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(key))
    numbers = (
        placed.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_range")  # one row per shuffle partition
        .select(key, (F.col("_before") + F.col("_inside")).alias(name))
    )
    return rows.join(numbers, key)
