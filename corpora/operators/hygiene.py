"""Filters, guards and removal of duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T


def require_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Fail at plan time, naming the columns there are."""
    missing = sorted(set(needed) - set(df.columns))
    if missing:
        raise ValueError(f"columns {missing} not found; available columns: {df.columns}")
    return df


def require_rows(df: DataFrame, least: int, what: str = "rows") -> DataFrame:
    """Fail when there are fewer than ``least`` rows; reads no more than that many."""
    found = df.limit(least).count()
    if found < least:
        raise ValueError(f"too few {what}: {found}, at least {least} needed")
    return df


def computed_once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns that are costly and that later filters refer to.

    A filter over a plain projection repeats the expression for each reference; the
    one-element generator keeps it a value.
    """
    others = [c for c in rows.columns if c not in columns]
    made = F.struct(*[column.alias(name) for name, column in columns.items()])
    return rows.select(*others, F.inline(F.array(made)))


#: Bits of a filter that is broadcast: 2 MB at most, whatever the number of keys.
FILTER_BITS = 1 << 24


def key_filter(keys: DataFrame, key: Column, bits: int = FILTER_BITS) -> DataFrame:
    """A Bloom filter of one hash over ``key``: pages of 4 KB with a bit for each hash, ``(_page, _bits)``.

    Pages are made where their keys meet, so no task holds all of them. The more keys, the
    more others pass; none of the keys ever fails.
    """
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    page = F.coalesce(F.bitmap_bucket_number(place), F.lit(0))  # never null: joins need not filter for it
    return keys.groupBy(page.alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))


def marked_by(rows: DataFrame, key: Column, pages: DataFrame, into: str, bits: int = FILTER_BITS) -> DataFrame:
    """``rows`` with the boolean ``into``: whether ``key`` may be among those of the filter ``pages``."""
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.expr("_byte >> _at") % 2 == 1, F.lit(False))
    met = rows.withColumn("_place", F.coalesce(F.bitmap_bucket_number(place), F.lit(0))).withColumn("_at", (at % 8).cast("int"))
    met = met.join(F.broadcast(pages), F.col("_place") == F.col("_page"), "left").withColumn("_byte", byte)
    return met.withColumn(into, found).select(*rows.columns, into)


def keep_first(rows: DataFrame, on: Sequence[Column], order: str, bits: int | None = None) -> DataFrame:
    """Of rows equal in ``on`` keep the one with the least ``order`` key.

    The winners come from an aggregation over digests, which is combined before
    the shuffle, so one text on a third of all rows costs one row per task. The
    wide rows move once, by the unique order key, and never by the skewed one. A row
    without an order key has no place among its equals and fails.

    With ``bits``, a filter of that size over the digests that occur again is broadcast, and
    rows that it does not hold stay where they are, for one more reading of ``rows``: the right
    choice for wide rows of a table, not for rows that are costly to make. Eight bits for each
    text that occurs again leave one other row in eight to move. Moved rows meet their winners
    by digest and order key, so those that pass the filter by chance are not lost.
    """
    digest = F.sha2(F.to_json(F.struct(*on)), 256) if len(on) > 1 else F.sha2(on[0].cast("string"), 256)
    missing = F.raise_error(F.lit(f"a row has no {order}")).cast(dict(rows.dtypes)[order])
    known = F.coalesce(F.col(order), missing)
    if bits is None:
        winners = rows.groupBy(digest.alias("_digest")).agg(F.min(known).alias(order)).select(order)
        return rows.join(winners, order, "left_semi")
    digested = rows.withColumn("_digest", F.coalesce(F.unhex(digest), F.lit(b"")))
    groups = digested.groupBy(F.col("_digest").alias("_group")).agg(
        F.min(known).alias("_first"), F.count(F.lit(1)).alias("_copies")
    )
    again = key_filter(groups.where("_copies > 1 and _first is not null"), F.col("_group"), bits)
    marked = marked_by(digested, F.col("_digest"), again, "_again", bits)
    winners = marked_by(groups.where("_copies > 0"), F.col("_group"), again, "_again", bits).where("_again")
    same = (F.col("_digest") == F.col("_group")) & (F.col(order) == F.col("_first"))
    moved = marked.where("_again").join(winners.select("_group", "_first"), same, "left_semi")
    return marked.where("not _again").unionByName(moved).select(*rows.columns)


def join_groups(rows: DataFrame, groups: DataFrame, key: Sequence[str], salts: int = 16) -> DataFrame:
    """Rows with the columns of their group, where one group may hold most rows.

    ``groups`` has one row per key and is small beside the rows; it is repeated per
    salt, so that the rows of one key meet it in several tasks. Equal rows of
    different partitions get different salts. Missing keys match each other.
    """
    salt = F.pmod(F.spark_partition_id() + F.hash(*rows.columns), F.lit(salts))
    repeated = groups.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names = {name: f"_of_{name}" for name in [*key, "_salt"]}
    salted, repeated = rows.withColumn("_salt", salt), repeated.withColumnsRenamed(names)
    same = [F.col(name).eqNullSafe(F.col(other)) for name, other in names.items()]
    joined = salted.join(repeated, reduce(lambda a, b: a & b, same)).drop("_salt", *names.values())
    return joined.select(*key, *[c for c in joined.columns if c not in key])


def in_bands(rows: DataFrame, level: str, bands: dict[str, Sequence[str]]) -> DataFrame:
    """One row per band that admits the level; levels of no band fall out.

    A level may belong to several bands, so a row may appear in several.
    """
    label = T.normal_level(F.col(level))
    admitted = F.array(*[F.when(label.isin(list(levels)), F.lit(b)) for b, levels in bands.items()])
    return (
        rows.withColumn(level, label)
        .withColumn("band", F.explode(F.array_compact(admitted)))
    )


def in_groups(rows: DataFrame, group: str, values: Sequence[object] = ()) -> DataFrame:
    """Rows whose group, as text, is among the values; no values keeps all."""
    if not values:
        return rows
    return rows.where(F.col(group).cast("string").isin([str(v) for v in values]))


def between_words(rows: DataFrame, text: str, least: int, most: int | None = None) -> DataFrame:
    """Rows with a text of ``least`` to ``most`` words, both inclusive; adds ``word_count``."""
    counted = computed_once(rows, word_count=T.word_count(F.col(text)))
    kept = counted.where(F.col("word_count") >= least)
    return kept if most is None else kept.where(F.col("word_count") <= most)


def mapped_codes(rows: DataFrame, code: str, codes: DataFrame) -> DataFrame:
    """Rows with a known code, with its value; codes match exactly, untrimmed.

    ``codes`` is a short table of score codes, which Spark broadcasts if it is small.
    """
    return rows.join(codes.withColumnRenamed("code", code), code)
