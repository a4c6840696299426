"""Fetching the texts of wanted documents without shuffling all texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the filter that is broadcast: one row each at most, whatever the data.
FILTER_BUCKETS = 1 << 20


def document_key(id: str, text: Column) -> Column:
    """A hash that tells rows apart by id and text; rows equal in both are one document."""
    return F.xxhash64(F.col(id), text)


def passing(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` whose ``key`` (a long) may be among the column ``key`` of ``wanted``.

    Keys are dealt to a fixed number of buckets, and the table of those that occur - a long for
    each of ``FILTER_BUCKETS`` at most - is broadcast. Some other rows pass too.
    """
    bucket = F.pmod(F.col(key), F.lit(FILTER_BUCKETS))
    buckets = wanted.select(bucket.alias("_bucket")).distinct()
    return rows.withColumn("_bucket", bucket).join(F.broadcast(buckets), "_bucket", "left_semi").drop("_bucket")


def texts_of(docs: DataFrame, wanted: DataFrame, id: str, text: str) -> DataFrame:
    """``k``, ``id`` and ``t`` (the text, empty for null) of the documents whose key is in ``wanted.k``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(document_key(id, body).alias("k"), F.col(id).alias("id"), body.alias("t"))
    passed = passing(rows, "k", wanted)
    return passed.join(wanted.select("k"), "k", "left_semi").dropDuplicates(["k"])
