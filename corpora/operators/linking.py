"""Joining analyser output back to documents and their metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.operators.hygiene import keep_first
from corpora.operators.selection import numbered_by_key

# Names under which analysers report the analysed file.
FILE_COLUMNS = [
    "Filename", "filename", "File", "file", "Filepath", "filepath",
    "Path", "path", "Source", "source",
]


def file_column(features: DataFrame) -> str | None:
    """The column that names the analysed file, if there is one."""
    return next((name for name in FILE_COLUMNS if name in features.columns), None)


def link_by_file(features: DataFrame, files: DataFrame) -> DataFrame:
    """Features with the ``doc_id`` of their file, matched on the base name.

    ``files`` holds one row ``(doc_id, temp_filename)`` per document. Features
    without a known file keep a NULL ``doc_id``. A file name on many feature rows is
    left to the skew handling of adaptive execution: only the side of the features
    can repeat a key, and a left join may split that side.
    """
    column = file_column(features)
    if column is None:
        raise ValueError(f"no file column among {features.columns}")
    named = features.withColumn("temp_filename", T.base_name(F.col(column)))
    return named.join(files.select("doc_id", "temp_filename"), "temp_filename", "left")


def link_by_position(features: DataFrame, files: DataFrame, feature_key: str, file_key: str) -> DataFrame:
    """Features with the ``doc_id`` of the file at the same place.

    Both sides are numbered by an explicit unique key. Files beyond the number of
    features stay out; features without a file fail when the result is read.
    """
    left = numbered_by_key(features, feature_key, "_position")
    keyed = files.select("doc_id", F.col(file_key).alias("_key"))
    right = numbered_by_key(keyed, "_key", "_position").drop("_key").withColumn("_found", F.lit(True))
    lost = F.raise_error(F.concat(F.lit("no file for the feature at place "), F.col("_position").cast("string")))
    linked = left.join(right, "_position", "left")
    known = F.when(F.col("_found"), F.col("doc_id")).otherwise(lost.cast(dict(files.dtypes)["doc_id"]))
    return linked.withColumn("doc_id", known).drop("_position", "_found")


def with_metadata(
    features: DataFrame, documents: DataFrame, order: str, drop: Sequence[str] = ("text", "word_count")
) -> DataFrame:
    """Features with the metadata of the first document of their id, id first."""
    metadata = keep_first(documents, [F.col("doc_id")], order).drop(*drop)
    merged = features.join(metadata, "doc_id", "left")
    return merged.select("doc_id", *[c for c in merged.columns if c != "doc_id"])
