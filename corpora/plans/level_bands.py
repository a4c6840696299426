"""A learner corpus cut into proficiency bands, with a size summary."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.operators.hygiene import in_bands, require_columns
from corpora.sources.sinks import write_parts, write_table

# The bands of the study. B2_C1 overlaps with two others.
BANDS = {
    "A1_A2": ("A1", "A2"),
    "B1_B2": ("B1", "B2"),
    "C1": ("C1",),
    "B2_C1": ("B2", "C1"),
}


def banded_corpus(
    texts: DataFrame,
    text: str = "text",
    level: str = "cefr",
    bands: dict[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Rows with text and level, once for each band that admits the level."""
    require_columns(texts, text, level)
    return in_bands(texts.dropna(subset=[text, level]), level, bands or BANDS)


def band_summary(
    banded: DataFrame,
    text: str = "text",
    bands: dict[str, Sequence[str]] | None = None,
    length_of: Callable[[Column], Column] = T.token_length,
    tokenizer: str = T.TOKENIZER,
) -> DataFrame:
    """Rows and tokens per band, in band order; an empty band has zeros."""
    names = list(bands or BANDS)
    spark = banded.sparkSession
    order = spark.createDataFrame(list(enumerate(names)), "place int, split string")
    lengths = banded.select("band", length_of(F.col(text)).alias("_length"))
    sizes = lengths.groupBy("band").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_length").alias("total_tokens")
    )
    zero = F.lit(0).cast("bigint")
    return (
        order.join(sizes, F.col("split") == F.col("band"), "left")
        .orderBy("place")
        .select(
            "split",
            F.coalesce("n_rows", zero).alias("n_rows"),
            F.coalesce("total_tokens", zero).alias("total_tokens"),
            F.lit(tokenizer).alias("tokenizer"),
        )
    )


def write_bands(banded: DataFrame, path: str, rows_per_file: int = 1_000_000, **summary: object) -> str:
    """A folder of rows for each band and the summary of all, under ``path``; returns it.

    The summary is made of the rows as written. ``summary`` are options of :func:`band_summary`.
    """
    rows = write_parts(banded, f"{path}/bands", "band", balanced=True, rows_per_file=rows_per_file)
    spark = banded.sparkSession
    write_table(band_summary(spark.read.parquet(rows), **summary), f"{path}/summary", "csv")
    return path


def read_bands(spark: SparkSession, path: str, bands: Sequence[str]) -> DataFrame:
    """The rows of some bands; folders of others are not read."""
    return spark.read.parquet(f"{path}/bands").where(F.col("band").isin(list(bands)))


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """The summary that :func:`write_bands` left."""
    kinds = "split string, n_rows bigint, total_tokens bigint, tokenizer string"
    return spark.read.schema(kinds).options(header=True, escape='"').csv(f"{path}/summary")
