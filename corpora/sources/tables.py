"""Tables from files: explicit columns, pandas-like missing values, clear errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpora.functions import text as T
from corpora.operators.hygiene import require_columns

# Cell texts that mean a missing value.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def missing_to_null(df: DataFrame) -> DataFrame:
    """Text cells that mean a missing value become NULL."""
    return df.select(
        *[
            F.when(~F.col(f"`{name}`").isin(MISSING), F.col(f"`{name}`")).alias(name)
            if kind == "string"
            else F.col(f"`{name}`")
            for name, kind in df.dtypes
        ]
    )


def read_csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: StructType | str | None = None,
    multi_line: bool = True,
    row_key: str | None = None,
    **options: object,
) -> DataFrame:
    """CSV with a header; quoted cells may hold line breaks and doubled quotes.

    Files whose header differs from the schema fail instead of shifting columns.
    ``multi_line=False`` lets large files without line breaks in cells be split.
    ``row_key`` names a column to add: a unique text that orders the rows by path and
    then by place in the file, whatever the partitions.
    """
    reader = spark.read.options(
        header=True, multiLine=multi_line, escape='"', enforceSchema=False, encoding="UTF-8", **options
    )
    if schema is not None:
        reader = reader.schema(schema)
    rows = reader.csv(paths if isinstance(paths, str) else list(paths))
    if row_key is None:
        return missing_to_null(rows)
    # A block of a file is read in order by one task, so ids rise within a block.
    places = [F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    padded = [F.lpad(place.cast("string"), 20, "0") for place in places]
    key = F.concat_ws("|", F.col("_metadata.file_path"), *padded)
    return missing_to_null(rows.select("*", key.alias(row_key)))


def read_table(
    spark: SparkSession, path: str, schema: StructType | str | None = None
) -> DataFrame:
    """One table by suffix: ``.csv`` or ``.parquet``, a file or a folder of that name."""
    plain = path.rstrip("/").lower()
    if plain.endswith(".csv"):
        return read_csv(spark, path, schema)
    if plain.endswith(".parquet"):
        reader = spark.read if schema is None else spark.read.schema(schema)
        return reader.parquet(path)
    raise ValueError(f"unsupported table {path!r}: a .csv or .parquet path is needed")


def spread(table: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores.

    Text work is bound by processor time, and a file with few row groups would leave
    cores idle. Input with enough partitions stays where it is: on large data this
    moves nothing.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table if table.rdd.getNumPartitions() >= cores else table.repartition(cores)


def union_tables(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows of all tables; a column a table lacks is NULL in its rows."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def text_column(table: DataFrame, text: str, min_length: int = 1) -> DataFrame:
    """Table with stripped texts of at least ``min_length`` characters."""
    require_columns(table, text)
    stripped = table.withColumn(text, T.strip(F.col(text).cast("string")))
    return stripped.where(F.length(text) >= max(1, min_length))


def read_text_columns(
    spark: SparkSession, paths: Sequence[str], text: str, min_length: int = 1
) -> DataFrame:
    """The text column of several tables as ``(path, text)``."""
    parts = [
        text_column(read_table(spark, path), text, min_length).select(
            F.lit(path).alias("path"), F.col(text).alias("text")
        )
        for path in paths
    ]
    return union_tables(*parts)


def labelled_texts(table: DataFrame, text: str, label: str) -> DataFrame:
    """``(text, label)`` as string and double, without rows that lack either."""
    require_columns(table, text, label)
    return (
        table.select(F.col(text).cast("string").alias("text"), F.col(label).cast("double").alias("label"))
        .dropna()
    )
