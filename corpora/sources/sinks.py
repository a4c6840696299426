"""Writers for splits, reports, metrics and predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


# White space at the ends of texts is part of them.
_CSV = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_parts(
    df: DataFrame,
    path: str,
    by: str | Sequence[str],
    format: str = "parquet",
    balanced: bool = False,
    rows_per_file: int = 0,
) -> str:
    """One folder per value of ``by``: splits, bands or subsets. Returns the path.

    Rows are not shuffled: a large part is written by many tasks, and a small one too. ``balanced``
    brings the rows of a value together first, by one shuffle; parts beyond the session's advisory
    partition size are split again, so each folder gets as many files as its size needs.
    ``rows_per_file`` bounds the rows of a file.
    """
    by = [by] if isinstance(by, str) else list(by)
    if balanced:
        df = df.hint("rebalance", *by)
    writer = df.write.mode("overwrite").partitionBy(*by)
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    if format == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(format).save(path)
    return path


def write_table(df: DataFrame, path: str, format: str = "parquet") -> str:
    """One table, ``parquet``, ``csv`` with a header, or ``json``."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.options(**_CSV).csv(path)
    else:
        writer.format(format).save(path)
    return path


def write_runs(preds: DataFrame, root: str) -> str:
    """Predictions ``(run, gold, pred)`` as ``<root>/run=<run>/test_predictions.csv``."""
    named = preds.select("run", F.lit("test_predictions.csv").alias("file"), "gold", "pred")
    return write_parts(named, root, ["run", "file"], "csv", balanced=True)


def write_run_metrics(
    report: DataFrame, root: str, metrics: Sequence[str], prefix: str = "eval"
) -> str:
    """Metrics of ``(run, split, ...)`` as ``<root>/run=<run>/file=<split>_metrics.json``.

    Each file holds one object whose names carry the prefix.
    """
    named = F.struct(*[F.col(name).alias(f"{prefix}_{name}") for name in metrics])
    file = F.concat("split", F.lit("_metrics.json"))
    body = report.select("run", file.alias("file"), F.to_json(named).alias("value"))
    return write_parts(body, root, ["run", "file"], "text", balanced=True)
