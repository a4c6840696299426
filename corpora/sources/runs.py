"""Saved scoring runs as a data source: metrics, predictions and their dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.session import materialize


def run_path(path: Column) -> Column:
    """Decoded path; folders of the form ``key=value`` count as ``value``.

    Spark escapes the values of such folders, so they are decoded once more.
    """
    key = r"/[a-z_]+="
    plain = T.decoded_path(path)
    return F.when(plain.rlike(key), F.regexp_replace(T.decoded_path(plain), key, "/")).otherwise(plain)


def run_place(path: Column, root: str = "runs") -> tuple[Column, Column]:
    """Run (its folder below the root) and split of a file of a saved run."""
    full = run_path(path)
    file = r"/(dev|test)_(?:metrics\.json|predictions\.csv)(?:/.*)?$"
    run = F.regexp_extract(full, rf"(?:^|/){root}/(.*?){file}", 1)
    split = F.regexp_extract(full, file, 1)
    return run, F.when(split != "", split)


def _part(source: Column, pattern: str) -> Column:
    found = F.regexp_extract(source, pattern, 1)
    return F.when(found != "", found)


def _direction(run: Column) -> Column:
    return _part(run, r"([A-Z]+-_?[A-Z]+)(?:/|$)")


def _leaf(run: Column) -> Column:
    return F.lower(F.substring_index(run, "/", -1))


def _single_corpus(run: Column) -> Column:
    """Corpus of a run that is trained and tested on the same one."""
    return F.upper(F.coalesce(_part(run, r"/(FCE|IELTS)/"), _part(_leaf(run), "^(fce|ielts)_")))


def run_target(run: Column) -> Column:
    """Corpus whose scores a run predicts."""
    return F.coalesce(_part(_direction(run), r"-_?([A-Z]+)$"), _single_corpus(run))


def run_dimensions(rows: DataFrame, run: str = "run_id") -> DataFrame:
    """Adds what the place of a run in the tree tells.

    ``experiment``, ``source`` and ``target`` corpus, ``model``, ``adapted``,
    ``shots`` and ``band``. A dimension that a layout lacks is NULL.
    """
    place, leaf = F.col(run), _leaf(F.col(run))
    direction = _direction(place)
    band = F.upper(_part(leaf, r"(?:^|_)([abc][12][abc][12])(?:_|$)"))
    model = F.regexp_replace(_part(leaf, "(roberta|distill?bert|bert)"), "distillbert", "distilbert")
    experiment = (
        F.when(place.startswith("Ablation"), F.lit("ablation"))
        .when(place.startswith("Transfer"), F.lit("transfer"))
        .otherwise(F.lit("in-domain"))
    )
    return rows.withColumns(
        {
            "experiment": experiment,
            "source": F.coalesce(_part(direction, r"^([A-Z]+)-"), _single_corpus(place)),
            "target": run_target(place),
            "model": model,
            "adapted": (F.instr(leaf, "dapt") > 0) | band.isNotNull(),
            "shots": F.when(direction.isNotNull(), _part(leaf, r"_(\d+)$").cast("int")),
            "band": band,
        }
    )


def long_metric_rows(files: DataFrame) -> DataFrame:
    """``(path, metric, value)`` from ``(path, value)`` with one JSON object per row.

    A prefix eval, dev or test of a metric name is dropped; the split follows from
    the file name.
    """
    entries = F.explode(F.from_json("value", "map<string,double>")).alias("_name", "_value")
    return files.select("path", entries).select(
        "path",
        F.regexp_replace("_name", "^(eval|dev|test)_", "").alias("metric"),
        F.col("_value").alias("value"),
    )


def read_run_metrics(spark: SparkSession, root: str, files: str = "*_metrics.json") -> DataFrame:
    """Metrics of all runs under a folder, long, with their dimensions; one scan."""
    found = (
        spark.read.options(recursiveFileLookup=True, pathGlobFilter=files)
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    run, split = run_place(F.col("path"))
    rows = long_metric_rows(found).select(run.alias("run_id"), split.alias("split"), "metric", "value")
    return run_dimensions(rows)


def run_files(spark: SparkSession, root: str, files: str) -> DataFrame:
    """``(file, run_id, split, target)``, a row for each file of saved runs, written once.

    Only names are listed. What a path tells is worked out here, once for each file.
    """
    listed = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=files)
    file = F.col("_metadata.file_path")
    run, split = run_place(file)
    placed = listed.load(root).select(file.alias("file"), run.alias("run_id"), split.alias("split"))
    return materialize(placed.withColumn("target", run_target(F.col("run_id"))), "run-files")


def read_run_predictions(
    spark: SparkSession, root: str, files: str = "*_predictions.csv"
) -> DataFrame:
    """Predictions of all runs under a folder: ``(run_id, split, target, gold, pred)``.

    Rows meet the table of files by the name of theirs.
    """
    reader = spark.read.schema("gold double, pred double").options(
        header=True, recursiveFileLookup=True, pathGlobFilter=files
    )
    rows = reader.csv(root).select(F.col("_metadata.file_path").alias("file"), "gold", "pred")
    return rows.join(run_files(spark, root, files), "file").select("run_id", "split", "target", "gold", "pred")
