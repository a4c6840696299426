"""Saved runs: metrics recomputed from predictions, and transfer by calibration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.functions.scores import SCALES, Scale
from corpora.operators.metrics import score_metrics
from corpora.operators.modelling import line_columns, on_line
from corpora.operators.splits import few_shot_samples
from corpora.session import materialize
from corpora.sources.runs import run_dimensions


def run_metrics(preds: DataFrame) -> DataFrame:
    """Metrics of each run, split and target on the target's scale, with dimensions.

    ``preds`` are :func:`corpora.sources.runs.read_run_predictions`. Runs of all
    targets are scored in one pass.
    """
    report = score_metrics(preds, ["run_id", "split", "target"], ("target", SCALES))
    return run_dimensions(report)


def calibrated_transfer(
    preds: DataFrame,
    key: str,
    scale: Scale,
    shots: Sequence[int] = (50, 100, 200),
    seed: int = 42,
) -> DataFrame:
    """Metrics of source-scale predictions after calibration on ``n`` target rows.

    ``preds`` holds ``(key, gold, pred)`` with predictions on the source scale. For
    each number of shots a stratified sample fits the line; all rows are scored. The
    lines, one per number of shots, reach the rows as one scalar, without a join.
    """
    base = materialize(preds.select(key, "gold", "pred"), "transfer")
    sampled = few_shot_samples(base, key, "gold", shots, seed)
    lines = sampled.groupBy("shots").agg(*line_columns())
    entries = F.collect_list(F.struct("shots", F.struct("slope", "intercept", "mean")))
    known = lines.agg(F.map_from_entries(entries)).scalar()
    moved = [
        F.struct(F.lit(n).alias("shots"), on_line(F.col("pred"), F.element_at("_lines", F.lit(n))).alias("pred"))
        for n in shots
    ]
    repeated = base.withColumn("_lines", known).select("gold", F.inline(F.array(*moved)))
    return score_metrics(repeated.where("pred is not null"), ["shots"], scale)
