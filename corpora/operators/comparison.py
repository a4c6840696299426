"""Comparison of many scoring runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_metrics(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """One row per run and metric: ``(*keys, metric, value)``."""
    return wide.unpivot(list(keys), list(metrics), "metric", "value")


def _of_one_run(which: Column, value: Column, by: Sequence[str]) -> Column:
    """Aggregate: the value of the one run that meets a condition; several fail."""
    several = F.raise_error(F.lit(f"several runs for one value of {list(by)}")).cast("double")
    return F.when(F.count_if(which) > 1, several).otherwise(F.max(F.when(which, value)))


def adapted_against_base(
    runs: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("rmse",), adapted: str = "adapted"
) -> DataFrame:
    """Adapted and base value of each metric side by side, with their difference.

    One row per group that has both kinds of run. A group with several runs of one
    kind fails: add the key that tells them apart. So does a run of which it is not
    known whether it is adapted.
    """
    unknown = F.raise_error(F.lit(f"a run has no {adapted} flag")).cast("boolean")
    runs = runs.withColumn(adapted, F.coalesce(F.col(adapted), unknown))
    columns = []
    for metric in metrics:
        with_it = _of_one_run(F.col(adapted), F.col(metric), by)
        without = _of_one_run(~F.col(adapted), F.col(metric), by)
        columns += [
            with_it.alias(f"adapted_{metric}"),
            without.alias(f"base_{metric}"),
            (with_it - without).alias(f"{metric}_change"),
        ]
    kinds = F.count_distinct(adapted).alias("_kinds")
    return runs.groupBy(*by).agg(*columns, kinds).where(F.col("_kinds") == 2).drop("_kinds")


def bands_against_base(
    runs: DataFrame,
    by: Sequence[str] = ("source", "target", "shots"),
    metrics: Sequence[str] = ("rmse",),
    model: str = "bert",
) -> DataFrame:
    """Runs adapted to one level band beside the base run with the same ``by``.

    Base runs lie in other experiments: those of ``model`` that are neither adapted nor
    of a band. Missing keys match each other. One row per group and band, with the band's
    value, the base value (NULL without a base run) and their difference; several runs
    for one of them fail.
    """
    group = F.struct(*by)
    of_band, is_base = F.col("band").isNotNull(), ~F.col("adapted") & (F.col("model") == model)
    bands = runs.where(of_band).groupBy(group.alias("_by"), "band").agg(
        *[_of_one_run(F.lit(True), F.col(m), [*by, "band"]).alias(f"adapted_{m}") for m in metrics]
    )
    base = runs.where(~of_band & is_base).groupBy(group.alias("_by")).agg(
        *[_of_one_run(F.lit(True), F.col(m), by).alias(f"base_{m}") for m in metrics]
    )
    sides = [(F.col(f"adapted_{m}"), F.col(f"base_{m}"), f"{m}_change") for m in metrics]
    measures = [x for a, b, name in sides for x in (a, b, (a - b).alias(name))]
    return bands.join(base, "_by", "left").select("_by.*", "band", *measures)


def transfer_grid(
    runs: DataFrame,
    by: Sequence[str],
    metric: str = "rmse",
    shots: Sequence[int] = (50, 100, 200),
) -> DataFrame:
    """One row per group, one column ``<metric>_<shots>`` per number of shots.

    A cell with several runs fails.
    """
    cells = [
        _of_one_run(F.col("shots") == n, F.col(metric), by).alias(f"{metric}_{n}") for n in shots
    ]
    return runs.groupBy(*by).agg(*cells)
