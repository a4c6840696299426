"""Score models: regression on document features or hashed text, and calibration between scales."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, SQLTransformer
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.functions.scores import Scale, denormalize, normalize
from corpora.operators.hygiene import join_groups
from corpora.operators.metrics import score_metrics
from corpora.session import materialize


def score_regression(
    essays: DataFrame,
    scale: Scale,
    score: str = "score",
    text: str = "text",
    strengths: Sequence[float] = (0.01, 0.1, 1.0),
    features: int = 1 << 10,
) -> DataFrame:
    """Fit on the train split, choose by dev RMSE, report dev and test metrics.

    ``essays`` holds ``split``, a text and a score. One row per split with the chosen
    ``strength`` of the penalty. Labels are shares of the score range while fitting.
    A fit is one pass over the vectors, so at most 4096 hashed features are taken.
    Without dev rows it fails when the result is read.
    """
    data = essays.select(
        "split",
        F.col(score).cast("double").alias("gold"),
        T.words(F.col(text)).alias("words"),
        normalize(F.col(score).cast("double"), scale).alias("label"),
    )
    prepare = Pipeline(
        stages=[
            HashingTF(inputCol="words", outputCol="counts", numFeatures=features),
            IDF(inputCol="counts", outputCol="features"),
            SQLTransformer(statement="SELECT split, gold, label, features FROM __THIS__"),
        ]
    )
    train = data.where(F.col("split") == "train")
    prepared = prepare.fit(train)
    # Every fit and every scoring reads the vectors; the texts are split into words once.
    every = materialize(prepared.transform(data), "vectors")
    vectors, held = every.where(F.col("split") == "train"), every.where(F.col("split") != "train")
    reports = None
    for strength in strengths:
        model = LinearRegression(regParam=strength, solver="normal").fit(vectors)
        scored = model.transform(held).select(
            "split",
            F.lit(float(strength)).alias("strength"),
            "gold",
            denormalize(F.col("prediction"), scale).alias("pred"),
        )
        reports = scored if reports is None else reports.unionByName(scored)
    metrics = score_metrics(materialize(reports, "scored"), ["strength", "split"], scale)
    chosen = metrics.where(F.col("split") == "dev").agg(
        F.min(F.struct("rmse", "strength")).alias("best")
    )
    missing = F.raise_error(F.lit("no dev rows to choose the penalty by")).cast("double")
    best = F.coalesce(chosen.select(F.col("best.strength")).scalar(), missing)
    return metrics.where(F.col("strength") == best)


@dataclass(frozen=True)
class Moments:
    """Rows, means and centred second moments of one split; the label is the last variable."""

    n: int
    means: np.ndarray
    covariance: np.ndarray


def split_moments(rows: DataFrame, features: Sequence[str], label: str) -> dict[str, Moments]:
    """Moments per ``split`` in one aggregation over the rows.

    Spark merges centred moments, so large values lose no digits. What reaches the driver is a
    row for each split, as wide as the square of the number of features. Rows that lack a feature
    or the label do not count.
    """
    names = [*features, label]
    places = range(len(names))
    whole = rows.select("split", *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(names)]).dropna()
    second = [F.covar_pop(f"v{i}", f"v{j}").alias(f"c{i}_{j}") for i in places for j in places if i <= j]
    summed = whole.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"v{i}").alias(f"m{i}") for i in places], *second)
    return {
        r["split"]: Moments(
            r["n"],
            np.array([r[f"m{i}"] for i in places]),
            np.array([[r[f"c{min(i, j)}_{max(i, j)}"] for j in places] for i in places]),
        )
        for r in summed.collect()
    }


@dataclass(frozen=True)
class LinearModel:
    """Weights of features and an intercept, fitted with a penalty of ``strength``."""

    features: tuple[str, ...]
    strength: float
    weights: np.ndarray
    intercept: float

    def predicted(self) -> Column:
        terms = [F.lit(float(w)) * F.col(c).cast("double") for c, w in zip(self.features, self.weights)]
        return sum(terms, F.lit(float(self.intercept)))

    def errors(self, held: Moments) -> tuple[float, float | None]:
        """RMSE and Pearson on a split, from its moments alone."""
        w, c = self.weights, held.covariance
        of_pred, both, of_label = w @ c[:-1, :-1] @ w, w @ c[:-1, -1], c[-1, -1]
        bias = held.means[-1] - self.intercept - w @ held.means[:-1]
        rmse = float(np.sqrt(max(of_label - 2 * both + of_pred, 0.0) + bias * bias))
        defined = of_pred > 0 and of_label > 0
        return rmse, float(both / np.sqrt(of_pred * of_label)) if defined else None


def ridge(train: Moments, features: Sequence[str], strength: float) -> LinearModel:
    """The line through the train split's means of least squares plus ``strength`` times the squared weights.

    Weights are penalised in standard deviations of their features; a feature without spread gets none.
    """
    c = train.covariance
    spread = np.sqrt(np.diag(c)[:-1])
    some = spread > 0
    scale = np.where(some, spread, 1.0)
    alike = np.where(np.outer(some, some), c[:-1, :-1] / np.outer(scale, scale), 0.0)
    alike[np.diag_indices_from(alike)] = 1.0 + strength
    weights = np.linalg.solve(alike, np.where(some, c[:-1, -1] / scale, 0.0)) / scale
    return LinearModel(tuple(features), strength, weights, float(train.means[-1] - weights @ train.means[:-1]))


def penalty_path(
    rows: DataFrame, features: Sequence[str], score: str = "score", strengths: Sequence[float] = (0.01, 0.1, 1.0)
) -> tuple[DataFrame, LinearModel]:
    """``(strength, split, n, rmse, pearson)`` for every penalty, and the model of least dev RMSE.

    ``rows`` hold ``split``, features and a score. They are read once, whatever the number of
    penalties: each model and its errors follow from the moments of the splits.
    """
    moments = split_moments(rows, features, score)
    for split in ("train", "dev"):
        if split not in moments:
            raise ValueError(f"no {split} rows to fit and choose the penalty by")
    models = [ridge(moments["train"], features, float(s)) for s in strengths]
    report = [(m.strength, split, held.n, *m.errors(held)) for m in models for split, held in sorted(moments.items())]
    best = min(models, key=lambda m: (m.errors(moments["dev"])[0], m.strength))
    kinds = "strength double, split string, n bigint, rmse double, pearson double"
    return rows.sparkSession.createDataFrame(report, kinds), best


def feature_regression(
    rows: DataFrame,
    features: Sequence[str],
    scale: Scale,
    score: str = "score",
    strengths: Sequence[float] = (0.01, 0.1, 1.0),
) -> DataFrame:
    """Metrics of the chosen model on the splits other than train: ``split, strength, n, rmse, pearson, spearman, qwk``.

    The rows are read twice: for the moments, and to score the held ones with the one model chosen.
    """
    _, model = penalty_path(rows, features, score, strengths)
    held = rows.where(F.col("split") != "train").dropna(subset=list(features))
    scored = held.select("split", F.col(score).cast("double").alias("gold"), F.round(model.predicted(), 6).alias("pred"))
    report = score_metrics(scored, ["split"], scale)
    return report.select("split", F.lit(model.strength).alias("strength"), "n", "rmse", "pearson", "spearman", "qwk")


def line_columns(gold: str = "gold", pred: str = "pred") -> list[Column]:
    """Aggregates: the line from predictions to gold scores, and the mean gold score."""
    return [
        F.regr_slope(gold, pred).alias("slope"),
        F.regr_intercept(gold, pred).alias("intercept"),
        F.avg(gold).alias("mean"),
    ]


def on_line(pred: Column, line: Column) -> Column:
    """A prediction moved along a line of :func:`line_columns`; without spread the mean."""
    return F.coalesce(line["slope"] * pred + line["intercept"], line["mean"])


def calibrate(shots: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Predictions moved to the gold scale by a line fitted per group on ``shots``.

    Both hold ``(*by, gold, pred)``; the fit is one aggregation with one row per
    group, which large groups meet in several tasks.
    Without spread among the shots the mean of their gold scores is predicted.
    """
    by = list(by)
    lines = shots.groupBy(*by).agg(*line_columns())
    lines = lines.select(*by, F.struct("slope", "intercept", "mean").alias("_line"))
    moved = on_line(F.col("pred"), F.col("_line"))
    return join_groups(rows, lines, by).withColumn("pred", moved).drop("_line")
