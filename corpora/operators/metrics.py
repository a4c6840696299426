"""Agreement between gold and predicted scores, per run."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.functions.ordering import value_bucket
from corpora.functions.scores import Scale, class_index
from corpora.operators.hygiene import join_groups
from corpora.session import materialize

Bounds = tuple[Column, Column]


# One scale for all rows, or a column with the scale that each of its values stands for.
ScaleChoice = Scale | tuple[str | Column, dict[str, Scale]]


def _choose(scales: ScaleChoice, column: Callable[[Scale], Column]) -> Column:
    """A column that depends on the scale of a row."""
    if isinstance(scales, Scale):
        return column(scales)
    name, known = scales
    return F.coalesce(*[F.when(name == value, column(scale)) for value, scale in known.items()])


def error_columns(gold: Column, pred: Column) -> list[Column]:
    """Aggregates for any ``groupBy``: rows with both scores, their RMSE and Pearson."""
    both = gold.isNotNull() & pred.isNotNull()
    gold, pred = F.when(both, gold), F.when(both, pred)
    deviation = F.stddev_pop(gold) * F.stddev_pop(pred)
    pearson = F.when(deviation > 0, F.covar_pop(gold, pred) / deviation)
    return [
        F.count(gold).alias("n"),
        F.sqrt(F.avg((gold - pred) * (gold - pred))).alias("rmse"),
        pearson.alias("pearson"),
    ]


def pair_errors(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """:func:`error_columns` per group of :func:`score_pairs`: ``(*by, n, rmse, pearson)``.

    The moments are taken around each group's means, which come first, so scores far
    from zero lose no digits.
    """
    by, n = list(by), F.col("n")

    def mean(value: Column) -> Column:
        return F.sum(n * value) / F.sum(n)

    sides = [F.col(c).cast("double") for c in ("gold", "pred")]
    centres = pairs.groupBy(*by).agg(mean(sides[0]).alias("_gold"), mean(sides[1]).alias("_pred"))
    centred = join_groups(pairs, centres, by)
    gold, pred = sides[0] - F.col("_gold"), sides[1] - F.col("_pred")
    # what rounding of the means leaves over
    spread = [F.greatest(mean(x * x) - mean(x) * mean(x), F.lit(0.0)) for x in (gold, pred)]
    constant = (F.min("gold") == F.max("gold")) | (F.min("pred") == F.max("pred"))
    deviation = F.sqrt(spread[0]) * F.sqrt(spread[1])
    covariance = mean(gold * pred) - mean(gold) * mean(pred)
    gap = sides[0] - sides[1]
    return centred.groupBy(*by).agg(
        F.sum(n).alias("n"),
        F.sqrt(mean(gap * gap)).alias("rmse"),
        F.when(~constant & (deviation > 0), covariance / deviation).alias("pearson"),
    )


def centred_ranks(
    counts: DataFrame, by: Sequence[str], value: str, name: str, bounds: Bounds | None = None
) -> DataFrame:
    """Average rank of each distinct value per group, minus the mean rank.

    ``counts`` holds ``(*by, value, n)`` with one row per distinct value. Values go
    to monotone buckets, so even the values of one huge group are ordered in many
    tasks; a bucket's rows before it come from a table of bucket sums. ``bounds``
    are the ends between which most values lie; they default to the group's own 5th and
    95th percentile, which no outlier moves.
    """
    by = list(by)
    if bounds is None:
        middle = F.percentile_approx(value, [0.05, 0.95], 1000).alias("_ends")
        ends = counts.groupBy(*by).agg(middle).select(
            *by, F.col("_ends")[0].alias("_low"), F.col("_ends")[1].alias("_high")
        )
        counts = join_groups(counts, ends, by)
        bounds = F.col("_low"), F.col("_high")
    placed = counts.withColumn("_bucket", value_bucket(F.col(value), *bounds))
    group = Window.partitionBy(*by)
    running = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        placed.groupBy(*by, "_bucket")
        .agg(F.sum("n").alias("_in_bucket"))
        .select(
            *by,
            "_bucket",
            (F.sum("_in_bucket").over(running) - F.col("_in_bucket")).alias("_before"),
            F.sum("_in_bucket").over(group).alias("_total"),
        )
    )
    inside = Window.partitionBy(*by, "_bucket").orderBy(value)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.col("_before") + F.col("_inside")
    # mean of ranks upto-n+1 .. upto, minus (total + 1) / 2
    centred = upto.cast("double") - (F.col("n") + F.col("_total")) / F.lit(2.0)
    return (
        placed.withColumn("_inside", F.sum("n").over(inside))
        .join(buckets, [*by, "_bucket"])
        .select(*by, value, centred.alias(name))
    )


def score_pairs(preds: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows per distinct pair of scores: ``(*by, gold, pred, n)``.

    The one shuffle that depends on the number of rows; ties collapse before it.
    """
    return preds.groupBy(*by, "gold", "pred").agg(F.count(F.lit(1)).alias("n"))


def _as_one_key(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """``pairs`` with the group as one struct ``_by``, in which missing keys match each other."""
    return pairs.select(F.struct(*by).alias("_by"), "gold", "pred", "n")


def rank_correlation(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spearman per group, ties at their average rank: ``(*by, spearman)``.

    ``pairs`` are :func:`score_pairs`. NULL when one side is constant. A missing key is
    a group of its own.
    """
    return _rank_correlation(_as_one_key(pairs, by), ["_by"]).select("_by.*", "spearman")


def _rank_correlation(
    pairs: DataFrame, by: Sequence[str], bounds: Bounds | None = None
) -> DataFrame:
    by = list(by)

    def ranks(side: str) -> DataFrame:
        values = pairs.groupBy(*by, side).agg(F.sum("n").alias("n"))
        return centred_ranks(values, by, side, f"_{side}", bounds)

    # Summed per gold score before that side is joined, so that a score which a third
    # of the rows share is one row when it meets its rank.
    n, rank = F.col("n"), F.col("_pred")
    per_gold = (
        pairs.join(ranks("pred"), [*by, "pred"])
        .groupBy(*by, "gold")
        .agg(
            F.sum("n").alias("n"),
            F.sum(n * rank).alias("_sum"),
            F.sum(n * rank * rank).alias("_squares"),
        )
        .join(ranks("gold"), [*by, "gold"])
    )
    gold = F.col("_gold")
    scale = F.sqrt(F.sum(n * gold * gold)) * F.sqrt(F.sum("_squares"))
    spearman = F.when(scale > 0, F.sum(gold * F.col("_sum")) / scale)
    return per_gold.groupBy(*by).agg(spearman.alias("spearman"))


def confusion(pairs: DataFrame, by: Sequence[str], scales: ScaleChoice) -> DataFrame:
    """Rows per pair of class indexes: ``(*by, a, b, n)``, at most classes squared."""

    def index(score: str) -> Column:
        return _choose(scales, lambda scale: class_index(F.col(score), scale))

    return (
        pairs.select(*by, index("gold").alias("a"), index("pred").alias("b"), "n")
        .groupBy(*by, "a", "b")
        .agg(F.sum("n").alias("n"))
    )


def quadratic_kappa(
    pairs: DataFrame, by: Sequence[str], scales: ScaleChoice, index: str = "compact"
) -> DataFrame:
    """Quadratic weighted kappa per group: ``(*by, qwk)``.

    ``pairs`` are :func:`score_pairs`. Weights are squared differences of class
    indexes. ``compact`` numbers only the classes that occur in the group, ``fixed``
    all classes of the scale. NULL when only one class occurs. A missing key is a
    group of its own.
    """
    if not isinstance(scales, Scale):
        name, known = scales
        scales = (F.col("_by")[name] if isinstance(name, str) else name, known)
        if not isinstance(name := scales[0], Column):
            raise TypeError("a scale is chosen by a key column")
    keyed = _quadratic_kappa(_as_one_key(pairs, by), ["_by"], scales, index)
    return keyed.select("_by.*", "qwk")


def _quadratic_kappa(
    pairs: DataFrame, by: Sequence[str], scales: ScaleChoice, index: str = "compact"
) -> DataFrame:
    if index not in ("compact", "fixed"):
        raise ValueError(f"index must be 'compact' or 'fixed', got {index!r}")
    cells = confusion(pairs, by, scales)
    if index == "compact":
        # A group has at most classes squared cells, whatever the number of rows.
        group = Window.partitionBy(*by)
        occurring = F.array_sort(
            F.array_union(F.collect_set("a").over(group), F.collect_set("b").over(group))
        )
        cells = cells.withColumn("_classes", occurring).withColumns(
            {
                "a": F.array_position("_classes", F.col("a")),
                "b": F.array_position("_classes", F.col("b")),
            }
        )
    # Whole decimals: exact, and wide enough for the product of two sums over all rows.
    n, a, b = (F.col(c).cast("decimal(19,0)") for c in ("n", "a", "b"))

    def over_all(value: Column) -> Column:
        return F.sum(value.cast("decimal(27,0)")).cast("decimal(27,0)")

    total, of_a, of_b = (over_all(x).cast("decimal(19,0)") for x in (n, n * a, n * b))
    observed = over_all(n * (a - b) * (a - b)).cast("decimal(19,0)") * total
    expected = over_all(n * (a * a + b * b)).cast("decimal(19,0)") * total - 2 * (of_a * of_b)
    share = observed.cast("double") / expected.cast("double")
    return cells.groupBy(*by).agg(F.when(expected != 0, 1 - share).alias("qwk"))


def score_metrics(
    preds: DataFrame,
    by: Sequence[str],
    scales: ScaleChoice | None,
    index: str = "compact",
    undefined: float | None = None,
) -> DataFrame:
    """One row per run: ``n, rmse, pearson, spearman`` and, with a scale, ``qwk``.

    ``preds`` holds ``(*by, gold, pred)`` on the raw score scale; rows without one
    of the scores do not count. ``undefined`` replaces correlations that do not
    exist.
    """
    # The keys travel as one struct, in which missing keys match each other.
    key = ["_run"]
    whole = preds.dropna(subset=["gold", "pred"]).select(F.struct(*by).alias("_run"), "gold", "pred")
    # All measures follow from the counted pairs. They are written, so the rows are read and shuffled
    # once, and what their keys were made of is in no later plan.
    pairs = materialize(score_pairs(whole, key), "score-pairs")
    errors = pair_errors(pairs, key)
    bounds = None
    if scales is not None:
        if not isinstance(scales, Scale):
            name, known = scales
            scales = (F.col("_run")[name], known)
        ends = [_choose(scales, lambda scale, e=e: F.lit(getattr(scale, e))) for e in ("low", "high")]
        bounds = (ends[0], ends[1])
    report = errors.join(_rank_correlation(pairs, key, bounds), key)
    measures = ["n", "rmse", "pearson", "spearman"]
    if scales is not None:
        report = report.join(_quadratic_kappa(pairs, key, scales, index), key)
        measures.append("qwk")
    if undefined is not None:
        report = report.fillna(undefined, ["pearson", "spearman"])
    return report.select("_run.*", *measures)


def perplexity(loss: Column) -> Column:
    """``exp(loss)`` below 50, else NULL."""
    return F.when(loss < 50, F.exp(loss))


def best_checkpoint(metrics: DataFrame, run: str, step: str, rmse: str = "rmse") -> DataFrame:
    """The row of each run with the lowest RMSE; of equal ones the earliest step."""
    others = [c for c in metrics.columns if c not in (run, step, rmse)]
    best = F.min(F.struct(rmse, step, *others)).alias("_best")
    return metrics.where(F.col(rmse).isNotNull()).groupBy(run).agg(best).select(run, "_best.*")
