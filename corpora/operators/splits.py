"""Train/dev/test splits, nested subsets and samples, reproducible from a seed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.functions.ordering import order_hash
from corpora.operators.selection import cut_points, cuts_as_column, first_rows, up_to


def _share(fraction: float, total: Column) -> Column:
    return F.ceil(F.lit(float(fraction)) * total)


def three_way_split(
    rows: DataFrame,
    key: str,
    grouped: bool = False,
    test: float = 0.15,
    dev_of_rest: float = 0.1765,
    seed: int = 42,
    units: DataFrame | None = None,
) -> DataFrame:
    """Adds ``split``: test first, then dev out of the rest, the remainder train.

    With ``grouped`` the key is shared by several rows and all of them go to one
    split. Sizes round up, over groups or rows. Membership is a comparison of the
    key's hash with two cuts, so a group of any size needs no join. ``units`` is a narrow
    table of the keys of ``rows`` to find the cuts in, if these are costly to read twice.
    """

    def ranks(total: Column) -> list[Column]:
        first = _share(test, total)
        return [first, first + _share(dev_of_rest, total - first)]

    units = (rows if units is None else units).select(key)
    units = units.distinct() if grouped else units
    order = order_hash(F.col(key), seed=seed)
    cuts = cuts_as_column(cut_points(units, order, ranks))
    place, at = F.col("_order"), F.col("_cuts")
    split = (
        F.when(up_to(place, at, 0), F.lit("test"))
        .when(up_to(place, at, 1), F.lit("dev"))
        .otherwise(F.lit("train"))
    )
    ordered = rows.withColumns({"_order": order, "_cuts": cuts})
    return ordered.withColumn("split", split).drop("_order", "_cuts")


def leakage(rows: DataFrame, key: str) -> DataFrame:
    """Number of keys that two splits share, for the three pairs of splits.

    One row per key after the first aggregation; the pairs are then counted in
    place, without joining the splits.
    """
    pairs = [("train", "dev"), ("train", "test"), ("dev", "test")]
    flags = [F.max((F.col("split") == s).cast("int")).alias(s) for s in ("train", "dev", "test")]
    per_key = rows.groupBy(key).agg(*flags)
    shared = [F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs]
    entries = [
        F.struct(F.lit(a).alias("split_a"), F.lit(b).alias("split_b"), F.col(f"{a}_{b}").alias("shared"))
        for a, b in pairs
    ]
    return per_key.agg(*shared).select(F.inline(F.array(*entries)))


def eval_and_subsets(
    rows: DataFrame, key: str, fractions: Sequence[float], eval_share: float = 0.05, seed: int = 42
) -> DataFrame:
    """Adds ``part`` (eval or train) and ``subset``, the least fraction a row is in.

    All subsets are prefixes of one order, so a smaller one lies inside a larger
    one, and the evaluation part is the same for all. ``subset`` is NULL for
    evaluation rows and for training rows beyond the largest fraction.
    """
    fractions = sorted(fractions)
    for fraction in fractions:
        if not 0 < fraction <= 1:
            raise ValueError(f"a subset fraction must be in (0, 1], got {fraction}")

    def ranks(total: Column) -> list[Column]:
        held = _share(eval_share, total)
        pool = total - held
        sizes = [F.greatest(F.lit(1), F.floor(pool * F.lit(float(f)))) for f in fractions]
        return [held, *[held + size for size in sizes]]

    order = order_hash(F.col(key), seed=seed)
    cuts = cuts_as_column(cut_points(rows.select(key), order, ranks))
    held = up_to(F.col("_order"), F.col("_cuts"), 0)
    subset = F.lit(None).cast("double")
    for place, fraction in reversed(list(enumerate(fractions, start=1))):
        inside = up_to(F.col("_order"), F.col("_cuts"), place)
        subset = F.when(inside, F.lit(float(fraction))).otherwise(subset)
    columns = {
        "part": F.when(held, F.lit("eval")).otherwise(F.lit("train")),
        "subset": F.when(~held, subset),
    }
    ordered = rows.withColumns({"_order": order, "_cuts": cuts})
    return ordered.withColumns(columns).drop("_order", "_cuts")


def random_rows(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows in hash order, or all rows if there are no more."""
    order = order_hash(F.col(key), seed=seed)
    return first_rows(rows, order, lambda total: [F.least(F.lit(n).cast("bigint"), total)])


def _class_facts(sizes: DataFrame) -> Column:
    """Scalar ``(total, classes, least)`` of a table of class sizes."""
    facts = F.struct(
        F.sum("size").alias("total"), F.count(F.lit(1)).alias("classes"), F.min("size").alias("least")
    )
    return sizes.agg(facts.alias("facts")).scalar()


def _stratifiable(facts: Column, n: Column) -> Column:
    """Whether every class can be in a sample of ``n`` and in the rest."""
    fits = (facts["classes"] <= n) & (facts["total"] - n >= facts["classes"])
    return F.coalesce((facts["least"] >= 2) & fits, F.lit(False))


def class_quotas(rows: DataFrame, label: str, shots: Sequence[int]) -> DataFrame:
    """Share of each class in stratified samples: ``(shots, label, size, quota)``.

    Largest remainders get the rows that rounding down leaves; ties go to the
    smaller label. A sample size is absent when a stratified sample of it is
    impossible: a class with one member, or fewer sampled or remaining rows than
    classes. So a size never has more rows than itself, whatever the labels are.
    """
    sizes = rows.groupBy(label).agg(F.count(F.lit(1)).alias("size"))
    facts = _class_facts(sizes)
    n = F.explode(F.array(*[F.lit(int(s)) for s in shots]))
    wanted = sizes.withColumn("_facts", facts).withColumn("shots", n)
    wanted = wanted.where(_stratifiable(F.col("_facts"), F.col("shots")))
    exact = F.col("size") * F.col("shots").cast("double") / F.col("_facts.total")
    shares = wanted.withColumns({"floor": F.floor(exact), "remainder": exact - F.floor(exact)})
    sample = Window.partitionBy("shots")
    place = F.row_number().over(sample.orderBy(F.desc("remainder"), label))
    spare = F.col("shots") - F.sum("floor").over(sample)
    quota = F.col("floor") + F.when(place <= spare, 1).otherwise(0)
    return shares.select("shots", label, "size", quota.alias("quota"))


def few_shot_samples(
    rows: DataFrame,
    key: str,
    label: str,
    shots: Sequence[int],
    seed: int = 42,
    stratify: bool = True,
) -> DataFrame:
    """Samples of exactly ``shots`` rows each, classes in proportion.

    Adds ``shots`` and ``mode``: ``all`` when there are no more rows, ``stratified``
    where quotas exist, else ``random``. A row appears once per sample it is in. A
    class of any size is cut by rank and never gathered; all sizes share the passes.
    Rows without a label are a class of their own.
    """
    shots, columns = [int(n) for n in shots], rows.columns
    # In a struct missing labels match each other.
    rows, label = rows.withColumn("_label", F.struct(label)), "_label"
    order = order_hash(F.col(key), seed=seed)
    facts = _class_facts(rows.groupBy(label).agg(F.count(F.lit(1)).alias("size")))

    def sizes(total: Column) -> list[Column]:
        return [F.least(F.lit(n).cast("bigint"), total) for n in shots]

    plain = cuts_as_column(cut_points(rows.select(key), order, sizes))
    keyed = rows.withColumns({"_order": order, "_plain": plain, "_facts": facts})
    plain, facts = F.col("_plain"), F.col("_facts")
    if stratify:
        targets = class_quotas(rows, label, shots).select(
            label, F.col("shots").alias("cut"), F.col("quota").alias("rank")
        )
        cuts = cut_points(rows.select(key, label), order, targets, by=[label])
        per_class = cuts.groupBy(label).agg(
            F.map_from_entries(F.collect_list(F.struct("cut", "at"))).alias("_cuts")
        )
        # At most as many classes as the largest sample has rows, see class_quotas.
        keyed = keyed.join(F.broadcast(per_class), label, "left")
    samples = []
    for place, n in enumerate(shots):
        whole = facts["total"] <= n
        drawn = up_to(F.col("_order"), plain, place)
        mode = F.when(whole, F.lit("all")).otherwise(F.lit("random"))
        if stratify:
            possible = _stratifiable(facts, F.lit(n))
            in_class = F.col("_order") <= F.coalesce(F.element_at("_cuts", F.lit(n)), F.lit(""))
            mode = F.when(possible & ~whole, F.lit("stratified")).otherwise(mode)
            drawn = F.when(possible & ~whole, in_class).otherwise(drawn)
        samples.append(F.when(drawn, F.struct(F.lit(n).alias("shots"), mode.alias("mode"))))
    return keyed.select(*columns, F.inline(F.array_compact(F.array(*samples))))


def few_shot_sample(
    rows: DataFrame, key: str, label: str, n: int, seed: int = 42, stratify: bool = True
) -> DataFrame:
    """One sample of exactly ``n`` rows, see :func:`few_shot_samples`."""
    return few_shot_samples(rows, key, label, [n], seed, stratify).drop("shots")


def label_histogram(rows: DataFrame, label: str) -> DataFrame:
    """Rows per label, in label order."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(label)


def split_sizes(rows: DataFrame) -> DataFrame:
    """Rows and columns per split."""
    columns = len([c for c in rows.columns if c != "split"])
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")).withColumn(
        "n_columns", F.lit(columns)
    )
