import hashlib
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpora.functions.ordering import order_hash, value_bucket
from corpora.operators import selection, splits
from corpora.operators.hygiene import join_groups, keep_first, key_filter, marked_by, require_rows


def digest(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


def numbers(spark, n, partitions=5):
    return spark.range(0, n, 1, partitions).withColumnRenamed("id", "k")


@pytest.mark.parametrize("n", [0, 1, 7, 500])
def test_first_rows(spark, n):
    rows = numbers(spark, 500)
    order = order_hash(F.col("k"))
    got = {r.k for r in selection.first_rows(rows, order, lambda total: [F.lit(n)]).collect()}
    assert got == set(sorted(range(500), key=digest)[:n])


def test_cuts_per_group_with_one_huge_group(spark):
    rows = numbers(spark, 2000).withColumn("g", F.when(F.col("k") < 1500, "hot").otherwise((F.col("k") % 5).cast("string")))
    cuts = selection.cut_points(
        rows, order_hash(F.col("k")), lambda total: [F.floor(total / 2)], by=["g"]
    )
    for row in cuts.collect():
        members = sorted(
            digest(k) for k in range(2000) if ("hot" if k < 1500 else str(k % 5)) == row.g
        )
        assert row["at"] == members[len(members) // 2 - 1]


def test_order_does_not_depend_on_partitions(spark):
    picks = [
        {r.k for r in splits.random_rows(numbers(spark, 300, p), "k", 20).collect()} for p in (1, 9)
    ]
    assert picks[0] == picks[1] and len(picks[0]) == 20
    other = {r.k for r in splits.random_rows(numbers(spark, 300), "k", 20, seed=7).collect()}
    assert other != picks[0]


def ordered(spark, lengths):
    rows = [(f"{place:04x}", length) for place, length in enumerate(lengths)]
    return spark.createDataFrame(rows, "h string, length int")


@pytest.mark.parametrize(
    "lengths, cap, kept",
    [
        ([4, 5, 3, 1], 10, [4, 5]),  # the later 1 is not taken
        ([4, 5, 1], 10, [4, 5, 1]),
        ([4, 0, 5, -1, 3], 9, [4, 5]),
        ([11, 1], 10, []),
        ([4, 5, 3], 0, [4, 5, 3]),
        ([4, 5, 3], 1000, [4, 5, 3]),
    ],
)
def test_budget(spark, lengths, cap, kept):
    rows = ordered(spark, lengths)
    got = selection.within_budget(rows, F.col("h"), F.col("length"), cap).orderBy("h").collect()
    assert [r.length for r in got] == kept


def test_budget_against_brute_force(spark):
    rows = numbers(spark, 400).withColumn("length", F.col("k") % 17 + 1)
    got = selection.within_budget(rows, order_hash(F.col("k")), F.col("length"), 1000)
    expected, spent = set(), 0
    for k in sorted(range(400), key=digest):
        if spent + k % 17 + 1 > 1000:
            break
        spent += k % 17 + 1
        expected.add(k)
    assert {r.k for r in got.collect()} == expected


def test_numbers_follow_the_key(spark):
    rows = numbers(spark, 300).withColumn("k", F.col("k") * F.col("k"))
    got = selection.numbered_by_key(rows, "k", "n").collect()
    assert {(r.k, r.n) for r in got} == {(k * k, k + 1) for k in range(300)}


def test_numbers_with_uneven_keys(spark):
    keys = [-(10**15), *range(400), *range(10**12, 10**12 + 300), 10**18]
    rows = spark.createDataFrame([(k,) for k in reversed(keys)], "k bigint")
    got = selection.numbered_by_key(rows, "k", "n").collect()
    assert {(r.k, r.n) for r in got} == {(k, i) for i, k in enumerate(keys, start=1)}


def test_buckets_are_monotone(spark):
    values = [-5.0, 0.0, 0.1, 3.0, 3.0, 19.99, 20.0, 99.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    b = [r[0] for r in rows.select(value_bucket(F.col("v"), F.lit(0), F.lit(20))).collect()]
    assert b == sorted(b)
    beyond = spark.range(10000).select((F.lit(21.0) + F.col("id") / 100).alias("v"))
    n = beyond.select(value_bucket(F.col("v"), F.lit(0), F.lit(20))).distinct().count()
    assert n > 100


def test_three_way_split_by_group(spark):
    rows = numbers(spark, 1000).withColumn(
        "script", F.when(F.col("k") < 333, "hot").otherwise((F.col("k") % 97).cast("string"))
    )
    split = splits.three_way_split(rows, "script", grouped=True).collect()
    of = {}
    for row in split:
        assert of.setdefault(row.script, row.split) == row.split
    sizes = Counter(of.values())
    total = len(of)
    test = math.ceil(0.15 * total)
    assert sizes["test"] == test and sizes["dev"] == math.ceil(0.1765 * (total - test))
    assert len(split) == 1000
    leaks = splits.leakage(splits.three_way_split(rows, "script", True), "script").collect()
    assert [r.shared for r in leaks] == [0, 0, 0]


def test_leakage_is_found(spark):
    rows = spark.createDataFrame(
        [("a", "train"), ("a", "dev"), ("b", "dev"), ("b", "test"), ("c", "dev"), ("c", "train")],
        "key string, split string",
    )
    found = {(r.split_a, r.split_b): r.shared for r in splits.leakage(rows, "key").collect()}
    assert found == {("train", "dev"): 2, ("train", "test"): 0, ("dev", "test"): 1}


def test_subsets_are_nested_and_share_the_evaluation_part(spark):
    rows = numbers(spark, 333)
    quarter, half, whole = (
        splits.eval_and_subsets(rows, "k", [f]).collect() for f in (0.25, 0.5, 1.0)
    )
    held = [{r.k for r in part if r.part == "eval"} for part in (quarter, half, whole)]
    taken = [{r.k for r in part if r.subset is not None} for part in (quarter, half, whole)]
    assert held[0] == held[1] == held[2] and len(held[0]) == math.ceil(0.05 * 333)
    assert taken[0] < taken[1] < taken[2]
    pool = 333 - len(held[0])
    assert [len(t) for t in taken] == [pool // 4, pool // 2, pool]
    assert not taken[2] & held[0]
    with pytest.raises(ValueError):
        splits.eval_and_subsets(rows, "k", [0.0])
    with pytest.raises(ValueError):
        splits.eval_and_subsets(rows, "k", [1.5])


def test_few_shot_modes(spark):
    rows = numbers(spark, 100).withColumn("label", F.col("k") % 4)
    sample = splits.few_shot_sample(rows, "k", "label", 50).collect()
    assert {r.mode for r in sample} == {"stratified"}
    assert sorted(Counter(r.label for r in sample).values()) == [12, 12, 13, 13]
    assert len({r.k for r in sample}) == 50
    assert {r["mode"] for r in splits.few_shot_sample(rows, "k", "label", 100).collect()} == {"all"}
    assert splits.few_shot_sample(rows, "k", "label", 500).count() == 100
    for n, why in ((3, "fewer rows than classes"), (97, "too few rows left")):
        drawn = splits.few_shot_sample(rows, "k", "label", n).collect()
        assert {r.mode for r in drawn} == {"random"} and len(drawn) == n, why
    lonely = rows.withColumn("label", F.when(F.col("k") == 5, -1).otherwise(F.col("label")))
    drawn = splits.few_shot_sample(lonely, "k", "label", 50).collect()
    assert {r.mode for r in drawn} == {"random"} and len(drawn) == 50
    plain = splits.few_shot_sample(rows, "k", "label", 50, stratify=False).collect()
    assert {r.mode for r in plain} == {"random"} and len(plain) == 50


def test_few_shot_with_a_hot_class(spark):
    rows = numbers(spark, 3000).withColumn("label", F.when(F.col("k") < 2000, 0).otherwise(F.col("k") % 9 + 1))
    sample = splits.few_shot_samples(rows, "k", "label", [50, 200]).collect()
    for n in (50, 200):
        classes = Counter(r.label for r in sample if r.shots == n)
        assert sum(classes.values()) == n
        assert abs(classes[0] - n * 2 / 3) < 1


@pytest.mark.parametrize("bits", [None, 1 << 20])
def test_keep_first_needs_order_keys(spark, bits):
    rows = spark.createDataFrame([(1, "a"), (None, "b")], "k int, t string")
    with pytest.raises(Exception, match="a row has no k"):
        keep_first(rows, [F.col("t")], "k", bits).collect()


def test_rows_without_a_label_are_drawn(spark):
    rows = spark.createDataFrame([(i, None if i % 5 == 0 else "xy"[i % 2]) for i in range(500)], "k int, label string")
    sample = splits.few_shot_sample(rows, "k", "label", 100).collect()
    assert len(sample) == 100 and sum(r.label is None for r in sample) == 20


def test_keep_first(spark):
    rows = spark.createDataFrame(
        [(3, "x"), (1, "x"), (2, "y"), (5, None), (4, None), (6, "x ")], "k int, t string"
    )
    assert {r.k for r in keep_first(rows, [F.col("t")], "k").collect()} == {1, 2, 4, 6}
    both = keep_first(rows, [F.col("t"), F.lit(1)], "k")
    assert {r.k for r in both.collect()} == {1, 2, 4, 6}


@pytest.mark.parametrize("bits", [1, 64, 1 << 20])
def test_keep_first_whatever_the_filter_lets_pass(spark, bits):
    rows = [(i, f"t{i % 70}" if i % 3 else f"u{i}") for i in range(400)] + [(500, None), (501, None), (7, "t7")]
    got = keep_first(spark.createDataFrame(rows, "k int, t string"), [F.col("t")], "k", bits).collect()
    least = {}
    for k, t in rows:
        least[t] = min(k, least.get(t, k))
    assert sorted(r.k for r in got) == sorted(k for k, t in rows if least[t] == k)
    empty = spark.createDataFrame([], "k int, t string")
    assert keep_first(empty, [F.col("t")], "k", bits).count() == 0


def test_a_filter_holds_its_keys(spark):
    keys = spark.range(3000).select((F.col("id") * 7919).alias("v"))
    pages = key_filter(keys, F.col("v"), 1 << 18)
    marked = marked_by(spark.range(7919 * 50).withColumnRenamed("id", "v"), F.col("v"), pages, "m", 1 << 18)
    held, passed = marked.where("v % 7919 = 0 and m").count(), marked.where("v % 7919 <> 0 and m").count()
    assert held == 50 and passed < 0.03 * 7919 * 50
    assert pages.agg(F.max(F.length("_bits"))).collect()[0][0] == 4096 and pages.count() <= (1 << 18) / 32768 + 1


def test_texts_that_occur_once_stay_where_they_are(spark, tmp_path):
    made = [(i, f"text {i if i > 20 else 0}", "wide " * 50) for i in range(600)]
    spark.createDataFrame(made, "k int, t string, w string").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    kept = keep_first(rows, [F.col("t")], "k", 1 << 20)
    assert {r.k for r in kept.collect()} == {0, *range(21, 600)}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    lines = plan[plan.index("Union"):].splitlines()
    semi = next(i for i, line in enumerate(lines) if "LeftSemi" in line)
    # of the first branch only the filter's pages are exchanged: the rows' own side has none
    own = next(i for i, line in enumerate(lines) if "BroadcastExchange" in line)
    assert own < semi and not any("Exchange" in line for line in lines[:own])
    assert any("w#" in line and "FileScan" in line for line in lines[:own])
    assert any("Exchange hashpartitioning(_digest" in line for line in lines[semi:])


def test_row_guard(spark):
    assert require_rows(numbers(spark, 5), 5) is not None
    with pytest.raises(ValueError, match="too few texts: 5"):
        require_rows(numbers(spark, 5), 6, "texts")


def test_rows_without_a_key_are_not_lost(spark):
    rows = spark.createDataFrame([("a", 1), (None, 2)], "k string, v int")
    with pytest.raises(Exception, match="no k to be numbered by"):
        selection.numbered_by_key(rows, "k", "n").collect()
    groups = spark.createDataFrame([("a", 10), (None, 20)], "k string, w int")
    joined = join_groups(rows, groups, ["k"])
    assert joined.columns == ["k", "v", "w"] and {tuple(r) for r in joined.collect()} == {("a", 1, 10), (None, 2, 20)}
