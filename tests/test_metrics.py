import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpora.functions import scores as S
from corpora.operators import comparison, metrics, modelling
from corpora.plans import run_comparison


def frame(spark, rows):
    return spark.createDataFrame(rows, "run string, gold double, pred double")


def kappa(a, b):
    classes = sorted({*a, *b})
    k = len(classes)
    observed = np.zeros((k, k))
    for x, y in zip(a, b):
        observed[classes.index(x), classes.index(y)] += 1
    expected = np.outer(observed.sum(1), observed.sum(0)) / len(a)
    weights = np.subtract.outer(np.arange(k), np.arange(k)) ** 2
    return 1 - (weights * observed).sum() / (weights * expected).sum()


def test_kappa_index(spark):
    pairs = list(zip([0, 1, 5, 5, 0, 1], [0, 5, 5, 1, 0, 1]))
    band = [(1 + a / 2, 1 + b / 2) for a, b in pairs]
    table = metrics.score_pairs(frame(spark, [("r", a, b) for a, b in band]), ["run"])
    assert metrics.quadratic_kappa(table, ["run"], S.BAND).first().qwk == pytest.approx(0.75)
    fixed = metrics.quadratic_kappa(table, ["run"], S.BAND, "fixed").first().qwk
    assert fixed == pytest.approx(0.428571, abs=1e-6)
    with pytest.raises(ValueError):
        metrics.quadratic_kappa(table, ["run"], S.BAND, "other")


def test_metrics_against_pandas(spark):
    draw = random.Random(5)
    rows = []
    for run, size in (("hot", 900), ("a", 40), ("b", 7)):
        for _ in range(size):
            gold = draw.choice(S.EXAM.values)
            rows.append((run, gold, round(gold + draw.gauss(0, 3), draw.choice([0, 6]))))
    found = {r.run: r for r in metrics.score_metrics(frame(spark, rows), ["run"], S.EXAM).collect()}
    for run, part in pd.DataFrame(rows, columns=["run", "gold", "pred"]).groupby("run"):
        got = found[run]
        assert got.n == len(part)
        assert got.rmse == pytest.approx(math.sqrt(((part.gold - part.pred) ** 2).mean()))
        assert got.pearson == pytest.approx(part.gold.corr(part.pred))
        ranks = part[["gold", "pred"]].rank()
        assert got.spearman == pytest.approx(ranks.gold.corr(ranks.pred))
        index = [
            [min(range(17), key=lambda i: (abs(S.EXAM.values[i] - v), i)) for v in part[c]]
            for c in ("gold", "pred")
        ]
        assert got.qwk == pytest.approx(kappa(*index))


def test_spearman_with_values_beyond_the_scale(spark):
    draw = random.Random(9)
    rows = [("r", draw.choice(S.BAND.values), draw.choice([-1e6, 1e9, draw.uniform(0, 10)])) for _ in range(300)]
    part = pd.DataFrame(rows, columns=["run", "gold", "pred"])
    expected = part.gold.rank().corr(part.pred.rank())
    bounded = metrics.score_metrics(frame(spark, rows), ["run"], S.BAND).first().spearman
    pairs = metrics.score_pairs(frame(spark, rows), ["run"])
    assert bounded == pytest.approx(expected)
    assert metrics.rank_correlation(pairs, ["run"]).first().spearman == pytest.approx(expected)


def test_undefined_metrics(spark):
    rows = [("flat", 5.0, 5.0), ("flat", 5.0, 5.0), ("one", 3.0, 4.0), ("part", 4.0, 6.0), ("part", 5.0, 6.0)]
    found = {r.run: r for r in metrics.score_metrics(frame(spark, rows), ["run"], S.BAND).collect()}
    for run in ("flat", "one", "part"):
        assert found[run].pearson is None and found[run].spearman is None
    assert found["flat"].qwk is None and found["flat"].rmse == 0
    zero = metrics.score_metrics(frame(spark, rows), ["run"], S.BAND, undefined=0.0).collect()
    assert {(r.pearson, r.spearman) for r in zero} == {(0.0, 0.0)}
    missing = frame(spark, [("a", 1.0, None), ("a", 1.0, 2.0), ("a", 2.0, 3.0)])
    assert metrics.score_metrics(missing, ["run"], None).first().n == 2


def test_missing_keys_are_a_group(spark):
    rows = [(None, 1.0, 1.0), (None, 2.0, 3.0), ("x", 1.0, 2.0), ("x", 2.0, 2.0)]
    found = metrics.score_metrics(frame(spark, rows), ["run"], S.BAND).collect()
    assert {r.run for r in found} == {None, "x"}


def test_golden_rows(spark):
    """Hand-checked: errors 0.5, -0.5, 1 and 0 on the band scale."""
    rows = [("r", 6.0, 6.5), ("r", 7.0, 6.5), ("r", 5.0, 6.0), ("r", 8.0, 8.0)]
    got = metrics.score_metrics(frame(spark, rows), ["run"], S.BAND).first()
    assert got.rmse == pytest.approx(math.sqrt(1.5 / 4))
    assert got.spearman == pytest.approx(4.5 / math.sqrt(5 * 4.5))


def test_perplexity(spark):
    losses = spark.createDataFrame([(1.0,), (49.9,), (50.0,), (None,)], "loss double")
    got = [r[0] for r in losses.select(metrics.perplexity(F.col("loss"))).collect()]
    assert got[0] == pytest.approx(math.e) and got[1] == pytest.approx(math.exp(49.9))
    assert got[2] is None and got[3] is None


def test_best_checkpoint(spark):
    rows = [("a", 100, 0.9, "x"), ("a", 200, 0.8, "y"), ("a", 300, 0.8, "z"), ("b", 100, None, "x"), ("b", 200, 1.0, "w")]
    table = spark.createDataFrame(rows, "run string, step int, rmse double, note string")
    best = {r.run: (r.step, r.note) for r in metrics.best_checkpoint(table, "run", "step").collect()}
    assert best == {"a": (200, "y"), "b": (200, "w")}


def test_run_comparison(spark):
    rows = [("bert", True, 50, 0.7), ("bert", False, 50, 0.9), ("bert", True, 200, 0.5), ("rob", True, 50, 0.6)]
    table = spark.createDataFrame(rows, "model string, adapted boolean, shots int, rmse double")
    change = comparison.adapted_against_base(table, ["model", "shots"]).collect()
    assert [(r.model, r.shots, round(r.rmse_change, 6)) for r in change] == [("bert", 50, -0.2)]
    cells = comparison.transfer_grid(table, ["model", "adapted"]).collect()
    grid = {(r.model, r.adapted): (r.rmse_50, r.rmse_100, r.rmse_200) for r in cells}
    assert grid[("bert", True)] == (0.7, None, 0.5)
    long = comparison.long_metrics(table, ["model", "shots"], ["rmse"]).collect()
    assert {(r.metric, r.value) for r in long} == {("rmse", x) for x in (0.7, 0.9, 0.5, 0.6)}


def test_runs_of_both_scales_in_one_pass(spark):
    rows = [
        ("Transfer/FCE-_IELTS/base/BERT_50", "test", "IELTS", g, p) for g, p in [(6.0, 6.2), (7.0, 7.4), (5.0, 5.1)]
    ] + [("Transfer/IELTS-_FCE/base/BERT_50", "test", "FCE", g, p) for g, p in [(11.5, 12.0), (20.0, 18.2), (4.0, 6.0)]]
    table = spark.createDataFrame(rows, "run_id string, split string, target string, gold double, pred double")
    found = {r.target: r for r in run_comparison.run_metrics(table).collect()}
    assert found["IELTS"].spearman == pytest.approx(1) and found["FCE"].spearman == pytest.approx(1)
    assert found["FCE"].shots == 50
    assert found["FCE"].qwk == pytest.approx(kappa([7, 16, 2], [8, 14, 3]))


def test_calibration(spark):
    rows = frame(spark, [("r", 2.0 * x + 1, float(x)) for x in range(5)] + [("flat", 3.0, 1.0), ("flat", 5.0, 1.0)])
    moved = modelling.calibrate(rows, rows, ["run"]).collect()
    for row in moved:
        assert row.pred == pytest.approx(4.0 if row.run == "flat" else row.gold)


def test_regression_learns(spark):
    rows = []
    for i in range(240):
        good = i % 2 == 0
        split = "train" if i < 160 else "dev" if i < 200 else "test"
        rows.append((split, "clear strong essay " * 3 if good else "weak poor text " * 3, 8.0 if good else 3.0))
    essays = spark.createDataFrame(rows, "split string, text string, score double")
    report = {r.split: r for r in modelling.score_regression(essays, S.BAND, strengths=[0.01, 1.0]).collect()}
    assert set(report) == {"dev", "test"}
    assert report["test"].pearson > 0.99 and report["test"].rmse < 1


def test_missing_keys_are_groups(spark):
    rows = [(None, 1.0, 1.0), (None, 2.0, 2.0), (None, 3.0, 2.5), ("a", 1.0, 2.0), ("a", 2.0, 1.0)]
    pairs = metrics.score_pairs(spark.createDataFrame(rows, "run string, gold double, pred double"), ["run"])
    ranks = {r.run: r.spearman for r in metrics.rank_correlation(pairs, ["run"]).collect()}
    assert abs(ranks["a"] + 1.0) < 1e-12 and abs(ranks[None] - 1.0) < 1e-12


def test_kappa_of_very_many_rows(spark):
    cells = [(1.0, 1.0, 4 * 10**9), (2.0, 2.0, 3 * 10**9), (2.0, 1.0, 2 * 10**9), (1.0, 2.0, 10**9)]
    pairs = spark.createDataFrame([("x", *c) for c in cells], "run string, gold double, pred double, n bigint")
    small = spark.createDataFrame([("x", g, p, n // 10**9) for g, p, n in cells], pairs.schema)
    big, little = (metrics.quadratic_kappa(p, ["run"], S.BAND).collect()[0].qwk for p in (pairs, small))
    assert abs(big - little) < 1e-12 and abs(big - 0.4) < 1e-12


def test_bands_meet_the_base_run_of_another_experiment(spark):
    rows = [
        ("FCE", "FCE", None, "bert", False, None, 1.0), ("FCE", "FCE", None, None, True, "A1A2", 0.8),
        ("FCE", "FCE", None, None, True, "B1B2", 1.3), ("FCE", "FCE", None, "roberta", False, None, 5.0),
        ("FCE", "IELTS", 50, None, True, "A1A2", 0.5),
    ]
    kinds = "source string, target string, shots int, model string, adapted boolean, band string, rmse double"
    out = comparison.bands_against_base(spark.createDataFrame(rows, kinds)).collect()
    got = {(r.target, r.band): (r.adapted_rmse, r.base_rmse, r.rmse_change and round(r.rmse_change, 9)) for r in out}
    assert got == {("FCE", "A1A2"): (0.8, 1.0, -0.2), ("FCE", "B1B2"): (1.3, 1.0, 0.3), ("IELTS", "A1A2"): (0.5, None, None)}


def test_several_runs_of_a_kind_fail(spark):
    rows = [("m", 50, True, 1.0), ("m", 50, True, 2.0), ("m", 50, False, 3.0)]
    table = spark.createDataFrame(rows, "model string, shots int, adapted boolean, rmse double")
    with pytest.raises(Exception, match="several runs"):
        comparison.adapted_against_base(table, ["model", "shots"]).collect()
    with pytest.raises(Exception, match="several runs"):
        comparison.transfer_grid(table, ["model", "adapted"]).collect()


def test_regression_needs_dev_rows(spark):
    essays = spark.createDataFrame([("train", f"word{i} text", float(i % 5 + 1)) for i in range(20)] + [("test", "word", 3.0)], "split string, text string, score double")
    with pytest.raises(Exception, match="no dev rows"):
        modelling.score_regression(essays, S.BAND, strengths=[0.1], features=16).collect()


def test_rows_with_one_score_do_not_count(spark):
    frame = spark.createDataFrame([(1.0, 2.0), (2.0, None), (None, 9.0), (3.0, 3.0)], "gold double, pred double")
    row = frame.agg(*metrics.error_columns(F.col("gold"), F.col("pred"))).collect()[0]
    assert row.n == 2 and abs(row.rmse - 0.5**0.5) < 1e-12 and row.pearson == 1.0


def test_pearson_of_scores_far_from_zero(spark):
    rng = np.random.default_rng(1)
    gold = 1e8 + rng.integers(0, 9, 200)
    pred = gold + rng.normal(0, 1, 200).round(3)
    rows = spark.createDataFrame([("r", float(g), float(p)) for g, p in zip(gold, pred)], "run string, gold double, pred double")
    got = metrics.score_metrics(rows, ["run"], None).collect()[0]
    want = rows.groupBy("run").agg(*metrics.error_columns(F.col("gold"), F.col("pred"))).collect()[0]
    assert got.pearson == pytest.approx(np.corrcoef(gold - 1e8, pred - 1e8)[0, 1], abs=1e-9)
    assert got.pearson == pytest.approx(want.pearson, abs=1e-9) and got.rmse == pytest.approx(want.rmse)


def test_runs_without_an_adapted_flag_fail(spark):
    table = spark.createDataFrame([("m", 50, True, 1.0), ("m", 50, None, 2.0)], "model string, shots int, adapted boolean, rmse double")
    with pytest.raises(Exception, match="no adapted flag"):
        comparison.adapted_against_base(table, ["model", "shots"]).collect()


def test_calibration_of_a_missing_group(spark):
    rows = spark.createDataFrame([(None, 2.0 * x + 1, float(x)) for x in range(4)], "run string, gold double, pred double")
    assert sorted(r.pred for r in modelling.calibrate(rows, rows, ["run"]).collect()) == pytest.approx([1.0, 3.0, 5.0, 7.0])
