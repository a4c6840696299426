"""Mergeable sketches beside the exact numbers, and the written bands."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpora.operators import lexical, modelling, profile
from corpora.plans import level_bands
from corpora.functions import scores as S
from corpora.session import scratch_path


def test_merged_type_sketches_are_those_of_the_whole(spark):
    rng = random.Random(2)
    rows = [("ab"[n % 2], n % 7, " ".join("".join(rng.choices("abcdefgh", k=4)) for _ in range(50))) for n in range(400)]
    texts = spark.createDataFrame(rows, "corpus string, part int, text string")
    parts = [lexical.type_sketches(texts.where(F.col("part") == p)) for p in range(7)]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    value = lexical.estimated_types(F.col("types")).alias("n")
    whole = {r.corpus: r.n for r in lexical.type_sketches(texts).select("corpus", value).collect()}
    again = {r.corpus: r.n for r in lexical.merged_types(merged, ["corpus"]).select("corpus", value).collect()}
    exact = {r.corpus: r.n_types for r in lexical.corpus_statistics(lexical.tally(texts)).collect()}
    of_all = lexical.merged_types(merged).select(value).collect()[0].n
    every = len({w for *_, t in rows for w in t.split()})
    for name, n in exact.items():
        assert abs(whole[name] - n) <= 4 * 1.04 / 64 * n and abs(again[name] - whole[name]) <= 0.01 * n
    assert abs(of_all - every) <= 4 * 1.04 / 64 * every
    assert lexical.type_sketches(texts.limit(0)).count() == 0


def test_rank_error_of_quantile_sketches(spark):
    rng = np.random.default_rng(3)
    values = {"x": rng.lognormal(0, 2, 30000), "y": rng.integers(0, 9, 30000).astype(float)}
    frame = spark.createDataFrame(list(zip(["ab"[i % 2] for i in range(30000)], *(v.tolist() for v in values.values()))), "g string, x double, y double")
    sketches = profile.quantile_sketches(frame.repartition(6), "g", ["x", "y"])
    merged = profile.merged_quantiles(sketches)
    for r in merged.select("feature", *[F.kll_sketch_get_quantile_double("sketch", F.lit(s)).alias(f"q{s}") for s in (0.25, 0.5, 0.9)]).collect():
        ordered = np.sort(values[r.feature])
        for s in (0.25, 0.5, 0.9):
            low, high = (np.searchsorted(ordered, r[f"q{s}"], side) / 30000 for side in ("left", "right"))
            assert low - 2.5 / 400 <= s <= high + 2.5 / 400


def test_exact_quantiles(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("a", 4.0), ("b", None)], "g string, x double")
    got = {r.group: (r.p25, r.p50, r.p75) for r in profile.group_quantiles(frame, "g", ["x"]).collect()}
    assert got == {"a": (1.5, 2.0, 3.0), "b": (None, None, None)}


def test_regression_from_moments_is_least_squares(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(1e6, 3, (300, 3))
    x[:, 2] = 7.0  # no spread
    y = 5 + 0.4 * (x[:, 0] - 1e6) - 0.2 * (x[:, 1] - 1e6) + rng.normal(0, 0.1, 300)
    split = ["train"] * 200 + ["dev"] * 50 + ["test"] * 50
    rows = spark.createDataFrame([(s, *map(float, v), float(t)) for s, v, t in zip(split, x, y)] + [("test", None, 1.0, 1.0, 1.0)], "split string, a double, b double, c double, score double")
    path, best = modelling.penalty_path(rows, ["a", "b", "c"], strengths=[0.0, 0.5])
    report = {(r.strength, r.split): r for r in path.collect()}
    design = np.c_[x[:, :2] - 1e6, np.ones(300)]
    line = np.linalg.lstsq(design[:200], y[:200], rcond=None)[0]
    for name, part in (("train", slice(0, 200)), ("dev", slice(200, 250)), ("test", slice(250, 300))):
        pred = design[part] @ line
        r = report[0.0, name]
        assert r.n == len(pred) and r.rmse == pytest.approx(np.sqrt(np.mean((y[part] - pred) ** 2)), rel=1e-6)
        assert r.pearson == pytest.approx(np.corrcoef(y[part], pred)[0, 1], rel=1e-6)
    assert best.strength == 0.0 and report[0.5, "dev"].rmse > report[0.0, "dev"].rmse and best.weights[2] == 0
    scored = {r.split: r for r in modelling.feature_regression(rows, ["a", "b", "c"], S.BAND, strengths=[0.0, 0.5]).collect()}
    assert set(scored) == {"dev", "test"} and scored["test"].n == 50
    assert scored["test"].rmse == pytest.approx(report[0.0, "test"].rmse, rel=1e-5)
    with pytest.raises(ValueError, match="no dev rows"):
        modelling.penalty_path(rows.where("split <> 'dev'"), ["a", "b", "c"])


def test_bands_are_written_in_few_files_and_read_by_folder(spark):
    rows = [(i, "text of words", ["A1", "a2 ", "B1", "B2", "C1"][i % 5]) for i in range(500)]
    texts = spark.createDataFrame(rows, "doc_id int, text string, cefr string").repartition(8)
    path = level_bands.write_bands(level_bands.banded_corpus(texts), scratch_path(spark, "bands"))
    files = glob.glob(f"{path.removeprefix('file:')}/bands/band=*/*.parquet")
    assert len(files) == 4  # one for each band, from eight tasks
    some = level_bands.read_bands(spark, path, ["C1"])
    assert some.count() == 100 and some.inputFiles() and "PartitionFilters: [isnotnull(band" in some._jdf.queryExecution().toString()
    summary = {r.split: (r.n_rows, r.total_tokens) for r in level_bands.read_summary(spark, path).collect()}
    assert summary == {"A1_A2": (200, 600), "B1_B2": (200, 600), "C1": (100, 300), "B2_C1": (200, 600)}
    small = level_bands.write_bands(level_bands.banded_corpus(texts), scratch_path(spark, "bands"), rows_per_file=40)
    assert len(glob.glob(f"{small.removeprefix('file:')}/bands/band=C1/*.parquet")) == 3
