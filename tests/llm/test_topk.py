"""Exact top-k search against a brute-force version."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from corpora.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, every):
    valid = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            valid.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q in valid:
        if q % every:
            continue
        for own in {tuple(v) for v in valid[q]}:
            scored = [
                (-sum(a * b for a, b in zip(own, v)), i)
                for i, vs in valid.items() if i != q for v in vs if len(v) == len(own)
            ]
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, rows, every=10, k=5, **options):
    frame = spark.createDataFrame(rows, SCHEMA)
    out = topk.top_inner_products(frame, F.col("vec_id") % every == 0, k=k, **options)
    return sorted(map(tuple, out.collect()))


def test_against_brute_force_in_small_shards(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)]) for i in range(600)]
    assert found(spark, rows, shard_rows=100, block_queries=20) == brute(rows, 5, 10)


def test_ties_and_copies(spark):
    rows = [(i, [0.5, float(i % 3)]) for i in range(300)] + [(i, [0.0, 0.0]) for i in range(300, 500)]
    assert found(spark, rows, shard_rows=90) == brute(rows, 5, 10)


def test_nulls_odd_vectors_and_repeats(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0])]
    rows += [(None, [9.0, 9.0]), (5, [1.0, 1.0]), (5, [1.0, 1.0]), (6, []), (10, []), (7, [3.0]), (20, [1.0, -2.0])]
    assert found(spark, rows) == brute(rows, 5, 10)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit(1)).withColumn("v", F.lit(2)).withColumn("dim", F.lit(3))
    assert topk.top_inner_products(frame, F.col("vec_id") % 10 == 0).count() == len(brute(rows, 5, 10))
    assert topk.top_inner_products(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0


def test_trees_leave_rows_out():
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 300, (20, 8))
    points = np.floor(centres[rng.integers(0, 20, 4000)] + rng.normal(0, 5, (4000, 8)))
    tree, seen = topk.BallTree(points, np.arange(4000)), []
    scan = tree._scan
    tree._scan = lambda node, active: (seen.append(len(node.rows) * len(active)), scan(node, active))
    queries = points[:50]
    found, scores = tree.search(queries, np.arange(50), 5, np.full(50, -np.inf))
    every = queries @ points.T
    every[np.arange(50), np.arange(50)] = -np.inf
    assert (np.sort(every, axis=1)[:, ::-1][:, :5] == scores).all() and sum(seen) < 0.3 * 50 * 4000


def test_large_components(spark):
    rng = random.Random(9)
    rows = {i: [float(rng.randint(-9, 9)) for _ in range(3)] for i in range(60)}
    rows |= {7: [1e30, 1.0, 0.0], 10: [-2e8, 3e7, 5.0], 30: [1e9, -1e9, 1e9]}
    vectors = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    got = topk.top_inner_products(vectors, F.col("vec_id") % 10 == 0, k=4, scale=256, shard_rows=16, block_queries=4)
    exact = {i: [int(256 * c) for c in v] for i, v in rows.items()}
    want = set()
    for q in range(0, 60, 10):
        scores = sorted((-sum(a * b for a, b in zip(exact[q], v)), i) for i, v in exact.items() if i != q)
        clipped = sorted((-max(-(2**63), min(2**63 - 1, -s)), i) for s, i in scores)
        want |= {(q, n, i, -s) for n, (s, i) in enumerate(clipped[:4], 1)}
    assert {tuple(r) for r in got.collect()} == want
