"""Whitening against plain Python integers and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpora.llm import whitening
from corpora.llm.queries import QUERIES


def brute(rows, scale=256, parts=4):
    usable = [
        (i, [max(-(2**63), min(2**63 - 1, math.floor(scale * c))) for c in v])
        for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    fit = [list(t) for t in sorted({tuple(x) for _, x in usable})]
    n, dims = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(dims)]
    covariance = np.array([
        [(n * sum(x[i] * x[j] for x in fit) - sums[i] * sums[j]) / n**2 for j in range(dims)] for i in range(dims)
    ])
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:parts], vectors[:, ::-1][:, :parts]
    out = {}
    for place, (i, x) in enumerate(usable):
        w = (np.array([(n * c - s) / n for c, s in zip(x, sums)]) @ vectors) / np.sqrt(values)
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        out[place] = (i, n, deviation, w, values / np.trace(covariance))
    return out


def table(spark, rows):
    return spark.createDataFrame([(n, i, v) for n, (i, v) in enumerate(rows)], "n long, vec_id long, embedding array<float>").repartition(3).drop("n")


def check(spark, rows, **options):
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    want = brute(rows, **options)
    got = whitening.whitened_embeddings(table(spark, rows), **options).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, {}).setdefault(r.component, r)
    sign = None
    for i, n, deviation, w, share in want.values():
        own = by_id[i]
        assert sorted(own) == list(range(1, len(w) + 1))
        line = np.array([own[c].whitened for c in sorted(own)])
        if sign is None:
            sign = np.sign(line) * np.sign(w)
        assert np.allclose(line, sign * w, rtol=1e-9, atol=1e-9)
        assert {(own[c].n, int(own[c].deviation)) for c in own} == {(n, deviation)}
        assert np.allclose([own[c].explained for c in sorted(own)], share, rtol=1e-9)
    assert len(got) == sum(len(w) for *_, w, _ in want.values())
    assert len({r.identity_error for r in got}) == 1 and 0 <= got[0].identity_error < 1e-6


def vectors(rng, count, dims, size=1.0):
    mix = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(dims)]
    own = [[rng.gauss(0, size * (d + 1)) for d in range(dims)] for _ in range(count)]
    return [[sum(m * c for m, c in zip(row, v)) for row in mix] for v in own]


def test_random_vectors_with_repeats(spark):
    rng = random.Random(1)
    rows = list(enumerate(vectors(rng, 150, 7)))
    rows += [(1000 + n, rows[n % 5][1]) for n in range(40)]
    check(spark, rows)


def test_fewer_dimensions_than_components(spark):
    check(spark, list(enumerate(vectors(random.Random(2), 90, 3))))


def test_large_and_shifted_entries(spark):
    rng = random.Random(3)
    check(spark, [(n, [1e6 + 100 * v[0], -1e4 * v[1], 50 * v[2]]) for n, v in enumerate(vectors(rng, 80, 3))])


def test_nulls_infinities_and_clashes(spark):
    rng = random.Random(4)
    rows = list(enumerate(vectors(rng, 60, 5)))
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0, 0.0]), (102, [math.nan] * 5), (103, [math.inf] + [0.0] * 4), (104, [0.0, -0.0, 0.0, 0.0, 0.0])]
    check(spark, rows)
    clashing = table(spark, rows).withColumn("x", F.lit(1)).withColumn("id", F.lit("y")).withColumn("component", F.lit(2))
    assert whitening.whitened_embeddings(clashing).count() == 61 * 4


def test_ends_of_longs_empty_tables_and_no_variance(spark):
    huge = table(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (None, [0.5, 0.25])])
    rows = whitening.whitened_embeddings(huge).collect()
    assert len(rows) == 6 and all(r.n == 3 for r in rows) and sum(r.vec_id is None for r in rows) == 2
    assert whitening.whitened_embeddings(huge.limit(0)).count() == 0
    assert whitening.whitened_embeddings(huge.where("vec_id < 0")).columns == whitening.whitened_embeddings(huge).columns
    alone = whitening.whitened_embeddings(table(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert [(r.n, int(r.deviation), r.whitened) for r in alone] == [(1, 0, None)] * 4


def test_vectors_of_two_lengths_fail(spark):
    with pytest.raises(ValueError, match="entries"):
        whitening.whitened_embeddings(table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_bit_planes_give_products():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 1000, (300, 6), dtype=np.uint64)
    counts = whitening.weighted_counts(whitening.bit_planes(x, 10))
    products = (counts * (1 << np.arange(19))).sum(axis=2)
    assert (products == np.triu(x.T.astype(np.int64) @ x.astype(np.int64))).all()


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want = {i: (n, deviation, w) for i, n, deviation, w, _ in brute(rows).values()}
    got = QUERIES["op13_embedding_whitening"](spark, folder).collect()
    assert len(got) == 4 * len(want) and got[0].identity_error < 1e-9
    for r in got:
        n, deviation, w = want[r.vec_id]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-8
