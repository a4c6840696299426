"""The n-gram join against a brute-force version."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from corpora.llm import ngram_join
from corpora.llm.components import components


def shingles(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(texts, threshold=0.8):
    sets = {i: shingles(t) for i, t in texts.items()}
    links = {i: set() for i in texts}
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * len(sets[a] | sets[b]) - 1e-9:
            links[a].add(b)
            links[b].add(a)
    out = {}
    for i in texts:
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[i] = (min(seen), len(links[i]))
    return out


def result(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.near_duplicates(docs, **options).collect()}


def groups(rng, sizes, words=60):
    texts = {}
    for size in sizes:
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
            texts[len(texts)] = " ".join(own)
    return texts


def test_groups_of_near_copies(spark):
    texts = groups(random.Random(1), [1, 2, 3, 8, 1, 30])
    assert result(spark, texts) == brute(texts)


def test_a_large_group_in_small_blocks(spark):
    texts = groups(random.Random(2), [90, 4])
    assert result(spark, texts, block=8) == brute(texts)


def test_short_texts(spark):
    texts = {0: "a b", 1: "A  b", 2: "a b c", 3: "one two three four five", 4: "one two three four five six", 5: "x"}
    assert result(spark, texts) == brute(texts)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, None), (3, ""), (4, " \n"), (None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("f", F.lit(1)).withColumn("keys", F.lit(2))
    out = sorted((r.doc_id or 0, r.class_id or 0, r.n_links) for r in ngram_join.near_duplicates(docs).collect())
    assert out == [(0, 0, 0), (0, 1, 2), (1, 1, 2), (1, 1, 2), (2, 2, 0), (3, 3, 0), (4, 4, 0)]
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_depth_follows_the_target():
    assert ngram_join.prefix_depth(0.8, 12, 0.999) == 3 and ngram_join.prefix_depth(0.8, 12, 0.99) == 5
    assert ngram_join.prefix_depth(0.8, 1, 0.999) == 1
    assert 14 <= ngram_join.least_matches(0.8, 36) <= 20


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(9)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    both = ngram_join._overlaps(sets)
    np.fill_diagonal(both, np.diag(want))
    assert both.tolist() == want


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(7, 7), (None, 3), (200, 200)]
    edges += [(b, a) for a, b in edges[:10]]
    rng.shuffle(edges)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)} | {200: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
