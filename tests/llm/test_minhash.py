"""MinHash near-duplicates against a brute-force version."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from corpora.llm import minhash


def shingles(text):
    words = (text or "").encode().lower().split()
    width = min(2, len(words))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()


def brute(texts):
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {i: [] for i in texts}
    for a, b in combinations(texts, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 80 * len(sets[a] | sets[b]):
            near[a].append(b), near[b].append(a)
    out = {}
    for i in texts:
        seen, todo = {i}, [i]
        while todo:
            for x in set(near[todo.pop()]) - seen:
                seen.add(x)
                todo.append(x)
        out[i] = (len(sets[i]), min(seen), min(seen) == i)
    return out


def result(spark, texts, **options):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = minhash.minhash_near_duplicates(docs, **options).collect()
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


def changed(rng, words, times):
    own = list(words)
    for _ in range(times):
        own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
    return own


def test_groups_of_near_copies(spark):
    rng, texts = random.Random(1), {}
    for size in [1, 2, 3, 8, 1, 30]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([8, 60, 700]))]
        for _ in range(size):
            texts[len(texts)] = " ".join(changed(rng, base, rng.randrange(1 + len(base) // 15)))
    assert result(spark, texts) == brute(texts)


def test_pairs_near_the_threshold(spark):
    rng, texts = random.Random(2), {}
    for n in range(300):
        base = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 120))]
        texts[2 * n] = " ".join(base)
        texts[2 * n + 1] = " ".join(changed(rng, base, max(1, len(base) // 18)))
    want = brute(texts)
    assert len({c for _, c, _ in want.values()}) < 500  # many are linked, many are not
    assert result(spark, texts) == want


def test_chains_that_a_star_misses(spark):
    """Each text is like the next one alone, so most members of a bucket are not like its centre."""
    rng, texts = random.Random(4), {}
    for start in (0, 100):
        words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
        for n in range(40):
            texts[start + n] = " ".join(words)
            for i in range(8):
                words[(n * 23 + i * 25) % 200] = f"y{rng.randrange(10**6)}"
    assert result(spark, texts) == brute(texts)


def test_hot_texts_in_small_stars(spark, monkeypatch):
    monkeypatch.setattr(minhash, "_STAR", 4)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(50)]
    texts = {i: " ".join(changed(rng, base, i % 4)) for i in range(120)}
    texts |= {200 + i: " ".join(base) for i in range(100)}
    assert result(spark, texts) == brute(texts)


def test_short_texts(spark):
    texts = {0: "a b", 1: "A  B", 2: "a", 3: "A", 4: "b a", 5: "a b c", 6: "Äa b", 7: "äa b", 8: "a b a b a", 9: "a b"}
    assert result(spark, texts) == brute(texts)


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, ""), (4, " \n"), (None, "z"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.withColumn("f", F.lit(1)).withColumn("keys", F.lit(2)).withColumn("key", F.lit("x")).withColumn("salt", F.lit(3))
    out = sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0, r.kept) for r in minhash.minhash_near_duplicates(docs).collect())
    assert out == [
        (0, 0, 0, True), (0, 1, 0, True), (0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 0, 4, True)
    ]
    assert minhash.minhash_near_duplicates(docs.limit(0)).count() == 0


def test_signatures_agree_as_often_as_sets_are_alike():
    order = minhash.densification_order(448)
    rng = np.random.default_rng(8)
    for size in (6, 40, 3000):
        agree = []
        for _ in range(60 if size > 6 else 400):
            union = rng.integers(0, 1 << 63, size + size // 4, dtype=np.uint64)
            a, b = union[: size + size // 8], np.concatenate([union[:size], union[size + size // 8 :]])
            alike = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            one, two = (minhash.one_permutation_signature(np.unique(x), order) for x in (a, b))
            agree.append((one == two).mean() - alike)
        assert abs(np.mean(agree)) < 0.02


def test_each_member_of_a_bucket_meets_one_centre(spark):
    """Rows of a round are as many as members, whatever the size of a bucket, and keys are dealt out once for it."""
    rows = [(key, k, 10, False) for key, size in ((1, 40), (2, 3), (3, 30)) for k in range(size)]
    members = spark.createDataFrame(rows, "key long, k long, size int, was boolean")
    joined = spark.createDataFrame([(0, 0), (1, 0), (2, 0), (3, 0)], "node long, component long")
    seen = set()
    for _ in range(2):
        members = minhash.centres_outside(members, joined).localCheckpoint()
        got = members.collect()
        assert len(got) == 70 and {r.key for r in got} == {1, 3}  # bucket 2 hangs together
        centres = {(r.key, r.centre) for r in got}
        assert len(centres) == 2 and all(c > 3 for _, c in centres) and not centres & seen
        assert {(r.key, r.k) for r in got if r.was} == centres | seen
        seen |= centres
    plan = minhash.centres_outside(members, joined)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Window" in plan
