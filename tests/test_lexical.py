import math
from collections import Counter

import pytest

from corpora.operators import lexical
from corpora.plans.lexical_alignment import alignment_report, top_words_report


def corpus(spark, texts):
    rows = [(i, name, text) for i, (name, text) in enumerate(texts)]
    return spark.createDataFrame(rows, "place int, corpus string, text string")


def jsd(a, b, s=1e-12):
    vocabulary = sorted(set(a) | set(b))
    p = [a.get(w, 0) + s for w in vocabulary]
    q = [b.get(w, 0) + s for w in vocabulary]
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    m = [(x + y) / 2 for x, y in zip(p, q)]
    kl = lambda x, y: sum(i * math.log2(i / j) for i, j in zip(x, y))
    return (kl(p, m) + kl(q, m)) / 2


def test_statistics_count_texts_with_words(spark):
    texts = corpus(spark, [("a", "One two, one!"), ("a", "123 ..."), ("a", None), ("b", ""), ("b", "?")])
    tallied = lexical.tally(texts)
    stats = {r.corpus: (r.n_texts, r.n_tokens, r.n_types) for r in lexical.corpus_statistics(tallied).collect()}
    assert stats == {"a": (1, 3, 2), "b": (0, 0, 0)}
    counts = {(r.corpus, r.word): r.n for r in lexical.word_counts(tallied).collect()}
    assert counts == {("a", "one"): 2, ("a", "two"): 1}


def test_length_applies_only_with_stop_words(spark):
    texts = corpus(spark, [("a", "it is an ox, the Oxen"), ("a", "is it")])
    everything = lexical.corpus_statistics(lexical.tally(texts)).first()
    assert (everything.n_texts, everything.n_tokens) == (2, 8)
    kept = lexical.tally(texts, stop_words=["the", "is"])
    assert {r.word for r in lexical.word_counts(kept).collect()} == {"oxen"}
    assert lexical.corpus_statistics(kept).first().n_texts == 1


def test_top_words(spark):
    texts = corpus(spark, [("a", "b b c c a"), ("a", "z a"), ("b", "q")])
    best = lexical.top_words(lexical.tally(texts), 3).orderBy("corpus", "rank").collect()
    assert [(r.corpus, r["rank"], r.word, r.n) for r in best] == [
        ("a", 1, "a", 2), ("a", 2, "b", 2), ("a", 3, "c", 2), ("b", 1, "q", 1),
    ]
    assert best[0].relative_frequency == pytest.approx(2 / 7)
    placed = lexical.tally(texts, order="place")
    first = lexical.top_words(placed, 3).where("corpus = 'a'").orderBy("rank")
    assert [r.word for r in first.collect()] == ["b", "c", "a"]
    many = lexical.top_words(lexical.tally(texts), 5000).where("corpus = 'a'").orderBy("rank")
    assert [r.word for r in many.collect()] == ["a", "b", "c", "z"]


def test_divergence(spark):
    left = corpus(spark, [("same", "a b b c"), ("apart", "x y"), ("near", "a a b d")])
    right = corpus(spark, [("goal", "a b b c")])
    a, b = lexical.tally(left), lexical.tally(right)
    pairs = lexical.corpus_pairs(a, b)
    found = {
        r.pretraining_name: r
        for r in lexical.divergence(lexical.word_counts(a), lexical.word_counts(b), pairs).collect()
    }
    goal = Counter("abbc")
    assert found["same"].jsd_full_vocab == pytest.approx(0, abs=1e-12)
    assert found["apart"].jsd_full_vocab == pytest.approx(1, abs=1e-9)
    assert found["near"].jsd_full_vocab == pytest.approx(jsd(Counter("aabd"), goal), abs=1e-12)
    assert found["near"].js_distance_full_vocab == pytest.approx(math.sqrt(found["near"].jsd_full_vocab))
    assert {k: r.full_vocab_size for k, r in found.items()} == {"same": 3, "apart": 5, "near": 4}


@pytest.mark.parametrize("smoothing", [1e-12, 0.5, 1.0])
def test_divergence_is_symmetric_and_smoothed(spark, smoothing):
    one = corpus(spark, [("p", "a a a b c d e e"), ("p", "f g")])
    two = corpus(spark, [("q", "a b b h e")])
    sides = [lexical.tally(one), lexical.tally(two)]
    values = []
    for a, b in (sides, sides[::-1]):
        pairs = lexical.corpus_pairs(a, b)
        row = lexical.divergence(lexical.word_counts(a), lexical.word_counts(b), pairs, smoothing).first()
        values.append(row.jsd_full_vocab)
    expected = jsd(Counter("aaabcdeefg"), Counter("abbhe"), smoothing)
    assert values == pytest.approx([expected, expected], abs=1e-12)


def test_empty_pair_fails(spark):
    empty = lexical.tally(corpus(spark, [("a", "1 2"), ("a", "")]))
    pairs = lexical.corpus_pairs(empty, empty)
    with pytest.raises(Exception, match="union vocabulary is empty"):
        lexical.divergence(lexical.word_counts(empty), lexical.word_counts(empty), pairs).collect()


def test_one_empty_corpus_is_at_distance(spark):
    empty = lexical.tally(corpus(spark, [("a", "1 2")]))
    full = lexical.tally(corpus(spark, [("b", "x y")]))
    pairs = lexical.corpus_pairs(empty, full)
    row = lexical.divergence(lexical.word_counts(empty), lexical.word_counts(full), pairs).first()
    assert row.jsd_full_vocab == pytest.approx(jsd(Counter(), Counter("xy")), abs=1e-9)


def test_reports(spark):
    texts = corpus(spark, [("a", "the cat sat"), ("b", "a dog ran"), ("b", "the dog sat")])
    goal = corpus(spark, [("g", "the dog sat")])
    paths = spark.createDataFrame([("a", "/x | /y"), ("b", "/z")], "corpus string, corpus_paths string")
    report = alignment_report(texts, goal, pretraining_paths=paths)
    rows = report.collect()
    assert len(report.columns) == 18
    assert [r.pretraining_name for r in rows] == ["b", "a"]
    assert rows[1].pretraining_paths == "/x | /y" and rows[1].downstream_paths is None
    top = top_words_report(texts, 1, paths=paths)
    assert top.columns == [
        "corpus_name", "corpus_paths", "rank", "word", "count", "relative_frequency",
        "n_texts", "n_tokens", "n_types",
    ]
    assert {(r.corpus_name, r.word, r["count"]) for r in top.collect()} == {("a", "cat", 1), ("b", "dog", 2)}


def test_corpora_without_texts_stay_in_the_report(spark):
    left = spark.createDataFrame([("a", "one two two"), ("b", None), ("b", "123")], "corpus string, text string")
    right = spark.createDataFrame([("d", "two three")], "corpus string, text string")
    paths = spark.createDataFrame([("a", "/a"), ("b", "/b"), ("none", "/n")], "corpus string, corpus_paths string")
    rows = {r.pretraining_name: r for r in alignment_report(left, right, pretraining_paths=paths).collect()}
    assert set(rows) == {"a", "b", "none"}
    assert [rows[n].pretraining_n_texts for n in ("a", "b", "none")] == [1, 0, 0]
    assert rows["none"].pretraining_paths == "/n" and rows["none"].full_vocab_size == 2
    assert rows["none"].jsd_full_vocab == rows["b"].jsd_full_vocab
