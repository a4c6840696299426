"""Word distributions of corpora and their divergence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.operators.hygiene import join_groups


def tally(
    texts: DataFrame,
    lowercase: bool = True,
    stop_words: Sequence[str] | None = None,
    min_length: int = 3,
    corpus: str = "corpus",
    text: str = "text",
    order: str | None = None,
) -> DataFrame:
    """Occurrences per corpus and word, in one pass over the texts.

    Besides the words there is one row ``word = ''`` with the number of texts that
    keep at least one word, and one row ``word = NULL`` with the number of texts
    that keep none; so corpus statistics need no second pass. Frequent words and
    large corpora are combined before the shuffle.

    With ``order``, a whole number that orders the texts, ``first_place`` tells where
    a word first appears. Text and position share one decimal, whose minimum stays in
    the hash table of the partial aggregation.
    """
    found = T.words(F.col(text), lowercase)
    if stop_words is not None:
        found = T.without_stop_words(found, list(stop_words), min_length)
    marked = F.when(F.size("found") > 0, F.concat("found", F.array(F.lit("")))).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    measures = [F.count(F.lit(1)).alias("n")]
    if order is None:
        found_in = texts.select(F.col(corpus).alias("corpus"), found.alias("found"))
        rows = found_in.select("corpus", F.explode(marked).alias("word"))
    else:
        text_place = F.col(order).cast("decimal(19,0)") * F.lit(2**31).cast("decimal(10,0)")
        found_in = texts.select(
            F.col(corpus).alias("corpus"), text_place.alias("_text"), found.alias("found")
        )
        rows = found_in.select("corpus", "_text", F.posexplode(marked).alias("_at", "word"))
        measures.append(F.min(F.col("_text") + F.col("_at")).alias("first_place"))
    return rows.groupBy("corpus", "word").agg(*measures)


def word_counts(tallied: DataFrame) -> DataFrame:
    """``(corpus, word, n)`` of the real words."""
    return tallied.where(F.col("word") != "")


def corpus_statistics(tallied: DataFrame) -> DataFrame:
    """``(corpus, n_texts, n_tokens, n_types)``; a corpus without words has zeros."""
    is_word = F.coalesce(F.col("word") != "", F.lit(False))
    marker = F.coalesce(F.col("word") == "", F.lit(False))
    zero = F.lit(0).cast("bigint")
    return tallied.groupBy("corpus").agg(
        F.sum(F.when(marker, F.col("n")).otherwise(zero)).alias("n_texts"),
        F.sum(F.when(is_word, F.col("n")).otherwise(zero)).alias("n_tokens"),
        F.sum(F.when(is_word, 1).otherwise(zero)).alias("n_types"),
    )


def type_sketches(texts: DataFrame, lowercase: bool = True, corpus: str = "corpus", text: str = "text", bits: int = 12) -> DataFrame:
    """``(corpus, types)``: a mergeable sketch of the distinct words of each corpus.

    A sketch has at most 2 ** ``bits`` small registers, whatever the vocabulary, so words are not shuffled:
    each task sends one sketch per corpus. Sketches of parts, days or corpora merge by
    :func:`merged_types` into that of the whole.
    """
    words = texts.select(F.col(corpus).alias("corpus"), F.explode(T.words(F.col(text), lowercase)).alias("word"))
    return words.groupBy("corpus").agg(F.hll_sketch_agg("word", bits).alias("types"))


def merged_types(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, types)``: one sketch for each group of sketches, of any sizes."""
    return sketches.groupBy(*by).agg(F.hll_union_agg("types", F.lit(True)).alias("types"))


def estimated_types(sketch: Column) -> Column:
    """Number of distinct words that a sketch has seen, within a few standard errors of 1.04 / 2 ** (bits / 2)."""
    return F.hll_sketch_estimate(sketch)


def top_words(tallied: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words per corpus with rank, share and statistics.

    Equal counts are ordered by first place where the tally has it, else by word.
    """
    counts = word_counts(tallied)
    ranking = [F.desc("n"), "first_place" if "first_place" in tallied.columns else "word"]
    # Keep the k best of each part first, so no task orders a whole vocabulary.
    parts = Window.partitionBy("corpus", F.pmod(F.hash("word"), F.lit(64))).orderBy(*ranking)
    counts = counts.withColumn("_part", F.row_number().over(parts))
    counts = counts.where(F.col("_part") <= k).drop("_part")
    rank = F.row_number().over(Window.partitionBy("corpus").orderBy(*ranking))
    best = counts.withColumn("rank", rank).where(F.col("rank") <= k)
    share = F.when(F.col("n_tokens") > 0, F.col("n") / F.col("n_tokens")).otherwise(F.lit(0.0))
    return best.join(corpus_statistics(tallied), "corpus").select(
        "corpus", "rank", "word", "n", share.alias("relative_frequency"),
        "n_texts", "n_tokens", "n_types",
    )


def corpus_pairs(pretraining: DataFrame, downstream: DataFrame) -> DataFrame:
    """Every pretraining corpus with every downstream corpus, one row per report row."""
    names = downstream.agg(F.collect_set("corpus").alias("names")).scalar()
    corpora = pretraining.select(F.col("corpus").alias("pretraining_name")).distinct()
    return corpora.withColumn("downstream_name", F.explode(names))


_PAIR = ["pretraining_name", "downstream_name"]


def joint_histogram(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Number of words with given counts on both sides: ``(*pair, a, b, n_words)``.

    Only words both sides share are joined. The words of one side alone follow by
    subtraction from that side's own histogram of counts, so no vocabulary is ever
    repeated per pair. All numbers are integers.
    """
    a = left.select(F.col("corpus").alias("pretraining_name"), "word", F.col("n").alias("a"))
    b = right.select(F.col("corpus").alias("downstream_name"), "word", F.col("n").alias("b"))
    zero = F.lit(0).cast("bigint")
    shared = a.join(b, "word").groupBy(*_PAIR, "a", "b").agg(F.count(F.lit(1)).alias("n_words"))
    a_sizes = a.groupBy("pretraining_name", "a").agg(F.count(F.lit(1)).alias("n_words"))
    b_sizes = b.groupBy("downstream_name", "b").agg(F.count(F.lit(1)).alias("n_words"))
    a_alone = pairs.join(a_sizes, "pretraining_name").select(*_PAIR, "a", zero.alias("b"), "n_words")
    b_alone = pairs.join(b_sizes, "downstream_name").select(*_PAIR, zero.alias("a"), "b", "n_words")
    moved = shared.select(
        *_PAIR,
        F.inline(
            F.array(
                F.struct(F.col("a"), F.col("b"), F.col("n_words")),
                F.struct(F.col("a"), zero.alias("b"), (-F.col("n_words")).alias("n_words")),
                F.struct(zero.alias("a"), F.col("b"), (-F.col("n_words")).alias("n_words")),
            )
        ),
    )
    return (
        moved.unionByName(a_alone)
        .unionByName(b_alone)
        .groupBy(*_PAIR, "a", "b")
        .agg(F.sum("n_words").alias("n_words"))
        .where(F.col("n_words") != 0)
    )


def kl_term(p: Column, q: Column) -> Column:
    """Term of the divergence of ``p`` from ``q``, base 2; zero where ``p`` is zero."""
    return F.when(p > 0, p * F.log2(p / q)).otherwise(F.lit(0.0))


def divergence(
    left: DataFrame, right: DataFrame, pairs: DataFrame, smoothing: float = 1e-12
) -> DataFrame:
    """Divergences per pair over the union vocabulary, base 2.

    ``(*pair, full_vocab_size, kl_pretraining, kl_downstream, jsd_full_vocab,
    js_distance_full_vocab)``; the two KL columns are against the mean distribution.
    A pair without any word fails.
    """
    joint = joint_histogram(left, right, pairs)
    totals = joint.groupBy(*_PAIR).agg(
        F.sum("n_words").alias("vocab"),
        F.sum(F.col("a") * F.col("n_words")).alias("a_total"),
        F.sum(F.col("b") * F.col("n_words")).alias("b_total"),
    )
    s = F.lit(float(smoothing))
    p = (F.col("a") + s) / (F.col("a_total") + s * F.col("vocab"))
    q = (F.col("b") + s) / (F.col("b_total") + s * F.col("vocab"))
    terms = join_groups(joint, totals, _PAIR).withColumns({"p": p, "q": q})
    mean = F.lit(0.5) * (F.col("p") + F.col("q"))
    sums = terms.groupBy(*_PAIR).agg(
        F.first("vocab").alias("full_vocab_size"),
        F.sum(F.col("n_words") * kl_term(F.col("p"), mean)).alias("kl_pretraining"),
        F.sum(F.col("n_words") * kl_term(F.col("q"), mean)).alias("kl_downstream"),
    )
    empty = F.raise_error(F.lit("cannot compare corpora whose union vocabulary is empty"))
    # Identical corpora may leave a rounding error below zero.
    jsd = F.when(F.col("full_vocab_size").isNull(), empty.cast("double")).otherwise(
        F.greatest(F.lit(0.0), 0.5 * F.col("kl_pretraining") + 0.5 * F.col("kl_downstream"))
    )
    return (
        pairs.join(sums, _PAIR, "left")
        .withColumn("jsd_full_vocab", jsd)
        .withColumn("js_distance_full_vocab", F.sqrt("jsd_full_vocab"))
    )
