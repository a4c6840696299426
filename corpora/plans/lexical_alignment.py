"""Lexical alignment of pretraining and downstream corpora, and top words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.functions.stop_words import stop_words
from corpora.operators.lexical import (
    corpus_pairs,
    corpus_statistics,
    divergence,
    tally,
    top_words,
    word_counts,
)
from corpora.session import materialize


def _statistics(tallied: DataFrame, side: str) -> DataFrame:
    stats = corpus_statistics(tallied)
    return stats.select(*[F.col(c).alias(f"{side}_{'name' if c == 'corpus' else c}") for c in stats.columns])


def _named(tallied: DataFrame, paths: DataFrame | None) -> DataFrame:
    """Names of the corpora with texts and of those listed."""
    names = tallied.select("corpus")
    return names if paths is None else names.unionByName(paths.select("corpus"))


def _paths(paths: DataFrame | None, report: DataFrame, side: str) -> DataFrame:
    name, joined = f"{side}_name", f"{side}_paths"
    if paths is None:
        return report.withColumn(joined, F.lit(None).cast("string"))
    return report.join(paths.select(F.col("corpus").alias(name), F.col("corpus_paths").alias(joined)), name, "left")


def alignment_report(
    pretraining: DataFrame,
    downstream: DataFrame,
    lowercase: bool = True,
    remove_function_words: bool = False,
    min_word_len: int = 3,
    stopword_library: str = "nltk",
    smoothing: float = 1e-12,
    pretraining_paths: DataFrame | None = None,
    downstream_paths: DataFrame | None = None,
) -> DataFrame:
    """Divergence of every pretraining from every downstream corpus, 18 columns.

    Both inputs hold ``(corpus, text)``. Each text is read and split into words
    once; the word counts, far smaller than the texts, are kept in the shared folder
    and serve all pairs. Corpora that a table of paths names stay in the report without
    texts too. Sorted by downstream name, divergence, pretraining name.
    """
    stops = stop_words(stopword_library) if remove_function_words else None
    left, right = (
        materialize(tally(texts, lowercase, stops, min_word_len), f"tally-{side}")
        for side, texts in (("pretraining", pretraining), ("downstream", downstream))
    )
    left_stats, right_stats = _statistics(left, "pretraining"), _statistics(right, "downstream")
    pairs = corpus_pairs(_named(left, pretraining_paths), _named(right, downstream_paths))
    report = (
        divergence(word_counts(left), word_counts(right), pairs, smoothing)
        .join(left_stats, "pretraining_name", "left")
        .join(right_stats, "downstream_name", "left")
        .fillna(0, [f"{side}_n_{what}" for side in ("pretraining", "downstream") for what in ("texts", "tokens", "types")])
    )
    report = _paths(pretraining_paths, report, "pretraining")
    report = _paths(downstream_paths, report, "downstream")
    used = remove_function_words
    return report.select(
        "pretraining_name",
        "pretraining_paths",
        "downstream_name",
        "downstream_paths",
        F.lit(lowercase).alias("lowercase"),
        F.lit(used).alias("remove_function_words"),
        F.lit(stopword_library if used else None).cast("string").alias("stopword_library"),
        F.lit(min_word_len if used else None).cast("int").alias("min_word_len"),
        F.lit(smoothing).alias("smoothing"),
        "pretraining_n_texts",
        "pretraining_n_tokens",
        "pretraining_n_types",
        "downstream_n_texts",
        "downstream_n_tokens",
        "downstream_n_types",
        "full_vocab_size",
        "jsd_full_vocab",
        "js_distance_full_vocab",
    ).orderBy("downstream_name", "jsd_full_vocab", "pretraining_name")


def top_words_report(
    texts: DataFrame,
    k: int,
    lowercase: bool = True,
    remove_function_words: bool = False,
    min_word_len: int = 3,
    stopword_library: str = "nltk",
    order: str | None = None,
    paths: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` most frequent words of each corpus, 9 columns.

    With ``order`` (a whole number, unique per text) equal counts are listed in the
    order in which the words first appear, else alphabetically.
    """
    stops = stop_words(stopword_library) if remove_function_words else None
    counted = materialize(tally(texts, lowercase, stops, min_word_len, order=order), "tally")
    best = top_words(counted, k)
    if paths is None:
        best = best.withColumn("corpus_paths", F.lit(None).cast("string"))
    else:
        best = best.join(paths, "corpus", "left")
    return best.select(
        F.col("corpus").alias("corpus_name"),
        "corpus_paths",
        "rank",
        "word",
        F.col("n").alias("count"),
        "relative_frequency",
        "n_texts",
        "n_tokens",
        "n_types",
    )
