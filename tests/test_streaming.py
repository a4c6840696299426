"""Word counts kept in the state of a stream."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpora.operators import lexical
from corpora.session import scratch_path
from corpora.streaming import word_counts

SCHEMA = "corpus string, text string"


def rows_of(frame):
    return Counter(map(tuple, frame.collect()))


def test_arrivals_restarts_and_empty_runs(spark):
    rng = random.Random(1)
    words = ["one", "two", "three", "don't", "Four", ""]
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, " ".join(rng.choices(words, k=rng.randint(0, 9)))])) for _ in range(300)]
    rows += [("empty", None), ("empty", "...")]
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
    seen = []
    for part in (rows[:100], rows[100:101], rows[101:]):
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(inbox)
        seen += part
        assert word_counts.advance(word_counts.arriving(spark, inbox, SCHEMA), checkpoint) == 1
        expected = lexical.tally(spark.createDataFrame(seen, SCHEMA))
        assert rows_of(word_counts.tallied(spark, checkpoint).select(*expected.columns)) == rows_of(expected)
    assert word_counts.advance(word_counts.arriving(spark, inbox, SCHEMA), checkpoint) == 0
    statistics = {r.corpus: tuple(r)[1:] for r in lexical.corpus_statistics(word_counts.tallied(spark, checkpoint)).collect()}
    assert statistics["empty"] == (0, 0, 0)


def test_a_failed_batch_is_counted_once_when_carried_on(spark):
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
    for n in "pqrs":
        spark.createDataFrame([("a", f"word common w{n}")], SCHEMA).coalesce(1).write.mode("append").parquet(inbox)

    def stream(bad):
        texts = word_counts.arriving(spark, inbox, SCHEMA, files_per_batch=1)
        stop = F.raise_error(F.lit("lost")).cast("string")
        return texts.withColumn("text", F.when(F.col("text").contains(bad), stop).otherwise(F.col("text")))

    with pytest.raises(Exception, match="lost"):
        word_counts.advance(stream("wr"), checkpoint)
    word_counts.advance(stream("nothing"), checkpoint)
    got = {r.word: r.n for r in lexical.word_counts(word_counts.tallied(spark, checkpoint)).collect()}
    assert got == {"word": 4, "common": 4, "wp": 1, "wq": 1, "wr": 1, "ws": 1}


def test_options_of_the_tally(spark):
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
    spark.createDataFrame([("a", "The long word of a Text")], SCHEMA).write.parquet(inbox)
    stream = word_counts.arriving(spark, inbox, SCHEMA)
    word_counts.advance(stream, checkpoint, lowercase=True, stop_words=["the", "of"], min_length=3)
    assert {r.word for r in lexical.word_counts(word_counts.tallied(spark, checkpoint)).collect()} == {"long", "word", "text"}
