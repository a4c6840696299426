"""Word counts of corpora whose files keep arriving.

A stream reads the files of an inbox and keeps the tally of all texts so far as its state. One call
of :func:`advance` takes in what has arrived since the last one and ends. The state is the result:
:func:`tallied` reads it as a table of the shape of :func:`corpora.operators.lexical.tally`. Nothing is
written twice, and a run that is stopped at any point is carried on from its checkpoint by the next,
with each file counted once.

Words are combined before the shuffle, and the state is dealt by corpus and word, so it grows with
the vocabulary and not with the texts; RocksDB keeps it on disk, not in the executors' memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpora.operators.lexical import tally

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def arriving(
    spark: SparkSession, inbox: str, schema: StructType | str, files_per_batch: int = 1000
) -> DataFrame:
    """The Parquet files of a folder as a stream, oldest first, so many to a batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(inbox)


def advance(
    texts: DataFrame,
    checkpoint: str,
    lowercase: bool = True,
    stop_words: Sequence[str] | None = None,
    min_length: int = 3,
) -> int:
    """Takes in the texts ``(corpus, text)`` that have arrived; returns the batches this took.

    ``checkpoint`` is a folder that all executors share. It belongs to one inbox and one choice
    of options; the stream's first run fixes into how many parts its state is dealt.
    """
    counted = tally(texts, lowercase, stop_words, min_length)
    with _state_on_disk(texts.sparkSession):
        run = (
            counted.writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
    return sum(progress["numInputRows"] > 0 for progress in run.recentProgress)


def tallied(spark: SparkSession, checkpoint: str) -> DataFrame:
    """``(corpus, word, n)`` of all texts taken in so far, as :func:`corpora.operators.lexical.tally` gives it."""
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.corpus", "key.word", F.col("value.count").alias("n"))
