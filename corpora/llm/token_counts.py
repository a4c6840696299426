"""Token counts of whole texts by a map-side lookup in two tiers.

Tier one is a table of the lengths of frequent pre-tokens, counted on a bounded sample and
broadcast (at most ``table_size`` short strings). Tier two is each worker's own cache, filled
by the library. No pre-token is shuffled and texts stay where they are read. Both tiers only
save time: the counts are the library's for any sample.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id stays null. Repeated rows
give repeated rows. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.llm.tokens import PretokenEncoder, counting_encoder


def frequent_lengths(
    docs: DataFrame, tokenizer: str, text: str, sample_rows: int = 2_000, table_size: int = 65_536
) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of a bounded sample of ordinary texts.

    At most ``sample_rows`` texts of at most 20,000 characters come to the driver (``head`` reads
    as few partitions as it needs); at most ``table_size`` entries are made.
    """
    texts = docs.select(F.col(text).alias("t")).where(F.length("t") <= 20_000).head(sample_rows)
    counts = Counter(part for r in texts for part in r.t.lower().split() if len(part) <= 32)
    top = [part for part, _ in counts.most_common(table_size)]
    encoder = PretokenEncoder(tokenizer, len, sum)
    parts = [p for p in top if encoder.plain(p) and p.lower() == p]
    return {p: encoder.value(p) for p in parts}


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    limit: int = 2048,
    id: str = "doc_id",
    text: str = "text",
    table: dict[str, int] | None = None,
) -> DataFrame:
    """``id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of every row.

    ``tokenizer`` is the path of a tokenizers file on every machine. ``table`` replaces the
    table of frequent lengths.
    """
    spark = docs.sparkSession
    table = frequent_lengths(docs, tokenizer, text) if table is None else table
    shared = spark.sparkContext.broadcast(table)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(id).alias("id"), body.alias("t"), F.octet_length(body).cast("long").alias("n")
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counting_encoder(tokenizer, shared.value)
        for batch in batches:
            counts = [encoder.value(t.as_py()) for t in batch.column("t")]
            columns = [batch.column("id"), batch.column("n"), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "k"])

    kind = rows.schema["id"].dataType.simpleString()
    counted = rows.mapInArrow(count, f"id {kind}, n bigint, k bigint")
    return counted.select(
        F.col("id").alias(id),
        F.col("n").alias("n_bytes"),
        F.col("k").alias("n_tokens"),
        (F.col("k") > limit).alias("over_limit"),
    )
