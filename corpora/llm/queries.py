"""The registered queries of the operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.llm import alignment, line_dedup, minhash, ngram_join, packing, pieces, pii, quality
from corpora.llm import substring_dedup, token_counts, topk, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op3_token_counts(spark, folder):
    path = public_tokenizers.path(WORD_TOKENIZER)
    return token_counts.token_counts(table(spark, folder, "documents"), path, limit=2048)


@query
def op6_packed_documents(spark, folder):
    path = public_tokenizers.path(WORD_TOKENIZER)
    return packing.pack_documents(table(spark, folder, "documents"), path, size=2048)


@query
def op9_web_archives(spark, folder):
    records = warc.archived(table(spark, folder, "pages"))
    return records.select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


@query
def op10_top_inner_products(spark, folder):
    rows = table(spark, folder, "embeddings")
    return topk.top_inner_products(rows, F.col("vec_id") % 50 == 0, k=5, scale=256)


@query
def op8_quality_rules(spark, folder):
    report = quality.quality_report(table(spark, folder, "documents"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return report.select("doc_id", *names, "base_failed", "kept")


@query
def op4_personal_data(spark, folder):
    return pii.digests(pii.personal_data(table(spark, folder, "documents")))


@query
def op1_line_dedup(spark, folder):
    kept = line_dedup.deduplicated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_kept", "text")


@query
def op7_ngram_jaccard_join(spark, folder):
    return ngram_join.near_duplicates(table(spark, folder, "documents"), threshold=0.8)


@query
def op2_sentencepiece(spark, folder):
    model = public_tokenizers.path(PIECE_MODEL)
    docs = table(spark, folder, "documents")
    read = pieces.decode(pieces.encode(docs, model), model)
    return read.select(
        "doc_id", "n_tokens", "ids_crc32", F.md5("text").alias("decoded_md5"),
        F.length("text").cast("long").alias("decoded_chars"),
    )


@query
def op5_substring_dedup(spark, folder):
    docs = table(spark, folder, "documents")
    return substring_dedup.repeated_passages(docs, words=50, threshold=0.8)


@query
def op11_token_alignment(spark, folder):
    paths = [public_tokenizers.path(n) for n in (BYTE_TOKENIZER, PIECE_MODEL)]
    return alignment.token_alignment(table(spark, folder, "documents"), *paths)


@query
def op12_minhash_dedup(spark, folder):
    return minhash.minhash_near_duplicates(table(spark, folder, "documents"), percent=80, width=2)


@query
def op13_embedding_whitening(spark, folder):
    found = whitening.whitened_embeddings(table(spark, folder, "embeddings"), components=4, scale=256)
    return found.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
