"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of ``documents``. ``n_chars`` follows the text when a stage changes it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.llm import line_dedup, ngram_join, packing, pii, quality
from corpora.session import scratch_path

TOKENIZER = "word_bpe_49k.json"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _documents(docs: DataFrame) -> DataFrame:
    length = F.length("text").cast(dict(docs.dtypes).get("n_chars", "bigint"))
    return docs.withColumn("n_chars", length).select(*COLUMNS)


def _given(docs: DataFrame) -> DataFrame:
    """The columns of ``documents`` alone; others would meet those that a stage adds."""
    return docs.select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.judged(_given(docs), into="_rejected_by").where("_rejected_by is null").select(*COLUMNS)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that occur earlier; one with no other lines goes."""
    return _documents(line_dedup.deduplicated_lines(_given(docs)).where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document, by id, of each class of near-duplicates; of equal rows one.

    Rows are told apart by id and text, so null or repeated ids lose no document; null ids come last.
    """
    docs = _given(docs)
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", key.alias("key"))
    classes = ngram_join.near_duplicates(docs.withColumn("_order", order), id="_order")
    kept = classes.where("class_id = _order").select(F.col("_order.key").alias("_kept")).distinct()
    keyed = docs.withColumn("_key", key)
    first = keyed.join(kept, F.col("_key") == F.col("_kept"), "left_semi").dropDuplicates(["_key"])
    return first.select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with each span of personal data replaced by its kind."""
    found = pii.personal_data(_given(docs), into="_pii")
    return _documents(found.withColumn("text", pii.masked(F.col("text"), F.col("_pii.spans"))))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequence of at most 2048 tokens and their place in it."""
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), size=2048)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: Spans, ids and sequences are not expressible in SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
