"""The studies' inputs, derived from the given tables.

Each input is a DataFrame here and a common table expression in ``INPUT_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.functions.scores import EXAM_CODES
from corpora.sources.tables import spread

LEVELS = [" a1", "A2 ", "b1", "B2", "C1", "C2"]
CODES = [code for code, _ in EXAM_CODES] + ["9.9"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def texts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table for work on its texts."""
    return spread(table(spark, folder, name))


def _element(values: list[str], place: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def band_score() -> Column:
    """A score from 1 to 9 in steps of a half."""
    return F.lit(1.0) + (F.col("n_chars") % 17) * F.lit(0.5)


def learner(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with untidy proficiency labels."""
    docs = texts(spark, folder, "documents")
    return docs.withColumn("cefr", _element(LEVELS, F.col("doc_id") % 6))


def rated(spark: SparkSession, folder: str) -> DataFrame:
    """Essays with scores as text, some of them unusable."""
    place = F.col("doc_id") % 50
    overall = (
        F.when(place == 0, F.lit("x"))
        .when(place == 1, F.lit("7f"))
        .when(place == 2, F.lit(None).cast("string"))
        .when(place == 3, F.lit("12"))
        .otherwise(band_score().cast("string"))
    )
    return texts(spark, folder, "documents").select(
        "doc_id",
        F.col("text").alias("Essay"),
        overall.alias("Overall"),
        (F.lit(1) + F.col("doc_id") % 2).cast("int").alias("Task_Type"),
        F.col("lang").alias("Question"),
        F.col("source").alias("Examiner_Commen"),
    )


def answers(spark: SparkSession, folder: str) -> DataFrame:
    """Two answers per script with score codes, one of them unknown."""
    return table(spark, folder, "documents").select(
        "doc_id",
        F.floor(F.col("doc_id") / 2).cast("string").alias("script_id"),
        F.concat(F.lit("answer"), (F.col("doc_id") % 2 + 1).cast("string")).alias("answer_id"),
        "text",
        _element(CODES, F.col("n_chars") % 18).alias("answer_s"),
    )


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    """One run per source: gold scores and predictions around them."""
    noise = ((F.col("doc_id") * 37) % 101 - 50) / F.lit(25.0)
    return table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("run_id"),
        "lang",
        band_score().alias("gold"),
        (band_score() + noise).alias("pred"),
    )


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a score of 17 classes as label."""
    return table(spark, folder, "documents").select("doc_id", band_score().alias("label"))


def corpora_by_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = texts(spark, folder, "documents")
    return docs.select(F.col("lang").alias("corpus"), "text", "doc_id")


def downstream(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = table(spark, folder, "benchmark").select(F.lit("benchmark").alias("corpus"), "text")
    talks = texts(spark, folder, "conversations")
    return benchmark.unionByName(talks.select(F.lit("conversations").alias("corpus"), "text"))


def run_name() -> Column:
    """Place of a run in a tree of saved runs, from the number of its source."""
    k = F.substring("source", 4, 10).cast("int") % 20
    model = _element(["BERT", "ROBERTA", "DISTILBERT"], F.floor(k / 6) % 3)
    shots = _element(["50", "100", "200"], F.floor(k / 2) % 3)
    kind = F.when(k % 2 == 1, F.lit("DAPT/DAPT_")).otherwise(F.lit("base/"))
    transfer = F.concat(F.lit("Transfer/FCE-_IELTS/"), kind, model, F.lit("_"), shots)
    return (
        F.when(k == 18, F.lit("Downstream Fine-tuning/IELTS/ielts_bert"))
        .when(k == 19, F.lit("Downstream Fine-tuning/IELTS/ielts_dapt_bert"))
        .otherwise(transfer)
    )


def band_run_name(source: str) -> Column:
    """Place of a run of a band, or of its base run, from the number of its source."""
    k = F.substring(source, 4, 10).cast("int") % 12
    shots = _element(["50", "100", "200"], F.floor(k / 4) % 3)
    band = _element(["a1a2", "b1b2", "b2c1"], k % 4 - 1)
    return F.when(k % 4 == 0, F.concat(F.lit("Transfer/FCE-_IELTS/base/BERT_"), shots)).otherwise(
        F.concat(F.lit("Ablation/Transfer/FCE-_IELTS/"), band, F.lit("_"), shots)
    )


def saved_predictions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source", "n_chars")
    noise = ((F.col("doc_id") * 37) % 101 - 50) / F.lit(25.0)
    return docs.select(run_name().alias("run"), band_score().alias("gold"), (band_score() + noise).alias("pred"))


_SCORE = "(cast(1.0 as double) + (n_chars % 17) * cast(0.5 as double))"
_NOISE = "(((doc_id * 37) % 101 - 50) / cast(25 as double))"
_LEVEL_LIST = ", ".join(f"'{v}'" for v in LEVELS)
_CODE_LIST = ", ".join(f"'{v}'" for v in CODES)
_K = "(cast(substr(source, 4) as integer) % 20)"

INPUT_SQL = {
    "learner": f"select *, [{_LEVEL_LIST}][doc_id % 6 + 1] as cefr from documents",
    "rated": f"""
        select doc_id, text as Essay,
               case doc_id % 50 when 0 then 'x' when 1 then '7f' when 2 then null when 3 then '12'
                    else cast({_SCORE} as varchar) end as Overall,
               cast(1 + doc_id % 2 as integer) as Task_Type
        from documents""",
    "answers": f"""
        select doc_id, cast(doc_id // 2 as varchar) as script_id,
               'answer' || (doc_id % 2 + 1) as answer_id, text,
               [{_CODE_LIST}][n_chars % 18 + 1] as answer_s
        from documents""",
    "predictions": f"""
        select doc_id, source as run_id, lang, {_SCORE} as gold, {_SCORE} + {_NOISE} as pred
        from documents""",
    "labelled": f"select doc_id, {_SCORE} as label from documents",
    "by_language": "select lang as corpus, text, doc_id from documents",
    "downstream": """
        select 'benchmark' as corpus, text from benchmark
        union all select 'conversations', text from conversations""",
    "saved": f"""
        select case {_K}
                 when 18 then 'Downstream Fine-tuning/IELTS/ielts_bert'
                 when 19 then 'Downstream Fine-tuning/IELTS/ielts_dapt_bert'
                 else 'Transfer/FCE-_IELTS/' || case when {_K} % 2 = 1 then 'DAPT/DAPT_' else 'base/' end
                      || ['BERT', 'ROBERTA', 'DISTILBERT'][{_K} // 6 % 3 + 1] || '_'
                      || ['50', '100', '200'][{_K} // 2 % 3 + 1] end as run,
               {_SCORE} as gold, {_SCORE} + {_NOISE} as pred
        from documents""",
}
