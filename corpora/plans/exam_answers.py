"""Exam answers: hygiene, then a split that keeps a script together."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.operators.hygiene import keep_first, require_columns
from corpora.operators.splits import three_way_split
from corpora.session import materialize
from corpora.sources.annotated import parsed_answers, read_scripts, scored_answers


def answers_from_folder(spark: SparkSession, folder: str) -> DataFrame:
    """Scored answers of all annotated scripts under a folder, with ``answer_key``.

    The parsed answers are written once, so that no later pass parses again.
    """
    answers = parsed_answers(read_scripts(spark, folder))
    return materialize(scored_answers(answers, key="answer_key"), "parsed")


def prepared_answers(answers: DataFrame, order: str) -> DataFrame:
    """Answers with text and score, each text once."""
    require_columns(answers, "text", "answer_s", order)
    return keep_first(answers.dropna(subset=["text", "answer_s"]), [F.col("text")], order)


def split_answers(
    answers: DataFrame, order: str, test: float = 0.15, dev_of_rest: float = 0.1765, seed: int = 42
) -> DataFrame:
    """Prepared answers with their split; no script is in two splits.

    The scripts' keys are written once, for the two passes that find the cuts; texts are not.
    """
    prepared = prepared_answers(answers, order)
    scripts = materialize(prepared.select("script_id").distinct(), "scripts")
    return three_way_split(prepared, "script_id", True, test, dev_of_rest, seed, scripts)
