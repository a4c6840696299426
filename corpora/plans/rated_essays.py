"""Rated essays: cleaning in a fixed order, then a split by rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.functions.scores import BAND
from corpora.operators.hygiene import computed_once, keep_first, require_columns
from corpora.operators.splits import three_way_split
from corpora.session import materialize

# Columns of the raw table that the study does not use.
UNUSED = [
    "Question",
    "Examiner_Commen",
    "Task_Response",
    "Coherence_Cohesion",
    "Lexical_Resource",
    "Range_Accuracy",
]


def cleaned_essays(
    raw: DataFrame, order: str, essay: str = "Essay", overall: str = "Overall", min_length: int = 100
) -> DataFrame:
    """Essays with a score between 1 and 9, in the essay alphabet.

    The order of the steps matters. Duplicates go before scores are checked, so a
    first copy with a bad score also removes later copies; lengths are those of the
    raw text, so a cleaned essay may be shorter.
    """
    require_columns(raw, essay, overall, order)
    present = raw.drop(*UNUSED).dropna(subset=[essay, overall])
    first = keep_first(present, [F.col(essay)], order)
    scored = computed_once(first, **{overall: T.to_number(F.col(overall))}).where(
        F.col(overall).between(BAND.low, BAND.high)
    )
    long_enough = scored.where(F.length(essay) >= min_length)
    return long_enough.withColumn(essay, T.keep_essay_characters(F.col(essay)))


def split_essays(
    cleaned: DataFrame, order: str, task: str = "Task_Type", task_type: int = 2, seed: int = 42
) -> DataFrame:
    """Essays of one task with their split.

    The keys of the cleaned rows are written once, for the two passes that find the cuts;
    texts are not.
    """
    chosen = cleaned.where(F.col(task) == task_type)
    return three_way_split(chosen, order, seed=seed, units=materialize(chosen.select(order), "essay-keys"))
