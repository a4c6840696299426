"""Score scales, normalisation and snapping to valid scores."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Exam score code and its place on the 0-20 scale.
EXAM_CODES = [
    ("0", 0.0),
    ("1.1", 1.0),
    ("1.2", 4.0),
    ("1.3", 7.0),
    ("2.1", 9.0),
    ("2.2", 10.0),
    ("2.3", 11.0),
    ("2.3T", 11.5),
    ("3.1", 12.0),
    ("3.2", 13.0),
    ("3.3", 14.0),
    ("4.1", 15.0),
    ("4.2", 16.0),
    ("4.3", 17.0),
    ("5.1", 18.0),
    ("5.2", 19.0),
    ("5.3", 20.0),
]


@dataclass(frozen=True)
class Scale:
    """Valid scores in rising order."""

    name: str
    values: tuple[float, ...]

    @property
    def low(self) -> float:
        return self.values[0]

    @property
    def high(self) -> float:
        return self.values[-1]


EXAM = Scale("FCE", tuple(value for _, value in EXAM_CODES))
BAND = Scale("IELTS", tuple(1.0 + 0.5 * step for step in range(17)))
SCALES = {scale.name: scale for scale in (EXAM, BAND)}


def exam_codes(spark: SparkSession) -> DataFrame:
    """The 17 exam codes as a table ``(code, mapped_score)``."""
    return spark.createDataFrame(EXAM_CODES, "code string, mapped_score double")


def normalize(score: Column, scale: Scale) -> Column:
    """Score as a share of the range of its scale."""
    return (score - scale.low) / (scale.high - scale.low)


def denormalize(share: Column, scale: Scale) -> Column:
    """Score on its own scale from a share of the range."""
    return share * (scale.high - scale.low) + scale.low


def class_index(score: Column, scale: Scale) -> Column:
    """Index of the nearest valid score; half way between two, the lower one.

    That index is the number of midpoints below the score, which stays a chain
    of comparisons in generated code.
    """
    midpoints = [(a + b) / 2 for a, b in zip(scale.values, scale.values[1:])]
    passed = [F.when(score > m, 1).otherwise(0) for m in midpoints]
    total = passed[0]
    for step in passed[1:]:
        total = total + step
    return F.when(score.isNotNull() & ~F.isnan(score), total)


def snap(score: Column, scale: Scale) -> Column:
    """Nearest valid score."""
    values = F.array(*[F.lit(v) for v in scale.values])
    return F.get(values, class_index(score, scale))
