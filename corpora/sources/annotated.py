"""Exam scripts with error annotation, one XML file per script."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.functions.scores import exam_codes
from corpora.operators.hygiene import mapped_codes

ANSWERS = "path string, answer_id string, answer_s string, text string, error string"
#: Bytes of files that are parsed between two batches of answers, unless one file has more.
_PARSED = 1 << 20


def _answer_parser(size: int = _PARSED):
    """Parser of batches of files; built here so that it ships by value.

    Answers are handed on each ``size`` bytes of files, so a worker holds a batch of files and the answers of
    a few of them, however many files a batch has.
    """

    def learner_text(answer) -> str:
        """Text as the learner wrote it.

        An annotation keeps nothing but its first ``i`` element (the original
        wording); all other text inside it belongs to the correction.
        """
        for note in answer.findall(".//{*}NS"):
            original = note.find("{*}i")
            note.text = None
            note[:] = [] if original is None else [original]
            if original is not None:
                original.tail = None
        return "".join(answer.itertext())

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xml.etree.ElementTree as ElementTree

        import pyarrow as pa

        columns = ["path", "answer_id", "answer_s", "text", "error"]

        def handed_on(rows: list[tuple]) -> pa.RecordBatch:
            arrays = [pa.array(column, pa.string()) for column in zip(*rows)]
            return pa.RecordBatch.from_arrays(arrays, names=columns)

        for batch in batches:
            rows, taken = [], 0
            for path, content in zip(batch.column("path"), batch.column("content")):
                path, content = path.as_py(), content.as_py()
                taken += len(content or b"")
                try:
                    root = ElementTree.fromstring(content)
                    found = []
                    for name in ("answer1", "answer2"):
                        answer = root.find(f".//{name}")
                        coded = None if answer is None else answer.find("coded_answer")
                        if coded is not None:
                            code = answer.findtext("exam_score")
                            found.append((path, name, code, learner_text(coded), None))
                    rows += found
                except Exception as problem:
                    rows.append((path, None, None, None, str(problem)))
                if taken >= size and rows:
                    yield handed_on(rows)
                    rows, taken = [], 0
            if rows:
                yield handed_on(rows)

    return parse


def read_scripts(spark: SparkSession, folder: str) -> DataFrame:
    """All XML files under a folder as ``(path, content)``."""
    return (
        spark.read.format("binaryFile")
        .options(recursiveFileLookup=True, pathGlobFilter="*.xml")
        .load(folder)
        .select(T.decoded_path(F.col("path")).alias("path"), "content")
    )


def parsed_answers(scripts: DataFrame) -> DataFrame:
    """Answers ``(path, answer_id, answer_s, text, error)`` of ``(path, content)``.

    A file that cannot be parsed gives one row with ``error`` and does not fail the
    job. Files are parsed where they are read; there is no shuffle.
    """
    return scripts.select("path", "content").mapInArrow(_answer_parser(), ANSWERS)


def parse_errors(answers: DataFrame) -> DataFrame:
    """Files that could not be parsed."""
    return answers.where(F.col("error").isNotNull()).select("path", "error")


def scored_answers(answers: DataFrame, key: str | None = None) -> DataFrame:
    """Answers with a known score code, in the columns of the exam study.

    ``key`` names a column to add: a unique text that orders the answers by path.
    """
    file_name = T.base_name(F.col("path"))
    known = mapped_codes(answers.where(F.col("error").isNull()), "answer_s", exam_codes(answers.sparkSession))
    keys = [] if key is None else [F.concat_ws("|", "path", "answer_id").alias(key)]
    return known.select(
        *keys,
        F.regexp_replace(file_name, r"\.[^.]*$", "").alias("script_id"),
        file_name.alias("file_name"),
        "answer_id",
        T.collapse_space(F.col("text")).alias("text"),
        "answer_s",
        "mapped_score",
    )
