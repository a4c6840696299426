"""Line dedup against a brute-force version."""

import random

import pytest
from pyspark.sql import functions as F

from corpora.llm import line_dedup


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return min(2, sum(x != y for x, y in zip(a, b)))
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return 1 if any(long[:i] + long[i + 1 :] == short for i in range(len(long))) else 2


def brute(rows, near_from=20):
    seen, out = [], {}
    for id, text in sorted(rows):
        kept = []
        for line in text.split("\n"):
            plain = " ".join(line.lower().split())
            if plain == "":
                kept.append(line)
                continue
            near = [s for s in seen if s == plain or (min(len(s), len(plain)) >= near_from and edits(s, plain) <= 1)]
            if not near:
                kept.append(line)
            seen.append(plain)
        out[id] = "\n".join(kept)
    return out


def result(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = line_dedup.deduplicated_lines(docs, **options)
    return {r.doc_id: r.text for r in made.collect()}


def changed(line, rng):
    at, kind = rng.randrange(len(line)), rng.choice("ird")
    letter = rng.choice("abé😀")
    return line[:at] + (letter + line[at:] if kind == "i" else letter + line[at + 1 :] if kind == "r" else line[at + 1 :])


@pytest.mark.parametrize("size", [20, 21, 64, 65, 66, 130, 4200])
def test_edits_of_lines(spark, size):
    rng = random.Random(size)
    rows = []
    for i in range(12 if size < 1000 else 4):
        line = "".join(rng.choice("abcdefg hij") for _ in range(size)).strip().replace("  ", "k ")
        copies = [line, changed(line, rng), changed(line, rng), changed(changed(line, rng), rng), line[:-1], "x" + line]
        rng.shuffle(copies)
        rows += [(len(rows) + j, f"{c}\nshort\n\n{i}") for j, c in enumerate(copies)]
    assert result(spark, rows) == brute(rows)


def test_runs_of_one_letter_and_ties(spark):
    rows = [(0, "a" * 30), (1, "a" * 31 + "\n" + "a" * 33), (2, "a" * 29 + "b\n" + "b" + "a" * 29), (3, "a" * 32)]
    assert result(spark, rows) == brute(rows)


def test_only_equal_lines(spark):
    rows = [(0, "a line of more than twenty letters"), (1, "a line of more than twenty letterz\nA  line of more than twenty letters")]
    assert result(spark, rows, max_edits=0)[1] == "a line of more than twenty letterz"


def test_one_line_in_every_document(spark):
    rows = [(i, f"the line that all documents hold\nown line number {i} " + chr(97 + i % 26) * i) for i in range(300)]
    out = result(spark, rows)
    assert sum("all documents" in t for t in out.values()) == 1 and "all documents" in out[0]


def test_nulls_repeats_clashes_and_empty_tables(spark):
    rows = [(1, "one line\n\ntwo"), (1, "one line\n\ntwo"), (None, "one line\nthree"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_kept", F.lit("x"))
    docs = docs.withColumn("line", F.lit(1)).withColumn("first", F.lit(2)).withColumn("h1", F.lit(3))
    out = line_dedup.deduplicated_lines(docs)
    found = sorted(((r.doc_id or 0, r.text, r.n_lines, r.n_kept) for r in out.collect()))
    assert found == [(0, "three", 2, 1), (1, "one line\n\ntwo", 3, 3), (1, "one line\n\ntwo", 3, 3), (2, "", 1, 1), (3, "", 1, 1)]
    assert set(out.columns) == {"doc_id", "text", "n_kept", "n_lines", "line", "first", "h1"}
    assert line_dedup.deduplicated_lines(docs.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = line_dedup.deduplicated_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_columns_named_like_helpers_stay(spark):
    docs = spark.createDataFrame([(1, "a\na\nb")], "doc_id long, text string")
    for name in ("_kept", "_k", "_key", "_made", "row", "key", "k", "kept", "made", "body", "n_lines", "odd.name"):
        docs = docs.withColumn(name, F.lit(name))
    out = line_dedup.deduplicated_lines(docs).collect()[0].asDict()
    assert out["text"] == "a\nb" and (out["n_lines"], out["n_kept"]) == (3, 2)
    assert all(out[c] == c for c in docs.columns if c not in ("doc_id", "text", "n_lines"))
