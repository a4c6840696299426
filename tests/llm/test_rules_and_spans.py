"""Quality rules and personal data against plain versions."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from corpora.llm import pii, quality
from corpora.llm.expressions import starts

HARD = [
    "a@b.c_d@e.f g@h.i@j.k %x@y.z-1.q a@b@c.d a@b.", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4 1.2.3 1.2.3.4.5 0000255.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1111-1 4111  1111 1111 1111 1111 5500000000000004 0000000000000000",
    "+1 (017) 555-7713 +49.30.1234567890123 ++1 22 33 44 55+33 1 2 +1 2345678-", "é😀 x@y.zz é +12 345 678 90 😀 8.8.8.8",
    "", None, "a@b.c@d.e a.b@c.d.e.f-@g.h", "x@y.z " * 300 + "1 " * 400, "1234 5678 9012 3452 " * 20, "x" * 5000 + "@" + "y." * 3000 + "z",
]


def base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m.group() if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(digits))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def found(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in pii.digests(pii.personal_data(docs)).collect()}


def test_base_spans(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("01254+-. ()@ab.") for _ in range(rng.randint(0, 120))) for _ in range(300)]
    for i, r in found(spark, texts).items():
        want = base(texts[i] or "")
        listed = ",".join("%s:%d:%d" % x for x in want)
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (texts[i], listed, r.spans)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in want) for k in pii.BASE]
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))


def test_added_spans(spark):
    secret = 'then token = "04dbebab91ab85687d33eeaaf9ac699e11880000" and'
    texts = [secret, "mail anna (at) web (dot) de today", "a plain text of words", "page 12-34"] + [HARD[0], HARD[3]] * 5
    out = found(spark, texts)
    assert out[0].spans == "secret:14:54" and out[1].spans.startswith("email:5:")
    assert out[2].spans == "" and out[3].spans == ""


def test_labelers_are_learned():
    rows = [(True, ("card", 1, 1, 0, 1, 3, 4), 200), (False, ("secret", 1, 1, 1, 1, 6, 2), 100), (False, ("secret", -1, 0, 0, -1, 4, 0), 300)]
    real = pii.posteriors(rows)
    assert real[rows[1][:2]] > 0.9 and real[rows[2][:2]] < 0.1
    assert pii.classifier([])["bias"] == 0.0


def test_masking(spark):
    docs = spark.createDataFrame([(1, "é a@b.cd, +12 345 678 90!"), (2, "none"), (3, "a@b.cd")], "doc_id long, text string")
    made = pii.personal_data(docs).select("doc_id", pii.masked(F.col("text"), F.col("pii.spans")).alias("t"))
    assert sorted(map(tuple, made.collect())) == [(1, "é [EMAIL], [PHONE]!"), (2, "none"), (3, "[EMAIL]")]
    kinds = "t string, s array<struct<kind:string,start:int,end:int>>"
    over = spark.createDataFrame([("abcdefgh", [("x", 1, 4), ("y", 2, 6), ("z", 2, 3)])], kinds)
    assert over.select(pii.masked(F.col("t"), F.col("s"))).collect()[0][0] == "a[X][Y]gh"


def test_spans_of_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a@b.cd"), (1, None), (1, None)], "doc_id long, text string").withColumn("pii", F.lit(1))
    assert sorted((r.doc_id or 0, r.spans) for r in pii.digests(pii.personal_data(docs)).collect()) == [(0, "email:0:6"), (1, ""), (1, "")]
    assert pii.personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 64, 65, 300])
def test_starts(spark, n):
    numbers = [(i * 7) % 11 for i in range(n)]
    frame = spark.createDataFrame([(numbers,)], "x array<long>")
    assert frame.select(starts(F.col("x"))).collect()[0][0] == [sum(numbers[:i]) for i in range(n)]


def metrics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    places = {}
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + j for p in places.values() if len(p) > 1 for i in p for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def test_metrics(spark):
    rng = random.Random(2)
    texts = ["", "\n\n", " a ", "a a a", "a a a a", "é\xa0b \x0b\x0c c", "x\nx\n\nx \nx", "#|<> $ a", "a b c " * 50, "a b c d a b c"]
    texts += [rng.choice([" ", "\n", ""]).join(rng.choice("ab #\n\tc") for _ in range(rng.randint(0, 90))) for _ in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.quality_report(docs).collect():
        own = metrics(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == own, texts[r.doc_id]
        assert r.base_failed == (own[0] < 50 or 100 * own[4] > 50 * own[0]) and not (r.base_failed and r.kept)


def test_verdicts_do_not_depend_on_the_order(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    order = quality.cascade_order(docs)
    assert sorted(order) == sorted(quality.RULES)
    for names in (order, order[::-1], sorted(order)):
        kept = docs.where(quality.rejected_by(names, quality.of_text("text")).isNull())
        ids = sorted(r.doc_id for r in kept.select("doc_id").collect())
        report = quality.quality_report(docs).where("kept").select("doc_id")
        assert ids == sorted(r.doc_id for r in report.collect())


def test_rejected_texts_are_not_measured_further(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "Ab " * 60), (3, "ab cd " * 30)], "doc_id long, text string")
    asked = []

    def capitals(metric):
        asked.append(1)
        return F.when(metric("n_words") < 50, F.raise_error(F.lit("measured"))).otherwise(metric("n_capitals") > 9)

    rules = {"few_words": quality.BASE["few_words"], "capitals": capitals}
    measured, metric = quality._measured(docs, "text", quality.SHARED)
    found = measured.select("doc_id", quality.rejected_by(list(rules), metric, rules).alias("r")).collect()
    assert {r.doc_id: r.r for r in found} == {1: "few_words", 2: "capitals", 3: None} and asked


def test_shared_counts_are_made_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = quality.judged(docs).where("rejected_by is null").select("doc_id")
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    generator = next(line for line in plan.splitlines() if "Generate inline" in line)
    condition = next(line for line in plan.splitlines() if "Filter" in line and "CASE" in line)
    assert generator.count("split(") == 1 and condition.count("split(text") <= 5
    assert "word_chars" in condition


def test_rules_on_labelled_documents(spark):
    folder = "/root/testdata/sf0.1"
    report = quality.quality_report(spark.read.parquet(f"{folder}/documents.parquet"))
    both = report.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("n_words >= 50")
    good, bad = (both.where(f"quality = {q}").agg(F.avg(F.col("kept").cast("double"))).collect()[0][0] for q in (1, 0))
    assert good > 0.995 and bad < 0.25


def test_rules_on_nulls_repeats_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    docs = docs.withColumn("rejected_by", F.lit(1)).withColumn("n_words", F.lit(2)).withColumn("a.b", F.lit(3))
    assert [r.rejected_by for r in quality.judged(docs).collect()] == ["few_words"] * 3
    assert quality.judged(docs.limit(0)).count() == 0 and quality.quality_report(docs.limit(0)).count() == 0


def test_secrets_depend_on_their_own_letters_only(spark):
    keys = ["aB3dE5fG7hJ9kL1mN3pQ", "aB3" * 100, "abcdefghijklmnopqrstuvwx"]
    texts = keys + [f"{key} and 12" for key in keys] + ["aB3dE5fG7hJ9kL1mN3p 12"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = docs.select("doc_id", pii.candidate_spans(F.col("text"), pii.base_spans(F.col("text"))).alias("s"))
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.s] for r in spans.collect()}
    sizes = [20, 300, 24]
    assert got == {i: [("secret", 0, n)] for i, n in enumerate(sizes + sizes)} | {6: []}
