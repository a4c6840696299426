"""The pipeline's stages against plain versions, and the registered queries as a whole."""

import random
import re

import pytest

import __spark_entry__ as entry_points
import corpus_pipeline
from corpora.llm.ngram_join import near_duplicates

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def documents(spark):
    rng = random.Random(1)
    texts = [prose(rng, 80) for _ in range(20)]
    texts += ["too short", texts[0], texts[1].replace(texts[1].split()[3], "zzzzz"), "### $$$ *** " * 30, None, ""]
    texts += ["shared line of the corpus in question\n" + prose(rng, 70) for _ in range(3)]
    texts += [prose(rng, 60) + " write to someone@example.com or +1 (017) 555-7713 " + prose(rng, 60)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], (None, prose(rng, 90), None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_stages(spark, documents, tmp_path):
    docs, kept = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, "")
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "best_fit_packing":
            assert docs.columns == documents.columns
            kept[name] = sorted(((-1 if r.doc_id is None else r.doc_id), r.text, r.n_chars) for r in docs.collect())
    ids = {name: [r[0] for r in rows] for name, rows in kept.items()}
    assert ids["quality_rules"] == sorted([-1, *range(20), 2, 21, 22, 26, 27, 28, 29])
    assert ids["line_dedup"] == sorted([-1, *range(20), 2, 22, 26, 27, 28, 29])
    lines = {r[0]: r[1] for r in kept["line_dedup"]}
    assert "shared line" in lines[26] and "shared line" not in lines[27] + lines[28]
    assert ids["ngram_jaccard_join"] == sorted([-1, *range(20), 26, 27, 28, 29])
    masked = {r[0]: r[1] for r in kept["pii"]}
    assert "[EMAIL]" in masked[29] and "[PHONE]" in masked[29] and "@" not in masked[29]
    assert all(n == len(t) for rows in list(kept.values())[1:] for _, t, n in rows)
    assert {-1 if r.doc_id is None else r.doc_id for r in docs.collect()} == set(ids["pii"])


def test_stages_of_an_empty_table(spark, documents):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), "").count() == 0


def test_the_whole_run_keeps_clean_documents(spark):
    folder = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, folder)
    packed = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").where("quality = 1")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = near_duplicates(docs).where("class_id = doc_id").select("doc_id")
    clean = docs.join(labels, "doc_id").join(first, "doc_id").collect()
    good = [r.doc_id for r in clean if len(re.findall(r"\S+", r.text)) >= 60]
    assert sum(i in packed for i in good) >= 0.98 * len(good)


def test_every_operator_has_one_query():
    names = [n for n in entry_points.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry_points.queries()
