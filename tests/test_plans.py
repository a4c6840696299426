import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.operators import hygiene, linking, profile, sequences, splits
from corpora.sources import sinks, tables
from corpora.plans import document_features, exam_answers, level_bands, rated_essays, token_budget


def test_order_of_cleaning(spark):
    long = "An essay of more than one hundred characters. " * 3
    rows = [
        (1, long + "a", "x"), (2, long + "a", "6"),  # the bad first copy removes the second
        (3, long + "b", "6.5"), (4, long + "b", "7"),
        (5, long + "c", "9.5"), (6, long + "d", "7f"), (7, "short", "5"), (8, None, "5"), (9, long + "e", None),
        (10, long + "é", "9"), (11, long + "中", " 1 "),  # equal only after cleaning: both stay
        (12, "中" * 120 + "tiny", "4"),  # length is that of the raw text
    ]
    raw = spark.createDataFrame([(*r, "q") for r in rows], "k int, Essay string, Overall string, Question string")
    cleaned = rated_essays.cleaned_essays(raw, "k")
    assert cleaned.columns == ["k", "Essay", "Overall"] or "Question" not in cleaned.columns
    got = {r.k: (r.Overall, r.Essay) for r in cleaned.collect()}
    assert {k: v[0] for k, v in got.items()} == {3: 6.5, 10: 9.0, 11: 1.0, 12: 4.0}
    assert got[10][1] == got[11][1] and got[12][1] == "tiny"
    with pytest.raises(ValueError, match="Essay"):
        rated_essays.cleaned_essays(raw.drop("Essay"), "k")


def test_bands_may_overlap(spark):
    rows = [("a", " a1"), ("b b", "B2 "), ("c", "c1"), ("d", "C2"), (None, "A1"), ("e", None)]
    table = spark.createDataFrame(rows, "text string, cefr string")
    banded = level_bands.banded_corpus(table)
    assert {(r.cefr, r.band) for r in banded.collect()} == {
        ("A1", "A1_A2"), ("B2", "B1_B2"), ("B2", "B2_C1"), ("C1", "C1"), ("C1", "B2_C1"),
    }
    summary = level_bands.band_summary(banded.where("band <> 'C1'")).collect()
    assert [(r.split, r.n_rows, r.total_tokens) for r in summary] == [
        ("A1_A2", 1, 1), ("B1_B2", 1, 2), ("C1", 0, 0), ("B2_C1", 2, 3),
    ]


def test_answers_of_a_script_stay_together(spark):
    rows = [(i, f"s{i // 2}", f"text {i if i != 7 else 6}", "5.1") for i in range(80)]
    table = spark.createDataFrame(rows, "k int, script_id string, text string, answer_s string")
    split = exam_answers.split_answers(table, "k").collect()
    assert len(split) == 79
    assert all(len({r.split for r in split if r.script_id == s}) == 1 for s in {r.script_id for r in split})


def documents(spark, n=400):
    """Every fifth text is a copy; one text in ten is too long."""
    return spark.range(n).select(
        F.col("id").alias("k"),
        F.when(F.col("id") % 5 == 4, F.lit("the same copied text"))
        .when(F.col("id") % 10 == 0, F.repeat(F.concat(F.lit("w"), F.col("id").cast("string"), F.lit(" ")), 30))
        .otherwise(F.concat(F.lit(" text number "), F.col("id").cast("string")))
        .alias("text"),
    )


def test_token_budget(spark):
    docs = documents(spark)
    parts = token_budget.budgeted_parts(docs, "k", max_length=20, max_tokens=300, fraction=0.5)
    rows = {r.k: r for r in parts.collect()}
    assert len(rows) == 321  # 320 own texts and the first copy
    assert {k for k in rows if k % 5 == 4} == {4}
    kept = [r for r in rows.values() if r.kept]
    train = sum(r.length for r in kept if r.part == "train")
    assert train <= 300 < train + 4
    assert all(r.length <= 20 and r.in_subset for r in kept)
    held = [r for r in rows.values() if r.part == "eval"]
    assert len(held) == 17 and all(r.kept == r.short for r in held)
    corpus = token_budget.budgeted_corpus(docs, parts, "k")
    assert corpus.count() == len(kept)
    report = {(r.part, r.stage): (r.n_rows, r.n_tokens) for r in token_budget.budget_report(parts).collect()}
    assert report[("train", "split")][0] == 304 and report[("train", "subset")][0] == 152
    assert report[("train", "budget")] == (len(kept) - sum(r.short for r in held), train)
    more = token_budget.budgeted_parts(docs, "k", max_length=20, fraction=1.0)
    assert {r.k for r in kept} <= {r.k for r in more.where("kept").collect()}
    everything = token_budget.budgeted_parts(docs, "k", dedup=False)
    assert everything.count() == 400


def test_token_budget_guards(spark):
    docs = documents(spark, 150)
    with pytest.raises(ValueError, match="too few texts"):
        token_budget.budgeted_parts(docs.limit(50), "k")
    with pytest.raises(ValueError, match="length limit"):
        token_budget.budgeted_parts(docs, "k", max_length=2)
    with pytest.raises(Exception, match="keeps no text"):
        token_budget.budgeted_parts(docs, "k", max_tokens=1).collect()
    with pytest.raises(ValueError):
        token_budget.budgeted_parts(docs, "k", fraction=0)


def test_selected_documents(spark):
    rows = [(i, g, t) for i, (g, t) in enumerate([
        (1, "a b c"), (1, "a"), (2, "a b c d"), (3, "a b c"), (1, None), (2, "a\0b c  d e f"),
    ])]
    table = spark.createDataFrame(rows, "k bigint, g int, text string")
    chosen = document_features.selected_documents(
        table, "k", group="g", groups=["1", 2], min_words=2, max_words=4
    )
    assert [(r.doc_id, r.k, r.text) for r in chosen.orderBy("k").collect()] == [
        ("doc_000000", 0, "a b c"), ("doc_000001", 2, "a b c d"),
    ]
    named = document_features.selected_documents(table, "k", id_column="g", sample_n=2)
    assert named.count() == 2 and dict(named.dtypes)["doc_id"] == "string"
    with pytest.raises(ValueError, match="available columns"):
        document_features.selected_documents(table, "k", group="h")


def test_features_meet_their_documents(spark):
    docs = spark.createDataFrame(
        [(0, "a b", "x", "first"), (1, "c", "y", "other"), (2, "a b", "z", "second")],
        "row_no bigint, doc_id string, text string, note string",
    )
    named = docs.select("doc_id", document_features.file_name(F.col("doc_id"), F.col("row_no")).alias("file"))
    file = {r.doc_id: r.file for r in named.collect()}
    assert file["c"] == "c.txt" and file["a b"].startswith("a_b-")
    features = spark.createDataFrame([("/t/" + file["a b"], 1.0), ("c.txt", 2.0), ("/t/lost.txt", 3.0)], "File string, f double")
    merged = document_features.features_with_metadata(features, docs, "row_no")
    assert merged.columns[0] == "doc_id" and "text" not in merged.columns
    assert {(r.doc_id, r.f, r.note) for r in merged.collect()} == {
        ("a b", 1.0, "first"), ("c", 2.0, "other"), (None, 3.0, None),
    }
    with pytest.raises(ValueError, match="no file column"):
        linking.link_by_file(features.withColumnRenamed("File", "f_name"), docs)


def test_colliding_names_do_not_multiply_features(spark):
    docs = spark.createDataFrame([(0, "a b", "x"), (1, "a_b", "y"), (2, "a/b", "z")], "row_no bigint, doc_id string, text string")
    name = document_features.file_name(F.col("doc_id"), F.col("row_no"))
    features = docs.select(name.alias("File"), F.col("row_no").cast("double").alias("f"))
    merged = document_features.features_with_metadata(features, docs, "row_no").collect()
    assert sorted((r.f, r.doc_id) for r in merged) == [(0.0, "a b"), (1.0, "a_b"), (2.0, "a/b")]


def test_position_links_every_feature_or_fails(spark):
    features = spark.createDataFrame([(10, 1.0), (30, 3.0), (20, 2.0)], "no bigint, f double")
    files = spark.createDataFrame([(7, "b"), (5, "a"), (9, None), (11, "d")], "no bigint, doc_id string")
    linked = linking.link_by_position(features, files, "no", "no").collect()
    assert {(r.f, r.doc_id) for r in linked} == {(1.0, "a"), (2.0, "b"), (3.0, None)}
    with pytest.raises(Exception, match="no file for the feature at place 3"):
        linking.link_by_position(features, files.where("no < 9"), "no", "no").collect()


def test_every_position_can_be_chosen(spark):
    docs = spark.createDataFrame([(i, "one two three four five") for i in range(100)], "doc_id bigint, text string")
    assert sequences.masked_positions(docs, "doc_id", 1.0).count() == 500
    assert sequences.masked_positions(docs, "doc_id", 0.0).count() == 0
    cut = sequences.masked_positions(docs, "doc_id", 1.0, max_length=5)
    assert cut.count() == 300 and cut.agg(F.max("position")).collect()[0][0] == 2


def test_budgeted_texts_are_stripped(spark):
    docs = spark.createDataFrame([(i, f"  t{i} x  ") for i in range(300)] + [(999, " z ")], "doc_id bigint, text string")
    parts = token_budget.budgeted_parts(docs, "doc_id", min_char_len=2)
    texts = {r.text for r in token_budget.budgeted_corpus(docs, parts, "doc_id").collect()}
    assert "t0 x" in texts and "z" not in texts and all(t == t.strip() for t in texts)


def test_surface_features(spark):
    table = spark.createDataFrame([("One two. One!",), ("123",), ("",)], "text string")
    rows = profile.surface_features(table).collect()
    assert (rows[0].n_words, rows[0].n_sentences, rows[0].n_letters) == (3, 2, 9)
    assert rows[0].mean_sentence_length == 1.5 and rows[0].mean_word_length == 3
    assert rows[0].type_token_ratio == pytest.approx(2 / 3)
    assert rows[1].n_words == 0 and rows[1].mean_word_length is None and rows[2].n_sentences == 1


def test_batches_of_the_analyser(spark):
    def analyse(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": batch["k"], "size": len(batch), "first": batch.index[0]})

    rows = spark.range(0, 250, 1, 2).withColumnRenamed("id", "k")
    got = profile.analyse_in_batches(rows, analyse, "k bigint, size bigint, first bigint", 100).collect()
    assert {r.k for r in got} == set(range(250))
    assert {r["size"] for r in got} == {100, 25} and {r["first"] for r in got} == {0}


def test_closest_group(spark):
    rows = [("goal", 1.0, 10.0), ("goal", 3.0, 10.0), ("near", 2.0, 11.0), ("near", 2.0, 11.0), ("far", 9.0, 50.0)]
    table = spark.createDataFrame(rows, "g string, a double, b double")
    by_group = profile.group_profile(table, "g", ["a", "b"])
    spread = profile.group_profile(table.withColumn("x", F.lit("all")), "x", ["a", "b"])
    found = profile.closest_groups(by_group, spread, ["goal"]).orderBy("mean_abs_z").collect()
    assert [r.group for r in found] == ["near", "far"]
    frame = pd.DataFrame(rows, columns=["g", "a", "b"])
    sd = frame[["a", "b"]].std()
    assert found[1].mean_abs_z == pytest.approx(((7 / sd.a) + (40 / sd.b)) / 2)


def test_sequences(spark):
    table = spark.createDataFrame([(1, "a b, c d e"), (2, "")], "k bigint, text string")
    cut = {r.k: r for r in sequences.truncated_sequence(table, 6).collect()}
    assert cut[1].tokens == ["[CLS]", "a", "b", ",", "c", "[SEP]"] and cut[1].truncated
    assert cut[1].special_tokens_mask == [1, 0, 0, 0, 0, 1] and cut[1].length == 6
    assert cut[2].tokens == ["[CLS]", "[SEP]"] and not cut[2].truncated
    # at the length limit without markers the content is still cut
    full = spark.createDataFrame([(1, "a b c d e f")], "k bigint, text string")
    assert sequences.truncated_sequence(full, 6).first().truncated


def test_masking_is_stable_and_near_its_rate(spark):
    table = spark.range(50).select(F.col("id").alias("k"), F.repeat(F.lit("word "), 400).alias("text"))
    masked = sequences.masked_positions(table, "k")
    rows = masked.collect()
    assert {tuple(r) for r in masked.repartition(3).collect()} == {tuple(r) for r in rows}
    assert len(rows) / 20000 == pytest.approx(0.15, abs=0.01)
    share = {a: sum(r.action == a for r in rows) / len(rows) for a in ("mask", "random", "keep")}
    assert share["mask"] == pytest.approx(0.8, abs=0.03) and share["keep"] == pytest.approx(0.1, abs=0.03)
    assert {(r.action, r.input) for r in rows} == {("mask", "[MASK]"), ("random", None), ("keep", "word")}


def test_group_filter(spark):
    table = spark.createDataFrame([(1,), (2,), (None,)], "g int")
    assert hygiene.in_groups(table, "g", ["2"]).count() == 1
    assert hygiene.in_groups(table, "g").count() == 3


def test_lengths_by_a_callers_tokenizer(spark):
    def count(texts):
        return [len(t.split("-")) for t in texts]

    docs = spark.createDataFrame([(1, "a-b-c"), (2, "d"), (3, "a-b-c")], "k bigint, text string")
    keys = token_budget.text_keys(docs, "k", length_of=T.length_by(count))
    assert {(r.k, r.length) for r in keys.collect()} == {(1, 3), (2, 1)}
    banded = docs.withColumn("band", F.lit("C1"))
    summary = level_bands.band_summary(banded, bands={"C1": ["C1"]}, length_of=T.length_by(count), tokenizer="dash")
    assert [tuple(r) for r in summary.collect()] == [("C1", 3, 7, "dash")]


def test_random_tokens_come_from_the_vocabulary(spark):
    table = spark.range(60).select(F.col("id").alias("k"), F.repeat(F.lit("word "), 300).alias("text"))
    masked = sequences.masked_positions(table, "k")
    vocabulary = spark.createDataFrame([(w,) for w in "abcd"], "token string")
    rows = sequences.with_random_tokens(masked, vocabulary, "k").collect()
    assert len(rows) == masked.count()
    drawn = [r.input for r in rows if r.action == "random"]
    assert set(drawn) == set("abcd")
    assert all(0.15 < drawn.count(w) / len(drawn) < 0.35 for w in "abcd")
    assert {r.input for r in rows if r.action != "random"} == {"[MASK]", "word"}


def test_exam_study_from_files(spark, tmp_path):
    for i in range(40):
        folder = tmp_path / ("a" if i % 2 else "b")
        folder.mkdir(exist_ok=True)
        answers = "".join(
            f"<answer{n}><exam_score>3.{n}</exam_score><coded_answer><p>Text {i // 2 * 2 if n == 2 else i}"
            f" no {n}</p></coded_answer></answer{n}>"
            for n in (1, 2)
        )
        (folder / f"s{i}.xml").write_text(f"<x>{answers}</x>")
    answers = exam_answers.answers_from_folder(spark, str(tmp_path))
    assert answers.count() == 80
    split = exam_answers.split_answers(answers, "answer_key")
    rows = split.collect()
    # of each shared second answer the one with the lesser path stays, that in folder a
    assert len(rows) == 60
    assert all("/a/" in r.answer_key for r in rows if r.answer_id == "answer2")
    assert {r.mapped_score for r in rows} == {12.0, 13.0}
    path = sinks.write_parts(split, str(tmp_path / "out"), "split", "csv")
    back = tables.read_csv(spark, path)
    assert back.groupBy("split").count().count() == 3 and back.count() == 60
    leaks = splits.leakage(back, "script_id").collect()
    assert [r.shared for r in leaks] == [0, 0, 0]


def test_essay_study_from_files(spark, tmp_path):
    body = "An essay that is long enough to stay in the study, with more than one hundred characters in it. "
    for name in ("2.csv", "1.csv"):
        lines = [f'"{body}{i if i % 4 else name}\nend",{4 + i % 5},{1 + i % 2},{name}' for i in range(40)]
        (tmp_path / name).write_text("Essay,Overall,Task_Type,From\n" + "\n".join(lines) + "\n")
    raw = tables.read_csv(
        spark, [str(tmp_path / "2.csv"), str(tmp_path / "1.csv")],
        "Essay string, Overall string, Task_Type int, From string", row_key="row",
    )
    cleaned = rated_essays.cleaned_essays(raw, "row")
    rows = cleaned.collect()
    own = [r for r in rows if r.Essay.endswith(".csv end")]
    shared = [r for r in rows if not r.Essay.endswith(".csv end")]
    assert len(own) == 2 and len(shared) == 30 and {r.From for r in shared} == {"1.csv"}
    split = rated_essays.split_essays(cleaned, "row").collect()
    assert {r.Task_Type for r in split} == {2} and {r.split for r in split} == {"train", "dev", "test"}
