import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpora.functions import scores as S
from corpora.operators.hygiene import require_columns
from corpora.session import materialize, scratch_dir, scratch_path, scratch_run
from corpora.sources import annotated, corpus_files, runs, sinks, tables


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(content if isinstance(content, bytes) else content.encode())
    return str(path)


def test_csv_missing_values_and_quotes(spark, tmp_path):
    file = put(tmp_path / "t.csv", 'text,label\n"a ""q""\nb",1\nNA,2\nnull,3\n,4\nNone!,x\n')
    rows = tables.read_csv(spark, file, "text string, label string").collect()
    assert [r.text for r in rows] == ['a "q"\nb', None, None, None, "None!"]
    assert [r.label for r in tables.read_csv(spark, file).collect()] == ["1", "2", "3", "4", "x"]
    with pytest.raises(Exception):
        tables.read_csv(spark, file, "label string, text string").collect()
    with pytest.raises(ValueError, match="unsupported table"):
        tables.read_table(spark, str(tmp_path / "t.xlsx"))


def test_union_and_columns(spark):
    a = spark.createDataFrame([(1, "x")], "k int, t string")
    b = spark.createDataFrame([("y", 2.0)], "t string, z double")
    assert {tuple(r) for r in tables.union_tables(a, b).collect()} == {(1, "x", None), (None, "y", 2.0)}
    with pytest.raises(ValueError, match=r"\['no'\] not found; available columns: \['k', 't'\]"):
        require_columns(a, "t", "no")


def test_text_column(spark):
    table = spark.createDataFrame([(" ab\n",), ("　",), (None,), ("a",)], "t string")
    assert {r.t for r in tables.text_column(table, "t").collect()} == {"ab", "a"}
    assert {r.t for r in tables.text_column(table, "t", 2).collect()} == {"ab"}


def test_labelled_texts(spark):
    table = spark.createDataFrame([("a", "1.5"), (None, "2"), ("b", None)], "t string, s string")
    assert [tuple(r) for r in tables.labelled_texts(table, "t", "s").collect()] == [("a", 1.5)]


def test_manifest(spark, tmp_path):
    file = put(tmp_path / "m.csv", "name,path\nB,/b1\n A ,/a1\nB, /b2\n,/c\nC,\n")
    found = corpus_files.make_corpora(spark, manifest=file)
    assert [(c.name, c.paths) for c in found] == [("B", ("/b1", "/b2")), ("A", ("/a1",))]
    bad = put(tmp_path / "bad.csv", "name,file\nB,/b1\n")
    with pytest.raises(ValueError, match="path"):
        corpus_files.make_corpora(spark, manifest=bad)
    joined = {r.corpus: r.corpus_paths for r in corpus_files.corpus_paths(spark, found).collect()}
    assert joined == {"B": "/b1 | /b2", "A": "/a1"}


def test_corpora_from_paths(spark):
    made = corpus_files.make_corpora(spark, ["/d/essays.txt", "/d/folder/"])
    assert [c.name for c in made] == ["essays", "folder"]
    assert corpus_files.make_corpora(spark, ["/x"], ["n"])[0].name == "n"
    with pytest.raises(ValueError, match="2 names for 1 paths"):
        corpus_files.make_corpora(spark, ["/x"], ["a", "b"])
    with pytest.raises(ValueError):
        corpus_files.make_corpora(spark)


def test_read_corpora(spark, tmp_path):
    put(tmp_path / "c/one.txt", b"first line\r\n\n  ab\xffcd one \rthird\n")
    put(tmp_path / "c/deep/two.TXT", "fourth")
    put(tmp_path / "c/deep/three.csv", 'id,text\n1,"five\nlines"\n2,NA\n3,"  "\n')
    put(tmp_path / "c/notes.md", "ignored")
    folder = str(tmp_path / "c")
    twice = corpus_files.Corpus("c", (folder, f"{folder}/one.txt", f"{folder}/deep"))
    texts = corpus_files.read_corpora(spark, [twice], "text").collect()
    assert sorted(r.text for r in texts) == ["abcd one", "first line", "five\nlines", "fourth", "third"]
    assert {r.corpus for r in texts} == {"c"}
    with pytest.raises(ValueError, match="must be named"):
        corpus_files.read_corpora(spark, [twice])
    with pytest.raises(ValueError, match="not found"):
        corpus_files.read_corpora(spark, [twice], "essay")
    with pytest.raises(ValueError, match="unsupported file type"):
        corpus_files.discovered_files(spark, [f"{folder}/notes.md"])
    os.makedirs(tmp_path / "empty")
    with pytest.raises(ValueError, match="no supported files"):
        corpus_files.discovered_files(spark, [str(tmp_path / "empty")])
    with pytest.raises(Exception):
        corpus_files.discovered_files(spark, [str(tmp_path / "absent")])


def test_many_paths_take_one_scan(spark, tmp_path):
    put(tmp_path / "r/a/one.csv", 'id,text\n1,"x, y"\n2,z\n')
    put(tmp_path / "r/a/two.csv", '\ufeff"text","other, column",more\nleft,1,2\ntext,"other, column",more\n" kept ",3\n')
    put(tmp_path / "r/b c/three.txt", "line\n")
    put(tmp_path / "r/unused/four.csv", "no,such\n1,2\n")
    spark.createDataFrame([("p",), (None,)], "text string").write.parquet(str(tmp_path / "r/a/t.parquet"))
    root = str(tmp_path / "r")
    rows = [("all", f"{root}/a"), ("all", f"file://{root}/b c/"), ("one", f"{root}/a/one.csv"), ("one", f"{root}/b c/three.txt")]
    table = spark.createDataFrame(rows, "corpus string, path string")
    os.remove(tmp_path / "r/unused/four.csv")
    got = sorted(map(tuple, corpus_files.read_corpora(spark, table, "text", root=root).collect()))
    a, b, one, three = (path for _, path in rows)
    assert got == sorted([
        ("all", a, "left"), ("all", a, "kept"), ("all", a, "x, y"), ("all", a, "z"), ("all", a, "p"), ("all", b, "line"),
        ("one", one, "x, y"), ("one", one, "z"), ("one", three, "line"),
    ])
    put(tmp_path / "r/unused/four.csv", "no,such\n1,2\n")
    with pytest.raises(ValueError, match=r"\['text'\] not found in .*four.csv"):
        corpus_files.read_corpora(spark, table, "text", root=root)
    with pytest.raises(ValueError, match="root folder"):
        corpus_files.read_corpora(spark, table, "text")


def test_the_plan_does_not_grow_with_the_paths(spark, tmp_path):
    for n in range(40):
        put(tmp_path / f"d{n}/t.txt", f"text {n}\n")

    def plan(count):
        corpora = [corpus_files.Corpus(f"c{n}", (str(tmp_path / f"d{n}"),)) for n in range(count)]
        texts = corpus_files.read_corpora(spark, corpora)
        assert texts.count() == count
        return [line.split("(")[0].split("[")[0].split("#")[0].strip() for line in texts._jdf.queryExecution().optimizedPlan().toString().splitlines()]

    assert plan(2) == plan(40)


def test_manifest_as_a_table(spark, tmp_path):
    put(tmp_path / "r/a.txt", "one\n")
    put(tmp_path / "r/b/c.txt", "two\n")
    manifest = put(tmp_path / "m.csv", f"name,path\nB,{tmp_path}/r/b\nA,{tmp_path}/r/a.txt\nB,{tmp_path}/r/a.txt\n,x\n")
    texts = corpus_files.read_corpora(spark, corpus_files.manifest_table(spark, manifest), root=str(tmp_path / "r"))
    assert sorted((r.corpus, r.text) for r in texts.collect()) == [("A", "one"), ("B", "one"), ("B", "two")]
    lost = spark.createDataFrame([("A", f"{tmp_path}/r/none")], "corpus string, path string")
    with pytest.raises(ValueError, match="no supported files found in .*none"):
        corpus_files.read_corpora(spark, lost, root=str(tmp_path / "r"))


def test_outermost_paths():
    assert corpus_files.outermost(["/a/b", "/a b", "/a/", "/a-c", "/a/b/c", "/b.txt", "/b"]) == ["/a", "/a b", "/a-c", "/b", "/b.txt"]


NESTED = (
    '<p>I <NS type="RV"><i>goed</i><c>went</c></NS> to  <NS type="MD"><c>the</c></NS> shop '
    '<NS type="S">zz<i>no<NS type="Q"><i>t</i></NS></i>yy</NS>.</p>'
)


def script(*answers):
    parts = "".join(
        f"<{name}><exam_score>{code}</exam_score><coded_answer>{text}</coded_answer></{name}>"
        for name, code, text in answers
    )
    return f"<learner><text>{parts}</text></learner>"


def test_annotated_scripts(spark, tmp_path):
    put(tmp_path / "a/doc 1.xml", script(("answer1", "2.3T", NESTED), ("answer2", " 2.3", "<p>x</p>")))
    put(tmp_path / "a/doc2.xml", script(("answer2", "5.3", "<p>Plain\n text</p>"), ("answer1", "", "<p>y</p>")))
    put(tmp_path / "bad.xml", "<learner><answer1>")
    put(tmp_path / "a/other.txt", "<x/>")
    answers = annotated.parsed_answers(annotated.read_scripts(spark, str(tmp_path)))
    raw = {(r.path.rsplit("/", 1)[-1], r.answer_id): r.text for r in answers.where("error is null").collect()}
    assert raw[("doc 1.xml", "answer1")] == "I goed to   shop not."
    errors = annotated.parse_errors(answers).collect()
    assert [r.path.rsplit("/", 1)[-1] for r in errors] == ["bad.xml"]
    rows = {r.script_id: r for r in annotated.scored_answers(answers).collect()}
    assert set(rows) == {"doc 1", "doc2"}
    assert rows["doc 1"].text == "I goed to shop not." and rows["doc 1"].mapped_score == 11.5
    assert rows["doc2"].text == "Plain text" and rows["doc2"].answer_id == "answer2"
    assert rows["doc2"].file_name == "doc2.xml"


def test_no_scripts_is_an_empty_table(spark, tmp_path):
    answers = annotated.parsed_answers(annotated.read_scripts(spark, str(tmp_path)))
    assert annotated.scored_answers(answers).count() == 0


RUNS = [
    ("Downstream Fine-tuning/FCE/fce_dapt_bert", "in-domain", "FCE", "FCE", "bert", True, None, None),
    ("Downstream Fine-tuning/IELTS/ielts_distillbert", "in-domain", "IELTS", "IELTS", "distilbert", False, None, None),
    ("Transfer/IELTS-_FCE/DAPT/DAPT_ROBERTA_50", "transfer", "IELTS", "FCE", "roberta", True, 50, None),
    ("Transfer/FCE-_IELTS/base/DISTILBERT_200", "transfer", "FCE", "IELTS", "distilbert", False, 200, None),
    ("Ablation/Finetuning/fce_a1a2", "ablation", "FCE", "FCE", None, True, None, "A1A2"),
    ("Ablation/Transfer/FCE-_IELTS/B2C1_100", "ablation", "FCE", "IELTS", None, True, 100, "B2C1"),
]


def test_run_dimensions(spark):
    table = spark.createDataFrame([(r[0],) for r in RUNS], "run_id string")
    names = ["run_id", "experiment", "source", "target", "model", "adapted", "shots", "band"]
    assert [tuple(r) for r in runs.run_dimensions(table).select(names).collect()] == RUNS


def test_run_place(spark):
    paths = [
        "file:/x/runs/Downstream%20Fine-tuning/FCE/fce+bert/test_metrics.json",
        "/x/runs/run=Transfer%252FFCE-_IELTS%252Fbase%252FBERT_50/file=dev_predictions.csv/part-0.csv",
    ]
    table = spark.createDataFrame([(p,) for p in paths], "path string")
    run, split = runs.run_place(F.col("path"))
    assert [tuple(r) for r in table.select(run, split).collect()] == [
        ("Downstream Fine-tuning/FCE/fce+bert", "test"), ("Transfer/FCE-_IELTS/base/BERT_50", "dev"),
    ]


def test_saved_runs(spark, tmp_path):
    root = tmp_path / "runs"
    base = root / "Transfer/FCE-_IELTS/base/BERT_50"
    put(base / "test_metrics.json", '{\n  "eval_rmse": 0.66,\n  "epoch": 5\n}')
    put(base / "dev_metrics.json", '{"dev_rmse": 0.7, "dev_qwk": 0.5}')
    put(base / "test_predictions.csv", "gold,pred\n6.5,6.0\n7.0,7.25\n")
    put(root / "Downstream Fine-tuning/FCE/fce_bert/test_predictions.csv", "gold,pred\n11.5,12\n")
    found = runs.read_run_metrics(spark, str(root))
    assert {(r.split, r.metric, r.value, r.shots) for r in found.collect()} == {
        ("test", "rmse", 0.66, 50), ("test", "epoch", 5.0, 50), ("dev", "rmse", 0.7, 50), ("dev", "qwk", 0.5, 50),
    }
    preds = runs.read_run_predictions(spark, str(root)).collect()
    assert {(r.run_id, r.target, r.gold, r.pred) for r in preds} == {
        ("Transfer/FCE-_IELTS/base/BERT_50", "IELTS", 6.5, 6.0),
        ("Transfer/FCE-_IELTS/base/BERT_50", "IELTS", 7.0, 7.25),
        ("Downstream Fine-tuning/FCE/fce_bert", "FCE", 11.5, 12.0),
    }


def test_sinks(spark, tmp_path):
    table = spark.createDataFrame([(1, 'say "x"\n', "dev"), (2, "b", "test")], "k int, t string, split string")
    path = sinks.write_parts(table, str(tmp_path / "parts"), "split")
    assert {(r.k, r.t, r.split) for r in spark.read.parquet(path).collect()} == {
        (1, 'say "x"\n', "dev"), (2, "b", "test"),
    }
    csv = sinks.write_table(table, str(tmp_path / "new/folder/t.csv"), "csv")
    assert {r.t.strip() for r in tables.read_table(spark, csv).collect()} == {'say "x"', "b"}
    json = sinks.write_table(table, str(tmp_path / "t.json"), "json")
    assert spark.read.json(json).count() == 2


def test_scales(spark):
    assert len(S.EXAM.values) == len(S.BAND.values) == 17
    assert (S.EXAM.low, S.EXAM.high, S.BAND.low, S.BAND.high) == (0, 20, 1, 9)
    values = [-3.0, 0.0, 0.5, 0.51, 2.5, 11.25, 11.26, 11.75, 19.5, 19.6, 99.0, float("nan"), None]
    table = spark.createDataFrame([(v,) for v in values], "v double")

    def nearest(v, scale):
        if v is None or v != v:
            return None
        return min(range(17), key=lambda i: (abs(scale.values[i] - v), i))

    for scale in (S.EXAM, S.BAND):
        index = [r[0] for r in table.select(S.class_index(F.col("v"), scale)).collect()]
        assert index == [nearest(v, scale) for v in values]
        snapped = table.select(S.snap(F.col("v"), scale).alias("v"))
        again = [r[0] for r in snapped.select(S.snap(F.col("v"), scale)).collect()]
        assert again == [r.v for r in snapped.collect()]
        back = S.denormalize(S.normalize(F.col("v"), scale), scale)
        for before, after in table.where("v < 50").select("v", back).collect():
            assert after == pytest.approx(before)


def test_scratch_folder_is_the_named_one(spark):
    assert os.path.isdir(scratch_dir(spark))


def test_suffixes_in_any_case(spark, tmp_path):
    for name in ("a.txt", "b.TXT", "c.Txt", "d.tXt"):
        (tmp_path / name).write_text(f"text of {name}\n")
    (tmp_path / "e.Csv").write_text("text\nfrom a table\n")
    corpora = corpus_files.make_corpora(spark, [str(tmp_path)])
    texts = {r.text for r in corpus_files.read_corpora(spark, corpora, "text").collect()}
    assert len(texts) == 5 and "text of c.Txt" in texts


def test_a_run_s_tables_can_be_dropped(spark):
    with scratch_run(spark) as folder:
        rows = materialize(spark.range(5), "kept")
        assert rows.count() == 5 and os.path.isdir(folder)
        assert scratch_path(spark, "x").startswith(folder)
    assert not os.path.isdir(folder) and not scratch_path(spark, "x").startswith(folder)


def test_answers_of_a_large_batch_are_handed_on_in_small_ones():
    content = "<s><answer1><coded_answer>{}</coded_answer></answer1></s>"
    files = [content.format("word " * 200).encode() if i % 10 else b"<s>" for i in range(5_000)]
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(5_000)]), pa.array(files)], names=["path", "content"])
    out = list(annotated._answer_parser()(iter([batch])))
    assert [p for b in out for p in b.column("path").to_pylist()] == [str(i) for i in range(5_000)]
    assert max(b.nbytes for b in out) < 1.5 * (1 << 20) and len(out) > 3
    assert sum(b.column("error").null_count for b in out) == 4_500
