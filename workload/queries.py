"""The registered queries: each reads whole given tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpora.functions import scores as S
from corpora.functions import text as T
from corpora.functions.stop_words import ENGLISH
from corpora.operators import comparison, hygiene, lexical, linking, metrics, modelling, profile
from corpora.operators import sequences, splits
from corpora.plans import document_features, exam_answers, lexical_alignment, level_bands
from corpora.plans import rated_essays, run_comparison, token_budget
from corpora.session import materialize, scratch_path
from corpora.sources import annotated, corpus_files, runs, sinks, tables
from corpora.streaming import word_counts
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Fractions rounded, so that the order of additions does not show."""
    return df.select(
        *[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    )


# --- sources ---------------------------------------------------------------


@query
def q01_union_tables(spark, folder):
    parts = [inputs.table(spark, folder, n) for n in ("documents", "conversations", "benchmark")]
    return tables.union_tables(*parts)


@query
def q02_text_columns(spark, folder):
    paths = [f"{folder}/{n}.parquet" for n in ("documents", "conversations", "benchmark")]
    texts = tables.read_text_columns(spark, paths, "text", min_length=40)
    return texts.select(T.base_name(F.col("path")).alias("file"), "text")


@query
def q03_labelled_texts(spark, folder):
    rated = inputs.rated(spark, folder).withColumn("score", T.to_number(F.col("Overall")))
    return tables.labelled_texts(rated, "Essay", "score")


@query
def q03_labelled_csv(spark, folder):
    rated = inputs.rated(spark, folder).withColumn("score", T.to_number(F.col("Overall")))
    path = sinks.write_table(rated.select("Essay", "score"), scratch_path(spark, "labelled") + ".csv", "csv")
    return tables.labelled_texts(tables.read_table(spark, path), "Essay", "score")


@query
def q04_corpus_files(spark, folder):
    root = scratch_path(spark, "corpus-files")
    inputs.table(spark, folder, "documents").select("text").write.text(f"{root}/documents")
    sinks.write_table(inputs.table(spark, folder, "benchmark"), f"{root}/benchmark", "csv")
    sinks.write_table(inputs.table(spark, folder, "conversations"), f"{root}/conversations")
    names = ["documents", "benchmark", "conversations"]
    corpora = corpus_files.make_corpora(spark, [f"{root}/{n}" for n in names])
    texts = corpus_files.read_corpora(spark, corpora, "text")
    return texts.groupBy("corpus", "text").agg(F.count(F.lit(1)).alias("n"))


@query
def q05_manifest(spark, folder):
    pages = inputs.table(spark, folder, "pages")
    host = F.regexp_extract("url", "://([^/]+)", 1)
    manifest = pages.select("page_id", host.alias("name"), F.col("url").alias("path"))
    return corpus_files.manifest_rows(manifest, "page_id")


@query
def q05_manifest_corpora(spark, folder):
    """Documents by language and benchmark texts as files, read as the corpora that a manifest names."""
    root = scratch_path(spark, "manifest-corpora")
    docs = inputs.table(spark, folder, "documents").select("lang", "text")
    sinks.write_parts(docs, f"{root}/docs", "lang", balanced=True)
    sinks.write_table(inputs.table(spark, folder, "benchmark"), f"{root}/benchmark", "csv")
    name = F.when(F.col("lang").isin("en", "fr"), F.lit(" both ")).otherwise(F.col("lang"))
    rows = docs.select("lang").distinct().select(name.alias("name"), F.concat(F.lit(f"{root}/docs/lang="), "lang").alias("path"))
    rest = spark.createDataFrame([("benchmark", f"{root}/benchmark"), ("", root)], "name string, path string")
    manifest = sinks.write_table(rows.unionByName(rest), scratch_path(spark, "manifest"), "csv")
    texts = corpus_files.read_corpora(spark, corpus_files.manifest_table(spark, manifest), "text", root=root)
    return texts.groupBy("corpus", T.base_name(F.col("path")).alias("place"), "text").agg(F.count(F.lit(1)).alias("n"))


def _scripts(spark, folder):
    """Every document as an annotated exam script; one file in 50 is cut short."""
    clean = T.keep_essay_characters(F.col("text"))
    codes = F.array(*[F.lit(c) for c in inputs.CODES])
    first = F.substring_index(F.col("clean"), " ", 1)
    rest = F.expr("substring(clean, length(first) + 1)")
    one = F.concat(
        F.lit("<answer1><exam_score>"), F.get(codes, (F.col("n_chars") % 18).cast("int")),
        F.lit('</exam_score><coded_answer><p><NS type="R">x<i>'), F.col("first"),
        F.lit("</i><c>right</c>y</NS>"), F.col("rest"), F.lit("</p></coded_answer></answer1>"),
    )
    two = F.concat(
        F.lit("<answer2><exam_score>"), F.get(codes, (F.col("doc_id") % 18).cast("int")),
        F.lit('</exam_score><coded_answer><p>'), F.col("clean"),
        F.lit('</p> <NS type="M"><c>missing</c></NS></coded_answer></answer2>'),
    )
    end = F.when(F.col("doc_id") % 50 == 7, F.lit("")).otherwise(F.lit("</script>"))
    docs = inputs.texts(spark, folder, "documents").select("doc_id", "n_chars", clean.alias("clean"))
    docs = docs.withColumn("first", first).withColumn("rest", rest)
    return docs.select(
        F.concat(F.lit("/exam/s"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("path"),
        F.concat(F.lit("<script>"), one, two, end).cast("binary").alias("content"),
    )


@query
def q06_annotated_answers(spark, folder):
    return annotated.scored_answers(annotated.parsed_answers(_scripts(spark, folder)))


@query
def q06_parse_errors(spark, folder):
    return annotated.parse_errors(annotated.parsed_answers(_scripts(spark, folder))).select("path")


@query
def q07_write_and_read_back(spark, folder):
    split = splits.three_way_split(inputs.table(spark, folder, "documents"), "doc_id")
    path = sinks.write_parts(split, scratch_path(spark, "splits"), "split")
    return splits.split_sizes(spark.read.parquet(path))


# --- filters and cleaning ----------------------------------------------------


@query
def q08_required_values(spark, folder):
    return inputs.rated(spark, folder).dropna(subset=["Essay", "Overall"]).select("doc_id", "Overall")


@query
def q09_cleaned_essays(spark, folder):
    cleaned = rated_essays.cleaned_essays(inputs.rated(spark, folder), "doc_id")
    return cleaned.where(F.col("Task_Type") == 2)


@query
def q10_band_summary(spark, folder):
    return level_bands.band_summary(level_bands.banded_corpus(inputs.learner(spark, folder)))


@query
def q10_band_rows(spark, folder):
    return level_bands.banded_corpus(inputs.learner(spark, folder)).select("doc_id", "cefr", "band")


@query
def q10_written_bands(spark, folder):
    """Bands and their summary written and read back, the rows of each band by its folder alone."""
    banded = level_bands.banded_corpus(inputs.learner(spark, folder).select("doc_id", "text", "cefr"))
    path = level_bands.write_bands(banded, scratch_path(spark, "bands"))
    found = [level_bands.read_bands(spark, path, [band]).select("band", "doc_id") for band in level_bands.BANDS]
    counted = tables.union_tables(*found).groupBy("band").agg(
        F.count(F.lit(1)).alias("n_read"), F.sum("doc_id").alias("sum_read")
    )
    summary = level_bands.read_summary(spark, path).withColumnRenamed("split", "band")
    return summary.join(counted, "band")


@query
def q11_selected_documents(spark, folder):
    docs = inputs.texts(spark, folder, "documents").withColumnRenamed("doc_id", "row_no")
    chosen = document_features.selected_documents(
        docs, "row_no", group="lang", groups=["en", "fr"], min_words=50, max_words=400
    )
    return chosen.select("doc_id", "row_no", "lang", "word_count", "text")


def _budget(spark, folder):
    docs = inputs.texts(spark, folder, "documents")
    return token_budget.budgeted_parts(docs, "doc_id", max_tokens=20000, fraction=0.5, least=10)


@query
def q12_token_budget(spark, folder):
    return token_budget.budget_report(_budget(spark, folder))


@query
def q12_budgeted_corpus(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id", "text")
    return token_budget.budgeted_corpus(docs, _budget(spark, folder), "doc_id")


@query
def q13_mapped_scores(spark, folder):
    mapped = hygiene.mapped_codes(inputs.answers(spark, folder), "answer_s", S.exam_codes(spark))
    return mapped.select("doc_id", "script_id", "answer_id", "answer_s", "mapped_score")


# --- joins -------------------------------------------------------------------


@query
def q14_features_with_metadata(spark, folder):
    number = F.floor(F.col("doc_id") / 2).cast("string")  # ids in pairs that one cleaned name would join
    name = F.concat(F.when(F.col("doc_id") % 2 == 0, F.lit("essay ")).otherwise(F.lit("essay_")), number)
    docs = inputs.texts(spark, folder, "documents").withColumns({"row_no": F.col("doc_id"), "doc_id": name})
    again = docs.withColumns({"row_no": F.col("row_no") + 1000000000, "source": F.lit("copy")})
    file = F.concat(F.lit("/out/"), document_features.file_name(F.col("doc_id"), F.col("row_no")))
    features = profile.surface_features(docs).select(file.alias("Filename"), "n_words", "n_sentences")
    return document_features.features_with_metadata(
        features, docs.unionByName(again).drop("n_chars"), "row_no"
    )


@query
def q15_linked_by_position(spark, folder):
    features = profile.surface_features(inputs.texts(spark, folder, "documents"))
    files = inputs.table(spark, folder, "documents").select((-F.col("doc_id")).alias("place"), "doc_id")
    features = features.select(F.col("doc_id").alias("feature_no"), "n_words")
    return linking.link_by_position(features, files, "feature_no", "place")


@query
def q15_safe_keys(spark, folder):
    pages = inputs.table(spark, folder, "pages")
    return pages.select("page_id", T.safe_key(F.col("url"), F.col("page_id")).alias("safe_key"))


# --- splits and samples --------------------------------------------------------


def _split_answers(spark, folder):
    known = hygiene.mapped_codes(inputs.answers(spark, folder), "answer_s", S.exam_codes(spark))
    return exam_answers.split_answers(known, "doc_id")


@query
def q16_split_by_script(spark, folder):
    return _split_answers(spark, folder).select("doc_id", "script_id", "mapped_score", "split")


@query
def q16_split_sizes(spark, folder):
    return splits.split_sizes(_split_answers(spark, folder))


@query
def q17_few_shot(spark, folder):
    rows = inputs.labelled(spark, folder)
    return splits.few_shot_samples(rows, "doc_id", "label", [50, 100, 200])


@query
def q17_label_histogram(spark, folder):
    return splits.label_histogram(inputs.labelled(spark, folder), "label")


@query
def q18_leakage(spark, folder):
    return splits.leakage(_split_answers(spark, folder), "script_id")


@query
def q23_nested_subsets(spark, folder):
    docs = inputs.table(spark, folder, "documents").select("doc_id")
    return splits.eval_and_subsets(docs, "doc_id", [0.25, 0.5, 1.0])


@query
def q24_distinct_texts(spark, folder):
    documents = inputs.table(spark, folder, "documents")
    return hygiene.keep_first(documents, [F.col("text")], "doc_id", bits=hygiene.FILTER_BITS)


@query
def q25_random_documents(spark, folder):
    return splits.random_rows(inputs.table(spark, folder, "documents"), "doc_id", 120).select("doc_id", "lang")


@query
def q26_split_by_row(spark, folder):
    cleaned = rated_essays.cleaned_essays(inputs.rated(spark, folder), "doc_id")
    return rated_essays.split_essays(cleaned, "doc_id").select("doc_id", "Overall", "split")


@query
def q27_few_shot_fallback(spark, folder):
    first = F.col("doc_id") == 0
    rows = inputs.table(spark, folder, "documents").select(
        "doc_id", F.when(first, F.lit("single")).otherwise(F.col("lang")).alias("label")
    )
    return splits.few_shot_sample(rows, "doc_id", "label", 50)


@query
def q28_clean_documents(spark, folder):
    odd = F.translate("text", "qxzw", "\u00a0\u3000\u0085\x1c")
    odd = F.replace(odd, F.lit("k"), F.lit("\0"))
    docs = inputs.texts(spark, folder, "documents")
    return docs.select("doc_id", T.clean_document(odd).alias("clean"), T.strip(odd).alias("stripped"))


# --- words ---------------------------------------------------------------------


@query
def q19_word_counts(spark, folder):
    return lexical.word_counts(lexical.tally(inputs.corpora_by_language(spark, folder)))


@query
def q19_corpus_statistics(spark, folder):
    return lexical.corpus_statistics(lexical.tally(inputs.downstream(spark, folder)))


def _streamed(spark, folder):
    """The tally of texts that arrive in three parts, with a new run of the stream for each."""
    texts = inputs.corpora_by_language(spark, folder)
    inbox, checkpoint = scratch_path(spark, "inbox"), scratch_path(spark, "stream")
    for part in range(3):
        texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == part).write.mode("append").parquet(inbox)
        word_counts.advance(word_counts.arriving(spark, inbox, texts.schema), checkpoint)
    return word_counts.tallied(spark, checkpoint)


@query
def q19_streamed_word_counts(spark, folder):
    return lexical.word_counts(_streamed(spark, folder))


@query
def q19_streamed_statistics(spark, folder):
    return lexical.corpus_statistics(_streamed(spark, folder))


@query
def q19_type_sketches(spark, folder):
    """Distinct words of each corpus and of all, by merged sketches, beside the exact numbers."""
    texts = inputs.corpora_by_language(spark, folder)
    bits = 12
    sketches = materialize(lexical.type_sketches(texts, bits=bits), "sketches")
    whole = lexical.merged_types(sketches).select(F.lit("*").alias("corpus"), "types")
    counts = lexical.word_counts(materialize(lexical.tally(texts), "tally"))
    exact = counts.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_types"))
    of_all = counts.agg(F.count_distinct("word").alias("n_types")).select(F.lit("*").alias("corpus"), "n_types")
    gap = F.abs(lexical.estimated_types(F.col("types")) - F.col("n_types")) / F.col("n_types")
    both = exact.unionByName(of_all).join(sketches.unionByName(whole), "corpus")
    return both.select("corpus", "n_types", (gap <= 4 * 1.04 / 2 ** (bits / 2)).alias("within_bound"))


@query
def q20_top_words(spark, folder):
    report = lexical_alignment.top_words_report(inputs.corpora_by_language(spark, folder), 50)
    return rounded(report.drop("corpus_paths"))


@query
def q20_top_words_first_seen(spark, folder):
    texts = inputs.corpora_by_language(spark, folder)
    report = lexical_alignment.top_words_report(texts, 50, order="doc_id")
    return rounded(report.drop("corpus_paths"))


@query
def q21_divergence(spark, folder):
    sides = [
        materialize(lexical.tally(texts), "tally")
        for texts in (inputs.corpora_by_language(spark, folder), inputs.downstream(spark, folder))
    ]
    pairs = lexical.corpus_pairs(*[side.select("corpus") for side in sides])
    return rounded(lexical.divergence(*[lexical.word_counts(side) for side in sides], pairs))


@query
def q22_alignment_report(spark, folder):
    report = lexical_alignment.alignment_report(
        inputs.corpora_by_language(spark, folder), inputs.downstream(spark, folder)
    )
    return rounded(report.drop("pretraining_paths", "downstream_paths", "smoothing"))


def _named_paths(texts, folder, *others):
    """Two paths for each corpus, and corpora without texts."""
    known = texts.select("corpus").distinct()
    for name in others:
        known = known.unionByName(known.sparkSession.createDataFrame([(name,)], "corpus string"))
    both = F.posexplode(F.array(F.concat(F.lit("z/"), "corpus"), F.concat(F.lit("a/"), "corpus"))).alias("place", "path")
    return corpus_files.joined_paths(known.select("corpus", both), "place")


@query
def q20_top_words_with_paths(spark, folder):
    texts = inputs.corpora_by_language(spark, folder)
    return rounded(lexical_alignment.top_words_report(texts, 50, paths=_named_paths(texts, folder)))


@query
def q22_report_with_paths(spark, folder):
    """The report with paths, another smoothing, and a pretraining corpus without texts."""
    left, right = inputs.corpora_by_language(spark, folder), inputs.downstream(spark, folder)
    report = lexical_alignment.alignment_report(
        left, right, smoothing=1e-6,
        pretraining_paths=_named_paths(left, folder, "nothing"), downstream_paths=_named_paths(right, folder),
    )
    return rounded(report)


@query
def q29_content_words(spark, folder):
    counted = lexical.tally(inputs.corpora_by_language(spark, folder), stop_words=ENGLISH)
    return lexical.word_counts(counted)


@query
def q29_content_word_report(spark, folder):
    report = lexical_alignment.alignment_report(
        inputs.corpora_by_language(spark, folder),
        inputs.downstream(spark, folder),
        remove_function_words=True,
    )
    return rounded(report.drop("pretraining_paths", "downstream_paths", "smoothing"))


# --- scores ----------------------------------------------------------------------


@query
def q30_error_and_pearson(spark, folder):
    preds = inputs.predictions(spark, folder)
    return rounded(preds.groupBy("run_id").agg(*metrics.error_columns(F.col("gold"), F.col("pred"))))


def _pairs(spark, folder):
    return metrics.score_pairs(inputs.predictions(spark, folder), ["run_id"])


@query
def q31_spearman(spark, folder):
    return rounded(metrics.rank_correlation(_pairs(spark, folder), ["run_id"]))


@query
def q32_quadratic_kappa(spark, folder):
    pairs = _pairs(spark, folder)
    compact = metrics.quadratic_kappa(pairs, ["run_id"], S.BAND)
    fixed = metrics.quadratic_kappa(pairs, ["run_id"], S.BAND, "fixed")
    return rounded(compact.join(fixed.withColumnRenamed("qwk", "qwk_fixed"), "run_id"))


@query
def q33_normalized_scores(spark, folder):
    share = S.normalize(F.col("pred"), S.BAND)
    return rounded(
        inputs.predictions(spark, folder).select(
            "doc_id",
            share.alias("share"),
            S.denormalize(share, S.EXAM).alias("exam_score"),
            S.denormalize(share, S.BAND).alias("band_score"),
        )
    )


@query
def q34_snapped_scores(spark, folder):
    exam = S.denormalize(S.normalize(F.col("pred"), S.BAND), S.EXAM)
    return inputs.predictions(spark, folder).select(
        "doc_id",
        S.class_index(F.col("pred"), S.BAND).alias("band_class"),
        S.snap(F.col("pred"), S.BAND).alias("band_score"),
        S.class_index(F.round(exam, 6), S.EXAM).alias("exam_class"),
        S.snap(F.round(exam, 6), S.EXAM).alias("exam_score"),
    )


# --- saved runs --------------------------------------------------------------------


MODEL_FEATURES = [f for f in profile.SURFACE_FEATURES if f != "n_letters"]
RUN_KEYS = ["run_id", "experiment", "source", "target", "model", "adapted", "shots", "split"]


def _saved_run_metrics(spark, folder):
    """Predictions written as a tree of runs, read back, and scored."""
    root = scratch_path(spark, "tree") + "/runs"
    sinks.write_runs(inputs.saved_predictions(spark, folder), root)
    return run_comparison.run_metrics(runs.read_run_predictions(spark, root, "part-*.csv"))


@query
def q40_saved_runs(spark, folder):
    wide = _saved_run_metrics(spark, folder)
    return rounded(comparison.long_metrics(wide, RUN_KEYS, ["rmse", "pearson", "spearman", "qwk"]))


@query
def q40_metric_files(spark, folder):
    """Metric files with prefixed names, written and read back in long form."""
    root = scratch_path(spark, "metrics") + "/runs"
    saved = inputs.saved_predictions(spark, folder)
    per_run = saved.groupBy("run").agg(*metrics.error_columns(F.col("gold"), F.col("pred")))
    split = F.when(F.col("n") % 2 == 0, F.lit("dev")).otherwise(F.lit("test"))
    report = rounded(per_run, 6).withColumn("split", split)
    sinks.write_run_metrics(report, root, ["rmse", "pearson"])
    found = runs.read_run_metrics(spark, root, "part-*")
    return found.select("run_id", "model", "adapted", "shots", "split", "metric", "value")


@query
def q41_perplexity(spark, folder):
    preds = inputs.predictions(spark, folder)
    squared = F.avg((F.col("gold") - F.col("pred")) * (F.col("gold") - F.col("pred")))
    losses = preds.groupBy("run_id").agg(squared.alias("mse"))
    factors = F.explode(F.array(*[F.lit(x) for x in (1.0, 5.0, 60.0)]))
    losses = losses.withColumn("factor", factors).withColumn("loss", F.col("mse") * F.col("factor"))
    return losses.select(
        "run_id", "factor", F.round("loss", 9).alias("loss"),
        F.round(metrics.perplexity(F.col("loss")), 6).alias("perplexity"),
    )


@query
def q42_best_checkpoint(spark, folder):
    preds = inputs.predictions(spark, folder).withColumn("step", F.col("doc_id") % 4 * 100 + 100)
    columns = metrics.error_columns(F.col("gold"), F.col("pred"))
    checkpoints = rounded(preds.groupBy("run_id", "step").agg(*columns))
    return metrics.best_checkpoint(checkpoints, "run_id", "step")


@query
def q43_adapted_against_base(spark, folder):
    wide = _saved_run_metrics(spark, folder)
    return rounded(
        comparison.adapted_against_base(
            wide, ["experiment", "target", "model", "shots"], ["rmse", "pearson", "spearman", "qwk"]
        )
    )


@query
def q43_bands_against_base(spark, folder):
    """Every fourth source is a base run, the others are runs of one band each."""
    preds = inputs.predictions(spark, folder).select(inputs.band_run_name("run_id").alias("run_id"), "gold", "pred")
    report = preds.groupBy("run_id").agg(*metrics.error_columns(F.col("gold"), F.col("pred")))
    compared = comparison.bands_against_base(runs.run_dimensions(report), metrics=["rmse", "pearson"])
    return rounded(compared)


@query
def q44_transfer_grid(spark, folder):
    wide = _saved_run_metrics(spark, folder).where(F.col("experiment") == "transfer")
    return rounded(comparison.transfer_grid(wide, ["source", "target", "model", "adapted"]))


# --- document profiles ---------------------------------------------------------------


def _profile(spark, folder):
    docs = profile.surface_features(inputs.texts(spark, folder, "documents"))
    return docs.select("doc_id", "lang", *profile.SURFACE_FEATURES)


@query
def q45_document_profile(spark, folder):
    return rounded(_profile(spark, folder))


@query
def q45_group_profile(spark, folder):
    return rounded(profile.group_profile(_profile(spark, folder), "lang", profile.SURFACE_FEATURES), 6)


@query
def q45_group_quantiles(spark, folder):
    return rounded(profile.group_quantiles(_profile(spark, folder), "lang", profile.SURFACE_FEATURES), 6)


@query
def q46_external_analyser(spark, folder):
    def analyse(batch: pd.DataFrame) -> pd.DataFrame:
        split = batch["text"].str.split()
        return batch[["doc_id"]].assign(
            n_parts=split.str.len(), longest=[max(map(len, parts), default=0) for parts in split]
        )

    docs = inputs.texts(spark, folder, "documents").select("doc_id", "text")
    return profile.analyse_in_batches(docs, analyse, "doc_id bigint, n_parts bigint, longest bigint")


class _Parts:
    """Stands for an analyser that is costly to start."""

    def analyse(self, batch):
        for row in batch:
            parts = row["text"].split()
            yield row["doc_id"], len(parts), max(map(len, parts), default=0)

    def close(self):
        pass


@query
def q46_table_function(spark, folder):
    docs = inputs.texts(spark, folder, "documents").select("doc_id", "text")
    schema = StructType().add("doc_id", "long").add("n_parts", "long").add("longest", "long")
    return profile.analyse_by_table_function(docs, _Parts, schema)


@query
def q47_closest_groups(spark, folder):
    docs = materialize(_profile(spark, folder), "profile")
    by_group = profile.group_profile(docs, "lang", profile.SURFACE_FEATURES)
    spread = profile.group_profile(
        docs.withColumn("all", F.lit("all")), "all", profile.SURFACE_FEATURES
    )
    return rounded(profile.closest_groups(by_group, spread, ["en", "de"]), 6)


# --- models and sequences ------------------------------------------------------------


def _essay_features(spark, folder):
    scored = inputs.texts(spark, folder, "documents").withColumn("score", inputs.band_score())
    split = splits.three_way_split(scored, "doc_id").select("doc_id", "split", "text", "score")
    return materialize(profile.surface_features(split).select("split", "score", *MODEL_FEATURES), "essay-features")


@query
def q48_penalty_path(spark, folder):
    return rounded(modelling.penalty_path(_essay_features(spark, folder), MODEL_FEATURES)[0], 6)


@query
def q48_score_regression(spark, folder):
    return rounded(modelling.feature_regression(_essay_features(spark, folder), MODEL_FEATURES, S.BAND), 6)


@query
def q48_hashed_text_regression(spark, folder):
    essays = materialize(
        splits.three_way_split(
            inputs.texts(spark, folder, "documents").withColumn("score", inputs.band_score()), "doc_id"
        ).select("split", "text", "score"),
        "regression",
    )
    return modelling.score_regression(essays, S.BAND)


@query
def q49_calibrated_transfer(spark, folder):
    other = S.denormalize(S.normalize(F.col("pred"), S.BAND), S.EXAM)
    preds = inputs.predictions(spark, folder)
    preds = preds.select("doc_id", "gold", F.round(other, 6).alias("pred"))
    return rounded(run_comparison.calibrated_transfer(preds, "doc_id", S.BAND), 6)


@query
def q50_truncated_sequences(spark, folder):
    docs = inputs.texts(spark, folder, "documents").select("doc_id", "text")
    cut = sequences.truncated_sequence(docs, 128)
    return cut.select(
        "doc_id",
        F.array_join("tokens", " ").alias("tokens"),
        F.array_join(F.transform("special_tokens_mask", lambda m: m.cast("string")), "").alias("special"),
        F.col("length").cast("bigint").alias("length"),
        "truncated",
    )


@query
def q51_masked_positions(spark, folder):
    docs = inputs.texts(spark, folder, "documents").select("doc_id", "text")
    return sequences.masked_positions(docs, "doc_id", max_length=128)


@query
def q51_random_tokens(spark, folder):
    docs = inputs.texts(spark, folder, "documents").select("doc_id", "text")
    masked = materialize(sequences.masked_positions(docs, "doc_id", max_length=128), "masked")
    vocabulary = inputs.table(spark, folder, "benchmark").select(F.explode(T.tokens(F.col("text"))).alias("token"))
    return sequences.with_random_tokens(masked, vocabulary.distinct(), "doc_id")
