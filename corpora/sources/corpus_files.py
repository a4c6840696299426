"""Named corpora from files: specifications, manifests, discovery and reading."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.operators.hygiene import join_groups, require_columns
from corpora.session import materialize
from corpora.sources.tables import missing_to_null, read_csv, text_column, union_tables

SUFFIXES = (".txt", ".csv", ".parquet")


def _glob(*suffixes: str) -> str:
    """Pattern of file names with one of the suffixes, in any case of letters."""
    either = ["".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes]
    return "{" + ",".join(f"*{s}" for s in either) + "}"


@dataclass(frozen=True)
class Corpus:
    """A name and the files or folders that make up the corpus."""

    name: str
    paths: tuple[str, ...]


def default_name(path: str) -> str:
    """Name of a folder, or of a file without its suffix."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    return last.rsplit(".", 1)[0] if last.lower().endswith(SUFFIXES) else last


def manifest_rows(manifest: DataFrame, order: str) -> DataFrame:
    """Usable manifest rows ``(name, first_row, order, path)``.

    Rows with the same name form one corpus; ``first_row`` is the first place of
    the name and orders the corpora. Rows with a blank name or path are skipped.
    The table stays long, so a name may have any number of paths.
    """
    require_columns(manifest, "name", "path", order)
    rows = manifest.select(
        order, *[T.strip(F.col(c).cast("string")).alias(c) for c in ("name", "path")]
    ).where((F.col("name") != "") & (F.col("path") != ""))
    first = rows.groupBy("name").agg(F.min(order).alias("first_row"))
    return join_groups(rows, first, ["name"]).select("name", "first_row", order, "path")


def corpora_from_manifest(spark: SparkSession, path: str) -> list[Corpus]:
    """The corpora a manifest CSV lists; a manifest is a list of paths to read."""
    table = read_csv(spark, path, row_key="row_no")
    grouped: dict[str, list[str]] = {}
    for row in manifest_rows(table, "row_no").orderBy("row_no").collect():
        grouped.setdefault(row["name"], []).append(row["path"])
    return [Corpus(name, tuple(paths)) for name, paths in grouped.items()]


def make_corpora(
    spark: SparkSession,
    paths: Sequence[str] | None = None,
    names: Sequence[str] | None = None,
    manifest: str | None = None,
) -> list[Corpus]:
    """Corpora from a manifest, or one per path with given or default names."""
    if manifest is not None:
        return corpora_from_manifest(spark, manifest)
    if not paths:
        raise ValueError("paths or a manifest is needed")
    if names is not None and len(names) != len(paths):
        raise ValueError(f"{len(names)} names for {len(paths)} paths")
    names = names if names is not None else [default_name(p) for p in paths]
    return [Corpus(name, (path,)) for name, path in zip(names, paths)]


def outermost(paths: Sequence[str]) -> list[str]:
    """Paths in order without those that lie inside another one; each is read once."""
    kept: list[str] = []
    # a folder comes right before what lies in it, if "/" counts as the least character
    for path in sorted({p.rstrip("/") for p in paths}, key=lambda p: p.split("/")):
        if not kept or not path.startswith(kept[-1] + "/"):
            kept.append(path)
    return kept


def corpora_table(spark: SparkSession, corpora: Sequence[Corpus]) -> DataFrame:
    """``(corpus, path)`` of listed corpora."""
    rows = [(c.name, path) for c in corpora for path in c.paths]
    return spark.createDataFrame(rows, "corpus string, path string")


def manifest_table(spark: SparkSession, manifest: str) -> DataFrame:
    """``(corpus, path)`` of a manifest of any length, which stays a table."""
    rows = manifest_rows(read_csv(spark, manifest, row_key="row_no"), "row_no")
    return rows.select(F.col("name").alias("corpus"), "path")


def _plain(path: Column) -> Column:
    """A path without scheme, host, doubled and last slashes."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.rtrim(F.regexp_replace(bare, "/+", "/"), F.lit("/"))


def _ancestors(path: Column) -> Column:
    """A plain path and all folders above it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _listed(spark: SparkSession, places: Sequence[str]) -> DataFrame:
    """``(file, path, kind)`` of all files with a known suffix: their names, not their contents."""
    reader = spark.read.format("binaryFile").options(recursiveFileLookup=True, pathGlobFilter=_glob(*SUFFIXES))
    file = F.col("_metadata.file_path")
    found = reader.load(list(places)).select(file.alias("file"), _plain(T.decoded_path(file)).alias("path"))
    return found.withColumn("kind", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)))


def files_of_corpora(spark: SparkSession, paths: DataFrame, places: Sequence[str]) -> DataFrame:
    """``(file, kind, corpus, path)``: the files under ``places`` that belong to the corpora of ``(corpus, path)``.

    A file meets the paths by the folders above it, in one join for all paths. Of several paths of one
    corpus that hold it the outermost counts; it may belong to several corpora. Paths are compared
    without scheme and host. Paths without files fail.
    """
    named = paths.select("corpus", F.col("path").alias("given"), _plain(F.col("path")).alias("at")).distinct()
    last = F.substring_index("at", "/", -1)
    other = last.contains(".") & ~F.lower(last).rlike(r"\.(%s)$" % "|".join(s[1:] for s in SUFFIXES))
    if unknown := named.where(other).select("given").take(1):
        raise ValueError(f"unsupported file type: {unknown[0].given}")
    above = _listed(spark, places).select("file", "kind", F.explode(_ancestors(F.col("path"))).alias("at"))
    met = above.join(named, "at").groupBy("file", "kind", "corpus").agg(
        F.min_by(F.struct("given", "at"), F.length("at")).alias("path")
    )
    files = materialize(met.select("file", "kind", "corpus", "path.given", "path.at"), "corpus-files")
    held = files.select(F.explode(_ancestors(_plain(T.decoded_path(F.col("file"))))).alias("at")).distinct()
    if empty := [r.given for r in named.join(held, "at", "left_anti").select("given").take(5)]:
        raise ValueError(f"no supported files found in {empty}")
    return files.select("file", "kind", "corpus", F.col("given").alias("path"))


def discovered_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Files with a known suffix under the paths, as ``(path)``; fails if one has none."""
    table = corpora_table(spark, [Corpus("", tuple(paths))])
    files = files_of_corpora(spark, table, outermost(paths))
    return files.select(T.decoded_path(F.col("file")).alias("path"))


def _csv_texts(spark: SparkSession, places: Sequence[str], text: str, multi_line: bool) -> DataFrame:
    """``(file, text)`` of CSV files whose headers may differ, in one scan.

    The first lines tell in which column each file has its texts; the scan then reads cells by place. A
    row that repeats its file's header is no text. A file without the column fails.
    """
    options = {"recursiveFileLookup": True, "pathGlobFilter": _glob(".csv")}
    file, at = F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id()
    lines = spark.read.options(**options).text(list(places)).where("_metadata.file_block_start = 0")
    first = lines.select(file, "value", at.alias("at")).groupBy("file").agg(F.min_by("value", "at").alias("line"))
    cells = F.split(F.regexp_replace("line", "^\ufeff", ""), ',(?=(?:[^"]*"[^"]*")*[^"]*$)')
    bare = F.transform(cells, lambda c: F.replace(F.regexp_replace(c, '^"|"$', ""), F.lit('""'), F.lit('"')))
    headers = materialize(first.select(F.col("file").alias("of"), bare.alias("header")), "headers")
    if lacking := headers.where(~F.array_contains("header", text)).take(1):
        raise ValueError(f"columns ['{text}'] not found in {lacking[0]['of']}; available columns: {lacking[0].header}")
    width = headers.agg(F.max(F.size("header"))).first()[0] or 1
    names = [f"c{i}" for i in range(width)]
    schema = ", ".join(f"{n} string" for n in names)
    reader = spark.read.schema(schema).options(multiLine=multi_line, escape='"', encoding="UTF-8", **options)
    rows = reader.csv(list(places)).select(file, F.array(*names).alias("cells")).join(headers, F.col("file") == F.col("of"))
    own = F.get("cells", F.array_position("header", text).cast("int") - 1)
    is_header = F.slice("cells", 1, F.size("header")) == F.col("header")
    return missing_to_null(rows.where(~F.coalesce(is_header, F.lit(False))).select("file", own.alias("text")))


def read_corpora(
    spark: SparkSession,
    corpora: Sequence[Corpus] | DataFrame,
    text: str | None = None,
    multi_line: bool = True,
    root: str | None = None,
) -> DataFrame:
    """Texts of all corpora as ``(corpus, path, text)``.

    A ``.txt`` file holds one text per non-empty line; a table holds texts in the
    column ``text``, whose absence is an error (a single Parquet file without it, among others that
    have it, has no texts). ``corpora`` is a list or a table ``(corpus, path)``. All files
    under ``root``, or under the paths of a list, are read by one scan for each suffix, whatever
    the number of paths, and rows meet their corpora by the name of their file.
    """
    listed = not isinstance(corpora, DataFrame)
    if not listed and root is None:
        raise ValueError("a table of corpora needs the root folder of its paths")
    paths = corpora_table(spark, corpora) if listed else corpora
    places = [root] if root is not None else outermost([p for c in corpora for p in c.paths])
    files = files_of_corpora(spark, paths, places)
    kinds = {r.kind for r in files.select("kind").distinct().collect()}
    if kinds & {"csv", "parquet"} and text is None:
        raise ValueError("a text column must be named for the tables among the corpora")
    file = F.col("_metadata.file_path").alias("file")
    parts = []
    if "txt" in kinds:
        lines = spark.read.options(recursiveFileLookup=True, pathGlobFilter=_glob(".txt")).text(places)
        parts.append(lines.select(file, T.drop_undecodable(F.col("value")).alias("text")))
    if "csv" in kinds:
        parts.append(_csv_texts(spark, places, text, multi_line))
    if "parquet" in kinds:
        options = {"recursiveFileLookup": True, "pathGlobFilter": _glob(".parquet"), "mergeSchema": True}
        tables = require_columns(spark.read.options(**options).parquet(*places), text)
        parts.append(tables.select(file, F.col(text).cast("string").alias("text")))
    rows = union_tables(*[text_column(part, "text") for part in parts])
    return rows.join(files.select("file", "corpus", "path"), "file").select("corpus", "path", "text")


def joined_paths(paths: DataFrame, order: str) -> DataFrame:
    """``(corpus, corpus_paths)`` of a table of paths, joined in ``order`` for reports."""
    placed = F.array_sort(F.collect_list(F.struct(order, "path")))
    return paths.groupBy("corpus").agg(F.array_join(F.transform(placed, lambda x: x["path"]), " | ").alias("corpus_paths"))


def corpus_paths(spark: SparkSession, corpora: Sequence[Corpus]) -> DataFrame:
    """``(corpus, corpus_paths)`` with the paths joined for reports."""
    rows = [(c.name, " | ".join(c.paths)) for c in corpora]
    return spark.createDataFrame(rows, "corpus string, corpus_paths string")
