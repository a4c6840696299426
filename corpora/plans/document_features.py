"""Document features for the comparison of corpora."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.operators.hygiene import between_words, in_groups, require_columns, require_rows
from corpora.operators.linking import link_by_file, with_metadata
from corpora.operators.selection import numbered_by_key
from corpora.operators.splits import random_rows
from corpora.session import materialize


def selected_documents(
    table: DataFrame,
    order: str,
    text: str = "text",
    id_column: str | None = None,
    group: str | None = None,
    groups: Sequence[object] = (),
    min_words: int = 1,
    max_words: int | None = None,
    sample_n: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Cleaned documents within word bounds, with ``doc_id``.

    Without an id column, ids number the selected documents in ``order``, a unique
    key. If no document is left it fails.
    """
    needed = [text, order] + [c for c in (id_column, group) if c is not None]
    require_columns(table, *needed)
    rows = table if group is None else in_groups(table, group, groups)
    # Words are counted on the raw text, which spares cleaning the texts left out.
    rows = between_words(rows.dropna(subset=[text]), text, min_words, max_words)
    require_rows(rows, 1, "documents left after filtering")
    if sample_n is not None:
        rows = random_rows(materialize(rows, "counted"), order, sample_n, seed)
    rows = rows.withColumn(text, T.clean_document(F.col(text)))
    if id_column is not None:
        return rows.withColumn("doc_id", F.col(id_column).cast("string"))
    numbered = numbered_by_key(rows, order, "_number")
    place = F.col("_number") - 1
    name = F.concat(F.lit("doc_"), F.when(place < 1000000, F.lpad(place, 6, "0")).otherwise(place.cast("string")))
    return numbered.withColumn("doc_id", name).drop("_number")


def file_name(id: Column, fallback: Column) -> Column:
    """File name under which an analyser sees a document; different ids get different names.

    A name that is not the id itself ends with a digest of the id.
    """
    name, own = T.safe_key(id, fallback), id.cast("string")
    mark = F.concat(F.lit("-"), F.substring(F.md5(F.coalesce(own, F.lit(""))), 1, 16))
    unique = F.when(name.eqNullSafe(own), name).otherwise(F.concat(name, mark))
    return F.concat(unique, F.lit(".txt"))


def document_files(documents: DataFrame, fallback: str) -> DataFrame:
    """File name under which an analyser sees each document."""
    name = file_name(F.col("doc_id"), F.col(fallback))
    return documents.select("doc_id", name.alias("temp_filename")).distinct()


def features_with_metadata(
    features: DataFrame, documents: DataFrame, order: str, drop: Sequence[str] = ("text", "word_count")
) -> DataFrame:
    """Analyser output joined to its documents by file name, then to their metadata."""
    linked = link_by_file(features, document_files(documents, order))
    return with_metadata(linked, documents, order, drop)
