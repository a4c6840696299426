"""A training corpus within a token budget, with a fixed evaluation part."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.functions.ordering import order_hash
from corpora.operators.hygiene import require_rows
from corpora.operators.selection import overflow_point
from corpora.operators.splits import eval_and_subsets
from corpora.session import materialize
from corpora.sources.tables import text_column


def text_keys(
    documents: DataFrame,
    key: str,
    text: str = "text",
    dedup: bool = True,
    length_of: Callable[[Column], Column] = T.token_length,
    min_char_len: int = 1,
) -> DataFrame:
    """``(key, length)`` of the texts of at least ``min_char_len`` characters, the first of equal ones.

    Everything up to the final read works on this narrow table. The aggregation is
    combined before the shuffle, so copies of one text cost nothing extra.
    """
    stripped = text_column(documents, text).select(key, F.col(text).alias("_text"))
    stripped = stripped.where(F.length("_text") >= min_char_len)
    length = length_of(F.col("_text")).cast("bigint")
    if not dedup:
        return stripped.select(key, length.alias("length"))
    return (
        stripped.select(key, F.sha2("_text", 256).alias("_digest"), length.alias("length"))
        .groupBy("_digest")
        .agg(F.min(key).alias(key), F.max("length").alias("length"))
        .drop("_digest")
    )


def budgeted_parts(
    documents: DataFrame,
    key: str,
    text: str = "text",
    max_length: int = 512,
    max_tokens: int = 0,
    fraction: float = 1.0,
    eval_share: float = 0.05,
    dedup: bool = True,
    seed: int = 42,
    least: int = 100,
    length_of: Callable[[Column], Column] = T.token_length,
    min_char_len: int = 1,
) -> DataFrame:
    """Every usable text with its way through the plan, one narrow row per key.

    ``(key, length, part, in_subset, short, kept)``. The order is: duplicates out,
    evaluation part, subset of the training pool, length limit, token budget. The
    evaluation part is limited in length but never capped. The budget is filled in
    hash order and ends at the first text that would pass it. ``length_of`` counts the
    tokens of a text column, see :func:`corpora.functions.text.length_by`.
    """
    keys = materialize(text_keys(documents, key, text, dedup, length_of, min_char_len), "text-keys")
    require_rows(keys, least, "texts")
    parts = eval_and_subsets(keys, key, [fraction], eval_share, seed)
    in_subset = (F.col("part") == "eval") | F.col("subset").isNotNull()
    parts = parts.withColumns({"in_subset": in_subset, "short": F.col("length") <= max_length})
    parts = materialize(parts.drop("subset"), "parts")
    usable = parts.where(F.col("in_subset") & F.col("short"))
    pool = usable.where(F.col("part") == "train")
    require_rows(pool, least, "training texts within the length limit")
    order = order_hash(F.col(key), seed=seed)
    affordable = F.lit(True)
    if max_tokens > 0:
        past = overflow_point(pool, order, F.col("length"), max_tokens).scalar()
        first = pool.agg(F.min(order)).scalar()
        none = F.raise_error(F.lit(f"a budget of {max_tokens} tokens keeps no text"))
        end = F.when(past == first, none.cast("string")).otherwise(F.coalesce(past, F.lit("g")))
        affordable = (F.col("part") == "eval") | (order < end)
    kept = F.col("in_subset") & F.col("short") & affordable
    return parts.withColumn("kept", kept)


def budgeted_corpus(documents: DataFrame, parts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Documents that stay, stripped as they were measured, with their part.

    The one place where texts move.
    """
    return text_column(documents, text).join(parts.where("kept").select(key, "part", "length"), key)


def budget_report(parts: DataFrame, tokenizer: str = T.TOKENIZER) -> DataFrame:
    """Rows and tokens of both parts at each stage of the plan."""
    stages = {
        "split": F.lit(True),
        "subset": F.col("in_subset"),
        "length": F.col("in_subset") & F.col("short"),
        "budget": F.col("kept"),
    }
    zero = F.lit(0).cast("bigint")
    measures = F.array(
        *[
            F.struct(
                F.lit(place).alias("stage_no"),
                F.lit(stage).alias("stage"),
                F.count(F.when(stays, 1)).alias("n_rows"),
                F.sum(F.when(stays, F.col("length")).otherwise(zero)).alias("n_tokens"),
            )
            for place, (stage, stays) in enumerate(stages.items())
        ]
    )
    return (
        parts.groupBy("part")
        .agg(measures.alias("_stages"))
        .select("part", F.inline("_stages"), F.lit(tokenizer).alias("tokenizer"))
    )
