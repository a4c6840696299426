"""Token sequences for language models: truncation and static masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpora.functions import text as T
from corpora.functions.ordering import order_hash
from corpora.operators.selection import numbered_by_key

# Markers around a sequence and in place of a masked token.
START, END, MASK = "[CLS]", "[SEP]", "[MASK]"


def truncated_sequence(documents: DataFrame, max_length: int, text: str = "text") -> DataFrame:
    """Adds ``tokens`` of at most ``max_length`` including both markers.

    ``special_tokens_mask`` is 1 at the markers, ``length`` the number of tokens and
    ``truncated`` tells whether content was cut.
    """
    room = max_length - 2
    content = F.slice("_content", 1, room)
    ordinary = F.array_repeat(F.lit(0), F.size(content))
    return (
        documents.withColumn("_content", T.tokens(F.col(text)))
        .withColumns(
            {
                "tokens": F.concat(F.array(F.lit(START)), content, F.array(F.lit(END))),
                "special_tokens_mask": F.concat(F.array(F.lit(1)), ordinary, F.array(F.lit(1))),
                "length": F.least(F.size("_content"), F.lit(room)) + 2,
                "truncated": F.size("_content") > room,
            }
        )
        .drop("_content")
    )


def _within(digest: Column, share: float) -> Column:
    """Whether a digest is among that share of all digests."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(share * 16**8)


def masked_positions(
    documents: DataFrame,
    key: str,
    probability: float = 0.15,
    seed: int = 42,
    text: str = "text",
    max_length: int | None = None,
) -> DataFrame:
    """Positions to predict: ``(key, position, label, action, input)``.

    A position is chosen by the hash of seed, document and position. Of the chosen
    ones 80% become the mask marker, 10% a random token (``input`` is NULL until
    :func:`with_random_tokens` fills it) and 10% stay. With ``max_length`` positions are
    those of :func:`truncated_sequence` of that length, counted without its markers.
    """
    chosen = order_hash(F.col(key), F.col("position"), seed=seed)
    fate = order_hash(F.col(key), F.col("position"), seed=f"{seed}:action")
    action: Column = (
        F.when(_within(fate, 0.8), F.lit("mask"))
        .when(_within(fate, 0.9), F.lit("random"))
        .otherwise(F.lit("keep"))
    )
    shown = F.when(F.col("action") == "mask", F.lit(MASK)).when(
        F.col("action") == "keep", F.col("label")
    )
    content = T.tokens(F.col(text))
    if max_length is not None:
        content = F.slice(content, 1, max_length - 2)
    return (
        documents.select(key, F.posexplode(content).alias("position", "label"))
        .where(_within(chosen, probability))
        .withColumn("action", action)
        .withColumn("input", shown)
    )


def with_random_tokens(
    masked: DataFrame, vocabulary: DataFrame, key: str, seed: int = 42
) -> DataFrame:
    """:func:`masked_positions` with a token of the vocabulary at random positions.

    ``vocabulary`` holds distinct tokens in the column ``token``. The token is picked
    by the hash of seed, document and position, evenly over the vocabulary; only the
    random positions are joined.
    """
    numbered = numbered_by_key(vocabulary.select("token"), "token", "_place")
    size = numbered.agg(F.count(F.lit(1))).scalar()
    digest = order_hash(F.col(key), F.col("position"), seed=f"{seed}:token")
    number = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    random = masked.where(F.col("action") == "random").withColumn("_place", number % size + 1)
    filled = random.join(numbered, "_place").withColumn("input", F.col("token"))
    others = masked.where(F.col("action") != "random")
    return others.unionByName(filled.select(*masked.columns))
