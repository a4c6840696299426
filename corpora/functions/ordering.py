"""Reproducible pseudo-random order and monotone buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_DIGITS = 4
VALUE_BUCKETS = 1 << 20
#: Buckets for each doubling of the distance beyond the bounds.
OUTER_STEPS = 4096


def order_hash(*keys: Column, seed: int | str = 42) -> Column:
    """Hex digest that orders rows; equal on every engine and for every partitioning."""
    parts = [F.lit(f"{seed}")]
    for key in keys:
        parts += [F.lit(":"), key.cast("string")]
    return F.md5(F.concat(*parts))


def hash_bucket(digest: Column, digits: int = HASH_DIGITS) -> Column:
    """Leading hex digits: equal-sized buckets in digest order."""
    return F.substring(digest, 1, digits)


def value_bucket(value: Column, low: Column, high: Column, buckets: int = VALUE_BUCKETS) -> Column:
    """Bucket number that never falls as ``value`` rises.

    Buckets are even between ``low`` and ``high``. Beyond, they widen with the distance,
    so that values far outside are still spread over many.
    """
    low, high, value = (c.cast("double") for c in (low, high, value))
    span = F.when(high > low, high - low).otherwise(F.lit(1.0))
    share = (value - low) / span
    clipped = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    inside = F.least(F.floor(clipped * buckets), F.lit(buckets - 1).cast("bigint"))
    above = buckets + F.floor(F.log2(F.greatest(share, F.lit(1.0))) * OUTER_STEPS)
    below = -1 - F.floor(F.log2(F.greatest(1 - share, F.lit(1.0))) * OUTER_STEPS)
    return F.when(share > 1, above).when(share < 0, below).otherwise(inside)
