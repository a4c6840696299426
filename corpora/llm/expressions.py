"""Small helpers for long column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once per row however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def total(numbers: Column) -> Column:
    """Sum of an array of longs; 0 for an empty one."""
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def starts(lengths: Column, block: int = 64) -> Column:
    """For each place of an array of lengths the sum of all before it.

    Sums are taken in two levels, over blocks and within a block, so that an array of many
    thousands takes far fewer steps than its square.
    """

    def of_blocks(values: Column) -> Column:
        count = F.floor((F.size(values) + (block - 1)) / block).cast("int")
        return F.transform(
            F.filter(F.sequence(F.lit(0), count), lambda b: b < count),
            lambda b: total(F.slice(values, b * block + 1, F.lit(block))),
        )

    def within(values: Column, blocks: Column) -> Column:
        before = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        return let(
            before,
            lambda base: F.transform(
                values,
                lambda _, i: F.get(base, (i / block).cast("int"))
                + total(F.slice(values, (i / block).cast("int") * block + 1, i % block)),
            ),
        )

    return let(lengths, lambda values: let(of_blocks(values), lambda blocks: within(values, blocks)))
