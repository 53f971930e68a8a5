"""Array columns in linear time: no fold here copies a result that grows with the row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block, at least; larger arrays take blocks of the square root of their size.
WIDTH = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is mentioned."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(values: Column) -> Column:
    """The array in blocks, an array of arrays; mention a bound value only."""
    n = F.size(values)
    width = F.greatest(F.lit(WIDTH), F.ceil(F.sqrt(n)).cast("int"))
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, width)).otherwise(F.expr("CAST(array() AS array<int>)"))
    return F.transform(starts, lambda s: F.slice(values, s + 1, width))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of integers what ``combine`` makes of those before it; 0 is its neutral element."""

    def fold(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("last"), F.expr("CAST(array() AS array<int>)").alias("before"))
        return F.aggregate(part, start, lambda acc, x: F.struct(combine(acc["last"], x).alias("last"), F.array_append(acc["before"], acc["last"]).alias("before")))

    def joined(inner: Column) -> Column:
        bases = fold(F.transform(inner, lambda i: i["last"]))["before"]
        return F.flatten(F.zip_with(inner, bases, lambda i, base: F.transform(i["before"], lambda x: combine(base, x))))

    return bound(values, lambda v: bound(F.transform(blocks(v), fold), joined))
