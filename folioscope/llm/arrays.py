"""Scans over arrays within a row, as expressions.

An accumulator that grows by a value a step is copied at each step, so a plain fold takes time with the square of the array's length. Here a fold runs
within blocks, then over the blocks' totals.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 256
#: Code points of one segment of a text that `cut` reads from.
SEGMENT = 1024


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _before(values: Column, first: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each value `first` combined with all before it, by one fold."""
    start = F.struct(first.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(values, start, lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])


def scan(values: Column, op: Callable[[Column, Column], Column], zero: int = 0, block: int = BLOCK) -> Column:
    """For each of the values (array<bigint>) all before it combined by `op`, an associative function with that zero."""

    def of(v: Column) -> Column:
        starts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(block))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(starts, lambda s: F.slice(v, s + 1, F.lit(block))), blocks)

    def blocks(parts: Column) -> Column:
        totals = F.transform(parts, lambda x: F.aggregate(x, F.lit(zero).cast("long"), op))
        heads = let(totals, lambda t: _before(t, F.lit(zero), op))
        return let(heads, lambda h: F.flatten(F.transform(parts, lambda x, k: _before(x, F.get(h, k), op))))

    return let(values, of)


def segments(text: Column) -> Column:
    """The text in segments of SEGMENT code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{SEGMENT}}}"), F.lit(0))


def cut(parts: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text in `segments`; substring() would walk the text from its start each time."""
    i, j = F.floor(a / SEGMENT).cast("int"), F.floor(b / SEGMENT).cast("int")
    within = lambda x: (x % SEGMENT).cast("int")
    head = lambda k, n: F.coalesce(F.substring(F.get(parts, k), F.lit(1), n), F.lit(""))
    long = F.concat(F.coalesce(F.substring(F.get(parts, i), within(a) + 1, F.lit(SEGMENT)), F.lit("")), F.array_join(F.slice(parts, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), head(j, within(b)))
    return F.when(b <= a, "").when(i == j, F.substring(F.get(parts, i), within(a) + 1, (b - a).cast("int"))).otherwise(long)
