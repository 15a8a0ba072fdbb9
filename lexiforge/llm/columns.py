"""Column expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it and wherever the optimiser moves it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def running_sums(values: Column) -> Column:
    """Inclusive sums of an array of whole numbers, in passes that each reach 64 times as far back as the one before."""

    def reach(a: Column, step: int) -> Column:
        if step > 1 << 30:
            return a
        back = lambda x, i: F.aggregate(F.sequence(F.lit(1), F.lit(63)), x.cast("int"), lambda s, j: s + F.coalesce(F.get(a, i - j * step), F.lit(0)))
        return F.when(F.size(a) <= step, a).otherwise(let(F.transform(a, back), lambda b: reach(b, step * 64)))

    return let(values, lambda a: reach(a, 1))


def running_max(values: Column) -> Column:
    """Inclusive maxima of an array, in passes that each reach 64 times as far back as the one before."""

    def reach(a: Column, step: int) -> Column:
        if step > 1 << 30:
            return a
        back = lambda x, i: F.aggregate(F.sequence(F.lit(1), F.lit(63)), x, lambda s, j: F.greatest(s, F.get(a, i - j * step)))
        return F.when(F.size(a) <= step, a).otherwise(let(F.transform(a, back), lambda b: reach(b, step * 64)))

    return let(values, lambda a: reach(a, 1))


SPANS = "array<struct<start:int,end:int,match:string,before:string,after:string>>"


def spans(text: Column, pattern: str, context: int = 32) -> Column:
    """The matches of a pattern, leftmost first and without overlap: code points [start, end), the match, and up to
    ``context`` characters on either side that belong to no match."""

    def placed(match: Column, piece: Column) -> Column:
        steps = F.transform(match, lambda x, i: F.length(F.get(piece, i)) + F.coalesce(F.length(F.get(match, i - 1)), F.lit(0)))
        of = lambda at: F.transform(match, lambda x, i: F.struct(
            F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("match"),
            F.right(F.get(piece, i), F.lit(context)).alias("before"), F.left(F.get(piece, i + 1), F.lit(context)).alias("after"),
        ))
        return F.when(F.size(match) == 0, F.array().cast(SPANS)).otherwise(let(running_sums(steps), of))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: let(F.split(text, pattern, -1), lambda p: placed(m, p)))
