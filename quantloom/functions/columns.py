"""Small column helpers shared by all rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, places: int = 6) -> Column:
    """For comparing engines: round with the border a little below the half, where no short decimal lies."""
    scale = float(10**places)
    return F.floor(col(x) * F.lit(scale) + F.lit(0.50001)) / F.lit(scale)


def exact_round(x: Column | str, places: int = 2) -> Column:
    """Round the binary value, real ties to even. What the scaled product loses is found by splitting the number in halves, so that 60.345, which is stored a little lower, gives 60.34."""
    scale = F.lit(float(10**places))

    def body(v: Column) -> Column:
        y, wide = v * scale, v * F.lit(134217729.0)
        high = wide - (wide - v)
        lost = (high * scale - y) + (v - high) * scale
        low = F.floor(y)
        tie = F.when(lost > 0, low + 1).when(lost < 0, low).otherwise(low + low % 2)
        return F.when(y - low == 0.5, tie).otherwise(F.floor(y + 0.5)) / scale

    return once(col(x).cast("double"), body)


def told(x: Column | str) -> Column:
    """A value inside a text; null is told as ``None``."""
    return F.coalesce(col(x).cast("string"), F.lit("None"))


def age_hours(at: Column | str, now_micros: int | None) -> Column:
    """Hours from a time to the run's clock, given in microseconds since 1970."""
    return (F.lit(now_micros).cast("long") - F.unix_micros(col(at))) / F.lit(3600000000.0)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def ladder(x: Column | str, *steps: tuple[str, float, object], other: object = None, missing: object = None) -> Column:
    """First matching (comparison, bound, value) of an ordered list; ``other`` beyond it, ``missing`` for null."""
    tests = {">": Column.__gt__, ">=": Column.__ge__, "<": Column.__lt__, "<=": Column.__le__, "=": Column.__eq__}
    out = F.when(col(x).isNull(), F.lit(missing))
    for op, bound, value in steps:
        out = out.when(tests[op](col(x), F.lit(float(bound))), F.lit(value))
    return out.otherwise(F.lit(other))


def share(test: Column) -> Column:
    """Percentage of rows for which ``test`` holds (null counts as not)."""
    return F.avg(F.when(test, 1.0).otherwise(0.0)) * 100


def given(x: Column | str) -> Column:
    """Neither null nor zero."""
    return col(x).isNotNull() & (col(x) != 0)


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of ``x``, with ``x`` computed once however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """Non-overlapping occurrences of all phrases, summed; a listed phrase counts as often as it is listed."""
    listed = F.array(*map(F.lit, phrases))

    def count(t: Column) -> Column:
        return F.aggregate(listed, F.lit(0), lambda n, p: n + ((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p)).cast("int"))

    return once(text, count)


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the listed phrases occur; a phrase listed twice counts twice. Null has none."""
    return once(text, lambda t: F.size(F.filter(F.array(*map(F.lit, phrases)), lambda p: t.contains(p))))
