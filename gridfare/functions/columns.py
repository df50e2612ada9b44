"""Small column builders used across operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def r6(c: str | Column) -> Column:
    """Six decimals, the precision results are compared at."""
    return F.round(col(c), 6)


def ratio(top: Column, bottom: Column, default: float | None = 0.0) -> Column:
    """``top / bottom``, or ``default`` when the bottom is zero or null."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(default).cast("double"))


def half_even(c: Column) -> Column:
    """Round half to even, to a long."""
    return F.bround(c, 0).cast("long")


def flag(condition: Column) -> Column:
    """1 when true, 0 when false or null."""
    return F.when(condition, 1).otherwise(0).cast("long")


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def total(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, also when it is used inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def image_number(name: Column) -> Column:
    """The integer inside ``img_N.jpg``, null when the name has another shape."""
    digits = F.regexp_extract(name, r"^img_(\d+)\.jpg$", 1)
    return F.when(digits != "", digits.cast("long"))
