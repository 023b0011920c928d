"""Arithmetic shared by every operator: half-even rounding, clamps, integer division."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def round_even(c: Column) -> Column:
    """Whole number nearest to ``c``, ties to even (``rint`` keeps it in generated code)."""
    return F.rint(c)


def clamp(c: Column, lo, hi) -> Column:
    return F.least(F.greatest(c, lit(lo)), lit(hi))


def idiv(a: Column, b) -> Column:
    """Integer division of non-negative integers."""
    return F.floor(a / lit(b)).cast("bigint")


def r6(c: Column) -> Column:
    return F.round(c, 6)
