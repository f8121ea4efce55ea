"""Numeric column helpers shared by all reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def round_to(value: Column | str, digits: int) -> Column:
    """Round half to even on the scaled value; report figures are rounded this way.

    Adding zero turns a negative zero into a plain zero.
    """
    scale = F.lit(float(10**digits))
    return F.rint(as_column(value) * scale) / scale + F.lit(0.0)


def round_mean(value: Column | str, digits: int) -> Column:
    """Rounding for means of doubles, whose last bits depend on the order of addition.

    Rounding to a few more digits first removes those bits, so a tie is a tie in every run.
    """
    return round_to(round_to(value, digits + 6), digits)


def to_number(value: Column | str) -> Column:
    """Number, or NULL for junk, blanks and NaN, so that averages skip it."""
    number = as_column(value).try_cast("double")
    return F.when(~F.isnan(number), number)


def to_whole(value: Column | str, kind: str = "int") -> Column:
    """Integer, fraction cut off; NULL for junk and for what the type cannot hold. Long integers keep all digits."""
    value = as_column(value)
    return F.coalesce(value.try_cast(kind), to_number(value).try_cast(kind))


def to_flag(value: Column | str) -> Column:
    """0/1 integer from any representation; junk counts as 0."""
    return F.coalesce(to_whole(value), F.lit(0))


def truthy(value: Column | str) -> Column:
    """Review-sheet tick boxes: true, 1, 1.0 and yes are ticked, everything else is not."""
    text = F.lower(F.trim(as_column(value).cast("string")))
    return F.coalesce(text.isin("true", "1", "1.0", "yes"), F.lit(False))


def share(part: Column, whole: Column) -> Column:
    """Ratio as a double, NULL when the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def band_distance(value: Column | str, low: float, high: float) -> Column:
    """0 inside [low, high], otherwise the distance to the nearer end."""
    v = as_column(value)
    return F.when(v.isNotNull(), F.greatest(F.lit(low) - v, v - F.lit(high), F.lit(0.0)))


def in_band(value: Column | str, low: float, high: float) -> Column:
    return as_column(value).between(low, high)
