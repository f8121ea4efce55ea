"""Interval, test and agreement formulas as Column expressions (no Python workers)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallysmith.functions.numbers import as_column, share

# Fixed value: the two-sided 95 % quantile of the standard normal distribution.
Z95 = 1.959963984540054

# McNemar uses the exact binomial below this many discordant pairs.
EXACT_LIMIT = 25
EXACT_MOST = 1000


def wilson_bounds(correct: Column | str, total: Column | str) -> tuple[Column, Column]:
    """Lower and upper 95 % Wilson score bounds; NULL when there are no trials."""
    c = as_column(correct).cast("double")
    n = as_column(total).cast("double")
    z2 = F.lit(Z95 * Z95)
    centre = F.try_divide(c + z2 / 2, n + z2)
    half = F.try_divide(F.lit(Z95) * F.sqrt(F.try_divide(c * (n - c), n) + z2 / 4), n + z2)
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def erfc(value: Column) -> Column:
    """Complementary error function for value >= 0.

    Below 2 the all-positive power series of erf converges fast and 1 - erf keeps its digits; from 2 on
    the continued fraction, evaluated backwards, keeps relative accuracy far into the tail.
    """
    x2 = value * value
    term = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def grow(acc: Column, k: Column) -> Column:
        t = acc["t"] * 2.0 * x2 / (k * 2.0 + 1.0)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    series = F.aggregate(F.sequence(F.lit(1), F.lit(60)), term, grow, lambda acc: acc["s"])
    small = F.lit(1.0) - F.lit(2.0 / math.sqrt(math.pi)) * value * F.exp(-x2) * series
    tail = F.aggregate(
        F.sequence(F.lit(80), F.lit(1), F.lit(-1)), value, lambda acc, k: value + (k / 2.0) / acc
    )
    large = F.exp(-x2) / (F.lit(math.sqrt(math.pi)) * tail)
    return F.when(value < 2.0, small).otherwise(large)


def mcnemar_exact(b: Column | str, c: Column | str) -> Column:
    """Two-sided exact binomial p-value from the two discordant counts; NULL above ``EXACT_MOST`` of them,
    where a double no longer holds the first term."""
    b, c = as_column(b).cast("double"), as_column(c).cast("double")
    n, k = b + c, F.least(b, c)
    first = F.pow(F.lit(2.0), -n)
    start = F.struct(first.alias("term"), first.alias("total"))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(EXACT_MOST)).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
    tail = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(n <= EXACT_MOST, F.least(F.lit(1.0), F.lit(2.0) * tail))


def mcnemar_asymptotic(b: Column | str, c: Column | str) -> Column:
    """Continuity-corrected chi-square (1 degree of freedom) p-value; NULL without discordant pairs."""
    b, c = as_column(b).cast("double"), as_column(c).cast("double")
    stat = F.try_divide(F.pow(F.abs(b - c) - 1, F.lit(2)), b + c)
    return erfc(F.sqrt(stat / 2))


def mcnemar(b: Column | str, c: Column | str) -> Column:
    small = as_column(b) + as_column(c) < EXACT_LIMIT
    return F.when(small, mcnemar_exact(b, c)).otherwise(mcnemar_asymptotic(b, c))


def chance_corrected(observed: Column, expected: Column) -> Column:
    """(po - pe) / (1 - pe); when chance explains everything, 1 if observed is perfect, else NULL."""
    degenerate = F.when(observed == 1.0, F.lit(1.0))
    return F.when(expected == 1.0, degenerate).otherwise(
        F.try_divide(observed - expected, F.lit(1.0) - expected)
    )


def cohen_kappa(n00: Column, n01: Column, n10: Column, n11: Column) -> Column:
    """Cohen's kappa from the four cells of a 2x2 table (first index: rater A)."""
    n = n00 + n01 + n10 + n11
    observed = share(n00 + n11, n)
    expected = share(n00 + n01, n) * share(n00 + n10, n) + share(n10 + n11, n) * share(n01 + n11, n)
    return chance_corrected(observed, expected)


def fleiss_item_agreement(ones: Column, raters: Column) -> Column:
    """Share of agreeing rater pairs for one item with binary labels."""
    zeros = raters - ones
    return share(ones * (ones - 1) + zeros * (zeros - 1), raters * (raters - 1))


def fleiss_kappa(mean_item_agreement: Column, ones: Column, items: Column, raters: Column) -> Column:
    """Fleiss' kappa for binary labels; NULL with no items or fewer than two raters."""
    p1 = share(ones, items * raters)
    expected = p1 * p1 + (F.lit(1.0) - p1) * (F.lit(1.0) - p1)
    return F.when((items > 0) & (raters >= 2), chance_corrected(mean_item_agreement, expected))
