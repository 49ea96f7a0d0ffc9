"""Column helpers for sums, ratios and statistics that never raise and treat NULL as the library does."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def zero() -> Column:
    return F.lit(0.0)


def no_nan(c: Column) -> Column:
    """NULL for NaN, so that comparisons drop it."""
    return F.when(~F.isnan(c), c)


def ratio(num: Column, den: Column, other: Column | None = None) -> Column:
    """num / den where den > 0, else `other` (0.0)."""
    return F.when(den > 0, num / den).otherwise(zero() if other is None else other)


def total(columns: Iterable[Column]) -> Column:
    """Sum that skips NULL."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, zero()) for c in columns])


def plain_sum(columns: Iterable[Column]) -> Column:
    """Sum that is NULL if any part is."""
    return reduce(lambda a, b: a + b, list(columns))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation of the rows where both are set; NULL if either is constant."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    spread = F.stddev_pop(a) * F.stddev_pop(b)
    return F.when(spread > 0, F.covar_pop(a, b) / spread)


def micros_of(ts: Column) -> Column:
    return F.unix_micros(ts)


def time_of(us: Column) -> Column:
    return F.timestamp_micros(us)


def floor_to(us: Column, step: int) -> Column:
    return us - F.pmod(us, F.lit(step))


def ceil_to(us: Column, step: int) -> Column:
    return us + F.pmod(-us, F.lit(step))
