"""Ordered window primitives as columns over ``PARTITION BY symbol ORDER BY ts`` or a window given."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from .clean import finite, series


def raw_change(c: str, w: WindowSpec | None = None) -> Column:
    """Relative change; 0 on the first row and for 0 to 0, missing for 0 to anything else."""
    w = w or series()
    now, before = F.col(c), F.lag(c).over(w)
    return F.when(F.row_number().over(w) == 1, F.lit(0.0)).when((before == 0) & (now == 0), F.lit(0.0)).when(before == 0, F.lit(None).cast("double")).otherwise(F.try_divide(now, before) - 1)


def pct_change(c: str, w: WindowSpec | None = None) -> Column:
    return F.coalesce(raw_change(c, w), F.lit(0.0))


def pct_change_inf(c: str, w: WindowSpec | None = None) -> Column:
    """As ``pct_change``, but plus or minus infinity where a price leaves 0."""
    w = w or series()
    leaves = (F.lag(c).over(w) == 0) & (F.col(c) != 0)
    return F.when(leaves, F.signum(c) * F.lit(float("inf"))).otherwise(pct_change(c, w))


def diff(c: str, w: WindowSpec | None = None) -> Column:
    return F.col(c) - F.lag(c).over(w or series())


def shift(c: str, n: int = 1, w: WindowSpec | None = None) -> Column:
    return F.lag(c, n).over(w or series())


def _last(n: int, w: WindowSpec | None) -> WindowSpec:
    return (w or series()).rowsBetween(1 - n, Window.currentRow)


def rolling_mean(c: str, n: int, w: WindowSpec | None = None) -> Column:
    """Mean of the last n rows; missing unless all n are there."""
    f = _last(n, w)
    return F.when(F.count(c).over(f) == n, F.avg(c).over(f))


def rolling_std(c: str, n: int, w: WindowSpec | None = None, ddof: int = 1) -> Column:
    """Standard deviation of the last n rows; missing if any is missing or infinite."""
    f, x = _last(n, w), finite(F.col(c))
    std = F.stddev_samp if ddof else F.stddev_pop
    return F.when(F.count(x).over(f) == n, std(x).over(f))


def expanding_max(c: str, w: WindowSpec | None = None) -> Column:
    return F.max(c).over((w or series()).rowsBetween(Window.unboundedPreceding, Window.currentRow))


def clip_low(c: Column, low: float = 0.0) -> Column:
    """Like ``greatest``, but a missing value stays missing."""
    return F.when(c.isNotNull(), F.greatest(c, F.lit(low)))


def clip_high(c: Column, high: float = 0.0) -> Column:
    return F.when(c.isNotNull(), F.least(c, F.lit(high)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
