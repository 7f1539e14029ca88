"""Aggregate and scalar expressions. NULLs are skipped; denominators of zero give NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a).cast("double"), F.nullif(col(b).cast("double"), F.lit(0.0)))


def quantile(c: str | Column, q: float | Sequence[float]) -> Column:
    """Exact, with linear interpolation, as an aggregate of a group: it holds the group's
    distinct values. For whole columns of a large table there is `operators.quantiles`."""
    return F.percentile(col(c).cast("double"), list(q) if isinstance(q, (list, tuple)) else q)


def skew(c: str | Column) -> Column:
    """Adjusted Fisher-Pearson; NULL under three values, 0 for constant ones."""
    x = col(c).cast("double")
    n = F.count(x).cast("double")
    g = F.nanvl(F.skewness(x), F.lit(0.0))
    return F.when(n >= 3, F.coalesce(g, F.lit(0.0)) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def kurt(c: str | Column) -> Column:
    """Bias-corrected excess kurtosis; NULL under four values."""
    x = col(c).cast("double")
    n = F.count(x).cast("double")
    g = F.nanvl(F.kurtosis(x), F.lit(None).cast("double"))
    value = F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * g + 6)
    return F.when(n >= 4, value)


def zscore_fences(c: str | Column, t: float = 3.0) -> tuple[Column, Column]:
    """Mean and population deviation; a constant column has both fences at its mean."""
    x = col(c).cast("double")
    return F.avg(x) - t * F.stddev_pop(x), F.avg(x) + t * F.stddev_pop(x)


def outside(x: str | Column, lo: Column, hi: Column) -> Column:
    """False for NULL values and fences, and where the fences meet."""
    return F.coalesce((lo != hi) & ((col(x) < lo) | (col(x) > hi)), F.lit(False))


def money(c: str | Column) -> Column:
    """A sum that doesn't depend on the order of its parts: to four decimals."""
    return F.sum(col(c).cast("decimal(18,4)")).cast("double")


def average_rank(order: Column, *partition: str) -> Column:
    """Rank from 1, ties their mean rank."""
    from pyspark.sql.window import Window as W

    w = W.partitionBy(*partition)
    ties = W.partitionBy(*partition, order)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(ties) - 1) / 2.0
