"""Exact quantiles and ranks of large tables, without a task that holds a share of a column.

A sketch of each column brackets the wanted order statistics. A second pass counts what lies
below each bracket and, by value, what lies within; only values within brackets are put in
order, by ranges that many tasks share. Both passes aggregate before they shuffle, so hot
values and groups cost nothing. Ranks come from counts of distinct values, ordered by ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import running, written

#: One over the sketch's greatest error of a rank; a bracket holds at most four such errors.
ACCURACY = 20_000


def quantiles(df: DataFrame, columns: Sequence[str], probs: Sequence[float], by: Sequence[str] = (), accuracy: int = ACCURACY) -> DataFrame:
    """A row for each group and column: by, column, n and q (an array as long as probs).

    Exact, with linear interpolation; NULLs are skipped, and a column without values has no
    row. Groups are broadcast, a row a group and column: by must name few of them."""
    error, last = 1.0 / accuracy, len(probs)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns)))
    keys = [*by, "column"]
    long = df.select(*by, cells.alias("r")).select(*by, "r.*").where(F.col("x").isNotNull())
    ends = [max(0.0, p - 2 * error) for p in probs] + [min(1.0, p + 2 * error) for p in probs]
    sketch = long.groupBy(*keys).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", ends, accuracy).alias("ends"))
    few = F.col("n") < 4 * accuracy
    low = [F.when(few | F.lit(e <= 0), F.col("least")).otherwise(F.col("ends")[k]).alias(f"lo{k}") for k, e in enumerate(ends[:last])]
    high = [F.when(few | F.lit(e >= 1), F.col("most")).otherwise(F.col("ends")[last + k]).alias(f"hi{k}") for k, e in enumerate(ends[last:])]
    sides = F.broadcast(sketch.select(*[F.col(k).alias(f"_{k}") for k in keys], "n", *low, *high))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    rows = long.join(sides, _all(same))
    inside = F.lit(False)
    for k in range(last):
        inside = inside | F.col("x").between(F.col(f"lo{k}"), F.col(f"hi{k}"))
    bounds = [f"{s}{k}" for k in range(last) for s in ("lo", "hi")]
    counted = rows.groupBy(*keys, "n", *bounds, F.when(inside, F.col("x")).alias("x")).agg(
        F.count(F.lit(1)).alias("c"), *(F.count_if(F.col("x") < F.col(f"lo{k}")).alias(f"b{k}") for k in range(last))
    )
    counted = written(counted, "brackets")
    below = counted.groupBy(*keys).agg(*(F.sum(f"b{k}").alias(f"b{k}") for k in range(last)))
    below = F.broadcast(below.select(*(F.col(k).alias(f"_{k}") for k in keys), *(f"b{k}" for k in range(last))))  # a row a group and column
    counted = counted.drop(*(f"b{k}" for k in range(last))).where(F.col("x").isNotNull()).join(below, _all(same))
    parts = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(float(p)).alias("p"), *(F.col(f"{s}{k}").alias(s) for s in ("lo", "hi", "b"))) for k, p in enumerate(probs))))
    near = counted.select(*keys, "n", "x", "c", parts.alias("r")).select(*keys, "n", "x", "c", "r.*").where(F.col("x").between(F.col("lo"), F.col("hi")))
    near = running(near.drop("lo", "hi"), [*keys, "k"], [F.asc("x")], "c")
    upto = F.col("b") + F.col("before") + F.col("c")
    place = (F.col("n") - 1) * F.col("p")
    near = near.withColumns({"upto": upto, "place": place})
    at = near.groupBy(*keys, "n", "k", "place").agg(F.min(F.when(F.col("upto") > F.floor("place"), F.col("x"))).alias("v"), F.min(F.when(F.col("upto") > F.ceil("place"), F.col("x"))).alias("w"))
    value = F.when(F.col("v") == F.col("w"), F.col("v")).otherwise(F.col("v") + (F.col("place") - F.floor("place")) * (F.col("w") - F.col("v")))
    q = F.array(*(F.max(F.when(F.col("k") == k, value)) for k in range(last)))
    return at.groupBy(*keys, "n").agg(q.alias("q"))


def _all(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def quantile_row(df: DataFrame, wanted: Mapping[str, tuple[str, float]]) -> DataFrame:
    """One row with a column for each name: the quantile of (column, probability); NULL
    without values."""
    columns = list(dict.fromkeys(c for c, _ in wanted.values()))
    probs = sorted({p for _, p in wanted.values()})
    q = quantiles(df, columns, probs)
    return q.agg(*(F.max(F.when(F.col("column") == c, F.col("q")[probs.index(p)])).alias(name) for name, (c, p) in wanted.items()))


def average_ranks(df: DataFrame, series: Sequence[str]) -> DataFrame:
    """(series, x, n, rank) of the distinct values of each named column: how often each occurs,
    and the mean of the ranks (from 1) of its rows. NULLs have no rank."""
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("series"), F.col(c).cast("double").alias("x")) for c in series)))
    counts = df.select(cells.alias("r")).select("r.*").where(F.col("x").isNotNull()).groupBy("series", "x").agg(F.count(F.lit(1)).alias("n"))
    return running(counts, ["series"], [F.asc("x")], "n").select("series", "x", "n", (F.col("before") + (F.col("n") + 1) / 2.0).alias("rank"))
