"""Audits and distribution diagnostics: one wide aggregation, then a row a column."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..functions.stats import average_rank, kurt, outside, ratio, skew
from .quantiles import average_ranks, quantiles
from .tables import written


def numeric_columns(df: DataFrame, leave: Sequence[str] = ("CustomerID", "InvoiceNo", "StockCode")) -> list[str]:
    """Numeric columns that are no identifiers."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name not in leave]


def stacked(df: DataFrame, columns: Sequence[str], made: dict[str, callable], name: str = "column") -> DataFrame:
    """A row for each column with the aggregates `made` of it, from one aggregation."""
    one = df.agg(*(f(c).alias(f"{k}_{i}") for i, c in enumerate(columns) for k, f in made.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias(name), *(F.col(f"{k}_{i}").alias(k) for k in made)) for i, c in enumerate(columns))))
    return one.select(rows.alias("r")).select("r.*")


QUANTILES = {"q01": 0.01, "q05": 0.05, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q95": 0.95, "q99": 0.99}


def numerical_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    x = lambda c: F.col(c).cast("double")
    made = {
        "count": lambda c: F.count(c),
        "missing": lambda c: F.count_if(F.col(c).isNull()),
        "min": lambda c: F.min(x(c)),
        "max": lambda c: F.max(x(c)),
        "mean": lambda c: F.avg(x(c)),
        "std": lambda c: F.stddev_samp(x(c)),
        "zeros": lambda c: F.count_if(x(c) == 0),
        "negatives": lambda c: F.count_if(x(c) < 0),
    }
    names = list(columns or numeric_columns(df))
    return with_quantiles(stacked(df, names, made), df, names, QUANTILES)


def with_quantiles(rows: DataFrame, df: DataFrame, columns: Sequence[str], wanted: dict[str, float]) -> DataFrame:
    """rows (a row a column) with the named quantiles of df's columns; NULL without values."""
    q = quantiles(df, columns, list(wanted.values()))
    q = q.select("column", *(F.col("q")[i].alias(k) for i, k in enumerate(wanted)))
    return rows.join(F.broadcast(q), "column", "left")


def frequency_table(df: DataFrame, column: str, top_k: int | None = None) -> DataFrame:
    """value, count and rate_pct of the rows, most frequent first, then by value."""
    g = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    out = g.crossJoin(F.broadcast(total)).select("value", "count", F.bround(F.col("count") * 100.0 / F.col("_n"), 4).alias("rate_pct"))
    out = out.orderBy(F.desc("count"), F.asc_nulls_last("value"))
    return out if top_k is None else out.limit(top_k)


def categorical_profile(df: DataFrame, columns: Sequence[str], top_k: int = 5) -> DataFrame:
    """column, n_unique and the top values as value:count joined by semicolons."""
    cells = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("r")).select("r.*")
    counts = cells.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("column").orderBy(F.desc("n"), "value")
    top = counts.withColumn("k", F.row_number().over(w)).where(F.col("k") <= top_k).groupBy("column")
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "value", "n"))), lambda x: F.concat(x["value"], F.lit(":"), x["n"].cast("string"))), ";").alias("top_values"))
    return counts.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")).join(F.broadcast(top), "column")


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """Parsed, unparsed and missing values, the range, and rows that share a time with others."""
    raw = F.col(column).cast("string")
    t = df.select(raw.alias("s"), F.try_to_timestamp(raw).alias("t"))
    shared = t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_timestamps"))
    one = t.agg(F.count(F.lit(1)).alias("n_rows"), F.count("t").alias("parsed"), F.count_if(F.col("s").isNotNull() & F.col("t").isNull()).alias("unparsed"), F.count_if(F.col("s").isNull()).alias("missing"), F.min("t").alias("first"), F.max("t").alias("last"))
    return one.crossJoin(F.broadcast(shared))


def identifier_profile(df: DataFrame, column: str) -> DataFrame:
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    out = g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("non_null"), F.count(F.lit(1)).alias("n_unique"), F.count_if(F.col("n") > 1).alias("repeated_ids"))
    return out.withColumns({"extra_rows": F.col("non_null") - F.col("n_unique"), "unique_rate_pct": F.bround(ratio("n_unique", "non_null") * 100, 4), "is_unique": F.col("non_null") == F.col("n_unique")})


def prefix_profile(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """How many of the values start with a prefix."""
    x = F.col(column).cast("string")
    return df.agg(F.count_if(x.startswith(prefix)).alias("n_matching"), F.bround(ratio(F.count_if(x.startswith(prefix)), F.count(x)) * 100, 4).alias("rate_pct"))


def schema_profile(df: DataFrame) -> DataFrame:
    """column, kind (boolean, datetime, numeric or string), nullable and missing."""
    def kind(t: T.DataType) -> str:
        if isinstance(t, T.BooleanType):
            return "boolean"
        if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return "datetime"
        return "numeric" if isinstance(t, T.NumericType) else "string"

    kinds = {f.name: kind(f.dataType) for f in df.schema}
    rows = stacked(df, df.columns, {"missing": lambda c: F.count_if(F.col(c).isNull())})
    m = F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv))
    return rows.withColumns({"kind": m[F.col("column")], "nullable": F.col("missing") > 0})


# How cells of text are read, in the order in which the kinds are tried.
KINDS = {
    "integer": r"[+-]?[0-9]+",
    "decimal": r"[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+)([eE][+-]?[0-9]+)?",
    "boolean": r"[tT]rue|[fF]alse|TRUE|FALSE",
    "datetime": r"[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})?)?",
}


def type_census(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, missing, n_integer, n_decimal, n_boolean, n_datetime, n_text, inferred_type of
    columns of raw text, from all rows.

    A cell without anything but blanks is missing. Every other cell sets the bit of the first
    kind that it reads as, and one aggregation joins the bits of a column: numeric of integers
    and decimals, boolean, datetime, string of any other text or of no cells, and mixed where
    kinds meet. Cells are spread over tasks whatever their values are."""
    names = list(columns or [f.name for f in df.schema if isinstance(f.dataType, T.StringType)])
    text = [*KINDS, "text"]

    def kind(c: str) -> Column:
        x = F.trim(F.col(c).cast("string"))
        out = F.when(x.isNull() | (x == ""), 0)
        for i, pattern in enumerate(KINDS.values()):
            out = out.when(x.rlike(f"^({pattern})$"), 1 << i)
        return out.otherwise(1 << len(KINDS))

    cells = df.select(*(kind(c).alias(c) for c in names))
    made = {"missing": lambda c: F.count_if(F.col(c) == 0), "_bits": lambda c: F.bit_or(c)}
    made |= {f"n_{k}": lambda c, i=i: F.count_if(F.col(c) == 1 << i) for i, k in enumerate(text)}
    bits = F.col("_bits")
    inferred = F.when(bits.isin(1, 2, 3), "numeric").when(bits == 4, "boolean").when(bits == 8, "datetime").when(bits.isNull() | bits.isin(0, 16), "string").otherwise("mixed")
    return stacked(cells, names, made).withColumn("inferred_type", inferred).drop("_bits")


def distribution_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Moments, quartiles, bias-corrected skewness and kurtosis, missing ratio, variance and
    the coefficient of variation (NULL for means that aren't above 1e-9)."""
    x = lambda c: F.col(c).cast("double")
    made = {
        "count": lambda c: F.count(c),
        "mean": lambda c: F.avg(x(c)),
        "std": lambda c: F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(x(c))),
        "min": lambda c: F.min(x(c)),
        "max": lambda c: F.max(x(c)),
        "skewness": skew,
        "kurtosis": kurt,
        "missing_ratio": lambda c: F.avg(F.col(c).isNull().cast("double")),
        "variance": lambda c: F.var_samp(x(c)),
        "cv": lambda c: F.when(F.avg(x(c)) > 1e-9, F.stddev_samp(x(c)) / F.avg(x(c))),
    }
    df = written(df.select(*columns), "columns")  # read several times
    return with_quantiles(stacked(df, columns, made), df, columns, {"q25": 0.25, "median": 0.5, "q75": 0.75})


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Counts and fractions outside the fences; NULL under four values."""
    df = written(df.select(*columns), "columns")  # read several times
    q1, q3 = F.col("q")[0], F.col("q")[1]
    bounds = quantiles(df, columns, [0.25, 0.75]).select("column", "n", (q1 - k * (q3 - q1)).alias("lo"), (q3 + k * (q3 - q1)).alias("hi"))
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x")) for c in columns))).alias("r")).select("r.*")
    g = long.join(F.broadcast(bounds), "column").groupBy("column", "n", "lo", "hi").agg(F.count_if(outside("x", F.col("lo"), F.col("hi"))).alias("c"))
    few = F.col("n") < 4
    found = g.select("column", F.when(~few, F.col("c")).alias("n_outliers"), F.when(~few, F.col("c") / F.col("n")).alias("ratio"))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")  # a column without values too
    return every.join(F.broadcast(found), "column", "left")


def correlation_pairs(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """(feature_a, feature_b, corr) for each pair of columns, rows with both values only."""
    pairs = list(combinations(columns, 2))
    if method == "pearson":
        corr = lambda a, b: F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
        one = df.agg(*(corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
        rows = F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
        return one.select(F.explode(rows).alias("r")).select("r.*")
    if method != "spearman":
        raise ValueError("method must be pearson or spearman")
    # a pair's ranks are those among the rows that have both values: a column's own, unless the
    # other column has NULLs
    held = written(df.select(*(F.col(c).cast("double").alias(c) for c in columns)).withColumn("_id", F.monotonically_increasing_id()), "values")
    gaps = held.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    name = lambda c, other: f"{c}|{other}" if gaps[other] else c
    wanted = {name(*p): p for a, b in pairs for p in ((a, b), (b, a))}
    wide = held.select("_id", *(F.when(F.col(o).isNotNull(), F.col(c)).alias(n) if n != c else F.col(c) for n, (c, o) in wanted.items()))
    ranks = average_ranks(wide, list(wanted)).select("series", "x", "rank")
    cells = F.explode(F.array(*(F.struct(F.lit(n).alias("series"), F.col(f"`{n}`").alias("x")) for n in wanted)))
    placed = wide.select("_id", cells.alias("r")).select("_id", "r.*").join(ranks, ["series", "x"])
    each = placed.groupBy("_id").agg(*(F.max(F.when(F.col("series") == n, F.col("rank"))).alias(f"r{i}") for i, n in enumerate(wanted)))
    at = {n: f"r{i}" for i, n in enumerate(wanted)}
    one = each.agg(*(F.corr(at[name(a, b)], at[name(b, a)]).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
    rows = F.array(*(F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def redundant_pairs(corr: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Pairs with at least the threshold's absolute correlation, strongest first."""
    return corr.where(F.abs("corr") >= threshold).withColumn("abs_corr", F.abs("corr")).orderBy(F.desc("abs_corr"), "feature_a", "feature_b")


def pair_equality(df: DataFrame, a: str, b: str, tolerance: float = 1e-12) -> DataFrame:
    """How nearly two columns are the same: correlation, share of equal rows, greatest difference."""
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    d = F.abs(x - y)
    one = df.where(x.isNotNull() & y.isNotNull()).agg(F.corr(x, y).alias("pearson"), F.avg((d <= tolerance).cast("double")).alias("equality_rate"), F.max(d).alias("max_abs_diff"))
    kind = F.when(F.col("equality_rate") == 1, "DUPLICATE").when(F.abs("pearson") >= 0.95, "REDUNDANT").otherwise("DISTINCT")
    return one.withColumn("category", kind)


def spearman(df: DataFrame, x: Column, y: Column) -> DataFrame:
    """Rank correlation of two expressions on a small table, by windows."""
    t = df.select(x.alias("x"), y.alias("y")).where("x IS NOT NULL AND y IS NOT NULL")
    return t.select(average_rank(F.col("x")).alias("rx"), average_rank(F.col("y")).alias("ry")).agg(F.corr("rx", "ry").alias("corr"))


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and p of the Shapiro-Wilk test by Royston's approximation, for 3 to 5000 values."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return math.nan, math.nan
    from statistics import NormalDist

    norm = NormalDist()
    m = np.array([norm.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm = float(m @ m)
    u = 1 / math.sqrt(n)
    a = np.zeros(n)
    # The polynomials of Royston's 1995 approximation.
    last = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, m[-1] / math.sqrt(mm)], u)
    if n == 3:
        a[:] = (-math.sqrt(0.5), 0.0, math.sqrt(0.5))
    elif n <= 5:
        a[1:-1] = m[1:-1] / math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
        a[0], a[-1] = -last, last
    else:
        second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, m[-2] / math.sqrt(mm)], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a[2:-2] = m[2:-2] / math.sqrt(phi)
        a[0], a[1], a[-2], a[-1] = -last, -second, second, last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if n <= 11:
        mu = np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n)
        sigma = math.exp(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n))
        z = (-math.log(max(1e-300, -2.273 + 0.459 * n - math.log1p(-w))) - mu) / sigma
    else:
        v = math.log(n)
        mu = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], v)
        sigma = math.exp(np.polyval([0.0030302, -0.082676, -0.4803], v))
        z = (math.log(max(1e-300, 1 - w)) - mu) / sigma
    return w, 1 - norm.cdf(z)


def normality(df: DataFrame, columns: Sequence[str], alpha: float = 0.05, sample: int = 5000, seed: int = 42, key: str = "CustomerID") -> DataFrame:
    """Shapiro-Wilk of each column on a sample of at most `sample` rows, chosen by hash of the
    key, or of the whole row where there is no such column; equal values are drawn apart."""
    rows = []
    drawn = [key] if key in df.columns else df.columns
    for c in columns:
        x = df.where(F.col(c).isNotNull()).select(F.xxhash64(*drawn, F.lit(seed)).alias("h"), F.col(c).cast("double").alias("x"))
        got = [r["x"] for r in x.orderBy("h", "x").limit(sample).collect()]
        w, p = shapiro_wilk(got)
        rows.append((c, len(got), None if math.isnan(w) else w, None if math.isnan(p) else p, None if math.isnan(p) else p > alpha))
    return df.sparkSession.createDataFrame(rows, "feature string, n long, w double, p double, is_normal boolean")
