"""Rules for invalid records, duplicates, missing values and outliers.

Rules are boolean columns of one projection, so counting them all is one aggregation and
dropping is one filter. Row order isn't kept by Spark: "first" and "last" follow the
columns given as `order`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import outside, zscore_fences
from .quantiles import quantile_row

IDENTIFIERS = ("CustomerID", "InvoiceNo")


def coerce_dtypes(df: DataFrame) -> DataFrame:
    """Bad dates become NULL, customer ids longs (half to even), codes strings; no row goes."""
    out = df
    if "InvoiceDate" in df.columns and dict(df.dtypes)["InvoiceDate"] == "string":
        out = out.withColumn("InvoiceDate", F.try_to_timestamp("InvoiceDate"))
    if "CustomerID" in df.columns:
        out = out.withColumn("CustomerID", F.bround(F.col("CustomerID").try_cast("double")).cast("long"))
    return out.withColumns({c: F.col(c).cast("string") for c in ("InvoiceNo", "StockCode") if c in df.columns})


def is_cancellation(c: str = "InvoiceNo", prefix: str = "C") -> Column:
    return F.coalesce(F.col(c).cast("string").startswith(prefix), F.lit(False))


def is_return(c: str = "Quantity") -> Column:
    return F.coalesce(F.col(c) < 0, F.lit(False))


def non_positive(c: str = "UnitPrice") -> Column:
    return F.coalesce(F.col(c) <= 0, F.lit(False))


def unparseable_date(c: str = "InvoiceDate") -> Column:
    return F.col(c).isNotNull() & F.try_to_timestamp(F.col(c).cast("string")).isNull()


def missing_identifier(c: str) -> Column:
    return F.col(c).isNull() | F.coalesce(F.col(c).cast("string").rlike(r"^\s*$"), F.lit(False))


def with_flags(df: DataFrame) -> DataFrame:
    """IsCancellation and IsReturn."""
    return df.withColumns({"IsCancellation": is_cancellation(), "IsReturn": is_return()})


def ensure_flags(df: DataFrame) -> DataFrame:
    """False flags where they are absent."""
    return df.withColumns({c: F.lit(False) for c in ("IsCancellation", "IsReturn") if c not in df.columns})


def line_revenue(df: DataFrame, quantity: str = "Quantity", price: str = "UnitPrice", out: str = "LineRevenue") -> DataFrame:
    return df.withColumn(out, F.col(quantity).try_cast("double") * F.col(price).try_cast("double"))


#: The rules that drop rows, in the order of the report; flags are set before any drop.
DROPS = {
    "CL-01": lambda: missing_identifier("CustomerID"),
    "CL-03": lambda: missing_identifier("Description"),
    "CL-04": lambda: unparseable_date(),
    "CL-05": lambda: F.coalesce(F.col("Quantity") == 0, F.lit(False)),
    "CL-07": lambda: non_positive(),
    "CL-10": lambda: missing_identifier("InvoiceNo"),
}
FLAGS = {"CL-06": is_return, "CL-08": is_cancellation}


def rule_counts(df: DataFrame) -> DataFrame:
    """(rule_id, affected) of every rule, each counted on all rows."""
    rules = {**DROPS, **FLAGS}
    sums = df.agg(*(F.count_if(rule()).alias(k) for k, rule in rules.items()))
    return sums.unpivot([], list(rules), "rule_id", "affected")


def drop_invalid(df: DataFrame, rules: Sequence[str] = tuple(DROPS)) -> DataFrame:
    """Flags every row, then drops those that any of the rules hits."""
    hit = F.lit(False)
    for r in rules:
        hit = hit | DROPS[r]()
    return with_flags(df).where(~hit)


def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str = "first", order: Sequence[str] = ()) -> DataFrame:
    """keep first, last or none of equal rows; NULLs are equal to each other."""
    keys = list(subset or df.columns)
    if keep == "none":
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn("_n", n).where("_n = 1").drop("_n")
    if subset is None:
        return df.dropDuplicates()
    by = [F.col(c).asc_nulls_last() if keep == "first" else F.col(c).desc_nulls_last() for c in (order or [c for c in df.columns if c not in keys] or keys)]
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("_n = 1").drop("_n")


def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """rows, groups, duplicate_groups, extra_rows and max_group of equal rows."""
    g = df.groupBy(*(subset or df.columns)).agg(F.count(F.lit(1)).alias("n"))
    zero = F.lit(0).cast("long")
    return g.agg(
        F.coalesce(F.sum("n"), zero).alias("n_rows"),
        F.count(F.lit(1)).alias("n_groups"),
        F.count_if(F.col("n") > 1).alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("extra_rows"),
        F.coalesce(F.max("n"), zero).alias("max_group"),
    )


def missing_summary(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, missing, rate_pct and n_unique of each column, most missing first.

    Values are counted by column before they are shuffled, then counted again: no row is
    expanded by a distinct aggregate, and a hot value is one row a task."""
    cs = list(columns or df.columns)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cs)))
    values = df.select(cells.alias("r")).select("r.*").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    found = values.groupBy("column").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing"), F.count("value").alias("n_unique"), F.sum("n").alias("n"))
    every = df.sparkSession.createDataFrame([(c,) for c in cs], "column string")
    out = every.join(F.broadcast(found), "column", "left")  # of an empty table too
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return out.select("column", zero("missing"), zero("n_unique"), F.bround(F.try_divide(F.col("missing") * 100.0, F.col("n")), 4).alias("rate_pct")).orderBy(F.desc("missing"), "column")


def handle_missing(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    """drop, keep, impute_zero, impute_mean or impute_median; identifiers are never filled."""
    if strategy == "keep":
        return df
    if strategy == "drop":
        return df.dropna(subset=list(columns))
    if any(c in IDENTIFIERS for c in columns):
        raise ValueError("identifiers are not filled")
    if strategy == "impute_zero":
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})
    if strategy == "impute_mean":
        fill = df.agg(*(F.avg(F.col(c).cast("double")).alias(f"_f{k}") for k, c in enumerate(columns)))
    elif strategy == "impute_median":
        fill = quantile_row(df, {f"_f{k}": (c, 0.5) for k, c in enumerate(columns)})
    else:
        raise ValueError(f"no such strategy: {strategy}")
    out = df.crossJoin(F.broadcast(fill))  # one row
    return out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_f{k}")) for k, c in enumerate(columns)}).drop(*fill.columns)


def fence_row(df: DataFrame, wanted: Sequence[tuple[str, str, float | None]]) -> DataFrame:
    """One row: the fences of each (column, method, value), as _lo_k and _hi_k."""
    sides: list[Column] = []
    needed: dict[str, tuple[str, float]] = {}
    moments: list[tuple[int, str, float]] = []
    for k, (c, method, value) in enumerate(wanted):
        if method == "zscore":
            moments.append((k, c, 3.0 if value is None else value))
        elif method in ("iqr", "percentile"):
            v = {"iqr": 1.5, "percentile": 99.0}[method] if value is None else value
            ends = (0.25, 0.75) if method == "iqr" else ((100 - v) / 100, v / 100)
            needed |= {f"_a_{k}": (c, ends[0]), f"_b_{k}": (c, ends[1])}
            reach = v * (F.col(f"_b_{k}") - F.col(f"_a_{k}")) if method == "iqr" else F.lit(0.0)
            sides += [(F.col(f"_a_{k}") - reach).alias(f"_lo_{k}"), (F.col(f"_b_{k}") + reach).alias(f"_hi_{k}")]
        else:
            raise ValueError("method must be one of ['iqr', 'percentile', 'zscore']")
    z = [f.alias(f"{s}_{k}") for k, c, v in moments for s, f in zip(("_lo", "_hi"), zscore_fences(c, v))]
    quantile_sides = quantile_row(df, needed).select(*sides) if needed else None
    if not z:
        return quantile_sides
    both = df.agg(*z)
    return both if quantile_sides is None else quantile_sides.crossJoin(F.broadcast(both))  # one row each


def with_fences(df: DataFrame, columns: Sequence[str], method: str = "iqr", value: float | None = None) -> DataFrame:
    """Each column's fences beside every row (one broadcast row), as _lo_k and _hi_k."""
    return df.crossJoin(F.broadcast(fence_row(df.select(*columns), [(c, method, value) for c in columns])))


def outlier_summary(df: DataFrame, columns: Sequence[str], method: str = "iqr", value: float | None = None) -> DataFrame:
    """column, lower, upper, n_valid, n_outliers and rate_pct (percent of valid rows)."""
    f = with_fences(df.select(*columns), columns, method, value)
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("x"), F.col(f"_lo_{k}").alias("lo"), F.col(f"_hi_{k}").alias("hi")) for k, c in enumerate(columns))))
    g = f.select(cells.alias("r")).select("r.*").groupBy("column")
    out = g.agg(F.first("lo").alias("lower"), F.first("hi").alias("upper"), F.count("x").alias("n_valid"), F.count_if(outside("x", F.col("lo"), F.col("hi"))).alias("n_outliers"))
    return out.withColumn("rate_pct", F.bround(F.try_divide(F.col("n_outliers") * 100.0, F.col("n_valid")), 4))


def treat_outliers(df: DataFrame, columns: Sequence[str], method: str = "iqr", action: str = "clip", value: float | None = None) -> DataFrame:
    """clip to the fences (winsorize: the same), remove rows outside any, or flag them as IsOutlier."""
    f = with_fences(df, columns, method, value)
    extra = [c for c in f.columns if c not in df.columns]
    if action in ("clip", "winsorize"):
        made = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"_lo_{k}"), F.least(F.col(c).cast("double"), F.col(f"_hi_{k}")))) for k, c in enumerate(columns)}
        return f.withColumns(made).drop(*extra)
    hit = F.lit(False)
    for k, c in enumerate(columns):
        hit = hit | outside(c, F.col(f"_lo_{k}"), F.col(f"_hi_{k}"))
    if action == "remove":
        return f.where(~hit).drop(*extra)
    if action == "flag":
        return f.withColumn("IsOutlier", hit).drop(*extra)
    raise ValueError(f"no such action: {action}")


def sensitivity(df: DataFrame, column: str, iqr: Sequence[float] = (1.5, 2.0, 2.5, 3.0), percentiles: Sequence[float] = (95.0, 97.5, 99.0), zscores: Sequence[float] = (3.0,)) -> DataFrame:
    """method, threshold, lower, upper, n_outliers and rate (a fraction) for each setting."""
    wanted = [("iqr", v) for v in iqr] + [("percentile", v) for v in percentiles] + [("zscore", v) for v in zscores]
    bounds = fence_row(df.select(column), [(column, m, v) for m, v in wanted])
    rows = bounds.select(F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.lit(float(v)).alias("threshold"), F.col(f"_lo_{k}").alias("lower"), F.col(f"_hi_{k}").alias("upper")) for k, (m, v) in enumerate(wanted)))).alias("r")).select("r.*")
    joined = df.select(F.col(column).cast("double").alias("x")).crossJoin(F.broadcast(rows))  # as many rows as settings
    out = joined.groupBy("method", "threshold", "lower", "upper").agg(F.count("x").alias("n"), F.count_if(outside("x", F.col("lower"), F.col("upper"))).alias("n_outliers"))
    return out.withColumn("rate", F.try_divide(F.col("n_outliers").cast("double"), F.col("n"))).drop("n")


def filter_mode(df: DataFrame, mode: str) -> DataFrame:
    """all_rows, clean_purchase, non_cancellation or non_return."""
    rows = ensure_flags(df)
    kept = {"all_rows": F.lit(True), "clean_purchase": ~F.col("IsCancellation") & ~F.col("IsReturn"), "non_cancellation": ~F.col("IsCancellation"), "non_return": ~F.col("IsReturn")}
    if mode not in kept:
        raise ValueError(f"no such mode: {mode}")
    return rows.where(kept[mode])


@dataclass(frozen=True)
class CleaningPlan:
    """What clean_transactions does; outliers are left alone unless a method is named.

    strict_dates False keeps rows whose date doesn't parse, with a NULL date."""

    rules: tuple[str, ...] = tuple(DROPS)
    strict_dates: bool = False
    duplicates: str | None = "first"
    missing: str = "keep"
    missing_columns: tuple[str, ...] = ()
    outliers: str | None = None
    outlier_columns: tuple[str, ...] = field(default=("Quantity", "UnitPrice"))
    outlier_action: str = "flag"


def clean_transactions(df: DataFrame, plan: CleaningPlan | None = None) -> DataFrame:
    """Types, invalid records, duplicates, missing values, outliers: one lazy plan."""
    p = plan or CleaningPlan()
    rules = [r for r in p.rules if r != "CL-04" or p.strict_dates]
    out = drop_invalid(df, rules)
    out = coerce_dtypes(out)
    if p.duplicates:
        out = drop_duplicates(out, keep=p.duplicates)
    if p.missing_columns:
        out = handle_missing(out, p.missing_columns, p.missing)
    if p.outliers:
        out = treat_outliers(out, p.outlier_columns, p.outliers, p.outlier_action)
    return out


def summary(df: DataFrame, plan: CleaningPlan | None = None) -> DataFrame:
    """One row: lines before, after the rules, and after all of clean_transactions, and the
    flags of all lines."""
    p = plan or CleaningPlan()
    hit = F.lit(False)
    for r in p.rules:
        if r != "CL-04" or p.strict_dates:
            hit = hit | DROPS[r]()
    one = with_flags(df).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(~hit).alias("rows_valid"), F.count_if("IsCancellation").alias("flagged_cancellations"), F.count_if("IsReturn").alias("flagged_returns"))
    return one.crossJoin(F.broadcast(clean_transactions(df, p).agg(F.count(F.lit(1)).alias("rows_out"))))  # one row each
