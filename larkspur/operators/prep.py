"""Imputation, transformation and scaling: fitting is an aggregation, applying a projection."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantile_row, quantiles


@dataclass
class Fitted:
    """Parameters by column; apply gives the column's expression."""

    medians: dict[str, float] = field(default_factory=dict)
    lambdas: dict[str, float | None] = field(default_factory=dict)
    center: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        out = df
        for made in (
            {c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in self.medians.items()},
            {c: yeo_johnson(F.col(c).cast("double"), v) for c, v in self.lambdas.items() if v is not None},
            {c: (F.col(c).cast("double") - F.lit(self.center[c])) / F.lit(v) for c, v in self.scale.items()},
        ):
            out = out.withColumns(made) if made else out
        return out


def medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """The median of each column; a column without values is left out."""
    row = quantile_row(df, {c: (c, 0.5) for c in columns}).first()
    return {c: row[c] for c in columns if row[c] is not None}


def imputation_report(before: DataFrame, columns: Sequence[str], fitted: dict[str, float]) -> DataFrame:
    """feature, median, nulls before and after."""
    spark = before.sparkSession
    row = before.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first()
    rows = [(c, fitted.get(c), row[c], 0 if c in fitted else row[c]) for c in columns]
    return spark.createDataFrame(rows, "feature string, median double, n_missing_before long, n_missing_after long")


def log1p(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """log(1 + x); a negative value is an error, raised when the plan runs."""
    def one(c: str) -> Column:
        x = F.col(c).cast("double")
        return F.when(x < 0, F.raise_error(F.lit(f"{c}: log1p of a negative value"))).otherwise(F.log1p(x)).cast("double")

    return df.withColumns({c: one(c) for c in columns})


def yeo_johnson(x: Column, lam: float) -> Column:
    """The Yeo-Johnson transformation with a given parameter."""
    up = F.log1p(x) if abs(lam) < 1e-12 else (F.pow(x + 1, F.lit(lam)) - 1) / lam
    down = -F.log1p(-x) if abs(lam - 2) < 1e-12 else -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, up).otherwise(down)


def fit_yeo_johnson(df: DataFrame, columns: Sequence[str], rounds: int = 4, points: int = 17) -> dict[str, float | None]:
    """The parameter of greatest likelihood for each column, over rows that are complete.

    Each round evaluates a grid for all columns in one aggregation and narrows it around
    the best points. A constant column has none."""
    rows = df.select(*(F.col(c).cast("double").alias(c) for c in columns)).dropna()
    span = {c: (-3.0, 5.0) for c in columns}
    best: dict[str, float | None] = dict.fromkeys(columns)
    for _ in range(rounds):
        grid = {c: [lo + (hi - lo) * k / (points - 1) for k in range(points)] for c, (lo, hi) in span.items()}
        aggs = [F.var_pop(yeo_johnson(F.col(c), v)).alias(f"v{i}_{k}") for i, c in enumerate(columns) for k, v in enumerate(grid[c])]
        aggs += [F.sum(F.signum(c) * F.log1p(F.abs(c))).alias(f"s{i}") for i, c in enumerate(columns)]
        row = rows.agg(F.count(F.lit(1)).alias("n"), *aggs).first()
        for i, c in enumerate(columns):
            from math import log

            found = [(-row["n"] / 2 * log(v) + (g - 1) * row[f"s{i}"], g) for k, g in enumerate(grid[c]) if (v := row[f"v{i}_{k}"]) and v > 0]
            if found:
                best[c] = max(found)[1]
                step = (span[c][1] - span[c][0]) / (points - 1)
                span[c] = (best[c] - step, best[c] + step)
    return best


def fit_scaler(df: DataFrame, columns: Sequence[str], kind: str) -> tuple[dict[str, float], dict[str, float]]:
    """(center, scale) of none, standard (population), minmax or robust (median, IQR); a scale of 0 is 1."""
    if kind == "none":
        return dict.fromkeys(columns, 0.0), dict.fromkeys(columns, 1.0)
    x = lambda c: F.col(c).cast("double")
    made = {
        "standard": lambda c: (F.avg(x(c)), F.stddev_pop(x(c))),
        "minmax": lambda c: (F.min(x(c)), F.max(x(c)) - F.min(x(c))),
    }
    if kind == "robust":
        q = {r["column"]: r["q"] for r in quantiles(df, columns, [0.25, 0.5, 0.75]).collect()}  # a row a column
        return {c: q[c][1] if c in q else 0.0 for c in columns}, {c: (q[c][2] - q[c][0] if c in q else 0.0) or 1.0 for c in columns}
    if kind not in made:
        raise ValueError(f"no such scaler: {kind}")
    row = df.agg(*(v.alias(f"{s}{i}") for i, c in enumerate(columns) for s, v in zip("cs", made[kind](c)))).first()
    return {c: row[f"c{i}"] or 0.0 for i, c in enumerate(columns)}, {c: row[f"s{i}"] or 1.0 for i, c in enumerate(columns)}


def fit(df: DataFrame, columns: Sequence[str], transform: str = "yeo_johnson", scaler: str = "robust", impute: bool = True) -> Fitted:
    """Median imputation, then none, log1p or yeo_johnson, then a scaler, each fitted on what is before it."""
    f = Fitted()
    if impute:
        f.medians = medians(df, columns)
        df = f.apply(df)
    if transform == "yeo_johnson":
        f.lambdas = fit_yeo_johnson(df, columns)
        df = Fitted(lambdas=f.lambdas).apply(df)
    elif transform == "log1p":
        df = log1p(df, columns)
    elif transform != "none":
        raise ValueError(f"no such transform: {transform}")
    f.center, f.scale = fit_scaler(df, columns, scaler)
    return f


def perturbed(df: DataFrame, columns: Sequence[str], sigma: float, seed: int, key: str) -> DataFrame:
    """x + sigma * N(0, 1) * population deviation; the noise of a row follows from its key and the seed."""
    if sigma == 0:
        return df
    row = df.agg(*(F.stddev_pop(F.col(c).cast("double")).alias(c) for c in columns)).first()

    def noise(c: str) -> Column:
        u = lambda s: (F.pmod(F.xxhash64(F.col(key), F.lit(f"{seed}|{c}|{s}")), F.lit(2**53)) + 0.5) / float(2**53)
        return F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))

    return df.withColumns({c: F.col(c).cast("double") + F.lit(sigma * (row[c] or 0.0)) * noise(c) for c in columns})
