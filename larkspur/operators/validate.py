"""Checks of tables: every check is a boolean of one aggregation, or of the schema.

A result is a table of (check_id, status, detail), status PASS, WARNING or FAIL.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import numeric_columns

LEAKS = ("target", "label", "class", "answer")


def checked(df: DataFrame, rules: dict[str, Column], static: dict[str, bool] | None = None, warn: Sequence[str] = ()) -> DataFrame:
    """Aggregate conditions and known ones as rows; a NULL condition fails."""
    bad = lambda k: "WARNING" if k in warn else "FAIL"
    one = df.agg(*(F.coalesce(c, F.lit(False)).alias(k) for k, c in rules.items())) if rules else df.sparkSession.range(1)
    rows = [F.struct(F.lit(k).alias("check_id"), F.when(F.col(f"`{k}`"), "PASS").otherwise(bad(k)).alias("status")) for k in rules]
    rows += [F.struct(F.lit(k).alias("check_id"), F.lit("PASS" if ok else bad(k)).alias("status")) for k, ok in (static or {}).items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def overall(checks: DataFrame) -> DataFrame:
    """One row: the worst status (FAIL, then WARNING, then PASS) and the lifecycle state."""
    level = F.max(F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "WARNING", 1).otherwise(0))
    out = checks.agg(level.alias("_l"))
    return out.select(F.when(F.col("_l") == 2, "FAIL").when(F.col("_l") == 1, "WARNING").otherwise("PASS").alias("status"), F.when(F.col("_l") == 2, "FAILED").otherwise("VALID").alias("lifecycle"))


def none(c: Column) -> Column:
    return F.count_if(c) == 0


def customer_base(df: DataFrame) -> DataFrame:
    """Unique customers, counts that aren't negative, dates in order, sums that fit their parts."""
    rules = {
        "V-01 not empty": F.count(F.lit(1)) > 0,
        "V-02 key present": none(F.col("CustomerID").isNull()),
        "V-03 key unique": F.count("CustomerID") == F.count_distinct("CustomerID"),
        "V-04 invoices": none(F.col("DistinctInvoiceCount") < 1),
        "V-05 lines": none(F.col("TransactionLineCount") < F.col("DistinctInvoiceCount")),
        "V-06 products": none(F.col("DistinctProducts") < 1),
        "V-07 dates": none(F.col("FirstPurchaseDate") > F.col("LastPurchaseDate")),
        "V-08 cancellations": none(F.col("CancellationInvoiceCount") > F.col("DistinctInvoiceCount")),
        "V-09 returns": none(F.col("ReturnInvoiceCount") > F.col("DistinctInvoiceCount")),
        "V-10 frequency": none(F.col("PurchaseFrequency") != F.col("DistinctInvoiceCount")),
        "V-11 average": none(F.abs(F.col("AverageTransactionValue") * F.col("DistinctInvoiceCount") - F.col("TotalMonetary")) > 0.01),
    }
    return checked(df, rules)


def candidates(df: DataFrame) -> DataFrame:
    """One R, F and M, unique customers, no leaking names, intervals only of repeat customers."""
    one = lambda w: sum(w in c for c in df.columns) == 1
    few = F.col("Frequency") < 2
    rules = {
        "key unique": F.count("CustomerID") == F.count_distinct("CustomerID"),
        "interval of single purchases": (F.count_if(few) > 0) & (F.count_if(few & F.col("PurchaseIntervalMean").isNotNull()) == 0),
        "no NaN": none(F.greatest(*(F.isnan(F.col(c).cast("double")).cast("int") for c in numeric_columns(df))) == 1),
    }
    static = {"one monetary": one("Monetary"), "one frequency": one("Frequency"), "one quantity set": "TotalQuantity" in df.columns and one("TotalQuantity"), "no category count": "CategoryCount" not in df.columns, "no leakage": not any(w in c.lower() for c in df.columns for w in LEAKS)}
    return checked(df, rules, static)


def finite(c: str) -> Column:
    x = F.col(c).cast("double")
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def matrix(df: DataFrame, columns: Sequence[str], key: str = "CustomerID", expected_rows: int | None = None, least: int = 2) -> DataFrame:
    """Numeric, finite, not constant, enough rows, unique keys."""
    kinds = {f.name: f.dataType for f in df.schema}
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(c)
    rules = {"rows": F.count(F.lit(1)) >= least, "finite": none(~ok), "keys present": none(F.col(key).isNull()), "keys unique": F.count(key) == F.count_distinct(key)}
    if expected_rows is not None:
        rules["expected rows"] = F.count(F.lit(1)) == expected_rows
    constant = F.lit(True)
    for c in columns:
        constant = constant & (F.coalesce(F.var_samp(F.col(c).cast("double")), F.lit(0.0)) > 0)
    rules["no constant"] = constant
    return checked(df, rules, {"numeric": all(isinstance(kinds.get(c), T.NumericType) for c in columns)}, warn=("no constant",))


def structure(df: DataFrame) -> DataFrame:
    """Rows, columns, safe and distinct names, and columns that are all NULL."""
    names = [c.lower() for c in df.columns]
    rules = {"has rows": F.count(F.lit(1)) > 0}
    rules |= {f"not all null: {c}": F.count(F.col(f"`{c}`")) > 0 for c in df.columns}
    static = {"has columns": bool(names), "distinct names": len(set(names)) == len(names), "safe names": all(re.fullmatch(r"[A-Za-z_][A-Za-z0-9_ ]*", c) for c in df.columns)}
    return checked(df, rules, static)


def data_quality(df: DataFrame) -> DataFrame:
    """NaN, infinite and constant columns and repeated rows, as warnings."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    rules: dict[str, Column] = {}
    for c in floats:
        rules[f"no NaN: {c}"] = none(F.isnan(c))
        rules[f"no Inf: {c}"] = none(F.abs(c) == float("inf"))
    for c in numeric_columns(df):
        rules[f"varies: {c}"] = F.coalesce(F.min(c) < F.max(c), F.lit(False))
    # equal rows are counted by groups of a row each, so that the aggregate of the rules is a plain one
    distinct = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).count().agg(F.count_if(F.col("count") > 1).alias("_repeated"))
    rules["no repeated rows"] = F.coalesce(F.max("_repeated"), F.lit(0)) == 0
    return checked(df.join(F.broadcast(distinct), F.lit(True), "left"), rules, warn=tuple(rules))  # one row


def alignment(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Whether two tables have the same keys: rows of each, and keys of one only."""
    j = a.select(key, F.lit(1).alias("_a")).join(b.select(key, F.lit(1).alias("_b")), key, "full_outer")
    out = j.agg(F.count("_a").alias("left_rows"), F.count("_b").alias("right_rows"), F.count_if(F.col("_b").isNull()).alias("left_only"), F.count_if(F.col("_a").isNull()).alias("right_only"))
    return out.withColumn("aligned", (F.col("left_only") == 0) & (F.col("right_only") == 0))


def result_rows(df: DataFrame, required: Sequence[str] = ("experiment_id", "run_id", "algorithm", "k", "status")) -> DataFrame:
    """run_id and OK, MISSING (a required field is NULL) or INVALID (metrics of a failed run)."""
    gone, failed = F.lit(False), F.lit(False)
    for c in required:
        gone = gone | F.col(c).isNull()
    for c in ("silhouette", "davies_bouldin", "calinski_harabasz"):
        failed = failed | ((F.col("status") == "FAILED") & F.col(c).isNotNull()) | F.coalesce(F.isnan(c), F.lit(False))
    return df.select("run_id", F.when(F.coalesce(failed, F.lit(False)), "INVALID").when(gone, "MISSING").otherwise("OK").alias("validity"))


# Names that identify a row and are no features.
IDENTIFIERS = ("CustomerID", "InvoiceNo", "InvoiceDate", "StockCode", "Description", "Country", "Cluster", "ClusterID", "Label")


def leakage(matrix_rows: DataFrame, metadata: DataFrame, key: str = "CustomerID") -> DataFrame:
    """Whether a matrix is free of identifiers and labels, and fits its metadata."""
    n, m = matrix_rows.agg(F.count(F.lit(1)).alias("n")), metadata.agg(F.count(F.lit(1)).alias("m"))
    static = {"identifiers absent": not set(IDENTIFIERS) & set(matrix_rows.columns), "labels absent": not any(c.startswith("Cluster") for c in matrix_rows.columns), "key in metadata": key in metadata.columns}
    return checked(n.crossJoin(F.broadcast(m)), {"rows match": F.max("n") == F.max("m")}, static)  # one row each


def columns_present(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """A check for each expected column (name: description); values are not looked at."""
    rows = [(f"V-RFM-{'PRESENT' if c in df.columns else 'MISSING'}-{c}", "PASS" if c in df.columns else "FAIL", text) for c, text in expected.items()]
    return df.sparkSession.createDataFrame(rows, "check_id string, status string, detail string")


def customer_features(df: DataFrame) -> DataFrame:
    """Customer features as they are read: nothing is asked of them yet."""
    return checked(df, {}, {"customer features": True})


def evaluation_inputs(points: DataFrame, labels: DataFrame, columns: Sequence[str], key: str = "CustomerID") -> DataFrame:
    """Whether points and labels can be evaluated: same number of rows, finite features, none
    of which leaks a label, and labels for the keys."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & finite(c)
    one = points.agg(F.count(F.lit(1)).alias("n"), F.count_if(~ok).alias("bad")).crossJoin(F.broadcast(labels.agg(F.count(F.lit(1)).alias("m"))))
    static = {"no leakage": not any(w in c.lower() for c in columns for w in LEAKS), "key in labels": key in labels.columns, "has features": bool(columns)}
    return checked(one, {"same rows": F.max("n") == F.max("m"), "not empty": F.max("n") > 0, "finite": F.max("bad") == 0}, static)
