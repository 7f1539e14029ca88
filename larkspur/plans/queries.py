"""Queries over the driver's tables, each with the SQL that gives the same rows.

Doubles are rounded on both sides, since sums depend on their order in the last digits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cleaning, cluster, experiments, features, metrics, prep, profile, segments, store, validate
from ..sources import retail
from ..streaming import feeds
from . import pipeline

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded; a negative zero is zero."""
    made = {f.name: F.round(F.col(f.name), digits) + F.lit(0.0) for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.withColumns(made) if made else df


def query(sql: str | None = None, digits: int = 4) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(f(spark, sf_dir), digits)

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


TX = "WITH " + retail.CLEAN_SQL
RAW = "WITH " + retail.RAW_SQL
BASE = (
    TX
    + """, base AS (
  SELECT CustomerID, sum(Quantity)::BIGINT AS TotalQuantity, sum(LineRevenue::DECIMAL(18,4))::DOUBLE AS TotalMonetary,
    min(InvoiceDate) AS FirstPurchaseDate, max(InvoiceDate) AS LastPurchaseDate, count(DISTINCT InvoiceNo) AS PurchaseFrequency,
    count(InvoiceNo) AS TransactionLineCount, count(DISTINCT InvoiceNo) AS DistinctInvoiceCount, count(DISTINCT StockCode) AS DistinctProducts,
    count(DISTINCT CASE WHEN IsCancellation THEN InvoiceNo END) AS CancellationInvoiceCount,
    count(DISTINCT CASE WHEN IsReturn THEN InvoiceNo END) AS ReturnInvoiceCount,
    sum(LineRevenue::DECIMAL(18,4))::DOUBLE / count(DISTINCT InvoiceNo) AS AverageTransactionValue,
    count(DISTINCT InvoiceDate::DATE) AS ActiveDays
  FROM tx GROUP BY CustomerID
)"""
)
GAPS = """, invoices AS (SELECT CustomerID, InvoiceNo, min(InvoiceDate) AS t FROM tx GROUP BY ALL),
gaps AS (
  SELECT CustomerID, floor((epoch_us(t) - epoch_us(lag(t) OVER (PARTITION BY CustomerID ORDER BY t, InvoiceNo))) / 86400000000) AS gap FROM invoices
), intervals AS (
  SELECT CustomerID, avg(gap) AS PurchaseIntervalMean, stddev_samp(gap) AS PurchaseIntervalStd FROM gaps GROUP BY CustomerID
)"""
FEAT = (
    BASE
    + GAPS
    + """, ref AS (SELECT max(InvoiceDate) + INTERVAL 1 DAY AS d FROM tx), feat AS (
  SELECT b.CustomerID, datediff('day', LastPurchaseDate, d)::INT AS Recency, DistinctInvoiceCount AS Frequency, TotalMonetary AS Monetary,
    TotalQuantity::DOUBLE AS TotalQuantity, TotalQuantity::DOUBLE / DistinctInvoiceCount AS AverageQuantity,
    TotalQuantity::DOUBLE / DistinctInvoiceCount AS BasketSize, datediff('day', FirstPurchaseDate, LastPurchaseDate)::INT AS TenureDays,
    PurchaseIntervalMean, PurchaseIntervalStd, ActiveDays, TotalMonetary / DistinctInvoiceCount AS AverageInvoiceValue,
    DistinctProducts::DOUBLE / DistinctInvoiceCount AS ProductsPerInvoice, CancellationInvoiceCount::DOUBLE / DistinctInvoiceCount AS CancellationRate,
    ReturnInvoiceCount::DOUBLE / DistinctInvoiceCount AS ReturnRate
  FROM base b LEFT JOIN intervals i USING (CustomerID), ref
)"""
)


def rnd(*columns: str, digits: int = 4) -> str:
    """Select-list items with rounding for columns given as expression or 'expression AS name'."""
    out = []
    for c in columns:
        e, _, name = c.partition(" AS ")
        out.append(f"round({e}, {digits}) + 0 AS {name or e}")
    return ", ".join(out)


# --- cleaning ------------------------------------------------------------------------------

RULES_SQL = {
    "CL-01": "CustomerID IS NULL",
    "CL-03": "(Description IS NULL OR trim(Description) = '')",
    "CL-04": "(InvoiceDate IS NOT NULL AND try_cast(InvoiceDate AS TIMESTAMP) IS NULL)",
    "CL-05": "coalesce(Quantity = 0, false)",
    "CL-07": "coalesce(UnitPrice <= 0, false)",
    "CL-10": "(InvoiceNo IS NULL OR trim(InvoiceNo) = '')",
    "CL-06": "coalesce(Quantity < 0, false)",
    "CL-08": "coalesce(starts_with(InvoiceNo, 'C'), false)",
}
DROP_SQL = " OR ".join(v for k, v in RULES_SQL.items() if k not in ("CL-04", "CL-06", "CL-08"))


@query(RAW + f" SELECT DISTINCT InvoiceNo, StockCode, Description, Quantity, try_cast(InvoiceDate AS TIMESTAMP) AS InvoiceDate, UnitPrice, CustomerID, Country, starts_with(InvoiceNo, 'C') AS IsCancellation, Quantity < 0 AS IsReturn FROM raw WHERE NOT ({DROP_SQL})")
def clean_transactions(spark, d):
    return cleaning.clean_transactions(retail.raw(spark, d))


@query(RAW + " " + " UNION ALL ".join(f"SELECT '{k}' AS rule_id, count(*) FILTER (WHERE {v}) AS affected FROM raw" for k, v in RULES_SQL.items()))
def invalid_rule_counts(spark, d):
    return cleaning.rule_counts(retail.raw(spark, d))


@query(RAW + " SELECT starts_with(InvoiceNo, 'C') AS IsCancellation, Quantity < 0 AS IsReturn, count(*) AS n FROM raw GROUP BY ALL")
def cancellation_flags(spark, d):
    return cleaning.with_flags(retail.raw(spark, d)).groupBy("IsCancellation", "IsReturn").agg(F.count(F.lit(1)).alias("n"))


_RAW_COLUMNS = ("InvoiceNo", "StockCode", "Description", "Quantity", "InvoiceDate", "UnitPrice", "CustomerID", "Country")


@query(RAW + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS missing, count(DISTINCT {c}) AS n_unique, round(count(*) FILTER (WHERE {c} IS NULL) * 100.0 / count(*), 4) AS rate_pct FROM raw" for c in _RAW_COLUMNS))
def missing_profile(spark, d):
    return cleaning.missing_summary(retail.raw(spark, d), _RAW_COLUMNS)


@query(RAW + f" SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS extra_rows, max(n) AS max_group FROM (SELECT count(*) AS n FROM raw GROUP BY {', '.join(_RAW_COLUMNS)})")
def exact_duplicates(spark, d):
    return cleaning.duplicate_summary(retail.raw(spark, d))


@query(RAW + " SELECT sum(n)::BIGINT AS n_rows, count(*) AS n_groups, count(*) FILTER (WHERE n > 1) AS duplicate_groups, sum(n - 1)::BIGINT AS extra_rows, max(n) AS max_group FROM (SELECT count(*) AS n FROM raw GROUP BY InvoiceNo, StockCode)")
def subset_duplicates(spark, d):
    return cleaning.duplicate_summary(retail.raw(spark, d), ["InvoiceNo", "StockCode"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) WHERE k = 1")
def drop_duplicates_first(spark, d):
    e = retail.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return cleaning.drop_duplicates(e, ["user_id", "event_type"], "first", ["event_id"])


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1")
def drop_duplicates_last(spark, d):
    e = retail.table(spark, d, "events").select("user_id", "event_type", "event_id")
    return cleaning.drop_duplicates(e, ["user_id", "event_type"], "last", ["event_id"])


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE n = 1")
def drop_duplicates_none(spark, d):
    t = retail.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    return cleaning.drop_duplicates(t, ["l_orderkey"], "none")


_GAPPY = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS v FROM customer"


def _gappy(spark: SparkSession, d: str) -> DataFrame:
    return retail.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("v"))


@query(f"WITH g AS ({_GAPPY}) SELECT c_custkey, round(coalesce(v, (SELECT median(v) FROM g)), 4) AS v FROM g")
def impute_median(spark, d):
    return cleaning.handle_missing(_gappy(spark, d), ["v"], "impute_median")


@query(f"WITH g AS ({_GAPPY}) SELECT c_custkey, round(coalesce(v, (SELECT avg(v) FROM g)), 4) AS v FROM g")
def impute_mean(spark, d):
    return cleaning.handle_missing(_gappy(spark, d), ["v"], "impute_mean")


@query(f"WITH g AS ({_GAPPY}) SELECT c_custkey, round(coalesce(v, 0), 4) AS v FROM g")
def impute_zero(spark, d):
    return cleaning.handle_missing(_gappy(spark, d), ["v"], "impute_zero")


@query(f"WITH g AS ({_GAPPY}) SELECT c_custkey, round(v, 4) AS v FROM g WHERE v IS NOT NULL")
def drop_missing(spark, d):
    return cleaning.handle_missing(_gappy(spark, d), ["v"], "drop")


_LINE = ("l_quantity", "l_extendedprice", "l_discount")


def _fences_sql(column: str, method: str, value: float) -> tuple[str, str]:
    q = lambda p: f"quantile_cont({column}, {p})"
    if method == "iqr":
        return f"{q(0.25)} - {value} * ({q(0.75)} - {q(0.25)})", f"{q(0.75)} + {value} * ({q(0.75)} - {q(0.25)})"
    if method == "zscore":
        return f"avg({column}) - {value} * stddev_pop({column})", f"avg({column}) + {value} * stddev_pop({column})"
    return q(round((100 - value) / 100, 6)), q(value / 100)


def _outliers_sql(method: str, value: float) -> str:
    parts = []
    for c in _LINE:
        lo, hi = _fences_sql(c, method, value)
        parts.append(f"SELECT '{c}' AS \"column\", {rnd('lo AS lower', 'hi AS upper')}, count({c}) AS n_valid, count(*) FILTER (WHERE lo <> hi AND ({c} < lo OR {c} > hi)) AS n_outliers, round(count(*) FILTER (WHERE lo <> hi AND ({c} < lo OR {c} > hi)) * 100.0 / count({c}), 4) AS rate_pct FROM lineitem, (SELECT {lo} AS lo, {hi} AS hi FROM lineitem) GROUP BY lo, hi")
    return " UNION ALL ".join(parts)


@query(_outliers_sql("iqr", 1.5))
def iqr_bounds(spark, d):
    return cleaning.outlier_summary(retail.table(spark, d, "lineitem"), _LINE, "iqr")


@query(_outliers_sql("zscore", 1.5))
def zscore_flags(spark, d):
    return cleaning.outlier_summary(retail.table(spark, d, "lineitem"), _LINE, "zscore", 1.5)


@query(_outliers_sql("percentile", 97.5))
def percentile_flags(spark, d):
    return cleaning.outlier_summary(retail.table(spark, d, "lineitem"), _LINE, "percentile", 97.5)


_LO, _HI = _fences_sql("c_acctbal", "iqr", 0.5)


@query(f"SELECT c_custkey, round(greatest(lo, least(c_acctbal, hi)), 4) AS c_acctbal FROM customer, (SELECT {_LO} AS lo, {_HI} AS hi FROM customer)")
def winsorize(spark, d):
    t = retail.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return cleaning.treat_outliers(t, ["c_acctbal"], "iqr", "winsorize", 0.5)


@query(f"SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal, c_acctbal < lo OR c_acctbal > hi AS \"IsOutlier\" FROM customer, (SELECT {_LO} AS lo, {_HI} AS hi FROM customer)")
def flag_outliers(spark, d):
    return cleaning.treat_outliers(retail.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "iqr", "flag", 0.5)


@query(f"SELECT c_custkey, round(c_acctbal, 4) AS c_acctbal FROM customer, (SELECT {_LO} AS lo, {_HI} AS hi FROM customer) WHERE NOT (c_acctbal < lo OR c_acctbal > hi)")
def remove_outliers(spark, d):
    return cleaning.treat_outliers(retail.table(spark, d, "customer").select("c_custkey", "c_acctbal"), ["c_acctbal"], "iqr", "remove", 0.5)


_SETTINGS = [("iqr", v) for v in (1.5, 2.0, 2.5, 3.0)] + [("percentile", v) for v in (95.0, 97.5, 99.0)] + [("zscore", 3.0)]


@query(" UNION ALL ".join("SELECT '{m}' AS method, {v} AS threshold, {r}, count(*) FILTER (WHERE lo <> hi AND (o_totalprice < lo OR o_totalprice > hi)) AS n_outliers, {rate} FROM orders, (SELECT {lo} AS lo, {hi} AS hi FROM orders) GROUP BY lo, hi".format(m=m, v=f"{v}::DOUBLE", r=rnd("lo AS lower", "hi AS upper"), rate=rnd("count(*) FILTER (WHERE lo <> hi AND (o_totalprice < lo OR o_totalprice > hi)) / count(o_totalprice) AS rate"), lo=_fences_sql("o_totalprice", m, v)[0], hi=_fences_sql("o_totalprice", m, v)[1]) for m, v in _SETTINGS))
def sensitivity_table(spark, d):
    return cleaning.sensitivity(retail.table(spark, d, "orders"), "o_totalprice")


# --- audit ---------------------------------------------------------------------------------

_PROFILE = "count({c}) AS count, count(*) FILTER (WHERE {c} IS NULL) AS missing, " + rnd("min({c})::DOUBLE AS min", "max({c})::DOUBLE AS max", "avg({c}) AS mean", "stddev_samp({c}) AS std") + ", count(*) FILTER (WHERE {c} = 0) AS zeros, count(*) FILTER (WHERE {c} < 0) AS negatives, " + rnd(*(f"quantile_cont({{c}}::DOUBLE, {v}) AS {k}" for k, v in profile.QUANTILES.items()))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", " + _PROFILE.format(c=c) + " FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_tax")))
def numerical_profile(spark, d):
    return profile.numerical_profile(retail.table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])


@query(" UNION ALL ".join(f"SELECT * FROM (WITH c AS (SELECT {c} AS v, count(*) AS n FROM part WHERE {c} IS NOT NULL GROUP BY {c}), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM c) SELECT '{c}' AS \"column\", (SELECT count(*) FROM c) AS n_unique, string_agg(v || ':' || n::VARCHAR, ';' ORDER BY k) AS top_values FROM r WHERE k <= 5)" for c in ("p_brand", "p_type")))
def categorical_topk(spark, d):
    return profile.categorical_profile(retail.table(spark, d, "part"), ["p_brand", "p_type"])


@query("SELECT o_orderpriority AS value, count(*) AS count, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS rate_pct FROM orders GROUP BY o_orderpriority")
def frequency_table(spark, d):
    return profile.frequency_table(retail.table(spark, d, "orders"), "o_orderpriority")


@query(RAW + ", t AS (SELECT InvoiceDate AS s, try_cast(InvoiceDate AS TIMESTAMP) AS t FROM raw) SELECT count(*) AS n_rows, count(t) AS parsed, count(*) FILTER (WHERE s IS NOT NULL AND t IS NULL) AS unparsed, count(*) FILTER (WHERE s IS NULL) AS missing, min(t) AS first, max(t) AS last, (SELECT sum(n)::BIGINT FROM (SELECT count(*) AS n FROM t GROUP BY t) WHERE n > 1) AS duplicate_timestamps FROM t")
def date_profile(spark, d):
    return profile.date_profile(retail.raw(spark, d), "InvoiceDate")


@query(RAW + ", g AS (SELECT CustomerID, count(*) AS n FROM raw WHERE CustomerID IS NOT NULL GROUP BY CustomerID) SELECT sum(n)::BIGINT AS non_null, count(*) AS n_unique, count(*) FILTER (WHERE n > 1) AS repeated_ids, (sum(n) - count(*))::BIGINT AS extra_rows, round(count(*) * 100.0 / sum(n), 4) AS unique_rate_pct, sum(n) = count(*) AS is_unique FROM g")
def identifier_profile(spark, d):
    return profile.identifier_profile(retail.raw(spark, d), "CustomerID")


@query(RAW + " SELECT count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) AS n_matching, round(count(*) FILTER (WHERE starts_with(InvoiceNo, 'C')) * 100.0 / count(InvoiceNo), 4) AS rate_pct FROM raw")
def cancellation_prefix(spark, d):
    return profile.prefix_profile(retail.raw(spark, d), "InvoiceNo", "C")


@query("SELECT * FROM (VALUES ('event_id', 'numeric'), ('ts', 'datetime'), ('user_id', 'numeric'), ('event_type', 'string'), ('value', 'numeric'), ('props', 'string')) v(\"column\", kind), (SELECT 0::BIGINT AS missing, false AS nullable)")
def schema_profile(spark, d):
    return profile.schema_profile(retail.table(spark, d, "events"))


# --- features ------------------------------------------------------------------------------


@query(TX + " SELECT CustomerID, round(sum(LineRevenue::DECIMAL(18,4))::DOUBLE, 4) AS revenue FROM tx GROUP BY CustomerID")
def line_revenue(spark, d):
    from ..functions.stats import money

    return cleaning.line_revenue(retail.clean(spark, d)).groupBy("CustomerID").agg(money("LineRevenue").alias("revenue"))


@query(BASE + f" SELECT * EXCLUDE (ActiveDays, TotalMonetary, AverageTransactionValue), {rnd('TotalMonetary', 'AverageTransactionValue')} FROM base")
def customer_base(spark, d):
    return features.customer_base(cleaning.with_flags(retail.clean(spark, d)))


def _diagnostic_sql(where: str) -> str:
    return TX + f" SELECT CustomerID, round(sum(LineRevenue::DECIMAL(18,4))::DOUBLE, 4) AS total_spend, count(InvoiceNo) AS n_lines, count(DISTINCT InvoiceNo) AS n_invoices, round(avg(Quantity), 4) AS mean_quantity, count(DISTINCT InvoiceDate::DATE) AS active_days FROM tx WHERE {where} GROUP BY CustomerID"


@query(_diagnostic_sql("NOT IsCancellation AND NOT IsReturn"))
def customer_diagnostic_clean(spark, d):
    return features.customer_diagnostic(cleaning.with_flags(retail.clean(spark, d)), "clean_purchase")


@query(_diagnostic_sql("true"))
def customer_diagnostic_all(spark, d):
    return features.customer_diagnostic(cleaning.with_flags(retail.clean(spark, d)), "all_rows")


@query(BASE + " SELECT CustomerID, datediff('day', LastPurchaseDate, (SELECT max(InvoiceDate) + INTERVAL 1 DAY FROM tx))::INT AS Recency FROM base")
def recency(spark, d):
    t = retail.clean(spark, d)
    return features.recency(features.customer_base(t, features.BASE[3:4]), features.reference_date(t))


@query(TX + " SELECT CustomerID, count(DISTINCT InvoiceNo) AS FrequencyInvoices, count(InvoiceNo) AS FrequencyLines, count(InvoiceNo) - count(DISTINCT InvoiceNo) AS FrequencyDifference FROM tx GROUP BY CustomerID")
def frequency_variants(spark, d):
    return features.frequency_variants(retail.clean(spark, d))


_MONEY = TX + ", m AS (SELECT CustomerID, sum(LineRevenue::DECIMAL(18,4))::DOUBLE AS MonetarySigned, sum(abs(LineRevenue)::DECIMAL(18,4))::DOUBLE AS MonetaryAbsolute, sum(CASE WHEN NOT IsCancellation THEN LineRevenue END::DECIMAL(18,4))::DOUBLE AS MonetaryPurchaseOnly, sum(CASE WHEN IsCancellation THEN LineRevenue END::DECIMAL(18,4))::DOUBLE AS MonetaryCancellationOnly FROM tx GROUP BY CustomerID)"


@query(_MONEY + f" SELECT CustomerID, {rnd(*features.MONETARY)} FROM m")
def monetary_variants(spark, d):
    return features.monetary_variants(cleaning.with_flags(retail.clean(spark, d)))


@query(_MONEY + " " + " UNION ALL ".join(f"SELECT '{v}' AS variant, count(*) FILTER (WHERE {v} <> 0) AS customers, round(count(*) FILTER (WHERE {v} <> 0) * 100.0 / count(*), 4) AS percentage FROM m" for v in features.MONETARY))
def monetary_overlap(spark, d):
    return features.monetary_overlap(features.monetary_variants(cleaning.with_flags(retail.clean(spark, d))))


@query(TX + ", s AS (SELECT CustomerID, sum(Quantity)::DOUBLE AS q, count(DISTINCT InvoiceNo) AS n, sum(CASE WHEN NOT IsCancellation THEN Quantity END)::DOUBLE AS p, count(DISTINCT CASE WHEN NOT IsCancellation THEN InvoiceNo END) AS m FROM tx GROUP BY CustomerID) SELECT CustomerID, " + rnd("q AS TotalQuantity", "q / n AS AverageQuantity", "q / n AS BasketSize", "p AS TotalQuantityPurchaseOnly", "p / nullif(m, 0) AS AverageQuantityPurchaseOnly", "p / nullif(m, 0) AS BasketSizePurchaseOnly", "q - p AS TotalQuantityDifference", "q / n - p / nullif(m, 0) AS AverageQuantityDifference", "q / n - p / nullif(m, 0) AS BasketSizeDifference") + " FROM s")
def quantity_sets(spark, d):
    return features.quantity_variants(cleaning.with_flags(retail.clean(spark, d)))


@query(BASE + " SELECT CustomerID, datediff('day', FirstPurchaseDate, LastPurchaseDate)::INT AS TenureDays FROM base")
def tenure(spark, d):
    return features.tenure(features.customer_base(retail.clean(spark, d), features.BASE[2:4]))


@query(TX + GAPS + f" SELECT CustomerID, {rnd('PurchaseIntervalMean', 'PurchaseIntervalStd')} FROM intervals")
def purchase_interval(spark, d):
    return features.purchase_interval(retail.clean(spark, d))


@query(TX + " SELECT CustomerID, count(DISTINCT InvoiceDate::DATE) AS ActiveDays FROM tx GROUP BY CustomerID")
def active_days(spark, d):
    return features.active_days(retail.clean(spark, d))


_DOUBLES = ("Monetary", "TotalQuantity", "AverageQuantity", "BasketSize", "PurchaseIntervalMean", "PurchaseIntervalStd", "AverageInvoiceValue", "ProductsPerInvoice", "CancellationRate", "ReturnRate")


@query(FEAT + f" SELECT * EXCLUDE ({', '.join(_DOUBLES)}), {rnd(*_DOUBLES)} FROM feat")
def candidate_features(spark, d):
    return _features(spark, d)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return features.candidate_features(cleaning.with_flags(retail.clean(spark, d)))


# --- statistics ----------------------------------------------------------------------------

_STATS = ("Recency", "Frequency", "Monetary", "TenureDays", "ReturnRate")
_DIST = rnd("avg({c}) AS mean", "stddev_samp({c}) AS std", "min({c})::DOUBLE AS min", "quantile_cont({c}::DOUBLE, 0.25) AS q25", "quantile_cont({c}::DOUBLE, 0.5) AS median", "quantile_cont({c}::DOUBLE, 0.75) AS q75", "max({c})::DOUBLE AS max", "skewness({c}) AS skewness", "kurtosis({c}) AS kurtosis", "0.0::DOUBLE AS missing_ratio", "var_samp({c}) AS variance", "CASE WHEN avg({c}) > 1e-9 THEN stddev_samp({c}) / avg({c}) END AS cv", digits=3)


@query(FEAT + " " + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS count, " + _DIST.format(c=c) + " FROM feat" for c in _STATS), 3)
def distribution_stats(spark, d):
    return profile.distribution_stats(_features(spark, d), _STATS)


def _pairs_sql(f: str) -> str:
    from itertools import combinations

    return " UNION ALL ".join(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {f.format(a=a, b=b)} FROM feat" for a, b in combinations(_STATS, 2))


@query(FEAT + " " + _pairs_sql("round(corr({a}, {b}), 4) + 0 AS corr"))
def pearson(spark, d):
    return profile.correlation_pairs(_features(spark, d), _STATS)


_RANKED = ", ranked AS (SELECT " + ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS {c}" for c in _STATS) + " FROM feat)"


@query(FEAT + _RANKED + " " + _pairs_sql("round(corr({a}, {b}), 4) + 0 AS corr").replace("FROM feat", "FROM ranked"))
def spearman(spark, d):
    return profile.correlation_pairs(_features(spark, d), _STATS, "spearman")


@query(FEAT + ", p AS (" + _pairs_sql("corr({a}, {b}) AS c") + ") SELECT feature_a, feature_b, round(c, 4) AS corr, round(abs(c), 4) AS abs_corr FROM p WHERE abs(c) >= 0.1")
def redundancy_pairs(spark, d):
    return profile.redundant_pairs(profile.correlation_pairs(_features(spark, d), _STATS), 0.1)


@query(FEAT + " SELECT round(corr(AverageQuantity, BasketSize), 4) AS pearson, avg((abs(AverageQuantity - BasketSize) <= 1e-12)::INT)::DOUBLE AS equality_rate, max(abs(AverageQuantity - BasketSize)) AS max_abs_diff, 'DUPLICATE' AS category FROM feat")
def pair_equality(spark, d):
    return profile.pair_equality(_features(spark, d), "AverageQuantity", "BasketSize")


@query(FEAT + " " + " UNION ALL ".join("SELECT '{c}' AS \"column\", count(*) FILTER (WHERE lo <> hi AND ({c} < lo OR {c} > hi)) AS n_outliers, {r} FROM feat, (SELECT {lo} AS lo, {hi} AS hi FROM feat)".format(c=c, lo=_fences_sql(f"{c}::DOUBLE", "iqr", 1.5)[0], hi=_fences_sql(f"{c}::DOUBLE", "iqr", 1.5)[1], r=rnd(f"count(*) FILTER (WHERE lo <> hi AND ({c} < lo OR {c} > hi)) / count({c}) AS ratio")) for c in _STATS))
def feature_outliers(spark, d):
    return profile.iqr_outliers(_features(spark, d), _STATS)


@query()
def normality(spark, d):
    return profile.normality(_features(spark, d), ["Recency", "Monetary"])


@query(FEAT + ", p AS (" + _pairs_sql("abs(corr({a}, {b})) AS c") + "), e AS (SELECT feature_a AS feature, c FROM p UNION ALL SELECT feature_b, c FROM p), s AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, avg(({c} IS NULL)::INT)::DOUBLE AS missing_ratio, count(DISTINCT {c}) AS n_unique FROM feat" for c in _STATS) + "), m AS (SELECT feature, max(c) AS c FROM e GROUP BY feature) SELECT feature, missing_ratio, n_unique, round(c, 4) AS max_corr, 'PASS' AS quality_gate, 'PASS' AS leakage_gate, CASE WHEN n_unique <= 1 THEN 'FAIL' ELSE 'PASS' END AS variance_gate, CASE WHEN n_unique <= 1 THEN 'EXCLUDE' WHEN c >= 0.95 THEN 'PENDING' ELSE 'RETAIN' END AS decision FROM s LEFT JOIN m USING (feature)")
def selection_gates(spark, d):
    f = _features(spark, d)
    stats = profile.stacked(f, _STATS, {"missing_ratio": lambda c: F.avg(F.col(c).isNull().cast("double")), "n_unique": lambda c: F.count_distinct(c)}, "feature")
    return segments.selection(stats, profile.correlation_pairs(f, _STATS))


# --- preparation ---------------------------------------------------------------------------


@query("SELECT o_orderkey, round(ln(1 + o_totalprice), 4) AS o_totalprice FROM orders")
def log1p(spark, d):
    return prep.log1p(retail.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


def _scaled(spark: SparkSession, d: str, kind: str) -> DataFrame:
    t = retail.table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    return prep.fit(t, ["o_totalprice"], "none", kind, impute=False).apply(t)


def _scale_sql(center: str, scale: str) -> str:
    return f"SELECT o_orderkey, round((o_totalprice - c) / s, 4) + 0 AS o_totalprice FROM orders, (SELECT {center} AS c, {scale} AS s FROM orders)"


@query(_scale_sql("avg(o_totalprice)", "stddev_pop(o_totalprice)"))
def standard_scale(spark, d):
    return _scaled(spark, d, "standard")


@query(_scale_sql("min(o_totalprice)", "max(o_totalprice) - min(o_totalprice)"))
def minmax_scale(spark, d):
    return _scaled(spark, d, "minmax")


@query(_scale_sql("quantile_cont(o_totalprice, 0.5)", "quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25)"))
def robust_scale(spark, d):
    return _scaled(spark, d, "robust")


@query("SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN (pow(c_acctbal + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal, 1.5) - 1) / 1.5 END, 3) + 0 AS c_acctbal FROM customer", 3)
def yeo_johnson_fixed(spark, d):
    t = retail.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return prep.Fitted(lambdas={"c_acctbal": 0.5}).apply(t)


@query()
def yeo_johnson_fitted(spark, d):
    t = retail.table(spark, d, "customer").select("c_custkey", "c_acctbal")
    return prep.fit(t, ["c_acctbal"], "yeo_johnson", "robust").apply(t)


# --- cluster quality -----------------------------------------------------------------------


def _points(spark: SparkSession, d: str) -> DataFrame:
    return retail.table(spark, d, "embeddings").select(F.col("vec_id").alias("key"), "label", F.col("embedding").cast("array<double>").alias("x"))


_DIMS = "WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM embeddings), c AS (SELECT label, d, avg(x) AS m FROM v GROUP BY ALL), w AS (SELECT v.label, vec_id, sum((x - m) ** 2) AS d2 FROM v JOIN c ON v.label = c.label AND v.d = c.d GROUP BY ALL)"


@query(_DIMS + ", g AS (SELECT d, avg(x) AS m FROM v GROUP BY d), sizes AS (SELECT label, count(DISTINCT vec_id) AS n FROM v GROUP BY label), b AS (SELECT sum(n * (c.m - g.m) ** 2) AS between_ FROM c JOIN g USING (d) JOIN sizes USING (label)), s AS (SELECT label, avg(sqrt(d2)) AS s FROM w GROUP BY label), f AS (SELECT x.label AS a, y.label AS b, sqrt(sum((x.m - y.m) ** 2)) AS far FROM c x JOIN c y ON x.d = y.d AND x.label <> y.label GROUP BY ALL), r AS (SELECT a, max((sa.s + sb.s) / far) AS r FROM f JOIN s sa ON sa.label = a JOIN s sb ON sb.label = b GROUP BY a) SELECT count(*) AS n, (SELECT count(*) FROM sizes) AS k, round(sum(d2), 3) AS wcss, round((SELECT between_ FROM b) / ((SELECT count(*) FROM sizes) - 1) / (sum(d2) / (count(*) - (SELECT count(*) FROM sizes))), 3) AS calinski_harabasz, round((SELECT avg(r) FROM r), 3) AS davies_bouldin FROM w", 3)
def internal_metrics(spark, d):
    return metrics.internal_metrics(_points(spark, d))


@query("WITH p AS (SELECT a.vec_id AS i, a.label AS l, b.label AS m, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id), g AS (SELECT i, l, m, avg(d) AS d FROM p GROUP BY ALL), s AS (SELECT i, max(CASE WHEN l = m THEN d END) AS a, min(CASE WHEN l <> m THEN d END) AS b FROM g GROUP BY i) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 4) AS silhouette FROM s")
def silhouette(spark, d):
    return metrics.silhouette(_points(spark, d))


@query("SELECT label AS a, (vec_id % 7)::INT AS b, count(*) AS n FROM embeddings GROUP BY ALL")
def contingency(spark, d):
    p = _points(spark, d)
    return metrics.contingency(p, p.withColumn("label", (F.col("key") % 7).cast("int")))


_AB = "WITH t AS (SELECT label AS a, label // 2 AS b, count(*) AS n FROM embeddings GROUP BY ALL), n AS (SELECT sum(n) AS n FROM t), a AS (SELECT a, sum(n) AS n FROM t GROUP BY a), b AS (SELECT b, sum(n) AS n FROM t GROUP BY b)"


@query(_AB + ", p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM t) AS i, (SELECT sum(n * (n - 1) / 2) FROM a) AS pa, (SELECT sum(n * (n - 1) / 2) FROM b) AS pb, (SELECT n * (n - 1) / 2 FROM n) AS e) SELECT round((i - pa * pb / e) / ((pa + pb) / 2 - pa * pb / e), 4) AS ari, round((SELECT sum(t.n / n.n * ln(n.n * t.n / (a.n * b.n))) FROM t JOIN a USING (a) JOIN b USING (b), n) / ((-(SELECT sum(a.n / n.n * ln(a.n / n.n)) FROM a, n) - (SELECT sum(b.n / n.n * ln(b.n / n.n)) FROM b, n)) / 2), 4) AS nmi FROM p")
def label_agreement(spark, d):
    p = _points(spark, d)
    v = metrics.agreement(metrics.table_of(metrics.contingency(p, p.withColumn("label", F.floor(F.col("label") / 2).cast("int")))))
    return spark.createDataFrame([(float(v["ari"]), float(v["nmi"]))], "ari double, nmi double")


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Four runs' labels of the vectors, in two blocks."""
    k, label = F.col("vec_id"), F.col("label")
    made = {"r0": label, "r1": F.floor(label / 2), "r2": k % 7, "r3": F.when(k % 11 == 0, 0).otherwise(label)}
    each = F.explode(F.array(*(F.struct(F.lit(r).alias("run_id"), v.cast("int").alias("label")) for r, v in made.items())))
    rows = retail.table(spark, d, "embeddings").select(k.alias("key"), each.alias("r")).select("key", "r.*")
    return rows.withColumn("block", F.when(F.col("run_id").isin("r0", "r3"), "R").otherwise("S")).unionByName(rows.withColumn("block", F.lit("N")))


_RUNS = "WITH base AS (SELECT vec_id AS key, 'r0' AS run_id, label::INT AS label FROM embeddings UNION ALL SELECT vec_id, 'r1', label // 2 FROM embeddings UNION ALL SELECT vec_id, 'r2', vec_id % 7 FROM embeddings UNION ALL SELECT vec_id, 'r3', CASE WHEN vec_id % 11 = 0 THEN 0 ELSE label END FROM embeddings), runs AS (SELECT *, CASE WHEN run_id IN ('r0', 'r3') THEN 'R' ELSE 'S' END AS block FROM base UNION ALL SELECT *, 'N' FROM base), cells AS (SELECT x.block, x.run_id AS run_a, y.run_id AS run_b, x.label AS a, y.label AS b, count(*) AS n FROM runs x JOIN runs y ON x.block = y.block AND x.key = y.key AND x.run_id < y.run_id GROUP BY ALL), ta AS (SELECT block, run_a, run_b, a, sum(n) AS na FROM cells GROUP BY ALL), tb AS (SELECT block, run_a, run_b, b, sum(n) AS nb FROM cells GROUP BY ALL), tot AS (SELECT block, run_a, run_b, sum(n) AS n, sum(n * (n - 1) / 2) AS i FROM cells GROUP BY ALL), pa AS (SELECT block, run_a, run_b, sum(na * (na - 1) / 2) AS pa FROM ta GROUP BY ALL), pb AS (SELECT block, run_a, run_b, sum(nb * (nb - 1) / 2) AS pb FROM tb GROUP BY ALL), ha AS (SELECT t.block, t.run_a, t.run_b, -sum(na / t.n * ln(na / t.n)) AS ha FROM ta JOIN tot t USING (block, run_a, run_b) GROUP BY ALL), hb AS (SELECT t.block, t.run_a, t.run_b, -sum(nb / t.n * ln(nb / t.n)) AS hb FROM tb JOIN tot t USING (block, run_a, run_b) GROUP BY ALL), mi AS (SELECT t.block, t.run_a, t.run_b, sum(c.n / t.n * ln(t.n * c.n / (na * nb))) AS mi FROM cells c JOIN ta USING (block, run_a, run_b, a) JOIN tb USING (block, run_a, run_b, b) JOIN tot t USING (block, run_a, run_b) GROUP BY ALL), pairs AS (SELECT block, run_a, run_b, (i - pa * pb / (n * (n - 1) / 2)) / ((pa + pb) / 2 - pa * pb / (n * (n - 1) / 2)) AS ari, mi / ((ha + hb) / 2) AS nmi FROM tot JOIN pa USING (block, run_a, run_b) JOIN pb USING (block, run_a, run_b) JOIN ha USING (block, run_a, run_b) JOIN hb USING (block, run_a, run_b) JOIN mi USING (block, run_a, run_b))"


@query(_RUNS + " SELECT block, run_a, run_b, round(ari, 4) AS ari, round(nmi, 4) AS nmi FROM pairs")
def run_agreement(spark, d):
    return experiments.pairwise_agreement(_runs(spark, d), within=["block"]).drop("ami")


@query(_RUNS + ", sides AS (SELECT block, run_a, run_b, ari FROM pairs UNION ALL SELECT block, run_b, run_a, ari FROM pairs) SELECT block, run_a, run_b, round(ari, 4) AS ari FROM sides UNION ALL SELECT DISTINCT block, run_a, run_a, 1.0 FROM sides")
def run_matrix(spark, d):
    return experiments.agreement_matrix(experiments.pairwise_agreement(_runs(spark, d), within=["block"]), ["block"])


@query(_RUNS + " SELECT block, count(*) AS n_pairs, round(min(ari), 4) AS min, round(avg(ari), 4) AS mean, round(max(ari), 4) AS max, round(stddev_pop(ari), 4) AS std, count(DISTINCT round(ari, 9)) AS unique_count FROM pairs GROUP BY block")
def run_off_diagonal(spark, d):
    return experiments.off_diagonal(experiments.pairwise_agreement(_runs(spark, d), within=["block"]), ["block"])


@query(_RUNS + " SELECT block, CASE WHEN run_a = 'r0' THEN run_b ELSE run_a END AS run_id, round(ari, 4) AS ari, round(nmi, 4) AS nmi FROM pairs WHERE run_a = 'r0' OR run_b = 'r0'")
def run_baseline(spark, d):
    return experiments.against_baseline(experiments.pairwise_agreement(_runs(spark, d), within=["block"]), "r0", ["block"]).drop("ami")


_MODELS = "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x, label::INT AS l FROM embeddings), m AS (SELECT 0 AS model, vec_id, x, l FROM v UNION ALL SELECT 1, vec_id, x, l // 2 FROM v UNION ALL SELECT 2, vec_id, x, (vec_id % 3)::INT FROM v), e AS (SELECT model, vec_id, l, unnest(x) AS v, generate_subscripts(x, 1) AS d FROM m), c AS (SELECT model, l, d, avg(v) AS c FROM e GROUP BY ALL), w AS (SELECT e.model, e.l, e.vec_id, sum((v - c) ** 2) AS d2 FROM e JOIN c USING (model, l, d) GROUP BY ALL), s AS (SELECT model, l, count(*) AS n, sum(d2) AS w, avg(sqrt(d2)) AS s FROM w GROUP BY ALL), t AS (SELECT model, sum(n) AS n, count(*) AS k, sum(w) AS wcss FROM s GROUP BY ALL), g AS (SELECT model, d, avg(v) AS g FROM e GROUP BY ALL), b AS (SELECT s.model, sum(s.n * (c - g) ** 2) AS b FROM c JOIN s USING (model, l) JOIN g ON g.model = c.model AND g.d = c.d GROUP BY ALL), f AS (SELECT x.model, x.l AS a, y.l AS b, sqrt(sum((x.c - y.c) ** 2)) AS far FROM c x JOIN c y ON x.model = y.model AND x.d = y.d AND x.l <> y.l GROUP BY ALL), r AS (SELECT f.model, a, max((x.s + y.s) / far) AS r FROM f JOIN s x ON x.model = f.model AND x.l = f.a JOIN s y ON y.model = f.model AND y.l = f.b GROUP BY ALL), db AS (SELECT model, avg(r) AS db FROM r GROUP BY model), pd AS (SELECT x.vec_id AS i, y.vec_id AS j, list_distance(x.x, y.x) AS d FROM v x JOIN v y ON x.vec_id <> y.vec_id), pg AS (SELECT x.model, i, x.l, y.l AS o, avg(d) AS d FROM pd JOIN m x ON x.vec_id = i JOIN m y ON y.vec_id = j AND y.model = x.model GROUP BY ALL), sil AS (SELECT model, i, max(CASE WHEN l = o THEN d END) AS a, min(CASE WHEN l <> o THEN d END) AS b FROM pg GROUP BY ALL), ms AS (SELECT model, avg((b - a) / greatest(a, b)) AS silhouette FROM sil GROUP BY model)"


@query(_MODELS + " SELECT model, t.n::BIGINT AS n, k, round(wcss, 3) AS wcss, round(b / (k - 1) / (wcss / (t.n - k)), 3) AS calinski_harabasz, round(db, 3) AS davies_bouldin, round(silhouette, 3) AS silhouette FROM t JOIN b USING (model) JOIN db USING (model) JOIN ms USING (model)", 3)
def metrics_by_model(spark, d):
    label = F.col("label").cast("int")
    p = _points(spark, d).select("key", F.array(label, F.floor(label / 2).cast("int"), (F.col("key") % 3).cast("int")).alias("labels"), "x")
    most = p.agg(F.max(F.col("labels")[0])).first()[0] + 1
    found = metrics.quality_by_model(p, [most, most, 3])
    rows = spark.createDataFrame([(t, *r) for t, r in enumerate(found)], "model int, n long, k long, wcss double, calinski_harabasz double, davies_bouldin double")
    return rows.join(metrics.silhouettes_by_model(p).groupBy("model").agg(F.avg("silhouette").alias("silhouette")), "model")


_STATUS = ", cases AS (SELECT 'labels' AS case_, count(DISTINCT label) AS k FROM embeddings UNION ALL SELECT 'one', count(DISTINCT label * 0) FROM embeddings UNION ALL SELECT 'noise', count(*) FILTER (WHERE vec_id IS NULL) FROM embeddings), val AS (SELECT 'silhouette' AS metric, silhouette AS value FROM ms WHERE model = 0 UNION ALL SELECT 'davies_bouldin', db FROM db WHERE model = 0 UNION ALL SELECT 'calinski_harabasz', b / (k - 1) / (wcss / (t.n - k)) FROM t JOIN b USING (model) WHERE model = 0 UNION ALL SELECT 'wcss', wcss FROM t WHERE model = 0), one AS (SELECT sum((u - g) ** 2) AS w FROM (SELECT unnest(x) AS u, generate_subscripts(x, 1) AS d FROM v) JOIN (SELECT d, g FROM g WHERE model = 0) USING (d))"


@query(_MODELS + _STATUS + " SELECT case_, metric, round(CASE WHEN k > 1 THEN value WHEN k = 1 AND metric = 'wcss' THEN w END, 3) AS value, CASE WHEN k > 1 OR (k = 1 AND metric = 'wcss') THEN 'VALID_VALUE' ELSE 'NOT_APPLICABLE' END AS status, CASE WHEN k = 0 THEN 'ALL_NOISE' WHEN k = 1 AND metric <> 'wcss' THEN 'SINGLE_CLUSTER' END AS reason FROM cases, val, one", 3)
def metric_status(spark, d):
    p = _points(spark, d)
    cases = {"labels": p, "one": p.withColumn("label", F.col("label") * 0), "noise": p.withColumn("label", F.lit(-1))}
    out = None
    for name, rows in cases.items():
        found = metrics.metrics_with_status(rows).select(F.lit(name).alias("case_"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query("WITH v AS (SELECT kind, props FROM clicks WHERE json_valid(props)), t AS (SELECT kind, substr(fullkey, 3) AS path, coalesce(j.value ->> '$', 'null') AS value FROM v, json_tree(v.props) j WHERE j.type <> 'OBJECT' AND fullkey NOT LIKE '%[%'), p AS (SELECT kind, path, count(*) AS recorded, count(DISTINCT value) AS n FROM t GROUP BY ALL), m AS (SELECT kind, count(*) AS members FROM v GROUP BY ALL) SELECT p.kind, replace(path, '\"', '') AS path, members, recorded, n + (recorded < members)::INT AS n_values FROM p JOIN m ON p.kind IS NOT DISTINCT FROM m.kind WHERE members > 1 AND n + (recorded < members)::INT > 1")
def provenance_differences(spark, d):
    return store.provenance_differences(retail.table(spark, d, "clicks").select("kind", "props"), "kind", "props")


@query("WITH f AS (SELECT * FROM items ORDER BY item_id LIMIT 1), c AS (SELECT i.item_id, unnest([{'field': 'brand', 's': i.brand, 'c': f.brand}, {'field': 'kind', 's': i.kind, 'c': f.kind}, {'field': 'size', 's': i.size::VARCHAR, 'c': f.size::VARCHAR}]) AS r FROM items i, f WHERE i.item_id IS DISTINCT FROM f.item_id) SELECT item_id, r.field AS field, r.s AS stored_value, r.c AS compared_value FROM c WHERE r.s IS DISTINCT FROM r.c")
def incompatible_fields(spark, d):
    return store.incompatible(retail.table(spark, d, "items"), "item_id", ["brand", "kind", "size"])


@query()
def cluster_sweep(spark, d):
    """Metrics of four algorithms for 2 to 10 clusters, fitted in shared passes, and of DBSCAN."""
    return experiments.sweep(_points(spark, d).select("key", "x")).drop("runtime")


def _census_sql(column: str, table: str) -> str:
    x = f"trim({column}::VARCHAR)"
    kind = f"CASE WHEN {x} IS NULL OR {x} = '' THEN 0 " + " ".join(f"WHEN regexp_full_match({x}, '{p}') THEN {1 << i}" for i, p in enumerate(profile.KINDS.values())) + " ELSE 16 END"
    counts = ", ".join(f"count(*) FILTER (WHERE k = {1 << i}) AS n_{n}" for i, n in enumerate([*profile.KINDS, "text"]))
    return f"SELECT '{column}' AS \"column\", count(*) FILTER (WHERE k = 0) AS missing, {counts}, CASE WHEN bit_or(k) IN (1, 2, 3) THEN 'numeric' WHEN bit_or(k) = 4 THEN 'boolean' WHEN bit_or(k) = 8 THEN 'datetime' WHEN bit_or(k) IN (0, 16) OR bit_or(k) IS NULL THEN 'string' ELSE 'mixed' END AS inferred_type FROM (SELECT {kind} AS k FROM {table})"


@query(" UNION ALL ".join(_census_sql(c, "stamps") for c in ("stamp_id", "source", "zone", "raw")))
def type_census(spark, d):
    return profile.type_census(retail.table(spark, d, "stamps"), ["stamp_id", "source", "zone", "raw"])


def _fit_query(name: str, algorithm: str | None = None, **params) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return cluster.make(algorithm or name, **params).fit(_points(spark, d).select("key", "x")).labels.select("key", "label")

    QUERIES[f"cluster_{name}"] = run


for _name, _params in (("kmeans", {"n_clusters": 10}), ("fuzzy_cmeans", {"n_clusters": 4, "max_iter": 30}), ("gmm", {"n_components": 4, "covariance_type": "diag", "max_iter": 20}), ("dbscan", {"eps": 6.0}), ("agglomerative", {"n_clusters": 10})):
    _fit_query(_name, **_params)
_fit_query("single_linkage", algorithm="agglomerative", n_clusters=10, linkage="single")

#: Core points, the least core key that each reaches, and that rank as the number of its cluster.
SQL["cluster_dbscan"] = "WITH RECURSIVE near AS (SELECT a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) <= 6.0), core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 5), links AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)), reach AS (SELECT i, i AS j FROM core UNION SELECT r.i, l.j FROM reach r JOIN links l ON r.j = l.i), least AS (SELECT i, min(j) AS g FROM reach GROUP BY i), number AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS label FROM (SELECT DISTINCT g FROM least)), labelled AS (SELECT i, label FROM least JOIN number USING (g)), border AS (SELECT n.i, min(label) AS label FROM near n JOIN labelled l ON l.i = n.j WHERE n.i NOT IN (FROM core) GROUP BY n.i) SELECT vec_id AS key, coalesce(l.label, b.label, -1)::INT AS label FROM embeddings e LEFT JOIN labelled l ON l.i = vec_id LEFT JOIN border b ON b.i = vec_id"


# --- segments ------------------------------------------------------------------------------


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    label = F.when(F.col("CustomerID") % 29 == 0, -1).otherwise(F.col("CustomerID") % 4).cast("int")
    f = _features(spark, d)
    boost = lambda c: F.col(c) * (1 + F.col("CustomerID") % 4)
    return f.withColumns({"label": label, "key": F.col("CustomerID"), "Monetary": boost("Monetary"), "Frequency": boost("Frequency")})


_SEG = FEAT + ", seg AS (SELECT * REPLACE (Monetary * (1 + CustomerID % 4) AS Monetary, Frequency * (1 + CustomerID % 4) AS Frequency), (CASE WHEN CustomerID % 29 = 0 THEN -1 ELSE CustomerID % 4 END)::INT AS label FROM feat)"
_SEG_FEATURES = ("Recency", "Frequency", "Monetary", "TenureDays")
_LONG = _SEG + ", long AS (" + " UNION ALL ".join(f"SELECT label, '{c}' AS feature, {c}::DOUBLE AS v FROM seg WHERE label <> -1" for c in _SEG_FEATURES) + "), prof AS (SELECT label, feature, count(v) AS n, avg(v) AS mean, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.75) AS p75, min(v) AS min, max(v) AS max, stddev_samp(v) AS std, CASE WHEN grouping(label) = 1 THEN 'OVERALL' ELSE 'CLUSTER' END AS scope FROM long GROUP BY GROUPING SETS ((label, feature), (feature)))"
_REL = _LONG + ", rel AS (SELECT c.label, c.feature, c.median, o.median AS overall, CASE WHEN abs(o.median) > 1e-9 THEN (c.median - o.median) / abs(o.median) * 100 END AS pct FROM prof c JOIN prof o ON c.feature = o.feature AND o.scope = 'OVERALL' WHERE c.scope = 'CLUSTER'), dir AS (SELECT *, CASE WHEN pct IS NULL THEN 'NA' WHEN pct >= 10 THEN 'HIGHER' WHEN pct <= -10 THEN 'LOWER' ELSE 'COMPARABLE' END AS direction FROM rel)"
_LAP = ", lap AS (SELECT a.feature, a.label AS label_a, b.label AS label_b, CASE WHEN greatest(a.p75 - a.p25, b.p75 - b.p25) = 0 THEN (a.p25 = b.p25)::INT::DOUBLE ELSE greatest(0, least(a.p75, b.p75) - greatest(a.p25, b.p25)) / greatest(a.p75 - a.p25, b.p75 - b.p25) END AS overlap FROM prof a JOIN prof b ON a.feature = b.feature AND a.label < b.label WHERE a.scope = 'CLUSTER' AND b.scope = 'CLUSTER')"
_DISTINCT = ", eff AS (SELECT c.feature, (max(c.median) - min(c.median)) / abs(o.median) * 100 AS effect FROM prof c JOIN prof o ON c.feature = o.feature AND o.scope = 'OVERALL' WHERE c.scope = 'CLUSTER' GROUP BY c.feature, o.median), dist AS (SELECT feature, effect, avg(overlap) AS om, CASE WHEN avg(overlap) >= 0.7 THEN 'HIGH_OVERLAP' WHEN effect >= 50 AND avg(overlap) <= 0.5 THEN 'HIGH' WHEN effect >= 15 THEN 'MODERATE' ELSE 'LOW' END AS class FROM eff JOIN lap USING (feature) GROUP BY feature, effect)"


@query(_SEG + ", s AS (SELECT label, count(DISTINCT CustomerID) AS n FROM seg GROUP BY label), t AS (SELECT sum(n) AS t, sum(n) FILTER (WHERE label <> -1) AS a, count(*) FILTER (WHERE label <> -1) AS k FROM s) SELECT label, n, round(CASE WHEN label <> -1 THEN n * 100.0 / a END, 4) AS pct_of_assigned, round(n * 100.0 / t, 4) AS pct_of_total, round(CASE WHEN label <> -1 THEN n * k / a END, 4) AS relative_size FROM s, t")
def cluster_sizes(spark, d):
    return segments.sizes(_segmented(spark, d))


@query(_SEG + " SELECT count(*) FILTER (WHERE label = -1) AS noise, round(avg((label = -1)::INT) * 100, 4) AS noise_pct FROM seg")
def noise_summary(spark, d):
    return segments.noise_summary(_segmented(spark, d))


@query(_SEG + ", s AS (SELECT label, count(*) AS n FROM seg WHERE label <> -1 GROUP BY label) SELECT count(*) AS k, max(n) AS largest, min(n) AS smallest, round(avg(abs(n - (SELECT avg(n) FROM s))), 4) AS mean_abs_deviation, quantile_cont(n::DOUBLE, 0.5) AS median, round(max(n) / min(n), 4) AS size_ratio, max(n) - min(n) AS size_range FROM s")
def size_distribution(spark, d):
    return segments.distribution_indicators(segments.sizes(_segmented(spark, d)))


@query(_LONG + f" SELECT label, feature, n, {rnd('mean', 'median', 'p25', 'p75', 'min', 'max', 'std', digits=3)}, scope FROM prof", 3)
def segment_profiles(spark, d):
    return segments.feature_profiles(_segmented(spark, d), _SEG_FEATURES)


@query(_REL + f" SELECT label, feature, {rnd('median', 'overall', 'pct AS rel_diff_pct', digits=3)}, CASE WHEN abs(overall) <= 1e-9 THEN 'ZERO_REFERENCE' ELSE 'OK' END AS status, direction FROM dir", 3)
def relative_diff(spark, d):
    return segments.relative_comparison(segments.feature_profiles(_segmented(spark, d), _SEG_FEATURES))


@query(_LONG + _LAP + f" SELECT feature, label_a, label_b, {rnd('overlap')} FROM lap")
def iqr_overlap(spark, d):
    return segments.pair_overlaps(segments.feature_profiles(_segmented(spark, d), _SEG_FEATURES))


@query(_LONG + _LAP + _DISTINCT + f" SELECT feature, {rnd('effect AS effect_range_pct', 'om AS overlap_mean', digits=3)}, class FROM dist", 3)
def distinguishing_class(spark, d):
    return segments.distinguishing(segments.feature_profiles(_segmented(spark, d), _SEG_FEATURES))


_NAMES = _REL + _LAP + _DISTINCT + ", d AS (SELECT label, max(direction) FILTER (WHERE feature = 'Recency') AS r, max(direction) FILTER (WHERE feature = 'Frequency') AS f, max(direction) FILTER (WHERE feature = 'Monetary') AS m, max(direction) FILTER (WHERE feature = 'TenureDays' AND class IN ('HIGH', 'MODERATE')) AS t FROM dir JOIN dist USING (feature) GROUP BY label), tiers AS (SELECT label, CASE r WHEN 'LOWER' THEN 'Recent' WHEN 'HIGHER' THEN 'Older' ELSE 'Mixed' END AS recency_tier, CASE f WHEN 'LOWER' THEN 'Occasional' WHEN 'HIGHER' THEN 'Frequent' ELSE 'Mixed' END AS frequency_tier, CASE m WHEN 'LOWER' THEN 'LowValue' WHEN 'HIGHER' THEN 'HighValue' ELSE 'Mixed' END AS monetary_tier, CASE WHEN t = 'HIGHER' THEN 'LongTenured' END AS modifier FROM d), named AS (SELECT *, concat_ws(' ', recency_tier, frequency_tier, CASE WHEN monetary_tier <> 'Mixed' AND NOT (frequency_tier = 'Occasional' AND monetary_tier = 'LowValue') THEN monetary_tier END, modifier) AS segment_name, CASE WHEN recency_tier = 'Mixed' AND frequency_tier = 'Mixed' THEN 'COMPARATIVE' ELSE 'NAMED' END AS status FROM tiers)"


def _named(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    s = _segmented(spark, d)
    p = segments.feature_profiles(s, _SEG_FEATURES)
    rel, dist = segments.relative_comparison(p), segments.distinguishing(p)
    return s, rel, dist, segments.segment_names(rel, dist)


@query(_NAMES + " SELECT * FROM named")
def segment_names(spark, d):
    return _named(spark, d)[3]


@query(_SEG + ", s AS (SELECT label, count(*) AS n FROM seg WHERE label <> -1 GROUP BY label), p AS (SELECT label, n, n * 100.0 / sum(n) OVER () AS pct FROM s) SELECT label, n, round(pct, 4) AS pct_of_assigned, CASE WHEN pct >= 50 THEN 'DOMINANT' WHEN pct >= 25 THEN 'LARGE' WHEN pct >= 5 THEN 'MEDIUM' WHEN pct >= 1 THEN 'SMALL' ELSE 'MICRO' END AS size_band, CASE WHEN n < 30 THEN 'LOW' ELSE 'OK' END AS reliability FROM p")
def size_bands(spark, d):
    return segments.size_bands(segments.sizes(_segmented(spark, d)))


@query(_REL + " SELECT label, count(*) FILTER (WHERE direction IN ('HIGHER', 'LOWER')) AS n_directional, CASE WHEN count(*) FILTER (WHERE direction IN ('HIGHER', 'LOWER')) >= 3 THEN 'SUPPORTED' WHEN count(*) FILTER (WHERE direction IN ('HIGHER', 'LOWER')) >= 1 THEN 'LIMITED' ELSE 'NOT_ASSESSABLE' END AS relevance FROM dir GROUP BY label")
def business_relevance(spark, d):
    return segments.business_relevance(_named(spark, d)[1])


@query(_REL + _LAP + _DISTINCT + ", g AS (SELECT label, count(*) FILTER (WHERE class = 'HIGH' AND direction IN ('HIGHER', 'LOWER')) AS n_high, count(*) FILTER (WHERE direction <> 'NA') AS known FROM dir JOIN dist USING (feature) GROUP BY label) SELECT label, n_high, CASE WHEN known = 0 THEN 'NOT_ASSESSABLE' WHEN n_high >= 2 THEN 'DISTINCT' WHEN n_high = 1 THEN 'LIMITED' ELSE 'NOT_DISTINCT' END AS distinctiveness FROM g")
def distinctiveness(spark, d):
    _, rel, dist, _ = _named(spark, d)
    return segments.distinctiveness(rel, dist)


_FIT = lambda t, c, low, high: f"({t} = 'Mixed' OR ({t} = '{low}' AND {c} = 'LOWER') OR ({t} = '{high}' AND {c} = 'HIGHER'))"
_FINAL = (
    _NAMES + ", bs AS (SELECT label, count(*) AS n FROM seg WHERE label <> -1 GROUP BY label), bp AS (SELECT label, n, n * 100.0 / sum(n) OVER () AS pct FROM bs), bands AS (SELECT label, n, pct AS pct_of_assigned, CASE WHEN pct >= 50 THEN 'DOMINANT' WHEN pct >= 25 THEN 'LARGE' WHEN pct >= 5 THEN 'MEDIUM' WHEN pct >= 1 THEN 'SMALL' ELSE 'MICRO' END AS size_band, CASE WHEN n < 30 THEN 'LOW' ELSE 'OK' END AS reliability FROM bp)"
    + ", hg AS (SELECT label, count(*) FILTER (WHERE class = 'HIGH' AND direction IN ('HIGHER', 'LOWER')) AS n_high, count(*) FILTER (WHERE direction <> 'NA') AS known FROM dir JOIN dist USING (feature) GROUP BY label), hi AS (SELECT label, n_high, CASE WHEN known = 0 THEN 'NOT_ASSESSABLE' WHEN n_high >= 2 THEN 'DISTINCT' WHEN n_high = 1 THEN 'LIMITED' ELSE 'NOT_DISTINCT' END AS distinctiveness FROM hg)"
    + ", dn AS (SELECT label, count(*) FILTER (WHERE direction IN ('HIGHER', 'LOWER')) AS n_directional, max(direction) FILTER (WHERE feature = 'Recency') AS dr, max(direction) FILTER (WHERE feature = 'Frequency') AS df, max(direction) FILTER (WHERE feature = 'Monetary') AS dm, max(direction) FILTER (WHERE feature = 'TenureDays') AS dt FROM dir GROUP BY label)"
    + f", fin AS (SELECT label, segment_name, status, n, pct_of_assigned, size_band, reliability, n_high, distinctiveness, n_directional, CASE WHEN n_directional >= 3 THEN 'SUPPORTED' WHEN n_directional >= 1 THEN 'LIMITED' ELSE 'NOT_ASSESSABLE' END AS relevance, CASE WHEN n_directional > 6 THEN 'PARTIALLY_INTERPRETABLE' ELSE 'INTERPRETABLE' END AS interpretability, CASE WHEN NOT coalesce({_FIT('recency_tier', 'dr', 'Recent', 'Older')} AND {_FIT('frequency_tier', 'df', 'Occasional', 'Frequent')} AND {_FIT('monetary_tier', 'dm', 'LowValue', 'HighValue')}, false) THEN 'RFM_INCONSISTENT' WHEN modifier IS NULL OR dt = 'HIGHER' THEN 'CONSISTENT' WHEN dt IS NULL OR dt = 'NA' THEN 'PARTIALLY_CONSISTENT' ELSE 'MODIFIER_INCONSISTENT' END AS consistency FROM named LEFT JOIN bands USING (label) LEFT JOIN hi USING (label) LEFT JOIN dn USING (label))"
    + ", rdy AS (SELECT *, coalesce(distinctiveness IN ('DISTINCT', 'LIMITED') AND interpretability <> 'LIMITED' AND consistency IN ('CONSISTENT', 'PARTIALLY_CONSISTENT') AND relevance <> 'NOT_ASSESSABLE', false) AS is_ready FROM fin)"
)


@query(_FINAL + " SELECT * REPLACE (round(pct_of_assigned, 4) AS pct_of_assigned), CASE WHEN NOT is_ready THEN 'LIMITED' WHEN size_band IN ('DOMINANT', 'LARGE', 'MEDIUM') THEN 'READY' ELSE 'CONDITIONAL' END AS readiness FROM rdy")
def final_segments(spark, d):
    s, rel, dist, names = _named(spark, d)
    return segments.final_definitions(names, segments.size_bands(segments.sizes(s)), rel, dist)


@query(_LONG + " SELECT c.label, c.feature, CASE WHEN c.mean >= o.mean + 0.5 * o.std THEN 'mean_high' WHEN c.mean <= o.mean - 0.5 * o.std THEN 'mean_low' ELSE 'median_above' END AS characteristic FROM prof c JOIN prof o ON c.feature = o.feature AND o.scope = 'OVERALL' WHERE c.scope = 'CLUSTER' AND (c.mean >= o.mean + 0.5 * o.std OR c.mean <= o.mean - 0.5 * o.std OR c.median > o.median)")
def characteristics(spark, d):
    return segments.characteristics(_segmented(spark, d), _SEG_FEATURES)


@query("WITH c AS (SELECT c_nationkey % 3 AS label, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, value)::INT AS place FROM c) SELECT label, place, value, n, (SELECT coalesce(sum(n), 0)::BIGINT FROM r x WHERE x.label = r.label AND place > 3) AS other_count, 0::BIGINT AS missing_count FROM r WHERE place <= 3")
def segment_categories(spark, d):
    t = retail.table(spark, d, "customer").withColumn("label", F.col("c_nationkey") % 3)
    return segments.categorical_profile(t, "c_mktsegment")


@query(_NAMES + " SELECT label, segment_name, len(string_split(segment_name, ' '))::INT AS n_known, true AS matched FROM named")
def parsed_names(spark, d):
    p = segments.parsed_names(_named(spark, d)[3])
    words = F.size(F.filter(F.split("segment_name", " "), lambda w: F.array_contains(F.array(*(F.lit(x) for x in segments.WORDS)), w)))
    return p.select("label", "segment_name", words.alias("n_known"), "matched")


# --- experiment results --------------------------------------------------------------------

_RESULTS = "WITH res AS (SELECT event_type AS experiment_id, event_id::VARCHAR AS run_id, 'alg' || (user_id % 4)::VARCHAR AS algorithm, (2 + event_id % 9)::INT AS k, CASE WHEN event_id % 11 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status, CASE WHEN event_id % 11 <> 0 THEN round(value, 2) END AS silhouette, CASE WHEN event_id % 11 <> 0 THEN (event_id * 7919 % 1009) / 100.0::DOUBLE END AS davies_bouldin, CASE WHEN event_id % 11 <> 0 THEN (event_id * 104729 % 10007)::DOUBLE END AS calinski_harabasz, (event_id * 31 % 977)::DOUBLE AS wcss, (event_id % 13)::DOUBLE AS runtime FROM events WHERE value IS NOT NULL)"


def _results(spark: SparkSession, d: str) -> DataFrame:
    e = retail.table(spark, d, "events").where("value IS NOT NULL")
    i = F.col("event_id")
    ok = lambda c: F.when(i % 11 != 0, c)
    return e.select(
        F.col("event_type").alias("experiment_id"), i.cast("string").alias("run_id"), F.concat(F.lit("alg"), (F.col("user_id") % 4).cast("string")).alias("algorithm"),
        (2 + i % 9).cast("int").alias("k"), F.when(i % 11 == 0, "FAILED").otherwise("SUCCESS").alias("status"), ok(F.round("value", 2)).alias("silhouette"),
        ok((i * 7919 % 1009) / 100.0).alias("davies_bouldin"), ok((i * 104729 % 10007).cast("double")).alias("calinski_harabasz"),
        (i * 31 % 977).cast("double").alias("wcss"), (i % 13).cast("double").alias("runtime"),
    )


_SUMMARY = "count(*) AS n_runs, count(*) FILTER (WHERE status = 'SUCCESS') AS n_success, count(*) FILTER (WHERE status = 'FAILED') AS n_failed, " + ", ".join(f"count({m}) AS {m}_n, {rnd(f'min({m}) AS {m}_min', f'max({m}) AS {m}_max', f'avg({m}) AS {m}_mean', digits=3)}" for m in experiments.METRICS)


@query(_RESULTS + f" SELECT experiment_id, {_SUMMARY} FROM res GROUP BY ALL", 3)
def experiment_summary(spark, d):
    return experiments.summary(_results(spark, d), ["experiment_id"])


@query(_RESULTS + f" SELECT experiment_id, algorithm, {_SUMMARY} FROM res GROUP BY ALL", 3)
def algorithm_summary(spark, d):
    return experiments.summary(_results(spark, d), ["experiment_id", "algorithm"])


@query(_RESULTS + f" SELECT experiment_id, algorithm, k, {_SUMMARY} FROM res GROUP BY ALL", 3)
def k_summary(spark, d):
    return experiments.summary(_results(spark, d), ["experiment_id", "algorithm", "k"])


@query(_RESULTS + " SELECT experiment_id, metric, count(*) AS n, " + rnd("min(v) AS min", "max(v) AS max", "avg(v) AS mean", "CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(v) END AS std", digits=3) + " FROM (" + " UNION ALL ".join(f"SELECT experiment_id, '{m}' AS metric, {m} AS v FROM res" for m in experiments.METRICS) + ") WHERE v IS NOT NULL GROUP BY ALL", 3)
def metrics_long(spark, d):
    return experiments.metrics_long(_results(spark, d))


@query(_RESULTS + " SELECT run_id, silhouette, CASE WHEN silhouette IS NOT NULL THEN rank() OVER (PARTITION BY experiment_id, algorithm ORDER BY silhouette DESC NULLS LAST) END::INT AS rank_silhouette FROM res")
def min_rank(spark, d):
    return experiments.metric_ranks(_results(spark, d), "silhouette", ["experiment_id", "algorithm"]).select("run_id", "silhouette", "rank_silhouette")


@query(_RESULTS + " SELECT run_id, rank() OVER (PARTITION BY experiment_id ORDER BY silhouette) + (count(*) OVER (PARTITION BY experiment_id, silhouette) - 1) / 2.0 AS rank FROM res WHERE silhouette IS NOT NULL")
def average_tie_rank(spark, d):
    from ..functions.stats import average_rank

    return _results(spark, d).where("silhouette IS NOT NULL").select("run_id", average_rank(F.col("silhouette"), "experiment_id").alias("rank"))


_BEST = _RESULTS + ", best AS (SELECT algorithm, k, avg(silhouette) AS silhouette, avg(davies_bouldin) AS davies_bouldin, avg(calinski_harabasz) AS calinski_harabasz, avg(wcss) AS wcss FROM res GROUP BY ALL)"


def _best(spark: SparkSession, d: str) -> DataFrame:
    return _results(spark, d).groupBy("algorithm", "k").agg(*(F.avg(m).alias(m) for m in (*experiments.METRICS, "wcss")))


@query(_BEST + ", r AS (SELECT *, row_number() OVER (PARTITION BY algorithm ORDER BY silhouette DESC, k) AS a, row_number() OVER (PARTITION BY algorithm ORDER BY davies_bouldin, k) AS b, row_number() OVER (PARTITION BY algorithm ORDER BY calinski_harabasz DESC, k) AS c, lag(wcss) OVER (PARTITION BY algorithm ORDER BY k) AS w FROM best), e AS (SELECT algorithm, k, concat_ws(',', CASE WHEN a <= 2 THEN 'silhouette' END, CASE WHEN b <= 2 THEN 'davies_bouldin' END, CASE WHEN c <= 2 THEN 'calinski_harabasz' END, CASE WHEN (w - wcss) / w >= 0.2 THEN 'elbow' END) AS evidence, (a <= 2)::INT + (b <= 2)::INT + (c <= 2)::INT + coalesce(((w - wcss) / w >= 0.2)::INT, 0) AS n_evidence FROM r) SELECT * FROM e WHERE n_evidence >= 2")
def candidate_k(spark, d):
    return experiments.candidate_k(_best(spark, d)).withColumn("evidence", F.array_join("evidence", ","))


@query(_RESULTS + ", f AS (SELECT *, rank() OVER w AS r, row_number() OVER (PARTITION BY algorithm ORDER BY silhouette DESC, davies_bouldin, calinski_harabasz DESC, run_id) AS n FROM res WHERE silhouette IS NOT NULL AND davies_bouldin IS NOT NULL AND calinski_harabasz IS NOT NULL WINDOW w AS (PARTITION BY algorithm ORDER BY silhouette DESC, davies_bouldin, calinski_harabasz DESC)), t AS (SELECT *, sum((r = 1)::INT) OVER (PARTITION BY algorithm) > 1 AS tied FROM f) SELECT * EXCLUDE (r, n) FROM t WHERE n = 1")
def selected_configuration(spark, d):
    return experiments.selected(_results(spark, d))


@query(_RESULTS + ", k AS (SELECT run_id, CASE WHEN silhouette IS NOT NULL THEN rank() OVER (PARTITION BY experiment_id, algorithm ORDER BY silhouette DESC NULLS LAST) END AS a, CASE WHEN davies_bouldin IS NOT NULL THEN rank() OVER (PARTITION BY experiment_id, algorithm ORDER BY davies_bouldin NULLS LAST) END AS b, CASE WHEN calinski_harabasz IS NOT NULL THEN rank() OVER (PARTITION BY experiment_id, algorithm ORDER BY calinski_harabasz DESC NULLS LAST) END AS c FROM res) SELECT run_id, abs(a - b)::INT AS diff_db, abs(a - c)::INT AS diff_ch, coalesce(abs(a - b) > 1, false) AS conflict_db, coalesce(abs(a - c) > 1, false) AS conflict_ch FROM k")
def cross_metric_conflicts(spark, d):
    return experiments.metric_conflicts(_results(spark, d), ["experiment_id", "algorithm"]).select("run_id", "diff_db", "diff_ch", "conflict_db", "conflict_ch")


_FIELDS = ("experiment_id", "run_id", "algorithm", "k", "status", "silhouette", "davies_bouldin", "calinski_harabasz", "wcss", "runtime")


@query(_RESULTS + " " + " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) AS present, count(*) - count({f}) AS missing FROM res" for f in _FIELDS))
def field_coverage(spark, d):
    return experiments.field_coverage(_results(spark, d))


@query(_RESULTS + " SELECT sha256(concat_ws('|', experiment_id, algorithm, k::VARCHAR)) AS identity, count(*) AS n FROM res GROUP BY experiment_id, algorithm, k HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return experiments.duplicate_keys(_results(spark, d), ["experiment_id", "algorithm", "k"])


@query(_RESULTS + ", g AS (SELECT algorithm, k, count(DISTINCT status) AS s, count(DISTINCT experiment_id) AS e FROM res GROUP BY ALL) SELECT algorithm, k, concat_ws(',', CASE WHEN s > 1 THEN 'status' END, CASE WHEN e > 1 THEN 'experiment_id' END) AS fields FROM g WHERE s > 1 OR e > 1")
def inconsistent_conditions(spark, d):
    return experiments.inconsistent(_results(spark, d), ["algorithm", "k"], ["status", "experiment_id"]).withColumn("fields", F.array_join("fields", ","))


@query(_RESULTS + " SELECT algorithm, count(runtime) AS n, " + rnd("avg(runtime) AS mean", "stddev_pop(runtime) AS std", "min(runtime) AS min", "max(runtime) AS max") + ", count(DISTINCT runtime) AS unique_count, " + rnd("stddev_pop(runtime) / avg(runtime) AS cv") + " FROM res GROUP BY algorithm")
def runtime_variation(spark, d):
    return experiments.variation(_results(spark, d), "runtime", ["algorithm"])


@query(_RESULTS + " SELECT validity, count(*) AS n FROM (SELECT CASE WHEN status = 'FAILED' AND silhouette IS NOT NULL THEN 'INVALID' ELSE 'OK' END AS validity FROM res) GROUP BY validity")
def result_validity(spark, d):
    return validate.result_rows(_results(spark, d)).groupBy("validity").agg(F.count(F.lit(1)).alias("n"))


# --- validation and feeds ------------------------------------------------------------------


@query("SELECT count(*) AS left_rows, (SELECT count(*) FROM customer WHERE c_custkey % 3 <> 0) AS right_rows, (SELECT count(*) FROM customer WHERE c_custkey % 3 = 0) AS left_only, 0::BIGINT AS right_only, false AS aligned FROM customer")
def key_alignment(spark, d):
    c = retail.table(spark, d, "customer").select("c_custkey")
    return validate.alignment(c, c.where("c_custkey % 3 <> 0"), "c_custkey")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value::DECIMAL(18,4))::DOUBLE, 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, d):
    return feeds.windowed(retail.table(spark, d, "events"))


def rfm(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: recency, frequency and monetary value of every customer, from raw lines."""
    return features.candidate_features(cleaning.clean_transactions(retail.raw(spark, d))).select("CustomerID", "Recency", "Frequency", "Monetary")


@query(RAW + f", kept AS (SELECT DISTINCT InvoiceNo, StockCode, Description, Quantity, try_cast(InvoiceDate AS TIMESTAMP) AS InvoiceDate, UnitPrice, CustomerID, Country FROM raw WHERE NOT ({DROP_SQL})) SELECT CustomerID, datediff('day', max(InvoiceDate), (SELECT max(InvoiceDate) + INTERVAL 1 DAY FROM kept))::INT AS Recency, count(DISTINCT InvoiceNo) AS Frequency, round(sum((Quantity * UnitPrice)::DECIMAL(18,4))::DOUBLE, 4) AS Monetary FROM kept GROUP BY CustomerID")
def rfm_from_raw(spark, d):
    return rfm(spark, d)


def segment_pipeline(spark: SparkSession, d: str) -> DataFrame:
    plan = pipeline.Plan(columns=("Recency", "Frequency", "Monetary", "TenureDays"))
    return pipeline.segment_customers(retail.raw(spark, d), plan=plan)["final"]


QUERIES["segment_pipeline"] = segment_pipeline
