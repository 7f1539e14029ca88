"""Customer aggregates, RFM and behaviour features, fused into one aggregation a grain."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import money, ratio
from .cleaning import ensure_flags, filter_mode, line_revenue

KEY = "CustomerID"


@dataclass(frozen=True)
class AggSpec:
    """One aggregate: its output column, its source column and its function."""

    name: str
    source: str
    fn: str


#: Aggregates of lines: their parts by customer and invoice, and what the parts make.
PARTS = {
    "sum": ((F.sum,), lambda p: F.sum(p)),
    "money": ((lambda c: F.sum(F.col(c).cast("decimal(18,4)")),), lambda p: F.sum(p).cast("double")),
    "mean": ((lambda c: F.sum(F.col(c).cast("double")), F.count), lambda p, n: F.try_divide(F.sum(p), F.sum(n).cast("double"))),
    "min": ((F.min,), lambda p: F.min(p)),
    "max": ((F.max,), lambda p: F.max(p)),
    "count": ((F.count,), lambda p: F.sum(p)),
    "avg_by_invoice": ((lambda c: F.sum(F.col(c).cast("decimal(18,4)")),), lambda p: F.try_divide(F.sum(p).cast("double"), F.nullif(F.count("InvoiceNo"), F.lit(0)).cast("double"))),
}
FLAGS = {"conditional_nunique_cancellation": "IsCancellation", "conditional_nunique_return": "IsReturn"}


BASE = (
    AggSpec("TotalQuantity", "Quantity", "sum"),
    AggSpec("TotalMonetary", "LineRevenue", "money"),
    AggSpec("FirstPurchaseDate", "InvoiceDate", "min"),
    AggSpec("LastPurchaseDate", "InvoiceDate", "max"),
    AggSpec("PurchaseFrequency", "InvoiceNo", "nunique"),
    AggSpec("TransactionLineCount", "InvoiceNo", "count"),
    AggSpec("DistinctInvoiceCount", "InvoiceNo", "nunique"),
    AggSpec("DistinctProducts", "StockCode", "nunique"),
    AggSpec("CancellationInvoiceCount", "InvoiceNo", "conditional_nunique_cancellation"),
    AggSpec("ReturnInvoiceCount", "InvoiceNo", "conditional_nunique_return"),
    AggSpec("AverageTransactionValue", "LineRevenue", "avg_by_invoice"),
)
FEATURES = (
    "Recency", "Frequency", "Monetary", "TotalQuantity", "AverageQuantity", "BasketSize", "TenureDays", "PurchaseIntervalMean",
    "PurchaseIntervalStd", "ActiveDays", "AverageInvoiceValue", "ProductsPerInvoice", "CancellationRate", "ReturnRate",
)


def prepared(df: DataFrame) -> DataFrame:
    """Lines with flags and revenue, customers that are not NULL only."""
    out = ensure_flags(df)
    if "LineRevenue" not in out.columns:
        out = line_revenue(out)
    return out.where(F.col(KEY).isNotNull())


def invoices(rows: DataFrame, specs: Sequence[AggSpec] = ()) -> DataFrame:
    """A row for each customer and invoice: the parts of the aggregates, and the first date t."""
    parts = [f(s.source).alias(f"_{k}_{j}") for k, s in enumerate(specs) if s.fn in PARTS for j, f in enumerate(PARTS[s.fn][0])]
    flags = [F.max(F.col(FLAGS[s.fn]) & F.col(s.source).isNotNull()).alias(f"_{k}_0") for k, s in enumerate(specs) if s.fn in FLAGS]
    return rows.groupBy(KEY, "InvoiceNo").agg(F.min("InvoiceDate").alias("t"), F.max("InvoiceDate").alias("last"), *parts, *flags)


def customer_base(df: DataFrame, specs: Sequence[AggSpec] = BASE) -> DataFrame:
    """The aggregates of each customer, by way of one row an invoice. Distinct values of other
    columns are counted from their own groups. No line is expanded, and all shuffles carry
    what is aggregated already, so a customer with very many lines is no hot key."""
    rows = prepared(df)
    return _of_invoices(rows, invoices(rows, specs), specs)


def _of_invoices(rows: DataFrame, by_invoice: DataFrame, specs: Sequence[AggSpec]) -> DataFrame:
    made, others = [], []
    for k, s in enumerate(specs):
        if s.fn in PARTS:
            made.append(PARTS[s.fn][1](*(F.col(f"_{k}_{j}") for j in range(len(PARTS[s.fn][0])))).alias(s.name))
        elif s.fn in FLAGS and s.source == "InvoiceNo":
            made.append(F.count_if(F.col(f"_{k}_0")).alias(s.name))
        elif s.fn == "nunique" and s.source == "InvoiceNo":
            made.append(F.count("InvoiceNo").alias(s.name))
        elif s.fn in ("nunique", "nunique_date"):
            others.append(s)
        else:
            raise ValueError(f"no such aggregate: {s.fn} of {s.source}")
    out = by_invoice.groupBy(KEY).agg(*(made or [F.count(F.lit(1)).alias("_n")]))
    for s in others:
        value = F.to_date(F.col(s.source)) if s.fn == "nunique_date" else F.col(s.source)
        distinct = rows.select(KEY, value.alias("_v")).distinct().groupBy(KEY).agg(F.count("_v").alias(s.name))
        out = out.join(distinct, KEY)
    return out.select(KEY, *(s.name for s in specs))


def customer_diagnostic(df: DataFrame, mode: str = "all_rows") -> DataFrame:
    """Spend, lines, invoices, mean line and active days of each customer in a filter mode."""
    specs = (AggSpec("total_spend", "LineRevenue", "money"), AggSpec("n_lines", "InvoiceNo", "count"), AggSpec("n_invoices", "InvoiceNo", "nunique"), AggSpec("mean_quantity", "Quantity", "mean"), AggSpec("active_days", "InvoiceDate", "nunique_date"))
    return customer_base(filter_mode(df, mode), specs)


def reference_date(df: DataFrame) -> DataFrame:
    """One row: the day after the last date."""
    return df.agg((F.max("InvoiceDate") + F.expr("INTERVAL 1 DAY")).alias("reference_date"))


def recency(base: DataFrame, reference: DataFrame) -> DataFrame:
    """Calendar days from the last purchase to the reference date."""
    joined = base.crossJoin(F.broadcast(reference))  # one row
    return joined.select(KEY, F.datediff("reference_date", "LastPurchaseDate").alias("Recency"))


def frequency_variants(df: DataFrame) -> DataFrame:
    out = customer_base(df, (AggSpec("FrequencyInvoices", "InvoiceNo", "nunique"), AggSpec("FrequencyLines", "InvoiceNo", "count")))
    return out.withColumn("FrequencyDifference", F.col("FrequencyLines") - F.col("FrequencyInvoices"))


MONETARY = ("MonetarySigned", "MonetaryAbsolute", "MonetaryPurchaseOnly", "MonetaryCancellationOnly")


def monetary_variants(df: DataFrame) -> DataFrame:
    """Signed, absolute, purchase-only and cancellation-only sums; NULL without such lines."""
    x, c = F.col("LineRevenue"), F.col("IsCancellation")
    sums = (x, F.abs(x), F.when(~c, x), F.when(c, x))
    return prepared(df).groupBy(KEY).agg(*(money(s).alias(n) for n, s in zip(MONETARY, sums)))


def monetary_overlap(variants: DataFrame) -> DataFrame:
    """variant, customers with a sum that isn't zero, and their percentage."""
    one = variants.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(v) != 0).alias(v) for v in MONETARY))
    long = one.unpivot("n", list(MONETARY), "variant", "customers")
    return long.select("variant", "customers", (ratio("customers", "n") * 100).alias("percentage"))


def quantity_set(df: DataFrame, include_cancellations: bool = True) -> DataFrame:
    """TotalQuantity, AverageQuantity (an invoice) and BasketSize (the same under its old name)."""
    keep = F.lit(True) if include_cancellations else ~F.col("IsCancellation")
    q = F.sum(F.when(keep, F.col("Quantity")))
    n = F.count_distinct(F.when(keep, F.col("InvoiceNo")))
    out = prepared(df).groupBy(KEY).agg(q.cast("double").alias("TotalQuantity"), n.alias("_n"))
    return out.withColumns({"AverageQuantity": ratio("TotalQuantity", "_n"), "BasketSize": ratio("TotalQuantity", "_n")}).drop("_n")


def quantity_variants(df: DataFrame) -> DataFrame:
    """Signed and purchase-only quantities side by side with their differences."""
    signed, only = quantity_set(df), quantity_set(df, False)
    names = ("TotalQuantity", "AverageQuantity", "BasketSize")
    b = only.select(KEY, *(F.col(n).alias(f"{n}PurchaseOnly") for n in names))
    out = signed.join(b, KEY, "left")
    return out.withColumns({f"{n}Difference": F.col(n) - F.col(f"{n}PurchaseOnly") for n in names})


def tenure(base: DataFrame) -> DataFrame:
    """Calendar days between the first and the last purchase."""
    return base.select(KEY, F.datediff("LastPurchaseDate", "FirstPurchaseDate").alias("TenureDays"))


def purchase_interval(df: DataFrame) -> DataFrame:
    """Mean and sample deviation of whole 24-hour periods between successive invoices."""
    return _intervals(invoices(prepared(df)))


def _intervals(by_invoice: DataFrame) -> DataFrame:
    first = by_invoice.select(KEY, "InvoiceNo", "t")
    before = F.lag("t").over(W.partitionBy(KEY).orderBy("t", "InvoiceNo"))
    gap = F.floor((F.unix_micros("t") - F.unix_micros(before)) / 86_400_000_000)
    gaps = first.select(KEY, gap.alias("gap"))
    return gaps.groupBy(KEY).agg(F.avg("gap").alias("PurchaseIntervalMean"), F.stddev_samp(F.col("gap").cast("double")).alias("PurchaseIntervalStd"))


def active_days(df: DataFrame) -> DataFrame:
    return customer_base(df, (AggSpec("ActiveDays", "InvoiceDate", "nunique_date"),))


def candidate_features(df: DataFrame) -> DataFrame:
    """All features of each customer, by way of one row an invoice: aggregates, the reference
    date and the intervals come from these rows, products and days from their own groups."""
    rows = prepared(df)
    specs = (*BASE, AggSpec("ActiveDays", "InvoiceDate", "nunique_date"))
    by_invoice = invoices(rows, specs)
    last = by_invoice.agg((F.max("last") + F.expr("INTERVAL 1 DAY")).alias("reference_date"))
    wide = _of_invoices(rows, by_invoice, specs).crossJoin(F.broadcast(last)).join(_intervals(by_invoice), KEY, "left")
    n = F.col("DistinctInvoiceCount")
    return wide.select(
        KEY,
        F.datediff("reference_date", "LastPurchaseDate").alias("Recency"),
        n.alias("Frequency"),
        F.col("TotalMonetary").alias("Monetary"),
        F.col("TotalQuantity").cast("double").alias("TotalQuantity"),
        ratio("TotalQuantity", n).alias("AverageQuantity"),
        ratio("TotalQuantity", n).alias("BasketSize"),
        F.datediff("LastPurchaseDate", "FirstPurchaseDate").alias("TenureDays"),
        "PurchaseIntervalMean",
        "PurchaseIntervalStd",
        "ActiveDays",
        ratio("TotalMonetary", n).alias("AverageInvoiceValue"),
        ratio("DistinctProducts", n).alias("ProductsPerInvoice"),
        ratio("CancellationInvoiceCount", n).alias("CancellationRate"),
        ratio("ReturnInvoiceCount", n).alias("ReturnRate"),
    )
