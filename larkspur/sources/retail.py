"""Retail transactions over the order tables, and the same view as SQL for the oracle.

The tables have no defects, so rules for cleaning get some here, decided by the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean lines: a cancelled or returned line has a C invoice and a negative quantity."""
    t = lambda n: table(spark, sf_dir, n)
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    lines = lines.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    back = F.col("l_returnflag") == "R"
    quantity = F.col("l_quantity").cast("long")
    return lines.select(
        F.concat(F.when(back, "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
        F.col("l_partkey").cast("string").alias("StockCode"),
        F.col("p_name").alias("Description"),
        F.when(back, -quantity).otherwise(quantity).alias("Quantity"),
        F.timestamp_micros(F.unix_micros(F.col("l_shipdate").cast("timestamp")) + (F.col("l_partkey") % 86400) * 1_000_000).alias("InvoiceDate"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100.0).cast("double").alias("UnitPrice"),
        F.col("o_custkey").alias("CustomerID"),
        F.col("n_name").alias("Country"),
        F.col("l_orderkey"),
        F.col("l_partkey"),
        F.col("l_linenumber"),
    )


KEYS = ("l_orderkey", "l_partkey", "l_linenumber")


def clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions(spark, sf_dir).drop(*KEYS)


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with missing ids, blank descriptions, zero quantities and prices, bad dates and copies."""
    t = transactions(spark, sf_dir)
    k = F.col("l_orderkey")
    dirty = t.select(
        F.when(k % 29 == 0, "  ").otherwise(F.col("InvoiceNo")).alias("InvoiceNo"),
        "StockCode",
        F.when(F.col("l_partkey") % 101 == 0, " ").otherwise(F.col("Description")).alias("Description"),
        F.when(F.col("l_linenumber") == 7, 0).otherwise(F.col("Quantity")).alias("Quantity"),
        F.when(k % 17 == 0, "not-a-date").otherwise(F.date_format("InvoiceDate", "yyyy-MM-dd HH:mm:ss")).alias("InvoiceDate"),
        F.when(F.col("l_partkey") % 97 == 0, 0.0).otherwise(F.col("UnitPrice")).alias("UnitPrice"),
        F.when(k % 13 == 0, None).otherwise(F.col("CustomerID")).alias("CustomerID"),
        "Country",
        "l_orderkey",
    )
    return dirty.unionByName(dirty.where(k % 50 == 0)).drop("l_orderkey")


CLEAN_SQL = """
lines AS (
  SELECT (CASE WHEN l_returnflag = 'R' THEN 'C' ELSE '' END) || o_orderkey::VARCHAR AS InvoiceNo, l_partkey::VARCHAR AS StockCode,
    p_name AS Description, CASE WHEN l_returnflag = 'R' THEN -l_quantity::BIGINT ELSE l_quantity::BIGINT END AS Quantity,
    make_timestamp(epoch_us(l_shipdate) + (l_partkey % 86400) * 1000000) AS InvoiceDate,
    floor(l_extendedprice / l_quantity * 100) / 100.0 AS UnitPrice, o_custkey AS CustomerID, n_name AS Country,
    l_orderkey, l_partkey, l_linenumber
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
    JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), tx AS (
  SELECT *, Quantity * UnitPrice AS LineRevenue, starts_with(InvoiceNo, 'C') AS IsCancellation, Quantity < 0 AS IsReturn FROM lines
)"""

RAW_SQL = (
    CLEAN_SQL
    + """, dirty AS (
  SELECT CASE WHEN l_orderkey % 29 = 0 THEN '  ' ELSE InvoiceNo END AS InvoiceNo, StockCode,
    CASE WHEN l_partkey % 101 = 0 THEN ' ' ELSE Description END AS Description,
    CASE WHEN l_linenumber = 7 THEN 0 ELSE Quantity END AS Quantity,
    CASE WHEN l_orderkey % 17 = 0 THEN 'not-a-date' ELSE strftime(InvoiceDate, '%Y-%m-%d %H:%M:%S') END AS InvoiceDate,
    CASE WHEN l_partkey % 97 = 0 THEN 0.0 ELSE UnitPrice END AS UnitPrice,
    CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE CustomerID END AS CustomerID, Country, l_orderkey
  FROM lines
), raw AS (
  SELECT * EXCLUDE (l_orderkey) FROM dirty UNION ALL SELECT * EXCLUDE (l_orderkey) FROM dirty WHERE l_orderkey % 50 = 0
)"""
)
