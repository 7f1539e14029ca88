"""Tables between the steps of an algorithm: written ones, running sums over ranges, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir, the folder that all executors share. Only where
    all runs on one machine and the setting is missing, a temporary folder becomes its value."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, so that nothing is computed again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weight: str, name: str = "before") -> DataFrame:
    """df with the sum of `weight` over the rows of the same keys that come before in order.

    Rows are dealt out by ranges of keys and order; a table of each range's sums, at most a row
    for each range and for each group of keys, gives where a range begins. So a group of any
    size is ordered by many tasks, none of which has more than a range."""
    spark = df.sparkSession
    by = [F.asc_nulls_first(k) for k in keys]
    dealt = written(df.repartitionByRange(parts_of(spark), *by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(*keys, "_range").agg(F.sum(weight).alias("_sum"))
    earlier = W.partitionBy(*keys).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    starts = F.broadcast(starts.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("_range").alias("__range"), "_start"))
    same = F.col("_range") == F.col("__range")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    inside = W.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = dealt.join(starts, same).withColumn(name, F.col("_start") + F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return out.select(*df.columns, name)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """df with the number of each row in order, from 0, without a task that has all rows."""
    return running(df.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", name).drop("_one")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the nodes of edges (a, b) of longs; label is the least node reachable.

    Stars are contracted: neighbours above a node are tied to its least neighbour, then those
    below, until the edges stay the same, in about as many rounds as the longest path's
    logarithm. Each round is a table in the shared folder. Loops alone give no row."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    before = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        e = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = e.groupBy("a").agg(F.min("b").alias("m"))
        tied = e.join(down, "a")
        e = tied.select("a", F.col("m").alias("b")).unionByName(tied.select(F.col("b").alias("a"), F.col("m").alias("b")))
        e = written(e.where("a <> b").distinct(), "edges")
        now = _state(e)
        if now == before:
            break
        before = now
    out = e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return out.unionByName(out.select(F.col("label").alias("node"), "label").distinct())


def _state(edges: DataFrame) -> tuple:
    sums = (F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in range(2))
    return tuple(edges.agg(F.count(F.lit(1)), *sums).first())
