"""Helpers shared by the operators: scratch tables, size checks, component search."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two longs (a key and a value) that may be broadcast: at most about 64 MB.
BROADCAST_ROWS = 2_000_000
#: Fewer keys than this have more than one in as many of all rows.
HOT_KEYS = 65_536


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share.

    The folder is the session's spark.checkpoint.dir. Only where that is unset and all runs
    on one machine, as in tests, a local temporary folder is set as this session's value;
    on a cluster it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows read back from a table in the shared folder: lineage ends there,
    so a lost executor costs a re-read and not a recomputation."""
    spark = df.sparkSession
    return read_back(df, scratch_dir(spark, name))


def read_back(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark deletes a query's shuffle files as the query ends. Else they stay until the
    driver's JVM happens to collect its garbage, beside those of the queries that follow."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Marks df for broadcast if its counted rows are within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df


def split_join(rows: DataFrame, by: DataFrame, key: str, degree: str, least: int) -> DataFrame:
    """Inner join of rows with the one row of their key in `by`, of bounded width, where
    `degree` is no less than the number of rows with the key.

    Keys of more than `least` rows and of more than one in HOT_KEYS of all degrees are fewer
    than HOT_KEYS, whatever the input: these are broadcast and their rows stay where they
    are. The others are shuffled, none with more rows than that. Null keys meet nothing.
    """
    total = int(by.agg(F.sum(degree)).first()[0] or 0)
    hot = F.col(degree) > max(least, total // HOT_KEYS)
    often = by.where(hot)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(by.where(~hot), key)
    return rows.join(F.broadcast(often), key).unionByName(rest)


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of each text of an Arrow string column."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def texts_in(column: pa.Array, rows: int = 256) -> Iterator[bytes | None]:
    """The same one by one, with few of them held at a time."""
    for k in range(0, len(column), rows):
        yield from bytes_of(column.slice(k, rows))


def trim() -> None:
    """Gives a worker's freed memory back: workers are used again by later stages."""
    pa.default_memory_pool().release_unused()
    free = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if free is not None:
        free(0)


#: What a worker process keeps for later tasks of the same kind.
KEPT: dict = {}


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], keeps: bool = False):
    """The same function of Arrow batches, with its memory given back at its end. What other
    functions kept for later tasks is dropped, unless this one keeps things itself."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            KEPT.clear()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def batches_of(rows: Iterable[tuple], schema: pa.Schema, size: int = 2000) -> Iterator[pa.RecordBatch]:
    """Record batches of at most `size` rows from row tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a graph of longs: (node, label), label the least node reachable.

    Each round joins every edge to the least neighbour of its two ends (large star, then
    small star), so stars form in a number of rounds that grows with the logarithm of the
    longest path; rounds go on until the edges stay the same. Every round is written to the
    shared folder, and the one before it deleted. Nulls and loops are ignored; nodes without
    an edge to another node do not appear. An empty graph gives no rows.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    path = scratch_dir(spark, "cc")
    e = read_back(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), path)
    before = _state(e)
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(down, "a").select(
            F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")
        )
        last, path = path, scratch_dir(spark, "cc")
        e = read_back(step.select("x.a", "x.b").where("a <> b").distinct(), path)
        delete(spark, last)
        now = _state(e)
        if now == before:
            break
        before = now
    out = e.groupBy("a").agg(F.min("b").alias("label")).withColumnRenamed("a", "node")
    return out.unionByName(out.select(F.col("label").alias("node"), "label").distinct())


def _state(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges; two 64-bit sums tell others apart."""
    sums = (F.sum(F.xxhash64("a", "b", F.lit(k)).cast("decimal(38,0)")) for k in range(2))
    return tuple(edges.agg(F.count("*"), *sums).first())
