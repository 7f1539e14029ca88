"""Sharding by fixed virtual slots and a versioned slot-to-shard map."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

#: Records are hashed into so many slots; a map holds one row a slot, whatever the input.
SLOTS = 4096

MAP = T.StructType(
    [
        T.StructField("version", T.IntegerType(), False),
        T.StructField("virtual_slot", T.IntegerType(), False),
        T.StructField("shard", T.IntegerType(), False),
        T.StructField("bytes", T.LongType(), False),
        T.StructField("rows", T.LongType(), False),
    ]
)


def virtual_slot(key: Column, text: Column, slots: int = SLOTS) -> Column:
    """Slot of a record: its key decides; a record without a key is spread by its text."""
    return F.pmod(F.xxhash64(F.coalesce(key.cast("string"), F.concat(F.lit("\x00"), F.coalesce(text, F.lit(""))))), F.lit(slots)).cast("int")


def slot_sizes(records: DataFrame) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) of the slots in use: at most as many rows as there are slots."""
    rows = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    return sorted((r["virtual_slot"], r["bytes"], r["rows"]) for r in rows)


def first_map(sizes: Sequence[tuple[int, int, int]], shards: int, slots: int = SLOTS) -> list[tuple]:
    """Version 1: the largest slot first, each to the shard with the fewest bytes so far.

    Empty slots go round the shards. Ties go to the lower shard and the lower slot.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    used = {s: (b, n) for s, b, n in sizes}
    heap = [(0, i) for i in range(shards)]
    rows = []
    for slot, (size, n) in sorted(used.items(), key=lambda x: (-x[1][0], x[0])):
        load, shard = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, shard))
        rows.append((1, slot, shard, size, n))
    rows += [(1, s, s % shards, 0, 0) for s in range(slots) if s not in used]
    return sorted(rows, key=lambda r: r[1])


def rebalanced(current: Sequence[tuple], shards: int) -> list[tuple]:
    """The next version of a map for more shards: slots move only into the new ones.

    Each new shard takes slots from the fullest old shard while that brings both nearer
    to the mean; all other slots stay where they are.
    """
    old = max(r[2] for r in current) + 1
    if shards < old:
        raise ValueError("this edit only adds shards")
    rows = {r[1]: list(r) for r in current}
    load = [0] * shards
    held: dict[int, list[tuple[int, int]]] = {i: [] for i in range(shards)}
    for _, slot, shard, size, _n in current:
        load[shard] += size
        if size:
            heapq.heappush(held[shard], (-size, slot))
    mean = sum(load) / shards
    for new in range(old, shards):
        spare = {i: list(held[i]) for i in range(old)}
        while load[new] < mean:
            giver = max((i for i in range(old) if spare[i]), key=lambda i: (load[i], -i), default=None)
            if giver is None:
                break
            size, slot = heapq.heappop(spare[giver])
            if load[new] - size > mean * 1.001 + 1:
                continue
            load[giver] += size
            load[new] -= size
            rows[slot][2] = new
            held[giver] = [x for x in held[giver] if x[1] != slot]
            heapq.heapify(held[giver])
    version = max(r[0] for r in current) + 1
    return [(version, s, r[2], r[3], r[4]) for s, r in sorted(rows.items())]


def save_map(spark: SparkSession, rows: Sequence[tuple], path: str) -> DataFrame:
    """Adds a version to the table of maps at path; versions that exist are kept."""
    df = spark.createDataFrame(list(rows), MAP)
    df.coalesce(1).write.mode("append").partitionBy("version").parquet(path)
    return df


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One version of the map, by default the latest."""
    maps = spark.read.schema(MAP).parquet(path)
    if version is None:
        version = maps.agg(F.max("version")).first()[0]
    return maps.where(F.col("version") == version)


def shard_records(docs: DataFrame, slot_map: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """Each record's shard by a stored map, and its gapless place in the shard.

    Returns doc key, size (UTF-8 bytes plus 1), text_crc32, virtual_slot, shard and slot.
    A null text has no bytes. Places follow virtual slot, key, checksum and size, so equal
    rows may change places among themselves only. An empty table gives no rows; extra
    columns are left out, so none can clash. Only numbers are shuffled, by virtual slot;
    a slot's first place comes from the map's row counts, which has one row a slot.
    """
    spark = docs.sparkSession
    rows = sized(docs, key, text, slots)
    per_shard = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = [r.asDict() for r in slot_map.select("virtual_slot", "shard", "rows").withColumn("start", F.coalesce(F.sum("rows").over(per_shard), F.lit(0))).collect()]
    starts_df = spark.createDataFrame([(r["virtual_slot"], r["shard"], r["start"]) for r in starts], "virtual_slot int, shard int, start long")
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("virtual_slot").orderBy(key, "text_crc32", "size")) - 1)
    out = placed.join(F.broadcast(starts_df), "virtual_slot")
    return out.select(key, "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("place")).cast("long").alias("slot"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", slots: int = SLOTS) -> DataFrame:
    """key, size, text_crc32 and virtual slot of each record."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(key),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).cast("long").alias("text_crc32"),
        virtual_slot(F.col(key), F.col(text), slots).alias("virtual_slot"),
    )
