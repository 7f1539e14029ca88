"""Exact nearest binary codes by incremental multi-index hashing.

The bits that vary among the codes are cut into m segments with an index each: a table of
(segment, value, code), bucketed by segment and value. A code that differs from a
query in fewer than m * r bits differs in at most r - 1 bits in one of its segments. So
queries look up all values at radius 0, 1,
2, ... of their segments, a join a round, verify whole codes, and are done as soon as their
kth distance is below m * r: nothing nearer can be missing. Each round asks for the rest.

Equal codes are searched once. Values that very many entries share are dealt into parts,
and looked up in all of them. A query so far from everything that its next lookups would
be more work than comparing it with all entries is compared with all, in blocks of bounded
size: every query gets its exact nearest either way.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import HOT_KEYS, delete, lean, read_back, scratch_dir, split_join, written

#: Bits of a segment: as many as the number of entries has, within these.
MIN_SEGMENT, MAX_SEGMENT = 8, 30
#: Entries of one value of a segment that stay in one part.
BUCKET = 1 << 14
#: Values that a query may look up in a round at any size, and entries whose comparison is
#: about the work of one lookup: more entries than that for each of LOOKUPS allow more.
LOOKUPS, COMPARED = 1024, 4096
#: Values to look up in one batch.
PROBE_BATCH = 1 << 16
#: Entries and queries of a block where all are compared.
INDEX_BLOCK, QUERY_BLOCK = 1 << 16, 512


def sign_codes(rows: DataFrame, vector_col: str = "embedding", out: str = "code") -> DataFrame:
    """Adds the code of each vector: a bit an element, set where it is above zero.

    Codes are padded with zeros to 64 bits or a multiple, by the longest vector. A null
    vector has a null code; null and NaN elements give zero bits.
    """
    longest = rows.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(1, -(-max(longest, 0) // 64)) * 8
    keep = [c for c in rows.columns if c != out]
    at = keep.index(vector_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for v in batch.column(at).to_pylist():
                if v is None:
                    codes.append(None)
                    continue
                bits = np.packbits(np.array([x is not None and x > 0 for x in v], bool)) if v else np.zeros(0, np.uint8)
                codes.append(bits.tobytes().ljust(width, b"\0"))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary())], [*keep, out])

    return rows.select(*keep).mapInArrow(lean(run), rows.select(*keep).schema.add(out, "binary"))


def word_columns(code: Column, n: int) -> list[Column]:
    """The 64-bit words of a code in hex digits, which is shorter codes with zeros after them."""
    return [F.conv(F.substring(code, 16 * w + 1, 16), 16, -10).cast("long").alias(f"w{w}") for w in range(n)]


def signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word


class Segment(NamedTuple):
    """Bits of a word that one index looks at, and the value they make."""

    word: int
    at: tuple[int, ...]

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.at)

    def flips(self, radius: int) -> np.ndarray:
        """What changes a value to each of those that differ from it in `radius` bits."""
        chosen = combinations([b - self.at[0] for b in self.at], radius)
        return np.fromiter((sum(1 << b for b in c) for c in chosen), np.int64)

    def probes(self, radius: int) -> int:
        return math.comb(len(self.at), radius)

    def bits(self, word: Column) -> Column:
        return word.bitwiseAND(F.lit(signed(self.mask)))


def segments(varying: list[int], n: int) -> list[Segment]:
    """Cuts the bits that vary into segments of about as many bits as n distinct values have."""
    width = min(max(MIN_SEGMENT, n.bit_length()), MAX_SEGMENT)
    found = []
    for w, bits in enumerate(varying):
        at = [b for b in range(64) if bits >> b & 1]
        found += [Segment(w, tuple(map(int, part))) for part in np.array_split(at, -(-len(at) // width))] if at else []
    return found or [Segment(0, (0,))]


def probe_rows(pending: DataFrame, parts: list[Segment], radius: int) -> DataFrame:
    """A row for each value to look up: those at just this radius of each segment's value."""
    schema = pending.select("*", F.lit(0).alias("s"), F.lit(0).cast("long").alias("v")).schema
    names = [*pending.columns, "s", "v"]
    at = [names.index(f"w{p.word}") for p in parts]
    masks = [signed(p.mask) for p in parts]
    lows = [p.at[0] for p in parts]
    flips = [p.flips(radius) for p in parts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s, (column, mask, low, every) in enumerate(zip(at, masks, lows, flips)):
                words = batch.column(column).to_numpy(zero_copy_only=False)
                own = ((words & mask).view(np.uint64) >> np.uint64(low)).view(np.int64)
                for f in range(0, len(every), PROBE_BATCH):
                    some = every[f : f + PROBE_BATCH]
                    step = max(1, PROBE_BATCH // len(some))
                    for q in range(0, len(own), step):
                        values = (own[q : q + step, None] ^ some[None, :]).ravel()
                        rows = batch.take(pa.array(np.repeat(np.arange(q, min(q + step, len(own))), len(some))))
                        columns = [*rows.columns, pa.array(np.full(len(values), s, np.int32)), pa.array(values)]
                        yield pa.RecordBatch.from_arrays(columns, names)

    return pending.mapInArrow(lean(run), schema)


def least_k(rows: DataFrame, by: str, k: int) -> DataFrame:
    """The k rows of least distance, then id, with their rank; Spark cuts to k in each task first."""
    order = W.partitionBy(by).orderBy("distance", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hamming_top_k(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "vec_id",
    code_col: str = "code",
    index_block: int = INDEX_BLOCK,
    query_block: int = QUERY_BLOCK,
    bucket: int = BUCKET,
) -> DataFrame:
    """The k rows of index with the least Hamming distance to each query: query_id, rank
    (from 1), id_col and distance, ties by the lower id.

    Exact. Null codes are neither indexed nor searched, null ids are left out. A query that
    is in the index finds itself. Fewer than k rows give fewer results, an empty table
    none. A repeated query id gives its rows once; repeated index rows each count. Shorter
    codes count as followed by zeros. Of rows with one code only the k lowest ids can be
    among the nearest, so no more are carried; queries with one code are searched once.
    """
    spark = index.sparkSession
    scratch: list[str] = []

    def kept(df: DataFrame, name: str) -> DataFrame:
        scratch.append(scratch_dir(spark, name))
        return read_back(df, scratch[-1])

    present = F.col(code_col).isNotNull() & F.col(id_col).isNotNull()
    rows, asked = (t.where(present).select(F.col(id_col).cast("long").alias("id"), F.col(code_col).cast("binary").alias("code")) for t in (index, queries))
    longest = max(t.agg(F.max(F.octet_length("code"))).first()[0] or 0 for t in (rows, asked))
    n_words = max(1, -(-longest // 8))
    names = [f"w{w}" for w in range(n_words)]
    rows, asked = (t.withColumn("code", F.rpad(F.hex("code"), 16 * n_words, "0")) for t in (rows, asked))

    by_code = W.partitionBy("code").orderBy("id")
    rows = rows.withColumn("n", F.row_number().over(by_code)).where(F.col("n") <= k)
    members = kept(rows.select("id", *word_columns(F.col("code"), n_words)), "members")
    facts = members.agg(F.count("*").alias("n"), *(f(w).alias(f"{f.__name__}_{w}") for w in names for f in (F.bit_or, F.bit_and))).first()
    n = facts["n"]
    same = [(facts[f"bit_and_{w}"] or 0) for w in names]
    varying = [((facts[f"bit_or_{w}"] or 0) & ~s) & (1 << 64) - 1 for w, s in zip(names, same)]
    parts = segments(varying, n)

    # Bits that are the same in all of the index add one number to all distances of a query.
    queried = asked.select(F.col("id").alias("query_id"), "code").distinct()
    words = word_columns(F.col("code"), n_words)
    apart = [F.bit_count(w.bitwiseXOR(F.lit(s)).bitwiseAND(F.lit(signed(~v & (1 << 64) - 1)))) for w, s, v in zip(words, same, varying)]
    asked_codes = queried.groupBy("code").agg(F.count("*").alias("degree"))
    pending = kept(asked_codes.select("code", *words, F.lit(64 * n_words).alias("limit")), "pending")

    values = [F.shiftrightunsigned(p.bits(F.col(f"w{p.word}")), p.at[0]) for p in parts]
    entries = members.select("id", *names, F.posexplode(F.array(*values)).alias("s", "v"))
    sizes = entries.groupBy("s", "v").agg(F.count("*").alias("size"))
    least = max(bucket, n * len(parts) // HOT_KEYS)  # fewer than HOT_KEYS values of any input have more
    hot = F.broadcast(kept(sizes.where(F.col("size") > least).select("s", "v", F.ceil(F.col("size") / least).cast("int").alias("deal")), "hot"))
    mine = F.when(F.col("deal").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", *names), F.col("deal"))).cast("int")
    entries = entries.join(hot, ["s", "v"], "left").select("s", "v", mine.alias("part"), F.col("id"), *(F.col(w).alias(f"i{w}") for w in names))
    # Bucketed by the values looked up: each round shuffles what it asks for, not the index.
    # Joins here merge: by the size of its files Spark would send a whole index by way of the driver.
    tables = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scratch.append(scratch_dir(spark, "entries"))
    indexed = scratch[-1].rsplit("/", 1)[1].replace("-", "_")
    key = ["s", "v", "part"]
    entries.repartition(tables, *key).write.bucketBy(tables, *key).option("path", scratch[-1]).saveAsTable(indexed)
    entries = spark.table(indexed)

    differ = [F.bit_count(p.bits(F.col(f"w{p.word}").bitwiseXOR(F.col(f"iw{p.word}")))) for p in parts]
    distance = reduce(Column.__add__, differ).cast("int")
    best = None
    found: list[DataFrame] = []
    radius, allowed = 0, min(n, max(LOOKUPS, n // COMPARED))
    left = pending.count() if n else 0
    while left and radius <= max(len(p.at) for p in parts) and sum(p.probes(radius) for p in parts) <= allowed:
        asking = probe_rows(pending, parts, radius).join(hot, ["s", "v"], "left")
        deals = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("deal") - 1, F.lit(0))))
        asking = asking.select("code", "limit", *names, "s", "v", deals.alias("part"))
        # An entry comes once: in the round of its least differing segment, by the first of those.
        first = F.coalesce(*(F.when(d == radius, s) for s, d in enumerate(differ)))
        new = reduce(Column.__and__, [d >= radius for d in differ]) & (first == F.col("s")) & (distance <= F.col("limit"))
        near = asking.join(entries.hint("merge"), key).where(new).select("code", "id", distance.alias("distance"))
        if best is not None:
            near = near.unionByName(best.select("code", "id", "distance"))
        whole = W.partitionBy("code")
        ranked = least_k(near, "code", k).withColumns({"n": F.count("*").over(whole), "last": F.max("distance").over(whole)})
        best = kept(ranked, "best")
        radius += 1
        covered = (F.col("n") == k) & (F.col("last") < len(parts) * radius)
        found.append(best.where(covered).select("code", "rank", "id", "distance"))
        best = best.where(~covered)
        full = best.where((F.col("rank") == 1) & (F.col("n") == k)).select("code", F.col("last").alias("nearer"))
        done = found[-1].where("rank = 1").select("code")
        pending = kept(pending.join(done.hint("merge"), "code", "left_anti").join(full.hint("merge"), "code", "left").select("code", *names, F.coalesce("nearer", "limit").alias("limit")), "pending")
        left = pending.count()
    if left:
        found.append(by_blocks(members, pending, varying, k, max(1, -(-n // index_block)), max(1, -(-left // query_block))))

    out = "query_id long, rank int, id long, distance int"
    if found:
        lists = reduce(DataFrame.unionByName, found).groupBy("code").agg(F.collect_list(F.struct("rank", "id", "distance")).alias("nearest"))  # at most k
        lists = kept(lists.join(asked_codes.hint("merge"), "code").withColumn("apart", reduce(Column.__add__, apart).cast("int")), "lists")
        each = split_join(queried, lists, "code", "degree", bucket).select("query_id", "apart", F.explode("nearest").alias("x"))
        each = each.select("query_id", F.col("x.id").alias("id"), (F.col("x.distance") + F.col("apart")).alias("distance"))
        result = written(least_k(each, "query_id", k), "nearest")
    else:
        result = spark.createDataFrame([], out)
    spark.sql(f"DROP TABLE {indexed}")
    for path in scratch:
        delete(spark, path)
    return result.select("query_id", "rank", F.col("id").alias(id_col), "distance")


def by_blocks(members: DataFrame, pending: DataFrame, varying: list[int], k: int, blocks: int, asked_blocks: int) -> DataFrame:
    """The same for queries whose kth nearest is so far that looking up is more work: blocks of them are compared with all blocks of members."""
    names = [f"w{w}" for w in range(len(varying))]
    masks = np.array(varying, np.uint64)
    left = members.withColumn("i", F.pmod(F.xxhash64("id", *names), F.lit(blocks)).cast("int"))
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(asked_blocks - 1))))
    right = pending.withColumn("j", F.pmod(F.xxhash64("code"), F.lit(asked_blocks)).cast("int"))
    right = right.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def search(block: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
        codes, ids = block[names].to_numpy(np.int64).view(np.uint64) & masks, block["id"].to_numpy(np.int64)
        of, out_id, out_d = [], [], []
        for code, query in zip(wanted["code"], wanted[names].to_numpy(np.int64).view(np.uint64) & masks):
            d = np.bitwise_count(codes ^ query).sum(axis=1, dtype=np.int32)
            near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
            near = near[np.lexsort((ids[near], d[near]))][:k]
            of += [code] * len(near)
            out_id.append(ids[near])
            out_d.append(d[near])
        if not of:
            return pd.DataFrame({"code": [], "id": np.zeros(0, np.int64), "distance": np.zeros(0, np.int32)})
        return pd.DataFrame({"code": of, "id": np.concatenate(out_id), "distance": np.concatenate(out_d)})

    pairs = left.groupBy("i", "j").cogroup(right.groupBy("i", "j"))
    return least_k(pairs.applyInPandas(search, "code string, id long, distance int"), "code", k).select("code", "rank", "id", "distance")
