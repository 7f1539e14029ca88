"""Token-id files in Simple-8b coding.

A 64-bit word is a selector in its low four bits and 60 bits of ids above it; the selector
says how many ids there are and how wide. Ids of more than 30 bits are escaped: selector 15
holds one id of up to 60 bits. Runs of zeros have words of their own. Ids are coded in
blocks of BLOCK ids, each starting a new word, and the offsets of the blocks' first words
allow any block to be decoded alone, with a whole segment's words decoded at once.

The container is Parquet, one row a segment of whole documents in order: part and seq (the
place of the segment), first (ids before it in its part), doc_ids and lengths (ids of each
document), n_ids, offsets (first word of each block) and words (little-endian).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import lean, texts_in
from .tokens import WordBpe, loaded

BLOCK = 512
#: A segment ends with the document that brings it to so many ids.
SEGMENT = 1 << 17

#: Ids a word and bits an id, by selector.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
BITS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

FILE = "part int, seq long, first long, doc_ids array<long>, lengths array<long>, n_ids long, offsets array<int>, words binary"


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets of the blocks' first words) of ids below 2**60."""
    v = np.asarray(ids, np.uint64)
    n = len(v)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int32)
    if int(v.max()) >> 60:
        raise ValueError("an id has more than 60 bits")
    blocks = -(-n // BLOCK)
    wide = BLOCK + int(COUNTS[0])  # a word may look beyond its block, where ids are zeros
    grid = np.zeros((blocks, wide), np.uint64)
    bits = np.zeros((blocks, wide), np.uint8)
    for to, ids_of in ((grid, v), (bits, np.frexp(np.minimum(v, np.uint64(1 << 30)).astype(np.float64))[1].astype(np.uint8))):  # 31 bits: an escape
        full = n // BLOCK
        to[:full, :BLOCK] = ids_of[: full * BLOCK].reshape(full, BLOCK)
        to[full:, : n - full * BLOCK] = ids_of[full * BLOCK :]
    selector = np.full((blocks, BLOCK), 15, np.int8)
    most = np.zeros((blocks, BLOCK), np.uint8)  # bits of the widest of the next `seen` ids
    seen = 0
    for s in range(14, -1, -1):  # what fits a selector fits all those of fewer, wider ids
        while seen < COUNTS[s]:
            np.maximum(most, bits[:, seen : seen + BLOCK], out=most)
            seen += 1
        fits = most <= np.uint8(BITS[s])
        if not fits[:, : BLOCK // 2].any():  # at a block's end padding fits everything
            break
        np.copyto(selector, np.int8(s), where=fits)
    sizes = np.full(blocks, BLOCK, np.int64)
    sizes[-1] = n - (blocks - 1) * BLOCK
    step = COUNTS[selector].ravel()
    first = np.arange(blocks) * BLOCK
    at, end = first.copy(), first + sizes
    starts: list[np.ndarray] = []  # of a word of every block; a block that has ended stays there
    while (at < end).any():
        starts.append(at)
        at = np.where(at < end, at + step[np.minimum(at, len(step) - 1)], at)
    begin = np.array(starts).T
    begin = begin[begin < end[:, None]]
    owner, start = begin // BLOCK, begin % BLOCK
    chosen = selector.ravel()[begin].astype(np.int64)
    words = chosen.astype(np.uint64)
    flat, place = grid.ravel(), owner * wide + start
    for s in np.unique(chosen):
        if s < 2:
            continue
        rows = np.flatnonzero(chosen == s)
        own, from_ = words[rows], place[rows]
        for k in range(COUNTS[s]):
            own |= flat[from_ + k] << np.uint64(4 + k * BITS[s])
        words[rows] = own
    return words, np.searchsorted(owner, np.arange(blocks)).astype(np.int32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids of a segment."""
    out = np.zeros(n, np.uint64)
    if n == 0:
        return out
    chosen = (words & np.uint64(15)).astype(np.int64)
    counts = COUNTS[chosen]
    ends = np.cumsum(counts)
    begin = ends - counts
    block = np.searchsorted(offsets, np.arange(len(words)), side="right") - 1
    place = begin - begin[offsets][block] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    for s in np.unique(chosen):
        if s < 2:
            continue
        rows = np.flatnonzero(chosen == s)
        k = np.arange(COUNTS[s])
        values = (words[rows, None] >> (4 + k * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        to = place[rows, None] + k
        inside = to < limit[rows, None]
        out[to[inside]] = values[inside]
    return out


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2) -> None:
    """Writes the ids of every whole text, in ascending order of id_col, to files at path.

    Null texts count as empty; each document ends in end_id unless that is None. Null ids
    come first; rows with equal ids follow their texts, and equal rows keep no order among
    themselves. An empty table writes a table without segments. Other columns are left out.
    Documents are dealt out by ranges of their ids and texts, so equal ids need not meet in
    one task, and each task writes its own segments, which a retried task writes again.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("by", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts, "id", "by").sortWithinPartitions("id", "by").select("id", "text")
    schema = pa.schema(
        [("part", pa.int32()), ("seq", pa.int64()), ("first", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("offsets", pa.list_(pa.int32())), ("words", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = loaded(WordBpe, tokenizer), TaskContext.get().partitionId()
        ends = np.array([] if end_id is None else [end_id], "<u4")
        seq = first = size = 0
        names: list[int | None] = []
        held: list[np.ndarray] = []

        def segment() -> pa.RecordBatch:
            words, offsets = pack(np.concatenate(held))
            lengths = [len(x) for x in held]
            row = [part, seq, first, names, lengths, size, offsets.tolist(), words.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema)], schema=schema)

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), texts_in(batch.column(1))):
                ids = np.concatenate((bpe.ids(text), ends))
                names.append(name)
                held.append(ids)
                size += len(ids)
                if size >= SEGMENT:
                    yield segment()
                    seq, first, size, names, held = seq + 1, first + size, 0, [], []
        if held:
            yield segment()

    ordered.mapInArrow(lean(run, True), FILE).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids of every document in the files.

    Parts' first ids come from the parts' sums, a row a part."""
    rows = _with_starts(spark.read.schema(FILE).parquet(path))
    return rows.mapInArrow(_reader(lambda ids: ids.astype(np.int64).tolist(), pa.list_(pa.int64()), "ids"), "doc_id long, start long, n_tokens long, ids array<long>")


def token_file_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 (of ids as little-endian 32-bit) from the files."""
    rows = _with_starts(spark.read.schema(FILE).parquet(path))
    return rows.mapInArrow(_reader(lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64(), "ids_crc32"), "doc_id long, start long, n_tokens long, ids_crc32 long")


def _with_starts(files: DataFrame) -> DataFrame:
    sums = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return files.join(F.broadcast(starts), "part").select((F.col("before") + F.col("first")).alias("first"), "doc_ids", "lengths", "n_ids", "offsets", "words")


def _reader(made, kind: pa.DataType, name: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), (name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, names, lengths, n, offsets, words in zip(*(c.to_pylist() for c in batch.columns)):
                ids = unpack(np.frombuffer(words, "<u8"), np.array(offsets, np.int64), n)
                ends = np.cumsum(lengths)
                begin = ends - np.array(lengths)
                made_of = [made(ids[b:e]) for b, e in zip(begin, ends)]
                columns = [pa.array(names, pa.int64()), pa.array(begin + first, pa.int64()), pa.array(lengths, pa.int64()), pa.array(made_of, kind)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return lean(run, True)
