"""Benchmark decontamination by a prefix-filtered join of word windows.

A benchmark item's windows are the records: `width` consecutive words each, or the whole
item when it has fewer. A document contains a window only if it contains every shingle of
it, so it is enough to look up one shingle of each window, its prefix: with shingles
ordered by their count in the corpus, the rarest one. The place of the prefix in its window
and the document's length bound where the window can lie; there the words are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, lean, texts_in
from .words import mixed, plain_words

#: Words of a window.
WINDOW = 13
#: Words of a shingle; windows with fewer words are one shingle.
SHINGLE = 3
#: Bytes of benchmark text that a worker holds the windows of at once.
BLOCK_BYTES = 2_000_000
_NONE = np.uint64(2**64 - 1)


@dataclass
class Windows:
    """Distinct windows of some items, a row of word ids each; 0 is any other word or none.

    For a word at most its text and an id are held, and for a window some 80 bytes."""

    vocabulary: dict[bytes, int]
    words: np.ndarray
    size: np.ndarray
    #: Items that have a name, and of each window the first of its places in owners and the last.
    names: list[str]
    owners: np.ndarray
    bounds: np.ndarray
    #: Sorted prefix shingles; window and offset of each, with repeats.
    prefix: np.ndarray
    window: np.ndarray
    offset: np.ndarray

    @classmethod
    def of(cls, items: Iterable[tuple[str | None, bytes]], width: int) -> Windows:
        vocabulary: dict[bytes, int] = {}
        rows, owner, names = [], [], []
        for name, text in items:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in plain_words(text)], np.int32)
            if not len(ids):
                continue
            made = np.lib.stride_tricks.sliding_window_view(ids, width) if len(ids) >= width else np.pad(ids, (0, width - len(ids)))[None, :]
            rows.append(made)
            owner.append(np.full(len(made), len(names) if name is not None else -1))
            if name is not None:
                names.append(name)
        every = np.concatenate(rows) if rows else np.zeros((0, width), np.int32)
        words, number = np.unique(every, axis=0, return_inverse=True)
        number = number.ravel()
        named = np.concatenate(owner) if owner else np.zeros(0, np.int64)
        pairs = np.unique(np.stack([number[named >= 0], named[named >= 0]], axis=1), axis=0)
        bounds = np.searchsorted(pairs[:, 0], np.arange(len(words) + 1))
        none = np.zeros(0, np.int64)
        return cls(vocabulary, words, (words > 0).sum(axis=1), names, pairs[:, 1], bounds, none.astype(np.uint64), none, none)

    @property
    def sizes(self) -> list[int]:
        """Words of the shingles there are."""
        return np.unique(np.minimum(self.size, SHINGLE)).tolist()

    def word_ids(self, words: list[bytes]) -> np.ndarray:
        get = self.vocabulary.get
        return np.fromiter((get(w, 0) for w in words), np.int64, len(words))

    def shingles(self) -> np.ndarray:
        """The shingle at each offset of each window; where there is none, the greatest value."""
        out = np.full((len(self.words), max(1, self.words.shape[1] - SHINGLE + 1)), _NONE)
        for s in self.sizes:
            rows = np.flatnonzero(np.minimum(self.size, SHINGLE) == s)
            for k in range(out.shape[1] if s == SHINGLE else 1):
                fits = rows[self.size[rows] >= k + s]
                out[fits, k] = _keys([self.words[fits, k + j] for j in range(s)])
        return out

    def choose(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Makes the rarest shingle of each window its prefix, by the counts of sorted keys."""
        own = self.shingles()
        seen = np.zeros(own.shape, np.int64)
        if len(keys):
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            seen = np.where(keys[at] == own, counts[at], 0)
        seen[own == _NONE] = np.iinfo(np.int64).max
        first = np.where(seen == seen.min(axis=1, keepdims=True), own, _NONE).argmin(axis=1)
        prefix = own[np.arange(len(own)), first]
        order = np.argsort(prefix, kind="stable")
        self.prefix, self.window, self.offset = prefix[order], order, first[order]

    def found(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set[int]]:
        """Runs of words that are windows, and those windows, in a document's word ids."""
        spans, windows = [], set()
        for s in self.sizes:
            h = shingle_keys(ids, s)
            lo = np.searchsorted(self.prefix, h)
            hit = np.flatnonzero((self.prefix[np.minimum(lo, len(self.prefix) - 1)] == h) & (h != 0))
            hi = np.searchsorted(self.prefix, h[hit], side="right")
            for p, x, y in zip(hit.tolist(), lo[hit].tolist(), hi.tolist()):
                for k in range(x, y):
                    w, start = int(self.window[k]), p - int(self.offset[k])
                    n = int(self.size[w])
                    if start >= 0 and start + n <= len(ids) and min(SHINGLE, n) == s and np.array_equal(ids[start : start + n], self.words[w, :n]):
                        spans.append((start, start + n))
                        windows.add(w)
        return spans, windows

    def items(self, windows: Iterable[int]) -> set[str]:
        return {self.names[i] for w in windows for i in self.owners[self.bounds[w] : self.bounds[w + 1]].tolist()}


def _keys(parts: list[np.ndarray]) -> np.ndarray:
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for part in parts:
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) ^ part.astype(np.uint64))
    return h


def shingle_keys(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit key of each run of `size` word ids; runs with an unknown word have key 0."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    parts = [ids[k : k + n] for k in range(size)]
    h = _keys(parts)
    h[np.min(parts, axis=0) == 0] = 0
    return h


class Blocks:
    """Windows of a benchmark in broadcast blocks, of which a process holds one at a time."""

    def __init__(self, spark: SparkSession, made: Iterable):
        self.held: list[Broadcast] = []
        for value in made:
            self.held.append(spark.sparkContext.broadcast(value))
            self._forget(self.held[-1])

    def __iter__(self) -> Iterator:
        for block in self.held:
            yield block.value
            if len(self.held) > 1:
                self._forget(block)

    @staticmethod
    def _forget(block: Broadcast) -> None:
        vars(block).pop("_value", None)  # read again from this machine's copy


def shingle_counts(docs: DataFrame, text_col: str, blocks: Blocks) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each block its sorted shingles that occur in the corpus and how often they do, in
    one pass over it; at most a count a shingle of the benchmark comes to the driver."""
    schema = pa.schema([("block", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for b, own in enumerate(blocks):
                if b not in total:
                    known = np.unique(own.shingles())
                    total[b] = known, np.zeros(len(known), np.int64)
                known, n = total[b]
                for text in texts_in(batch.column(0)):
                    ids = own.word_ids(plain_words(text))
                    for s in own.sizes:
                        h = shingle_keys(ids, s)
                        h = h[h != 0]
                        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
                        n += np.bincount(at[known[at] == h], minlength=len(known))
        for b, (known, n) in total.items():
            used = np.flatnonzero(n)
            yield from batches_of(zip([b] * len(used), known[used].view(np.int64).tolist(), n[used].tolist()), schema, 50_000)

    counts = docs.select(text_col).mapInArrow(lean(run), "block int, key long, n long").groupBy("block", "key").agg(F.sum("n").alias("n")).toArrow()
    block, key, n = (counts.column(c).to_numpy() for c in ("block", "key", "n"))
    out = []
    for b in range(len(blocks.held)):
        own = np.flatnonzero(block == b)
        keys = key[own].view(np.uint64)
        order = np.argsort(keys)
        out.append((keys[order], n[own][order]))
    return out


def _items(benchmark: DataFrame, item_col: str, text_col: str, bound: int) -> Iterator[list[tuple[str | None, bytes]]]:
    """Items in blocks of at most `bound` bytes (an item more), read a partition at a time."""
    held: list[tuple[str | None, bytes]] = []
    size = 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null").orderBy("item")
    for row in rows.toLocalIterator():
        text = row["text"].encode()
        held.append((row["item"], text))
        size += len(text)
        if size >= bound:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
    keep: list[str] | None = None,
) -> DataFrame:
    """The kept columns of docs (by default all) with n_words, hits (array of [start, end)
    word runs) and items (sorted item ids).

    A word is hit if it lies in any occurrence of any window. Words are those of
    `words.plain_words`; null and wordless texts have none and hit nothing, and an item
    without words has no window. Windows of items with a null id hit words, but such items
    aren't named; equal items are both named. Repeated documents give a row each. Empty
    tables on either side give no hits. Columns of docs named like the results are replaced.

    Two narrow passes, one to count shingles and one to find windows; documents are not
    shuffled. The benchmark's size is checked: beyond block_bytes its windows are held in
    several blocks, one at a time, and each batch of texts meets them one after the other.
    """
    spark = docs.sparkSession
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("n_words", "hits", "items")]
    sent = [c for c in keep if c != text_col]  # beside the text, which is sent once
    made = (Windows.of(items, width) for items in _items(benchmark, item_col, item_text_col, block_bytes))
    blocks = Blocks(spark, (w for w in made if len(w.words)))
    counts = shingle_counts(docs, text_col, blocks) if blocks.held else []

    def chosen() -> Iterator[Windows]:
        for own, (keys, n) in zip(blocks, counts):
            own.choose(keys, n)
            yield own

    ready = Blocks(spark, chosen())
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            spans: list[list[tuple[int, int]]] = [[] for _ in range(n)]
            items: list[set[str]] = [set() for _ in range(n)]
            n_words = None
            for own in ready:
                sizes = []
                for k, text in enumerate(texts_in(batch.column(0))):
                    ids = own.word_ids(plain_words(text))
                    sizes.append(len(ids))
                    found, windows = own.found(ids)
                    spans[k] += found
                    items[k] |= own.items(windows)
                n_words = sizes
            if n_words is None:
                n_words = [len(plain_words(t)) for t in texts_in(batch.column(0))]
            hits = [[{"start": s, "end": e} for s, e in merged(x)] for x in spans]
            columns = [pa.array(n_words, pa.int64()), pa.array(hits, hit_type), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
            own_columns = dict(zip([text_col, *sent], batch.columns))
            yield pa.RecordBatch.from_arrays([*(own_columns[c] for c in keep), *columns], [*keep, "n_words", "hits", "items"])

    run_type = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    schema = docs.select(*keep).schema.add("n_words", "long").add("hits", T.ArrayType(run_type)).add("items", T.ArrayType(T.StringType()))
    return docs.select(text_col, *sent).mapInArrow(lean(run), schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching runs as one, in order."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def n_hit() -> Column:
    return F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + (x["end"] - x["start"]).cast("long"))


def contaminated(percent_of: int = 20) -> Column:
    """True if at least one word in `percent_of` (and at least one word) is hit."""
    return (n_hit() > 0) & (n_hit() * percent_of >= F.col("n_words"))
