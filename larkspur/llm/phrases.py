"""Phrases whose words keep together, mined from n-gram counts by language.

Texts are read a level at a time: words, pairs of words, triples and so on. Each task numbers
the words of a shard of text, sorts the shard's suffixes by prefix doubling as deep as the
level, and takes the intervals of suffixes with a common prefix of so many words: an interval
is an n-gram and its width the count. Spark adds the counts of all shards by key. From the
second level on a shard leaves out suffixes that can't be frequent: both of the shorter n-grams
in them must be, which a bit map of fixed size says, without false denials, so counts stay exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batches_of, bytes_of, lean, texts_in, written
from .words import WordIds, mixed

#: Words of a shard, and bytes of its distinct words, at which it is counted.
SHARD, VOCABULARY = 1_000_000, 32_000_000
#: Bytes of a text that are split at a time, up to the next white space or end of a piece.
CUT = 1_000_000
#: Bits of the map of frequent n-grams: 16 MB. More of them than bits only weaken the pruning.
MAP_BITS = 1 << 27

_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x0A if c in _ENDS else 0x20 if c == 0x09 else c for c in range(256))
_END = b"\n"
_STEP = np.uint64(0x9E3779B97F4A7C15)


def cut_text(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, lower-cased, and a newline for each end of a piece, in lists of
    bounded size (unless a single word is larger)."""
    at = 0
    while at < len(text):
        end = at + CUT
        while end < len(text) and text[end] not in b" \t" + _ENDS:
            end += 1
        part = text[at : end + 1].translate(_PLAIN).replace(_END, b" \n ")
        yield [w for w in part.split(b" ") if w]
        at = end + 1


def lang_hash(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))


def chained(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of n-grams a word longer."""
    return mixed((h * _STEP) ^ words)


class Words(WordIds):
    """Numbers of words; the end of a piece is 0."""

    def __missing__(self, word: bytes) -> int:
        return 0 if word == _END else super().__missing__(word)


class Shard:
    """Word numbers of texts (0 at the end of each piece) and their n-grams of one length."""

    def __init__(self, length: int, frequent: np.ndarray | None):
        self.length, self.frequent = length, frequent
        self.words = Words(0)
        self.langs: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.marks: list[tuple[int, int]] = []  # language and words of each part
        self.size = 0

    def add(self, lang: str, ids: np.ndarray) -> None:
        self.parts += [ids, np.zeros(1, np.int32)]
        self.marks.append((self.langs.setdefault(lang, len(self.langs)), len(ids) + 1))
        self.size += len(ids) + 1

    @property
    def full(self) -> bool:
        return self.size >= SHARD or self.words.bytes > VOCABULARY

    def grams(self) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        """(lang, phrases, counts); afterwards the shard is empty."""
        if self.size:
            yield from self._intervals()
        self.words = Words(0)
        self.langs, self.parts, self.marks, self.size = {}, [], [], 0

    def _intervals(self) -> Iterator[tuple[str, pa.Array, np.ndarray]]:
        m = self.length
        x = np.concatenate(self.parts).astype(np.int64)
        lang = np.repeat([k for k, _ in self.marks], [n for _, n in self.marks])
        n = len(x) - m + 1
        if n <= 0:
            return
        whole = np.ones(n, bool)
        for k in range(m):
            whole &= x[k : k + n] > 0
        if self.frequent is not None:
            words = np.array(self.words.hashes, np.uint64)[x]
            h = np.array([lang_hash(name) for name in self.langs], np.uint64)[lang]
            for k in range(m - 1):
                h = chained(h[: len(x) - k], words[k:])
            bit = (h & np.uint64(MAP_BITS - 1)).astype(np.int64)
            known = (self.frequent[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
            whole &= known[:n] & known[1 : n + 1]
        at = np.flatnonzero(whole)
        if not len(at):
            return
        # ranks by prefixes of 1, 2, 4 ... words, of the suffixes that are needed alone
        rank, depth, top = x, 1, int(x.max()) + 1
        while depth < m:
            step = min(depth, m - depth)
            need = np.zeros(len(x), bool)
            need[at] = True
            for k in range(1, m - depth - step + 1):
                need[at + k] = True
            of = np.flatnonzero(need)
            key = rank[of] * top + rank[of + step]
            order = np.argsort(key)
            fresh = np.concatenate(([True], key[order][1:] != key[order][:-1]))
            rank = np.zeros(len(x), np.int64)
            rank[of[order]] = np.cumsum(fresh)
            depth, top = depth + step, int(fresh.sum()) + 1
        # the suffix array of what is left, in order of language and prefix; two neighbours with
        # one rank share m words, so a run of equal ranks is an interval of that depth
        key = lang[at] * top + rank[at]
        order = np.argsort(key)
        suffixes, key = at[order], key[order]
        begins = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        widths = np.diff(np.append(begins, len(key)))
        first = suffixes[begins]
        names = pa.array([b"", *self.words], pa.binary())
        ends = np.searchsorted(lang[first], np.arange(len(self.langs) + 1))
        for name, begin, end in zip(self.langs, ends, ends[1:]):
            for k in range(begin, end, 100_000):
                some = slice(k, min(end, k + 100_000))
                parts = [names.take(pa.array(x[first[some] + j])) for j in range(m)]
                yield name, parts[0] if m == 1 else pc.binary_join_element_wise(*parts, pa.scalar(b" ", pa.binary())), widths[some]


_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("n", pa.int64())])


def shard_counts(texts: DataFrame, length: int, frequent=None) -> DataFrame:
    """(lang, phrase, n) of the n-grams of `length` words in each shard of texts (lang, text);
    frequent: a broadcast bit map of the n-grams a word shorter. At length 1 a row with the
    phrase NULL has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard(length, None if frequent is None else np.frombuffer(frequent.value, np.uint8))

        def counts() -> Iterator[pa.RecordBatch]:
            total: dict[str, int] = {}
            if length == 1:
                names = list(shard.langs)
                for part, (k, _) in zip(shard.parts[::2], shard.marks):
                    total[names[k]] = total.get(names[k], 0) + int((part > 0).sum())
            for name, phrases, widths in shard.grams():
                lang = pa.array([name], pa.string()).take(pa.array(np.zeros(len(widths), np.int64)))
                yield pa.RecordBatch.from_arrays([lang, phrases, pa.array(widths, pa.int64())], schema=_COUNTS)
            yield from batches_of(((name, None, n) for name, n in total.items()), _COUNTS)

        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, texts_in(batch.column(1))):
                held = np.zeros(0, np.int32)
                for words in cut_text(text or b""):
                    # n-grams over a cut begin with the words before it: one too few for an n-gram of their own
                    held = np.concatenate((held[max(0, len(held) - length + 1) :], shard.words.array(words)))
                    shard.add(lang, held)
                    if shard.full:
                        names = [_END, *shard.words]
                        last = [names[k] for k in held[max(0, len(held) - length + 1) :]]
                        yield from counts()
                        held = shard.words.array(last)
        yield from counts()

    return texts.mapInArrow(lean(run), "lang string, phrase binary, n long")


def bit_map(spark: SparkSession, grams: DataFrame) -> bytes:
    """The map of MAP_BITS bits with a bit for each row (lang, phrase) of grams. Tasks hash the
    rows; Spark joins their bits in blocks of 4 KB, so the driver gets at most the map's size."""
    out = pa.schema([("bit", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds(0)
        for batch in batches:
            langs, split = batch.column(0).to_pylist(), [p.split(b" ") for p in bytes_of(batch.column(1))]
            if ids.full:
                ids.clear()
            known = {lang: lang_hash(lang) for lang in set(langs)}
            h = np.array([known[lang] for lang in langs], np.uint64)
            for k in range(max((len(p) for p in split), default=0)):
                numbers = ids.array([p[k] for p in split])
                h = chained(h, np.array(ids.hashes, np.uint64)[numbers])
            yield pa.RecordBatch.from_arrays([pa.array((h & np.uint64(MAP_BITS - 1)).astype(np.int64) + 1)], schema=out)

    bits = grams.select("lang", "phrase").mapInArrow(lean(run), "bit long")
    blocks = bits.groupBy(F.bitmap_bucket_number("bit").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = bytearray(MAP_BITS // 8)
    for row in blocks.collect():  # at most MAP_BITS / 32768 rows
        # Spark numbers bits and buckets from 1
        whole[(row["block"] - 1) * 4096 : row["block"] * 4096] = row["bits"]
    return bytes(whole)


def frequent_grams(docs: DataFrame, longest: int, least: int, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, words, f) of every n-gram of 1 to `longest` words that occurs `least`
    times in its language, (lang, n) with the number of all words). Exact at every size."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    found = totals = frequent = None
    for length in range(1, longest + 1):
        counts = shard_counts(texts, length, frequent).groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("f"))
        kept = written(counts.where(F.col("phrase").isNull() | (F.col("f") >= least)), f"grams-{length}")
        if length == 1:
            totals = kept.where(F.col("phrase").isNull()).select("lang", F.col("f").alias("n"))
            kept = kept.where(F.col("phrase").isNotNull())
        level = kept.select("lang", "phrase", F.lit(length).alias("words"), "f")
        found = level if found is None else found.unionByName(level)
        if length < longest:
            frequent = spark.sparkContext.broadcast(bit_map(spark, kept))
    return found, totals


def _run(words: str, first: int, length: int):
    """The n-gram of so many words from the word `first` (from 0) of an array of words."""
    return F.array_join(F.slice(words, first + 1, length), " ")


def phrases(
    docs: DataFrame, shortest: int = 2, longest: int = 3, least: int = 10, top: int = 2000, inside: int = 50, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best `top` phrases of each language.

    A text is lower-cased (A-Z), split at . , ; : ! ? and line ends into pieces and those at
    spaces and tabs into words. Phrases are runs of `shortest` to `longest` words in a piece
    that occur `least` times (a), overlapping ones included; n counts the language's words.
    Cut after its first k words a phrase has the score floor(1,000,000 a a / (l r)), l and r
    being the counts of both parts; the lowest counts, at the smallest k of equal ones. A
    phrase is dropped if a longer one holds it with at least `inside` per cent of its count,
    whether that one is dropped or not. Order: score and a descending, then the phrase's bytes.

    Null texts are empty, null languages are `und`; repeated rows count each time; other
    columns are left out; an empty table gives no rows. Long texts are split in parts, of
    which no n-gram is lost. Parts of phrases are joined, in which Spark may split a word with
    very many partners; each language's best are taken from the best of 16 groups of it by
    hash, so one task orders 16 * top rows at most.
    """
    grams, totals = frequent_grams(docs, longest, least, text_col, lang_col)
    counts = grams.select("lang", "phrase", "f")
    found = grams.where(F.col("words") >= shortest).select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = found.select("lang", "phrase", "words", "a", "w", F.explode(F.expr("sequence(1, words - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _run("w", 0, F.col("k")).alias("head"), F.array_join(F.expr("slice(w, k + 1, words - k)"), " ").alias("tail"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l")), ["lang", "head"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r")), ["lang", "tail"])
    wide = lambda c: F.col(c).cast("decimal(15,0)")  # noqa: E731  products of two and a million have at most 37 digits
    score = (wide("a") * wide("a") * F.lit(1_000_000).cast("decimal(7,0)"), wide("l") * wide("r"))
    cuts = cuts.withColumns({"_above": score[0], "_below": score[1]}).withColumn("score", F.expr("_above div _below"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("s")).select("lang", "phrase", "words", "a", "s.score", "s.l", "s.r")
    if longest > shortest:
        parts = found.where(F.col("words") > shortest).select(
            "lang", "a", F.explode(F.expr(f"flatten(transform(sequence({shortest}, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(w, i, m), ' '))))")).alias("phrase")
        )
        held = parts.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
        scored = scored.join(held, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < inside * F.col("a")))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(16))
    some = scored.withColumn("_g", group).withColumn("_k", F.row_number().over(W.partitionBy("lang", "_g").orderBy(*best))).where(F.col("_k") <= top)
    ranked = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
