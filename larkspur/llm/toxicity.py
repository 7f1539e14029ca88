"""Toxicity by class-conditional Kneser-Ney models of word pairs.

A class's model gives each word after the word before it: its pairs' counts, discounted,
back off to the class's own counts of the word, discounted too, and these back off to
continuation counts that both classes share: the logarithm of one and the number of distinct
words that a word occurs after in either class. By the number itself a frequent word of one
class would get much of the other's freed mass. Both classes discount one share, an occurrence of the smaller one, among
all words as well as after each word, so that the smaller class isn't smoothed more. A
document's statistics are per token: the mean log-likelihood ratio, the mean of its part
above a margin, and the strongest words, each of the whole model and of the words' own
backoff model: a pair seen twice says much by its ratio and little by its counts, so the
score weighs the two apart. A logistic function makes the score of them: folds are counted
apart, and each row's statistics leave its own fold's counts out.

The ratio of a word after another is the sum of what the word, the word before and the
pair add; pairs that the discount takes away in both classes add nothing and aren't kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, delete, lean, read_back, scratch_dir, shuffles_deleted, split_join, texts_in
from .labels import labelled, logistic, sampled, training_labels
from .words import WordHashes, WordIds, mixed, plain_words

#: Occurrences in the smaller class that the discount takes away.
DISCOUNT = 1.0
#: The word before the first one of a text.
START = np.uint64(0x5354415254)
#: Pairs with one word from which on the word's row is taken to the pairs, if it has a large share of all pairs.
PAIR_ROWS = 100_000
#: Parts of the pairs, by hash, that are counted one after the other: the texts are read once
#: for each, and only one part's counts are in shuffle files at a time.
PAIR_PARTS = 2
#: Rows of a block of the model; a worker that needs several blocks holds one at a time.
BLOCK_ROWS = 2**20
#: Words of texts that are looked up together, and counted together.
BATCH_WORDS, COUNTED_WORDS = 1_000_000, 1_000_000
#: Keys that are looked up at once.
LOOKUP = 1 << 17
#: Log-likelihood ratio above which a token counts as marked.
MARGIN = 2.0
#: Folds of the labelled rows, for the calibration of the score.
FOLDS = 5
#: About so many labelled rows, chosen by hash of their id, calibrate the score where there
#: are more, in so many tasks.
CALIBRATION_ROWS, CALIBRATION_TASKS = 20_000, 32
FEATURES = 8


@dataclass
class Table:
    """Values of 64-bit keys in sorted blocks by the keys' first bits; 0 for any other key."""

    blocks: list[Broadcast]
    bits: int

    @classmethod
    def of(cls, rows: DataFrame, values: list[str], n: int, bound: int | None = None) -> Table:
        """The n rows (key, block and values) a block at a time by way of the driver."""
        bits = block_bits(n, bound)
        made = []
        for b in range(2**bits):
            own = rows.where(F.col("block") == b) if bits else rows
            got = own.select("key", F.array(*(F.col(v).cast("float") for v in values)).alias("v")).toArrow()
            keys = got.column("key").to_numpy().view(np.uint64)
            v = got.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(values))
            order = np.argsort(keys)
            made.append(rows.sparkSession.sparkContext.broadcast((keys[order], np.ascontiguousarray(v[order]))))
        return cls(made, bits)

    def values_of(self, *roles: np.ndarray, column: np.ndarray | int | None = None) -> list[np.ndarray]:
        """For each role the values of its keys: all columns, or the one named at each place."""
        width = self.blocks[0].value[1].shape[1:] if column is None else ()
        out = [np.zeros((len(keys), *width), np.float32) for keys in roles]
        for b, block in enumerate(self.blocks):
            words, values = block.value
            for keys, made in zip(roles, out):
                for lo in range(0, len(keys) if len(words) else 0, LOOKUP):
                    own = keys[lo : lo + LOOKUP]
                    at = np.flatnonzero(own >> np.uint64(64 - self.bits) == b) if self.bits else np.arange(len(own))
                    found = np.searchsorted(words, own[at])
                    found[found == len(words)] = 0
                    hit = words[found] == own[at]
                    at, found = at[hit] + lo, found[hit]
                    made[at] = values[found] if column is None else values[found, column[at] if isinstance(column, np.ndarray) else column]
            if self.bits:
                del words, values
                vars(block).pop("_value", None)  # read again from the executor's copy
        return out

    def destroy(self) -> None:
        for block in self.blocks:
            block.destroy()


def block_bits(n: int, bound: int | None = None) -> int:
    return max(0, math.ceil(math.log2(max(n, 1) / (bound or BLOCK_ROWS))))


@dataclass
class Ratios:
    """Log-likelihood ratios of words and pairs of words of either class, and of any other word."""

    #: None without any word: all is neutral.
    table: Table | None
    #: A number a column of the table.
    other: np.ndarray
    weights: np.ndarray | None = None
    center: np.ndarray | None = None
    scale: np.ndarray | None = None

    def features(self, texts: list[np.ndarray], known: Known, columns: list[int] | None = None) -> Iterator[tuple[float, ...]]:
        """Statistics of each text's words, by the column of the table for each text."""
        lengths = [len(t) for t in texts]
        if self.table is None or not sum(lengths):
            yield from ((0.0,) * FEATURES for _ in texts)
            return
        column = np.repeat(np.array(columns), lengths) if columns else 0
        hashes, keys, end = known.hashes(), np.empty(sum(lengths), np.uint64), 0
        for t in texts:
            h = hashes[t]
            keys[end : end + len(t)] = pair_keys(preceding(h), h)
            end += len(t)
        pair, alone, context = known.looked_up(self.table, keys, column)
        end = 0
        for k, t in enumerate(texts):
            n, c = len(t), columns[k] if columns else 0
            end += n
            if n == 0:
                yield (0.0,) * FEATURES
                continue
            words = alone[t, c] + self.other[c]
            own = np.stack([words, words + context[preceding(t, 0), c] + pair[end - n : end]])
            top = np.partition(own, max(0, n - 3))[:, -3:]
            made = own.mean(axis=1), np.sqrt(np.maximum(own - MARGIN, 0).mean(axis=1)), top[:, -1], top.mean(axis=1)
            yield tuple(np.concatenate(made).tolist())

    def rows(self, texts: Iterable[bytes | None], known: Known, columns: list[int] | None = None) -> np.ndarray:
        """Statistics of texts, with the words of a bounded number of them held at a time."""
        out: list[tuple[float, ...]] = []
        held: list[np.ndarray] = []
        size = 0

        def done() -> None:
            out.extend(self.features(held, known, columns[len(out) : len(out) + len(held)] if columns else None))
            held.clear()
            known.trim()

        for text in texts:
            held.append(known.words.array(plain_words(text)))
            size += len(held[-1])
            if size >= BATCH_WORDS:
                done()
                size = 0
        done()
        return np.array(out, float).reshape(-1, FEATURES)

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = ((rows - self.center) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Known:
    """The words that a worker has met and what the table says of them alone and as contexts;
    forgets them at a bound."""

    def __init__(self):
        self.words = WordIds(int(START))
        self.values: list[np.ndarray] = []

    def hashes(self) -> np.ndarray:
        return np.array(self.words.hashes, np.uint64)

    def looked_up(self, table: Table, pairs: np.ndarray, column: np.ndarray | int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each pair its value, and all values of each word number alone and as a context."""
        new = self.hashes()[len(self.values[0]) if self.values else 0 :]
        found = table.values_of(new, context_keys(new)) if len(new) else []
        if self.values:
            found = [np.concatenate(x) for x in zip(self.values, found)] if found else self.values
        self.values = found
        return table.values_of(pairs, column=column)[0], *found

    def trim(self) -> None:
        if self.words.full:
            self.words.clear()
            self.values = []


def preceding(words: np.ndarray, start: int | np.uint64 = START) -> np.ndarray:
    return np.concatenate((np.array([start], words.dtype), words[:-1])) if len(words) else words


def context_keys(before: np.ndarray) -> np.ndarray:
    return mixed(before ^ np.uint64(0xC2B2AE3D27D4EB4F))


def pair_keys(before: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mixed(mixed(before * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x165667B19E3779F9)) ^ words)


def pair_counts(rows: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """h, w, c and n: occurrences of word hash w after h in c, twice the fold and 1 if ordinary.

    Counts all rows (text, label, fold); a triple may have several counts, to be added. Of
    several parts, each has the pairs of its share of the hashes, and no other part has them."""
    schema = pa.schema([(c, pa.int64()) for c in "hwcn"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        held: dict[int, list[np.ndarray]] = {}
        size = 0

        def counted() -> Iterator[pa.RecordBatch]:
            for c, texts in sorted(held.items()):
                before, words = np.concatenate([preceding(p) for p in texts]), np.concatenate(texts)
                keys = pair_keys(before, words)
                own = keys % np.uint64(parts) == part
                before, words = before[own], words[own]
                _, at, n = np.unique(keys[own], return_index=True, return_counts=True)
                for k in range(0, len(at), 50_000):
                    x = at[k : k + 50_000]
                    columns = before[x].view(np.int64), words[x].view(np.int64), np.full(len(x), c, np.int64), n[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], schema=schema)

        for batch in batches:
            for text, label, fold in zip(texts_in(batch.column(0)), *(batch.column(k).to_pylist() for k in (1, 2))):
                h = hashes.array(plain_words(text))
                if len(h):
                    held.setdefault(2 * fold + (1 - label), []).append(h)
                    size += len(h)
                if size >= COUNTED_WORDS:
                    yield from counted()
                    held, size = {}, 0
        if size:
            yield from counted()

    return rows.select("text", "label", "fold").mapInArrow(lean(run), "h long, w long, c long, n long")


#: Kinds of the rows of pair_model.
CONTEXT, PAIR, CONTINUED = 0, 1, 2


def pair_model(pairs: DataFrame | Iterable[DataFrame], scratch: list[str] | None = None) -> DataFrame:
    """What the pairs of pair_counts, or of all of its parts, say, as rows of three kinds, with a value a model in v.

    CONTEXT: key of a word, and the log-ratio of what its discounts free in either class.
    PAIR: key of a pair, its word w, and the pair's discounted shares over the freed ones:
    all models' in the toxic class, then in the ordinary one. CONTINUED: a word w, the number
    of distinct words met before it, and its occurrences by fold in the toxic and the ordinary
    class. A context without a pair that keeps something has no row; an empty table gives none.

    Counts are added up by pair before they are dealt out; no step gathers the pairs of one
    word in a task, as words with many followers are joined where their pairs are. Tables that
    the rows are read from are added to `scratch`, to be deleted once the rows are written.
    """
    parts = iter([pairs] if isinstance(pairs, DataFrame) else pairs)
    first = next(parts)
    spark = first.sparkSession
    scratch = [] if scratch is None else scratch

    def kept_table(df: DataFrame, name: str) -> DataFrame:
        scratch.append(scratch_dir(spark, name))
        return read_back(df, scratch[-1])

    kinds = range(2 * FOLDS)
    by_kind = [F.sum(F.when(F.col("c") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in kinds]
    sums = kept_table(first.groupBy("h", "w").agg(*by_kind), "pair-sums")
    for part in parts:  # each pair is in one part only
        part.groupBy("h", "w").agg(*by_kind).write.mode("append").parquet(scratch[-1])
    sums = spark.read.schema(sums.schema).parquet(scratch[-1])
    after = kept_table(sums.groupBy("h").agg(*(F.sum(f"n{k}").alias(f"of{k}") for k in kinds), F.count("*").alias("followers")), "contexts")
    # The discount is at least DISCOUNT occurrences in either class.
    often = sums.where(F.greatest(*(c[0] for c in _by_model("n"))) > DISCOUNT)
    names = [f"s{k}_{m}" for k in (0, 1) for m in range(1 + FOLDS)]

    def shares(contexts: DataFrame) -> DataFrame:
        """The pairs that keep something with their shares, the contexts' columns included."""
        counts, of = _by_model("n"), _by_model("of")
        smaller = [F.when(F.least(t, o) > 0, F.least(t, o)).otherwise(F.greatest(t, o)) for t, o in zip(*of)]
        cut = [F.lit(DISCOUNT) / F.greatest(x, F.lit(1)) for x in smaller]
        share = [n / F.greatest(x, F.lit(1)) - d for c, t in zip(counts, of) for n, x, d in zip(c, t, cut)]
        made = split_join(often, contexts, "h", "followers", PAIR_ROWS)
        made = made.select("*", *(F.when(x >= 1e-12, x).otherwise(0.0).alias(s) for s, x in zip(names, share)))
        return made.where(F.greatest(names[0], names[1 + FOLDS]) > 0)

    freed = shares(after).groupBy("h").agg(*((1 - F.sum(s)).alias(f"free_{s}") for s in names))
    freed = kept_table(after.join(freed, "h"), "freed")
    packed = lambda values: F.array(*(v.cast("float") for v in values)).alias("v")
    ratio = [F.log(F.col(f"free_{t}") / F.col(f"free_{o}")) for t, o in zip(names[: 1 + FOLDS], names[1 + FOLDS :])]
    rows = freed.select(F.lit(CONTEXT).alias("kind"), "h", F.col("h").alias("w"), packed(ratio))
    rows = rows.unionByName(shares(freed).select(F.lit(PAIR).alias("kind"), "h", "w", packed([F.col(s) / F.col(f"free_{s}") for s in names])))
    words = sums.groupBy("w").agg(F.count("*").alias("before"), *(F.sum(f"n{k}").alias(f"n{k}") for k in kinds))
    rows = rows.unionByName(words.select(F.lit(CONTINUED).alias("kind"), F.col("w").alias("h"), "w", packed([F.col("before"), *(F.col(f"n{k}") for k in kinds)])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, h, w = (c.to_numpy() for c in batch.columns[:3])
            h, w = h.view(np.uint64), w.view(np.uint64)
            key = np.select([kind == PAIR, kind == CONTEXT], [pair_keys(h, w), context_keys(h)], w)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(key.view(np.int64)), *batch.columns[2:]], ["kind", "key", "w", "v"])

    return rows.mapInArrow(lean(run), "kind int, key long, w long, v array<float>")


def _by_model(name: str) -> list[list[Column]]:
    """Of the toxic and the ordinary class: the sum of its columns, then that without each fold."""
    folds = [[F.col(f"{name}{2 * f + k}") for f in range(FOLDS)] for k in (0, 1)]
    return [[sum(c[1:], c[0]), *(sum(c[1:], c[0]) - x for x in c)] for c in folds]


def fit(docs: DataFrame, labels: DataFrame, column: str = "toxic", key: str = "doc_id", text_col: str = "text") -> Ratios:
    """The model of all training rows. With one class only, every ratio is neutral. A repeated
    document counts as often as it occurs; a key with several labels as toxic if any is."""
    with shuffles_deleted(docs.sparkSession):
        return _fitted(docs, labels, column, key, text_col)


def _fitted(docs: DataFrame, labels: DataFrame, column: str, key: str, text_col: str) -> Ratios:
    chosen = training_labels(labels, column, key).withColumn("label", (F.col("label") > 0).cast("int"))
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64(key), F.lit(FOLDS)).cast("int"))
    n_labels = chosen.count()
    rows = labelled(docs, chosen, key, text_col, n_labels)
    sample = labelled(docs, sampled(chosen, CALIBRATION_ROWS, key), key, text_col)
    spark = docs.sparkSession
    paths = {name: scratch_dir(spark, name) for name in ("pair-model", "word-counts", "word-model")}
    done: list[str] = []
    if n_labels > BROADCAST_ROWS:  # all texts are shuffled to their labels: once, and before the pairs are
        done.append(scratch_dir(spark, "training-rows"))
        rows = read_back(rows.select("text", "label", "fold"), done[-1])
    counted = (pair_counts(rows, k, PAIR_PARTS) for k in range(PAIR_PARTS))
    pairs = read_back(pair_model(counted, done), paths["pair-model"])
    for path in done:
        delete(spark, path)
    part = lambda k: F.sum(F.col("v")[k].cast("double"))
    by_fold = (part(1 + 2 * f + k).alias(f"{c}{f}") for f in range(FOLDS) for k, c in enumerate("to"))
    counts = read_back(pairs.where(F.col("kind") == CONTINUED).groupBy("w").agg(part(0).alias("before"), F.log1p(part(0)).alias("continued"), *by_fold), paths["word-counts"])
    folds = range(FOLDS)
    models = [list(folds), *([g for g in folds if g != f] for f in folds)]
    toxic = [sum(F.col(f"t{f}") for f in m) for m in models]
    ordinary = [sum(F.col(f"o{f}") for f in m) for m in models]
    sums = counts.agg(*(F.sum(c).alias(f"x{k}") for k, c in enumerate(toxic + ordinary)), F.sum("continued").alias("continued")).first()
    n1, n0 = (np.array([float(x or 0) for x in sums[k : k + len(models)]]) for k in range(0, 2 * len(models), len(models)))
    if min(n1[0], n0[0]) == 0:
        return _calibrated(Ratios(None, np.zeros(len(models))), sample, key)
    words, n_pairs = counts, sums["continued"]
    backoff = F.col("continued") / F.lit(n_pairs)
    p1, p0, other = [], [], np.zeros(len(models))
    both_classes = [k for k in range(len(models)) if min(n1[k], n0[k])]
    cut = {k: DISCOUNT / min(n1[k], n0[k]) for k in both_classes}
    own_share = {k: [F.greatest(c / F.lit(n) - F.lit(cut[k]), F.lit(0.0)) for c, n in ((toxic[k], n1[k]), (ordinary[k], n0[k]))] for k in both_classes}
    left = [1 - x for x in counts.agg(*(F.sum(d) for k in both_classes for d in own_share[k])).first()]
    freed = dict(zip(both_classes, zip(left[::2], left[1::2])))
    for k in range(len(models)):
        if k not in freed:  # a class that is in one fold only
            p1.append(backoff)
            p0.append(backoff)
            continue
        (d1, d0), (g1, g0) = own_share[k], freed[k]
        other[k] = math.log(g1 / g0)
        p1.append(d1 + g1 * backoff)
        p0.append(d0 + g0 * backoff)
    least = DISCOUNT / min(n1[0], n0[0])
    kept = (toxic[0] > least * n1[0]) | (ordinary[0] > least * n0[0])
    words = read_back(words.select("w", "before", kept.alias("kept"), *(p.alias(f"{c}{k}") for c, ps in (("p", p1), ("q", p0)) for k, p in enumerate(ps))), paths["word-model"])
    delete(spark, paths.pop("word-counts"))
    own = [F.log(F.col(f"p{k}") / F.col(f"q{k}")) for k in range(len(models))]
    both = split_join(pairs.where(F.col("kind") == PAIR), words, "w", "before", PAIR_ROWS)
    joint = [F.log((F.col("v")[k] + F.col(f"p{k}")) / (F.col("v")[len(models) + k] + F.col(f"q{k}"))) - own[k] for k in range(len(models))]
    split = (  # a pair's ratio is the sum of the three
        (words.where("kept"), F.col("w"), [x - F.lit(float(o)) for x, o in zip(own, other)]),
        (pairs.where(F.col("kind") == CONTEXT), F.col("key"), [F.col("v")[k] for k in range(len(models))]),
        (both, F.col("key"), [x if min(n1[k], n0[k]) else F.lit(0.0) for k, x in enumerate(joint)]),
    )
    parts = [t.select(key.alias("key"), *(v.cast("float").alias(f"v{k}") for k, v in enumerate(values))) for t, key, values in split]
    n = pairs.where(F.col("kind") != CONTINUED).count() + words.where("kept").count()
    return _calibrated(_blocks(parts[0].unionByName(parts[1]).unionByName(parts[2]), n, other, list(paths.values())), sample, key)


def _blocks(values: DataFrame, n: int, other: np.ndarray, done: list[str]) -> Ratios:
    """The model of all rows and of each without one fold, from n keys, written once. The
    tables at the paths `done` made it and are deleted, as is the written one."""
    spark = values.sparkSession
    path = scratch_dir(spark, "ratios")
    bits = block_bits(n)
    if bits:
        values.withColumn("block", F.shiftrightunsigned("key", 64 - bits)).repartition("block").write.partitionBy("block").parquet(path)
        values = spark.read.parquet(path)
    else:
        values = read_back(values, path)
    for old in done:
        delete(spark, old)
    table = Table.of(values, [f"v{k}" for k in range(len(other))], n)
    delete(spark, path)
    return Ratios(table, other)


def _calibrated(model: Ratios, sample: DataFrame, key: str) -> Ratios:
    """Fits the score on statistics that leave out the counts of a row's own fold."""
    sample = sample.repartition(CALIBRATION_TASKS, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            made = model.rows(texts_in(batch.column(0)), known, [1 + f for f in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.array(made.tolist(), pa.list_(pa.float64()))], ["label", "features"])

    got = sample.select("text", "fold", "label").mapInArrow(lean(run), "label int, features array<double>").collect()
    x = np.array([r["features"] for r in got], float).reshape(-1, FEATURES)
    y = np.array([r["label"] for r in got], float)
    model.center = x.mean(axis=0) if len(x) else np.zeros(FEATURES)
    model.scale = x.std(axis=0) + 1e-9 if len(x) else np.ones(FEATURES)
    model.weights = logistic((x - model.center) / model.scale, y) if len(y) else np.zeros(FEATURES + 1)
    return model


def score(docs: DataFrame, model: Ratios, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, 0 to 1, to the kept columns (by default all); a document without words
    has the statistics 0, as one of neutral words has. Labels are no input of a score.

    Null texts count as empty. Repeated rows give a row each, an empty table none. A column
    named score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Known()
        for batch in batches:
            rows = model.rows(texts_in(batch.column(0)), known)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(model.score(rows), pa.float64())], [*keep, "score"])

    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(lean(run), docs.select(*keep).schema.add("score", "double"))
