"""Quality by a generalised additive model with pairwise interactions.

Each feature of a text has a lookup table over its bins, learned by boosting shallow trees
one feature at a time, round after round; the pairs of features that explain most of what
is left get tables over two features' bins in the same way. A score is the sum of the
looked-up values through a logistic function.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, texts_in
from .labels import labelled, sampled, training_labels

#: About so many labelled rows, chosen by hash of their id, fit the model where there are more.
TRAINING_ROWS = 20_000
#: Bins of a feature, and of a feature in a pair.
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, PAIRS = 120, 60, 0.1, 4, 8
#: Least rows of a leaf.
LEAF_ROWS = 5

FEATURES = (
    "log_bytes", "log_words", "bytes_a_word", "upper_share", "digit_share", "mark_share", "symbol_share", "bar_share", "bang_share",
    "high_share", "space_share", "log_line_bytes", "repeated_line_share", "repeated_word_share", "distinct_word_share",
    "top_word_share", "short_word_share", "tail_mark_share", "sentence_share", "packed_share", "worst_part_symbols",
)

_CLASS = np.zeros(256, np.int64)  # 0 other, then letters, capitals, digits, marks, symbols, bar, bang, space, high
for _c in range(256):
    _ch = chr(_c)
    _CLASS[_c] = (
        1 if "a" <= _ch <= "z" else 2 if "A" <= _ch <= "Z" else 3 if "0" <= _ch <= "9" else 4 if _ch in ".,;:?'\"()-" else 6 if _ch == "|"
        else 7 if _ch == "!" else 8 if _ch in " \t\n\r\x0b\x0c" else 9 if _c >= 0x80 else 5 if _c > 0x20 else 0
    )


def features(text: bytes | None) -> list[float]:
    """The features of a whole text; an empty one has zeros."""
    if not text or not text.strip():
        return [0.0] * len(FEATURES)
    raw = np.frombuffer(text, np.uint8)
    n = len(raw)
    kinds = _CLASS[raw]
    k = np.bincount(kinds, minlength=10)
    words = text.split()
    m = len(words)
    lower = text.lower().split()
    counts = Counter(lower)
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen = Counter(lines)
    repeated = sum(len(x) * (c - 1) for x, c in seen.items() if c > 1)
    last = Counter(w[-1] for w in words)
    tail = sum(c for b, c in last.items() if _CLASS[b] in (5, 7)) / m
    stops = sum(c for b, c in last.items() if b in b".?") / m
    same = sum(a == b for a, b in zip(lower, lower[1:])) / max(1, m - 1)
    letters = max(1, k[1] + k[2])
    odd = np.isin(kinds, (5, 6, 7))
    part = max(200, -(-n // 64))
    worst = np.add.reduceat(odd, np.arange(0, n, part)).max() / min(part, n)
    return [
        float(np.log1p(n)), float(np.log1p(m)), n / m, k[2] / letters, k[3] / n, k[4] / n, k[5] / n, k[6] / n, k[7] / n, k[9] / n, k[8] / n,
        float(np.log1p(n / max(1, len(lines)))), repeated / n, same, len(counts) / m**0.75, max(counts.values()) / m,
        sum(c for w, c in counts.items() if len(w) <= 3) / m, tail, stops, len(zlib.compress(text, 1)) / (n + 64), float(worst),
    ]


@dataclass
class Additive:
    """Bin edges, a table a feature and a table a pair of features."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]
    start: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Scores of rows of features: a lookup and an addition a table."""
        z = np.full(len(x), self.start)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            a, b = (np.searchsorted(self.coarse[c], x[:, c], side="right") for c in (i, j))
            z += table[a, b]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins))


def _tree(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, leaves: int) -> np.ndarray:
    """Values by bin of a tree that cuts ordered bins into at most `leaves` runs, best cut first."""
    runs = [(0, len(grad))]
    g, h, r = (np.concatenate(([0.0], np.cumsum(v))) for v in (grad, hess, rows))
    while len(runs) < leaves:
        best = (1e-9, None, 0)
        for lo, hi in runs:
            if hi - lo < 2:
                continue
            cut = np.arange(lo + 1, hi)
            gl, gr, hl, hr = g[cut] - g[lo], g[hi] - g[cut], h[cut] - h[lo], h[hi] - h[cut]
            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (g[hi] - g[lo]) ** 2 / (h[hi] - h[lo] + 1)
            gain[(r[cut] - r[lo] < LEAF_ROWS) | (r[hi] - r[cut] < LEAF_ROWS)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], (lo, hi), int(cut[k]))
        if best[1] is None:
            break
        lo, hi = best[1]
        runs.remove((lo, hi))
        runs += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(grad))
    for lo, hi in runs:
        out[lo:hi] = -(g[hi] - g[lo]) / (h[hi] - h[lo] + 1)
    return out


def _pair_gain(grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[float, np.ndarray]:
    """The best tree of one cut on either axis over a grid of bins: its gain and its values."""
    g, h, r = (np.pad(v.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for v in (grad, hess, rows))
    best, out = 0.0, np.zeros_like(grad)
    a, b = grad.shape
    for i in range(1, a):
        for j in range(1, b):
            cells = [(g[y, x] - g[v, x] - g[y, u] + g[v, u], h[y, x] - h[v, x] - h[y, u] + h[v, u], r[y, x] - r[v, x] - r[y, u] + r[v, u]) for v, y in ((0, i), (i, a)) for u, x in ((0, j), (j, b))]
            gain = sum(c[0] ** 2 / (c[1] + 1) for c in cells if c[2] >= LEAF_ROWS)
            if gain > best:
                best = gain
                v = [-c[0] / (c[1] + 1) if c[2] >= LEAF_ROWS else 0.0 for c in cells]
                out = np.empty_like(grad)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray) -> Additive:
    """Boosts tables on rows of features and labels 0 and 1. Without rows of both labels
    every table is zero and the score is the share of ones (a half without rows)."""
    n, d = x.shape
    share = (y.sum() + 1) / (n + 2)
    edges = [_edges(x[:, j], BINS) if n else np.zeros(0) for j in range(d)]
    coarse = [_edges(x[:, j], PAIR_BINS) if n else np.zeros(0) for j in range(d)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    model = Additive(edges, tables, coarse, [], [], float(np.log(share / (1 - share))))
    if n == 0 or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[j], x[:, j], side="right") for j in range(d)]
    wide = [np.searchsorted(coarse[j], x[:, j], side="right") for j in range(d)]
    z = np.full(n, model.start)
    p = lambda: 1 / (1 + np.exp(-z))
    for _ in range(ROUNDS):
        for j in range(d):
            q = p()
            size = len(tables[j])
            step = RATE * _tree(np.bincount(bins[j], q - y, size), np.bincount(bins[j], q * (1 - q), size), np.bincount(bins[j], minlength=size), LEAVES)
            tables[j] += step
            z += step[bins[j]]

    def grid(i: int, j: int, v: np.ndarray | None) -> np.ndarray:
        a, b = len(coarse[i]) + 1, len(coarse[j]) + 1
        return np.bincount(wide[i] * b + wide[j], v, a * b).reshape(a, b).astype(float)

    q = p()
    gains = []
    for i in range(d):
        for j in range(i + 1, d):
            gains.append((_pair_gain(grid(i, j, q - y), grid(i, j, q * (1 - q)), grid(i, j, None))[0], i, j))
    model.pairs = [(i, j) for _, i, j in sorted(gains, reverse=True)[:PAIRS]]
    model.pair_tables = [np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1)) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            q = p()
            step = RATE * _pair_gain(grid(i, j, q - y), grid(i, j, q * (1 - q)), grid(i, j, None))[1]
            table += step
            z += step[wide[i], wide[j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, column: str = "quality", key: str = "doc_id", text_col: str = "text") -> Additive:
    """The model of about TRAINING_ROWS labelled rows outside the held-out third, or of all
    where there are fewer. A repeated document counts as often as it occurs; a key with
    several labels counts as 1 if any is 1; without labels every score is a half."""
    chosen = sampled(training_labels(labels, column, key), TRAINING_ROWS, key)
    rows = labelled(docs, chosen, key, text_col).select("text", F.col("label").cast("int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [features(t) for t in texts_in(batch.column(0))]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.float64()))], ["label", "features"])

    got = rows.mapInArrow(lean(run), "label int, features array<double>").collect()
    order = sorted(range(len(got)), key=lambda k: (got[k]["features"], got[k]["label"]))
    x = np.array([got[k]["features"] for k in order], float).reshape(-1, len(FEATURES))
    return fit_additive(x, np.array([got[k]["label"] > 0 for k in order], float))


def score(docs: DataFrame, model: Additive, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds score, 0 to 1, to the kept columns (by default all); null texts count as empty.

    Only the whole text is an input of a score. Repeated rows give a row each, an empty
    table none. A column named score is replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.array([features(t) for t in texts_in(batch.column(0))], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(m.score(x), pa.float64())], [*keep, "score"])

    return docs.select(F.col(text_col).alias("_text"), *keep).mapInArrow(lean(run), docs.select(*keep).schema.add("score", "double"))
