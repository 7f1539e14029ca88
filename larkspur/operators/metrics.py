"""Cluster quality and agreement of labels.

Points are rows of (key, label, x) with x an array of doubles. A label of -1 is noise and
is left out. With fewer than two clusters a metric is NULL.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

NOISE = -1


def assigned(points: DataFrame, label: str = "label", x: str = "x") -> DataFrame:
    return points.where(F.col(label).isNotNull() & (F.col(label) != NOISE)).select(F.col(label).alias("label"), F.col(x).cast("array<double>").alias("x"))


def centroids(points: DataFrame) -> DataFrame:
    """(label, n, c, q): size, mean vector and sum of squared lengths of each cluster."""
    dims = points.select(F.posexplode("x").alias("d", "v"), "label").groupBy("label", "d").agg(F.avg("v").alias("m"), F.count("v").alias("n"), F.sum(F.col("v") * F.col("v")).alias("q"))
    c = F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"])
    return dims.groupBy("label").agg(F.max("n").alias("n"), c.alias("c"), F.sum("q").alias("q"))


def squared_distance(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda u, v: (u - v) * (u - v)), F.lit(0.0), lambda s, v: s + v)


def internal_metrics(points: DataFrame, label: str = "label", x: str = "x") -> DataFrame:
    """One row: n, k, wcss, calinski_harabasz and davies_bouldin.

    Clusters are few, so their centroids are joined as a broadcast; points are read twice
    and only partial sums are shuffled."""
    p = assigned(points, label, x)
    c = centroids(p)
    each = p.join(F.broadcast(c), "label").select("label", squared_distance("x", "c").alias("d2"))
    per = each.groupBy("label").agg(F.sum("d2").alias("w"), F.avg(F.sqrt("d2")).alias("s"), F.count(F.lit(1)).alias("n"))
    rows = c.select("label", "c").join(per, "label").collect()  # one row a cluster
    found = quality(*(np.array([r[c] for r in rows], float) for c in ("n", "c", "w", "s")))
    schema = "n long, k long, wcss double, calinski_harabasz double, davies_bouldin double"
    return points.sparkSession.createDataFrame([found], schema)


def quality(sizes: np.ndarray, centers: np.ndarray, within: np.ndarray, mean_distance: np.ndarray) -> tuple[int, int, float | None, float | None, float | None]:
    """n, k, wcss, Calinski-Harabasz and Davies-Bouldin of clusters' sizes, centres, sums of
    squared distances and mean distances; the last two are None unless 2 <= k < n."""
    n, k = int(sizes.sum()), len(sizes)
    wcss = float(within.sum()) if k else None
    if not 2 <= k < n:
        return n, k, wcss, None, None
    mean = (centers * sizes[:, None]).sum(0) / n
    between = float((sizes * ((centers - mean) ** 2).sum(1)).sum())
    ch = between / (k - 1) / (wcss / (n - k)) if wcss else 1.0
    far = np.sqrt(((centers[:, None] - centers[None]) ** 2).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(far > 0, (mean_distance[:, None] + mean_distance[None]) / far, 0.0)
    np.fill_diagonal(ratio, -np.inf)
    return n, k, wcss, ch, float(ratio.max(1).mean())


def quality_by_model(points: DataFrame, ks: Sequence[int]) -> list[tuple]:
    """`quality` of each model's labels of points (labels, x), labels being below the model's
    number in ks or NOISE. Two passes over the points serve all models."""
    width = points.select(F.size("x")).limit(1).collect()[0][0]
    starts = np.cumsum([0, *ks])

    def hot(labels: np.ndarray) -> np.ndarray:
        out = np.zeros((len(labels), starts[-1]))
        for t, s in enumerate(starts[:-1]):
            real = np.flatnonzero(labels[:, t] != NOISE)
            out[real, s + labels[real, t]] = 1
        return out

    def totals(size: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for b in batches:
                if b.num_rows:
                    total += step(blocks.matrix(b.column(0)), hot(blocks.matrix(b.column(1)).astype(int)))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(total)], names=["i", "v"])

        out = np.zeros(size)
        for r in points.select("x", "labels").mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
            out[r["i"]] = r["v"]
        return out

    k = int(starts[-1])
    first = totals(k * width + k, lambda x, z: np.concatenate(((z.T @ x).ravel(), z.sum(0))))
    sizes = first[k * width :]
    centers = first[: k * width].reshape(k, width) / np.maximum(sizes, 1)[:, None]

    def about(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        d2 = blocks.squared(x, centers) * z
        return np.concatenate((d2.sum(0), np.sqrt(d2).sum(0)))

    second = totals(2 * k, about)
    out = []
    for s, e in zip(starts, starts[1:]):
        real = np.flatnonzero(sizes[s:e] > 0) + s
        out.append(quality(sizes[real], centers[real], second[real], second[k + real] / sizes[real]))
    return out


#: Rows of two blocks whose distances are made at once: what a core's cache holds.
TILE = 512


def _labels(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an Arrow column of arrays of labels, one for each model."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _distance_sums(points: blocks.Points, metric: str, clusters: Sequence[np.ndarray]) -> DataFrame:
    """(id, s): of each point with `labels`, an array with a label for each model, the sums of
    its distances to the points of each cluster of each model, in their order.

    Every pair of blocks is one group, whose distances are made once and serve both blocks and
    all models; a group gives a row a point, and Spark adds a point's rows up."""
    starts = np.cumsum([0, *map(len, clusters)])
    kind = pa.schema([("id", pa.int64()), ("s", pa.list_(pa.float64()))])

    def hot(labels: np.ndarray) -> np.ndarray:
        out = np.zeros((len(labels), starts[-1]))
        for t, (names, start) in enumerate(zip(clusters, starts)):
            real = np.flatnonzero(labels[:, t] != NOISE)
            out[real, start + np.searchsorted(names, labels[real, t])] = 1
        return out

    def work(one: dict, two: dict | None) -> pa.Table:
        sides = [one] if two is None else [one, two]
        x, y = sides[0]["x"], sides[-1]["x"]
        hots = [hot(_labels(side["labels"])) if len(side["id"]) else np.zeros((0, starts[-1])) for side in sides]
        sums = [np.zeros_like(z) for z in hots]
        for i in range(0, len(x), TILE):
            for j in range(i if two is None else 0, len(y), TILE):
                for at, d in blocks.strips(x[i : i + TILE], y[j : j + TILE], metric):
                    rows = slice(i + at.start, i + at.stop)
                    if two is None and i == j:  # the tile has both directions
                        d[np.arange(len(d)), np.arange(at.start, at.stop)] = 0.0
                        sums[0][rows] += d @ hots[0][j : j + TILE]
                        continue
                    sums[0][rows] += d @ hots[-1][j : j + TILE]
                    sums[-1][j : j + TILE] += d.T @ hots[0][rows]
        s = np.concatenate(sums)
        bounds = pa.array(np.arange(len(s) + 1) * starts[-1], pa.int32())
        return pa.Table.from_arrays([pa.array(np.concatenate([side["id"] for side in sides])), pa.ListArray.from_arrays(bounds, pa.array(s.ravel()))], schema=kind)

    rows = blocks.over_block_pairs(points, ["labels"], work, "id long, s array<double>")
    added = F.aggregate(F.collect_list("s"), F.array_repeat(F.lit(0.0), int(starts[-1])), lambda a, b: F.zip_with(a, b, lambda u, v: u + v))
    return rows.groupBy("id").agg(added.alias("s"))


def silhouettes_by_model(points: DataFrame, metric: str = "euclidean") -> DataFrame:
    """(model, key, label, silhouette) of points (key, labels, x), labels having one for each
    model: exact mean distances, 0 in a cluster of one, NULL with fewer than two clusters.

    All points meet all points, which is what the metric is: as pairs of blocks of bounded
    size, whose partial sums Spark adds. Only sizes of clusters are known to every task."""
    held = blocks.numbered_points(points.select("key", "labels", "x"))
    each = held.rows.select(F.posexplode("labels").alias("model", "c")).where(F.col("c") != NOISE)
    found = sorted((r["model"], r["c"], r["n"]) for r in each.groupBy("model", "c").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a cluster
    models = range(max((m for m, _, _ in found), default=-1) + 1)
    clusters = [np.array([c for m, c, _ in found if m == t], np.int64) for t in models]
    sizes = [np.array([n for m, _, n in found if m == t], float) for t in models]
    starts = np.cumsum([0, *map(len, clusters)])
    key = held.rows.schema["key"]

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows or not clusters:
                continue
            labels, s = _labels(b.column(1)), blocks.matrix(b.column(2))
            for t, (names, n) in enumerate(zip(clusters, sizes)):
                real = np.flatnonzero(labels[:, t] != NOISE)
                if not len(real):
                    continue
                label, sums = labels[real, t], s[real, starts[t] : starts[t + 1]]
                row, own = np.arange(len(real)), np.searchsorted(names, label)
                inside = sums[row, own] / np.maximum(n[own] - 1, 1)
                means = sums / n
                means[row, own] = np.inf
                outside = means.min(1)
                top = np.maximum(inside, outside)
                with np.errstate(invalid="ignore"):
                    value = np.where((n[own] == 1) | (top == 0), 0.0, (outside - inside) / np.where(top == 0, 1.0, top))
                value = pa.array(value, mask=np.full(len(real), len(names) < 2))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(real), t, np.int32)), b.column(0).take(pa.array(real)), pa.array(label), value], names=["model", "key", "label", "silhouette"])

    sums = _distance_sums(held, metric, clusters)
    rows = held.rows.select("id", "key", "labels").join(sums, "id").select("key", "labels", "s")
    return rows.mapInArrow(valued, f"model int, key {key.dataType.simpleString()}, label long, silhouette double")


def silhouette_samples(points: DataFrame, key: str = "key", label: str = "label", x: str = "x", metric: str = "euclidean") -> DataFrame:
    """(key, label, silhouette) of the points that are no noise; see `silhouettes_by_model`."""
    p = points.where(F.col(label).isNotNull() & (F.col(label) != NOISE))
    p = p.select(F.col(key).alias("key"), F.array(F.col(label).cast("long")).alias("labels"), F.col(x).alias("x"))
    return silhouettes_by_model(p, metric).drop("model")


def silhouette(points: DataFrame, key: str = "key", label: str = "label", x: str = "x", metric: str = "euclidean") -> DataFrame:
    return silhouette_samples(points, key, label, x, metric).agg(F.avg("silhouette").alias("silhouette"))


# Statuses of a metric, and why there is none.
VALID, NOT_APPLICABLE, COMPUTATION_ERROR, ALL_NOISE, SINGLE_CLUSTER = "VALID_VALUE", "NOT_APPLICABLE", "COMPUTATION_ERROR", "ALL_NOISE", "SINGLE_CLUSTER"


def metrics_with_status(points: DataFrame, key: str = "key", label: str = "label", x: str = "x") -> DataFrame:
    """(metric, value, status, reason) of silhouette, davies_bouldin, calinski_harabasz, wcss.

    Noise is left out. Without any cluster no metric applies (ALL_NOISE); with one there is a
    wcss alone (SINGLE_CLUSTER); a metric that can't be computed of two or more, as of points
    that are clusters of their own, is a COMPUTATION_ERROR with what is wrong."""
    one = internal_metrics(points, label, x).first()
    known = one.asDict() | {"silhouette": silhouette(points, key, label, x).first()[0] if (one["k"] or 0) > 1 else None}
    n, k = one["n"], one["k"]
    rows = []
    for name in ("silhouette", "davies_bouldin", "calinski_harabasz", "wcss"):
        if k == 0 or (k == 1 and name != "wcss"):
            rows.append((name, None, NOT_APPLICABLE, ALL_NOISE if k == 0 else SINGLE_CLUSTER))
        elif name != "wcss" and k >= n:
            rows.append((name, None, COMPUTATION_ERROR, f"{k} clusters of {n} points"))
        else:
            rows.append((name, float(known[name]), VALID, None))
    return points.sparkSession.createDataFrame(rows, "metric string, value double, status string, reason string")


def contingency(a: DataFrame, b: DataFrame, key: str = "key", label: str = "label") -> DataFrame:
    """(a, b, n): how many keys have each pair of labels."""
    left, right = a.select(key, F.col(label).alias("a")), b.select(key, F.col(label).alias("b"))
    return left.join(right, key).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def table_of(pairs: DataFrame) -> np.ndarray:
    """A contingency as a matrix; there is a row a pair of labels, not of points."""
    rows = pairs.collect()
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    m = np.zeros((len(a), len(b)))
    for r in rows:
        m[a.index(r["a"]), b.index(r["b"])] = r["n"]
    return m


def agreement(m: np.ndarray) -> dict[str, float]:
    """Adjusted Rand index, adjusted and normalised mutual information (arithmetic mean)."""
    n = m.sum()
    if n == 0:
        return {"ari": math.nan, "ami": math.nan, "nmi": math.nan}
    a, b = m.sum(1), m.sum(0)
    pairs = lambda v: float((v * (v - 1) / 2).sum())
    both, pa, pb, every = pairs(m), pairs(a), pairs(b), n * (n - 1) / 2
    expected = pa * pb / every if every else 0.0
    ari = 1.0 if (pa + pb) / 2 == expected else (both - expected) / ((pa + pb) / 2 - expected)
    entropy = lambda v: -float(sum(x / n * math.log(x / n) for x in v if x > 0))
    ha, hb = entropy(a), entropy(b)
    mi = float(sum(m[i, j] / n * math.log(n * m[i, j] / (a[i] * b[j])) for i, j in np.argwhere(m > 0)))
    mean = (ha + hb) / 2
    if len(a) == len(b) == 1 or mean == 0:
        return {"ari": ari, "ami": 1.0, "nmi": 1.0}
    emi = expected_information(a, b, int(n))
    top = mean - emi
    return {"ari": ari, "ami": (mi - emi) / (top if abs(top) > 1e-15 else math.copysign(1e-15, top)), "nmi": mi / mean}


def expected_information(a: np.ndarray, b: np.ndarray, n: int) -> float:
    """Mutual information expected of random labels with these sizes."""
    g = math.lgamma
    total = 0.0
    for x in a.astype(int):
        for y in b.astype(int):
            k = np.arange(max(1, x + y - n), min(x, y) + 1)
            if not len(k):
                continue
            fixed = g(x + 1) + g(y + 1) + g(n - x + 1) + g(n - y + 1) - g(n + 1)
            logs = np.array([fixed - g(v + 1) - g(x - v + 1) - g(y - v + 1) - g(n - x - y + v + 1) for v in k])
            total += float((k / n * np.log(n * k / (x * y)) * np.exp(logs)).sum())
    return total


def best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of rows and columns with the greatest total, by shortest augmenting paths."""
    r, c = gain.shape
    n = max(r, c)
    cost = np.zeros((n + 1, n + 1))
    cost[1 : r + 1, 1 : c + 1] = -gain
    u, v, owner, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        owner[0], j = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j] = True
            reduced = cost[owner[j]] - u[owner[j]] - v
            better = ~used & (reduced < least)
            better[0] = False
            least[better], way[better] = reduced[better], j
            free = np.where(used, np.inf, least)
            free[0] = np.inf
            nxt = int(np.argmin(free))
            step = free[nxt]
            u[owner[used]] += step
            v[used] -= step
            least[~used] -= step
            j = nxt
            if owner[j] == 0:
                break
        while j:
            owner[j] = owner[way[j]]
            j = way[j]
    return sorted((int(owner[j]) - 1, j - 1) for j in range(1, n + 1) if owner[j] <= r and j <= c)


def hungarian(a: DataFrame, b: DataFrame, key: str = "key", label: str = "label") -> dict[str, object]:
    """The assignment of a's labels to b's with the most keys in common, noise left out."""
    pairs = contingency(a.where(F.col(label) != NOISE), b.where(F.col(label) != NOISE), key, label).collect()
    la, lb = sorted({r["a"] for r in pairs}), sorted({r["b"] for r in pairs})
    m = np.zeros((len(la), len(lb)))
    for r in pairs:
        m[la.index(r["a"]), lb.index(r["b"])] = r["n"]
    chosen = best_assignment(m) if m.size else []
    return {"mapping": {la[i]: lb[j] for i, j in chosen}, "overlap": float(sum(m[i, j] for i, j in chosen) / m.sum()) if m.size else math.nan}
