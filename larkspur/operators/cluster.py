"""Clustering algorithms behind one registry.

Each takes points (key, x) and gives (key, label) with optional memberships. K-means, fuzzy
c-means and Gaussian mixtures iterate over aggregations, so points stay distributed and only
a model of k rows comes to the driver. DBSCAN and single linkage join blocks of points (see
`blocks`) for any number of points, and so does Ward's linkage, whose clusters are a centre and
a size; complete and average linkage run in one task and refuse more points than their
documented limit.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel, cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import blocks
from .blocks import apart, matrix, pair_distances
from .blocks import squared as distances
from .tables import components, numbered, written

REGISTRY: dict[str, type[Algorithm]] = {}
#: Points that an algorithm over all pairs takes at most.
PAIRWISE_LIMIT = 20_000


@dataclass
class Clusters:
    """labels: (key, label[, membership]); info: what the fit says about itself."""

    labels: DataFrame
    info: dict[str, object] = field(default_factory=dict)


def register(name: str) -> Callable[[type[Algorithm]], type[Algorithm]]:
    def add(kind: type[Algorithm]) -> type[Algorithm]:
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        if not issubclass(kind, Algorithm):
            raise TypeError(f"{kind.__name__} is no Algorithm")
        REGISTRY[name] = kind
        return kind

    return add


def make(name: str, **params) -> Algorithm:
    if name not in REGISTRY:
        raise KeyError(f"no such algorithm: {name}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](**params)


class Algorithm(ABC):
    """What a plug-in has: parameters by keyword, fit, and whether it draws at random."""

    random = False
    defaults: dict[str, object] = {}

    def __init__(self, **params):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"{type(self).__name__} has no parameters {sorted(unknown)}")
        self.params = {**self.defaults, **params}

    @abstractmethod
    def fit(self, points: DataFrame) -> Clusters: ...


class Iterative(Algorithm):
    """An algorithm over sums and few rows of all points: `model` is a generator of requests
    (see `together`) that ends with what labels points and with what the fit says of itself."""

    soft = False

    @property
    def k(self) -> int:
        return self.params["n_clusters"]

    @abstractmethod
    def model(self, n: int) -> Model: ...

    def verify(self) -> None:
        """Raises ValueError for parameters that can't be."""

    def fit(self, points: DataFrame) -> Clusters:
        self.verify()
        n = checked(points, self.k)
        ((assign, info),) = driven(hashed(points), n, [lambda: self.model(n)])
        return Clusters(labelled(points, assign, self.soft), info)


# --- passes over all points that many models share -------------------------------------------


@dataclass
class Sum:
    """Asks for the sum over all points of the vector of `size` that step(x, h) makes of a batch:
    x its points, h the hashes of their keys."""

    size: int
    step: Callable[[np.ndarray, np.ndarray], np.ndarray]


@dataclass
class Rows:
    """Asks for points: those that pick(x, h) ranks (NaN: not asked for), of all points the
    `keep` lowest ranks, in their order, as seen(x, h) shows them."""

    keep: int
    pick: Callable[[np.ndarray, np.ndarray], np.ndarray]
    seen: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None


Request = Sum | Rows
Model = Generator[list[Request], list[np.ndarray], object]


def together(models: Sequence[Model]) -> Model:
    """One model that asks for what all of them ask for, a pass at a time; returns their results."""
    results: list[object] = [None] * len(models)
    asked: dict[int, list[Request]] = {}

    def on(i: int, answer: list[np.ndarray] | None) -> None:
        try:
            asked[i] = models[i].send(answer)
        except StopIteration as end:
            results[i] = end.value
            asked.pop(i, None)

    for i in range(len(models)):
        on(i, None)
    while asked:
        order = list(asked)
        got = yield [r for i in order for r in asked[i]]
        at = 0
        for i in order:
            n = len(asked[i])
            on(i, got[at : at + n])
            at += n
    return results


def lowest(ranks: np.ndarray, rows: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """The `keep` rows of lowest rank, in order; of equal ranks those of lower values."""
    low = np.lexsort((*rows.T[::-1], ranks))[:keep]
    return ranks[low], rows[low]


class Answers:
    """The answers to requests from the batches of points that it is given."""

    def __init__(self, requests: list[Request]):
        self.requests = requests
        self.found: list = [np.zeros(r.size) if isinstance(r, Sum) else None for r in requests]

    def add(self, x: np.ndarray, h: np.ndarray) -> None:
        for k, r in enumerate(self.requests):
            if isinstance(r, Sum):
                self.found[k] += r.step(x, h)
                continue
            rank = r.pick(x, h)
            of = np.flatnonzero(~np.isnan(rank))
            ranks, some = rank[of], (r.seen(x, h) if r.seen else x)[of]
            if self.found[k] is not None:
                ranks, some = np.concatenate((self.found[k][0], ranks)), np.concatenate((self.found[k][1], some))
            self.found[k] = lowest(ranks, some, r.keep)

    def values(self) -> list[np.ndarray]:
        return shown(self.found)


def shown(found: list) -> list[np.ndarray]:
    """Sums as they are, rows without their ranks."""
    return [f[1] if isinstance(f, tuple) else np.zeros((0, 0)) if f is None else f for f in found]


#: Bytes of points that a task reads in a pass, about, where there are many; and tasks whose
#: answers the driver merges by itself.
TASK_BYTES, DIRECT = 64_000_000, 64


def lots(points: DataFrame, n: int, width: int) -> RDD:
    """Points (x, h) as pairs of arrays of a block's rows, dealt out evenly: a pass reads arrays,
    and doesn't make them of rows again."""
    size = blocks.block_size(width)
    parts = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(n * (width + 1) * 8 / TASK_BYTES))
    made = pa.schema([("x", pa.binary()), ("h", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, size):
                some = b.slice(k, size)
                columns = [[matrix(some.column(0)).tobytes()], [hashes(some.column(1)).tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, made)], schema=made)

    packed = points.select("x", "h").repartition(min(parts, math.ceil(n / min(size, 1024)))).mapInArrow(pack, "x binary, h binary")
    return packed.rdd.map(lambda r: (np.frombuffer(r["x"]).reshape(-1, width), np.frombuffer(r["h"], np.uint64)))


def answered(points: RDD, requests: list[Request]) -> list[np.ndarray]:
    """The answers of one pass over `lots` of points. Each task gives its sums and the lowest
    rows; beyond DIRECT tasks Spark merges them first, to about the root of their number."""
    keeps = [None if isinstance(r, Sum) else r.keep for r in requests]

    def run(some: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[list]:
        found = Answers(requests)
        for x, h in some:
            found.add(x, h)
        yield found.found

    def merge(one: list, two: list) -> list:
        out = []
        for a, b, keep in zip(one, two, keeps):
            if keep is None:
                out.append(a + b)
            elif a is None or b is None:
                out.append(b if a is None else a)
            else:
                out.append(lowest(np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1])), keep))
        return out

    return shown(points.mapPartitions(run).treeReduce(merge, 1 if points.getNumPartitions() <= DIRECT else 2))


def driven(points: DataFrame, n: int, makers: Sequence[Callable[[], Model]]) -> list:
    """The results of the models that makers make, which advance together: an iteration of all
    is one pass over points (key, x, h). Points that fit one block are held by one task, where
    the same models ask for the same sums without a job for each."""
    width = points.select(F.size("x")).first()[0]
    if n <= blocks.block_size(width):
        return _in_one_block(points, makers)
    held = lots(points, n, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        joint = together([make() for make in makers])
        answer = None
        while True:
            try:
                answer = answered(held, joint.send(answer))
            except StopIteration as end:
                return end.value
    finally:
        held.unpersist()


def _in_one_block(points: DataFrame, makers: Sequence[Callable[[], Model]]) -> list:
    def run(table: pa.Table) -> pa.Table:
        x, h = matrix(table.column("x")), hashes(table.column("h"))
        order = np.lexsort((*x.T, h))  # sums don't depend on how rows were dealt out
        x, h = x[order], h[order]
        joint = together([make() for make in makers])
        answer = None
        while True:
            try:
                found = Answers(joint.send(answer))
            except StopIteration as end:
                return pa.table({"found": pa.array([cloudpickle.dumps(end.value)], pa.binary())})
            found.add(x, h)
            answer = found.values()

    whole = points.select("x", "h", F.lit(0).alias("_all")).groupBy("_all")
    return cloudpickle.loads(bytes(whole.applyInArrow(lambda table: run(table), "found binary").first()[0]))


def hashes(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def hashed(points: DataFrame) -> DataFrame:
    return points.select("key", F.col("x").cast("array<double>").alias("x"), F.xxhash64("key").alias("h"))


def drawn(h: np.ndarray, *seeds: int) -> np.ndarray:
    """Numbers in (0, 1) that the hash of a key and the seeds decide: the same in any task."""
    x = h.copy()
    for s in seeds:
        x = (x ^ np.uint64(s % 2**63)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(float) + 0.5) / 2**53


#: Rounds of oversampling, and candidates that one draws in the mean, a cluster.
ROUNDS, OVERSAMPLED = 4, 2


def oversampled(k: int, seed: int) -> Model:
    """k first centres by oversampling: rounds over all points draw each in proportion to its
    squared distance from the candidates so far; the candidates, weighed by the points next to
    them, are clustered here. There are about 1 + 8 k of them for any number of points."""
    (candidates,) = yield [Rows(1, lambda x, h: drawn(h, seed, 0))]
    for r in range(1, ROUNDS + 1):
        ((cost,),) = yield [Sum(1, lambda x, h, c=candidates: np.array([distances(x, c).min(1).sum()]))]
        if cost <= 0:
            break

        def pick(x: np.ndarray, h: np.ndarray, c: np.ndarray = candidates, r: int = r, cost: float = cost) -> np.ndarray:
            u = drawn(h, seed, r)
            return np.where(u * cost < OVERSAMPLED * k * distances(x, c).min(1), u, np.nan)

        (more,) = yield [Rows(8 * OVERSAMPLED * k + 64, pick)]  # eight times the mean and more: never reached but by chance of the draw
        if len(more):
            candidates = np.concatenate((candidates, more))
    (weight,) = yield [Sum(len(candidates), lambda x, h: np.bincount(distances(x, candidates).argmin(1), minlength=len(candidates)).astype(float))]
    rng = np.random.default_rng([seed % 2**63, k])
    c = plus_plus(candidates, k, rng, weight)
    for _ in range(100):
        at = distances(candidates, c).argmin(1)
        moved = c.copy()
        for j in range(k):
            if weight[at == j].sum() > 0:
                moved[j] = np.average(candidates[at == j], axis=0, weights=weight[at == j])
        if np.allclose(moved, c, rtol=0, atol=1e-12):
            break
        c = moved
    return c


def lloyd(k: int, seed: int, init: str, tol: float, max_iter: int) -> Model:
    """(wcss, centres, iterations) from one start."""
    if init == "random":
        (c,) = yield [Rows(k, lambda x, h: drawn(h, seed, 0))]
    else:
        c = yield from oversampled(k, seed)
    d = c.shape[1]
    wcss, iteration = math.inf, 0
    for iteration in range(1, max_iter + 1):
        def step(x: np.ndarray, h: np.ndarray, c: np.ndarray = c) -> np.ndarray:
            d2 = distances(x, c)
            hot = np.eye(k)[d2.argmin(1)]
            return np.concatenate(((hot.T @ x).ravel(), hot.sum(0), [d2.min(1).sum()]))

        (got,) = yield [Sum(k * d + k + 1, step)]
        n = got[k * d : -1, None]
        moved = np.where(n > 0, got[: k * d].reshape(k, d) / np.maximum(n, 1), c)
        wcss, shift, c = float(got[-1]), float(((moved - c) ** 2).sum()), moved
        if shift <= tol:
            break
    return wcss, c, iteration


def spread(width: int) -> Model:
    """The mean variance of the columns."""
    (got,) = yield [Sum(2 * width + 1, lambda x, h: np.concatenate((x.sum(0), (x**2).sum(0), [len(x)])))]
    mean = got[:width] / got[-1]
    return float(np.maximum(got[width:-1] / got[-1] - mean**2, 0).mean())


def seeds_of(seed: int | None, n: int) -> list[int]:
    return [(seed or 0) * 1_000_003 + s for s in range(n)]


def best_lloyd(k: int, p: dict, n_init: int) -> Model:
    (first,) = yield [Rows(1, lambda x, h: drawn(h, 0))]
    tol = p["tol"] * (yield from spread(first.shape[1]))
    tried = yield from together([lloyd(k, s, p["init"], tol, p["max_iter"]) for s in seeds_of(p["random_state"], n_init)])
    return min(tried, key=lambda r: r[0])


def plus_plus(x: np.ndarray, k: int, rng: np.random.Generator, weight: np.ndarray) -> np.ndarray:
    """k rows of x, each drawn in proportion to its weight and squared distance from those before."""
    chosen = [x[rng.choice(len(x), p=weight / weight.sum())]]
    d = ((x - chosen[0]) ** 2).sum(1)
    for _ in range(1, k):
        total = (d * weight).sum()
        chosen.append(x[rng.choice(len(x), p=d * weight / total) if total > 0 else rng.integers(len(x))])
        d = np.minimum(d, ((x - chosen[-1]) ** 2).sum(1))
    return np.array(chosen)


def labelled(points: DataFrame, step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray | None]], soft: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label, member = step(matrix(b.column(1)))
                columns = {"key": b.column(0), "label": pa.array(label.astype(np.int32))}
                if soft:
                    columns["membership"] = pa.array(list(member), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_pydict(columns)

    key = dict(points.dtypes)["key"]
    return points.select("key", "x").mapInArrow(run, f"key {key}, label int" + ", membership array<double>" * soft)


def checked(points: DataFrame, k: int) -> int:
    n = points.count()
    if not 1 <= k <= n:
        raise ValueError(f"{k} clusters of {n} points")
    return n


@register("kmeans")
class KMeans(Iterative):
    """Lloyd's algorithm over all points, from oversampled k-means++ or random starts; the start
    with the least WCSS stays. All starts advance in the same passes."""

    random = True
    defaults = {"n_clusters": 4, "init": "k-means++", "n_init": 10, "max_iter": 300, "tol": 1e-4, "random_state": 42}

    def model(self, n: int) -> Model:
        wcss, c, n_iter = yield from best_lloyd(self.k, self.params, self.params["n_init"])
        return (lambda x: (distances(x, c).argmin(1), None)), {"wcss": wcss, "centers": c.tolist(), "n_iter": n_iter}


@register("fuzzy_cmeans")
class FuzzyCMeans(Iterative):
    """Bezdek's fuzzy c-means; a label is the greatest membership. First memberships are drawn
    by the hash of each row's key, so they are the same however rows are dealt out."""

    random = soft = True
    defaults = {"n_clusters": 4, "m": 2.0, "max_iter": 150, "error": 1e-5, "random_state": 42}

    def verify(self) -> None:
        if self.params["m"] <= 1:
            raise ValueError("m must be above 1")

    @staticmethod
    def memberships(x: np.ndarray, c: np.ndarray, m: float) -> np.ndarray:
        """Rows add to 1; a point on a centre belongs to it alone, or to all such in equal parts."""
        d2 = distances(x, c)
        zero = d2 <= 1e-18
        with np.errstate(divide="ignore", invalid="ignore"):
            u = d2 ** (-1.0 / (m - 1))
            u /= u.sum(1, keepdims=True)
        on = zero.any(1)
        u[on] = zero[on] / zero[on].sum(1, keepdims=True)
        return u

    def model(self, n: int) -> Model:
        p = self.params
        k, m = self.k, p["m"]
        (first,) = yield [Rows(1, lambda x, h: drawn(h, 0))]
        d = first.shape[1]

        def begin(x: np.ndarray, h: np.ndarray) -> np.ndarray:
            u = -np.log(np.column_stack([drawn(h, p["random_state"] or 0, j + 1) for j in range(k)]))
            w = (u / u.sum(1, keepdims=True)) ** m
            return np.concatenate(((w.T @ x).ravel(), w.sum(0)))

        (got,) = yield [Sum(k * d + k, begin)]
        c = got[: k * d].reshape(k, d) / got[k * d :, None]
        converged, objective, iteration = False, math.nan, 0
        for iteration in range(1, p["max_iter"] + 1):
            def step(x: np.ndarray, h: np.ndarray, c: np.ndarray = c) -> np.ndarray:
                w = self.memberships(x, c, m) ** m
                return np.concatenate(((w.T @ x).ravel(), w.sum(0), [(w * distances(x, c)).sum()]))

            (got,) = yield [Sum(k * d + k + 1, step)]
            moved = got[: k * d].reshape(k, d) / np.maximum(got[k * d : k * d + k], 1e-300)[:, None]
            shift, c, objective = float(np.abs(moved - c).max()), moved, float(got[-1])
            if shift < p["error"]:
                converged = True
                break

        def last(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            u = self.memberships(x, c, m)
            return u.argmax(1), u

        return last, {"centers": c.tolist(), "objective": objective, "n_iter": iteration, "converged": converged}


@register("gmm")
class GaussianMixture(Iterative):
    """Gaussian mixtures by EM with full, tied, diag or spherical covariance, from the best of
    n_init clusterings of all points."""

    random = soft = True
    defaults = {"n_components": 4, "covariance_type": "full", "max_iter": 100, "tol": 1e-3, "reg_covar": 1e-6, "n_init": 1, "random_state": 42}

    def verify(self) -> None:
        if self.params["covariance_type"] not in ("full", "tied", "diag", "spherical"):
            raise ValueError(f"no such covariance: {self.params['covariance_type']}")

    @staticmethod
    def logs(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
        """log(weight * density) of each point and component; covs are full matrices or their
        diagonals alone."""
        out = np.empty((len(x), len(weights)))
        for j, (w, mu, s) in enumerate(zip(weights, means, covs)):
            if s.ndim == 1:
                z = (x - mu) / np.sqrt(s)
                out[:, j] = np.log(max(w, 1e-300)) - 0.5 * (z**2).sum(1) - 0.5 * np.log(s).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
                continue
            low = np.linalg.cholesky(s)
            z = np.linalg.solve(low, (x - mu).T)
            out[:, j] = np.log(max(w, 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    @property
    def diagonal(self) -> bool:
        return self.params["covariance_type"] in ("diag", "spherical")

    def _covs(self, raw: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Regular covariances of raw ones: k matrices, or k diagonals where no more counts."""
        kind, reg = self.params["covariance_type"], self.params["reg_covar"]
        k, d = raw.shape[:2]
        if kind == "tied":
            raw = np.repeat(((raw * n[:, None, None]).sum(0) / n.sum())[None], k, 0)
        elif kind == "spherical":
            raw = np.repeat(raw.mean(1, keepdims=True), d, 1)
        elif kind not in ("full", "diag"):
            raise ValueError(f"no such covariance: {kind}")
        return raw + (reg if self.diagonal else np.eye(d) * reg)

    def n_parameters(self, k: int, d: int) -> int:
        cov = {"full": k * d * (d + 1) // 2, "tied": d * (d + 1) // 2, "diag": k * d, "spherical": k}
        return cov[self.params["covariance_type"]] + k * d + k - 1

    @property
    def k(self) -> int:
        return self.params["n_components"]

    def model(self, n_points: int) -> Model:
        p, k = self.params, self.k
        _, centers, _ = yield from best_lloyd(k, {**KMeans.defaults, "random_state": p["random_state"]}, max(1, p["n_init"]))
        d = centers.shape[1]
        shape = (k, d) if self.diagonal else (k, d, d)
        size = k + k * d + math.prod(shape) + 1

        def moments(r: np.ndarray, x: np.ndarray, about: np.ndarray, score: float) -> np.ndarray:
            shift = np.empty(shape)
            for j in range(k):
                gap = x - about[j]
                shift[j] = r[:, j] @ gap**2 if self.diagonal else (gap * r[:, j, None]).T @ gap
            return np.concatenate((r.sum(0), (r.T @ x).ravel(), shift.ravel(), [score]))

        def updated(got: np.ndarray, about: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            n = got[:k] + 1e-10
            moved = got[k : k + k * d].reshape(k, d) / n[:, None]
            gap = moved - about
            raw = got[k + k * d : -1].reshape(shape) / n.reshape(-1, *[1] * (len(shape) - 1))
            return n / n.sum(), moved, self._covs(raw - (gap**2 if self.diagonal else gap[:, :, None] * gap[:, None, :]), n)

        (got,) = yield [Sum(size, lambda x, h: moments(np.eye(k)[distances(x, centers).argmin(1)], x, centers, 0.0))]
        weights, means, covs = updated(got, centers)
        before, converged, iteration, score = -math.inf, False, 0, -math.inf
        for iteration in range(1, p["max_iter"] + 1):
            def step(x: np.ndarray, h: np.ndarray, w: np.ndarray = weights, mu: np.ndarray = means, s: np.ndarray = covs) -> np.ndarray:
                logs = self.logs(x, w, mu, s)
                top = logs.max(1, keepdims=True)
                norm = top[:, 0] + np.log(np.exp(logs - top).sum(1))
                return moments(np.exp(logs - norm[:, None]), x, mu, norm.sum())

            (got,) = yield [Sum(size, step)]
            score = float(got[-1]) / n_points
            weights, means, covs = updated(got, means)
            if abs(score - before) < p["tol"]:
                converged = True
                break
            before = score
        free = self.n_parameters(k, d)

        def last(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            logs = self.logs(x, weights, means, covs)
            r = np.exp(logs - logs.max(1, keepdims=True))
            r /= r.sum(1, keepdims=True)
            return r.argmax(1), r

        info = {"weights": weights.tolist(), "means": means.tolist(), "n_iter": iteration, "converged": converged, "log_likelihood": score}
        info |= {"aic": -2 * score * n_points + 2 * free, "bic": -2 * score * n_points + free * math.log(n_points)}
        return last, info


def fit_many(points: DataFrame, algorithms: Sequence[Iterative], shifts: Sequence[Callable[[np.ndarray, np.ndarray], np.ndarray] | None] | None = None) -> tuple[DataFrame, list[dict]]:
    """((key, labels, x, h): an array with the label by each algorithm, what each says of itself).

    All models read the points in the same passes, so a sweep takes about as many jobs as its
    slowest model, whatever number of models it has. shifts: for a model with noise, what
    makes of (x, h) the points that it sees."""
    for a in algorithms:
        a.verify()
    n = checked(points, max(a.k for a in algorithms))
    shifts = shifts or [None] * len(algorithms)
    makers = [lambda a=a, s=s: shifted(a.model(n), s) if s else a.model(n) for a, s in zip(algorithms, shifts)]
    found = driven(hashed(points), n, makers)
    rules = [(assign, s) for (assign, _), s in zip(found, shifts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, h = matrix(b.column(1)), hashes(b.column(2))
                labels = np.column_stack([assign(s(x, h) if s else x)[0] for assign, s in rules]).astype(np.int32)
                yield pa.RecordBatch.from_pydict({"key": b.column(0), "labels": pa.array(list(labels), pa.list_(pa.int32())), "x": b.column(1), "h": b.column(2)})

    key = dict(points.dtypes)["key"]
    return hashed(points).mapInArrow(run, f"key {key}, labels array<int>, x array<double>, h long"), [info for _, info in found]


def shifted(model: Model, shift: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Model:
    """The same model over points that shift(x, h) moves."""
    answer = None
    while True:
        try:
            asked = model.send(answer)
        except StopIteration as end:
            return end.value
        moved: list[Request] = []
        for r in asked:
            if isinstance(r, Sum):
                moved.append(Sum(r.size, lambda x, h, f=r.step: f(shift(x, h), h)))
            else:
                moved.append(Rows(r.keep, lambda x, h, f=r.pick: f(shift(x, h), h), shift))
        answer = yield moved


def noise(points: DataFrame, sigma: float, seed: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray] | None:
    """x + sigma * N(0, 1) * population deviation of each column; a row's noise follows from its
    key and the seed. None without noise."""
    if sigma == 0:
        return None
    rows = points.select(F.posexplode(F.col("x").cast("array<double>")).alias("i", "v")).groupBy("i").agg(F.stddev_pop("v").alias("d")).collect()  # a row a column
    scale = sigma * np.array([r["d"] for r in sorted(rows)], float)

    def shift(x: np.ndarray, h: np.ndarray) -> np.ndarray:
        z = [np.sqrt(-2 * np.log(drawn(h, seed, 2 * j))) * np.cos(2 * np.pi * drawn(h, seed, 2 * j + 1)) for j in range(x.shape[1])]
        return x + scale * np.column_stack(z)

    return shift


@register("dbscan")
class Dbscan(Algorithm):
    """Density clusters in order of the least key of a core point; -1 is noise.

    Neighbours are counted by a join of blocks within eps; links between core points are
    contracted to components; another point within eps of core points belongs to the first
    cluster that has one. Any number of points: no task has more than a pair of blocks."""

    defaults = {"eps": 0.5, "min_samples": 5, "metric": "euclidean"}

    def fit(self, points: DataFrame) -> Clusters:
        p = self.params
        held = blocks.numbered_points(points.select("key", "x"))
        found = held.rows.select("id", "key")
        if not held.n:
            return Clusters(found.select("key", F.lit(-1).alias("label")), {"n_points": 0, "n_core": 0, "n_clusters": 0, "n_noise": 0})
        if held.n <= held.per_block:  # one block: one group's work, by the same rule
            labels = written(blocks.one_block(held, p["eps"], p["min_samples"], p["metric"]), "labels")
            k, noise_, n_core = labels.agg(F.max("label") + 1, F.count_if(F.col("label") == -1), F.count_if("core")).first()
            return Clusters(labels.select("key", "label"), {"n_points": held.n, "n_core": n_core, "n_clusters": k, "n_noise": noise_})
        grid = blocks.visits(held, p["eps"], p["metric"])
        rows = written(grid.rows, "grid")
        near = blocks.neighbour_counts(rows, p["eps"], p["metric"]).unionByName(grid.sure.select("id", "n")).groupBy("id").agg(F.sum("n").alias("n"))
        counts = written(near.select("id", (F.col("n") >= p["min_samples"]).alias("core")), "cores")
        links = written(blocks.core_links(rows.join(counts, "id"), p["eps"], p["metric"]), "links")
        whole = written(blocks.cell_links(grid, counts), "cell-links")
        joined = components(links.where("NOT border").select("a", "b").unionByName(whole))
        core = counts.where("core").join(found, "id").join(joined.withColumnRenamed("node", "id"), "id", "left")
        core = written(core.select("id", "key", F.coalesce("label", "id").alias("group")), "core-groups")
        groups = numbered(core.groupBy("group").agg(F.min("key").alias("least")), [F.asc("least"), F.asc("group")], "label")
        core = core.join(groups.select("group", F.col("label").cast("int").alias("label")), "group").select("id", "label")
        border = links.where("border").join(core.withColumnRenamed("id", "b"), "b").select(F.col("a").alias("id"), "label")
        first = F.broadcast(grid.homes.join(core, "id").groupBy("cell").agg(F.min("label").alias("label")))  # a row a pivot
        inside = grid.sure.join(counts.where("NOT core"), "id").select("id", F.explode("cells").alias("cell")).join(first, "cell")
        border = border.unionByName(inside.select("id", "label")).groupBy("id").agg(F.min("label").alias("label"))
        labels = written(found.join(core.unionByName(border), "id", "left").select("key", F.coalesce("label", F.lit(-1)).alias("label")), "labels")
        n_core = counts.where("core").count()
        k, noise = labels.agg(F.max("label") + 1, F.count_if(F.col("label") == -1)).first()
        return Clusters(labels, {"n_points": held.n, "n_core": n_core, "n_clusters": k, "n_noise": noise})


@register("agglomerative")
class Agglomerative(Algorithm):
    """Ward, complete, average or single linkage.

    Single linkage is the least spanning tree without its longest links, grown in rounds of
    least outgoing links (see `spanning_links`); Ward's merges all pairs of clusters that are
    nearest to each other in a round (see `ward_tree`): both for any number of points. Complete
    and average linkage run chains of nearest neighbours over all pairs in one task and refuse
    more than PAIRWISE_LIMIT points. info has the distances at which clusters merge."""

    defaults = {"n_clusters": 4, "linkage": "ward", "metric": "euclidean"}

    def fit(self, points: DataFrame) -> Clusters:
        found = self.cuts(points, [self.params["n_clusters"]])
        return Clusters(found.labels.select("key", F.col("labels")[0].alias("label")), found.info)

    def cuts(self, points: DataFrame, ks: Sequence[int]) -> Clusters:
        """Clusters of the same merges for each number of ks: labels are (key, labels), an array
        with one for each."""
        p = self.params
        if p["linkage"] == "ward" and p["metric"] not in ("euclidean", "l2"):
            raise ValueError("ward needs euclidean distances")
        if p["linkage"] not in ("ward", "complete", "average", "single"):
            raise ValueError(f"no such linkage: {p['linkage']}")
        n = points.count()
        if max(ks) >= max(2, n):
            raise ValueError(f"{max(ks)} clusters are as many as the points or more")
        width = points.select(F.size("x")).first()[0]
        if p["linkage"] in ("single", "ward") and n > blocks.block_size(width):
            held = blocks.numbered_points(points.select("key", "x"))
            return self._cut(held, ward_tree(held) if p["linkage"] == "ward" else spanning_links(held, p["metric"]), ks)
        if n > PAIRWISE_LIMIT:
            raise ValueError(f"{p['linkage']} linkage compares all pairs and takes at most {PAIRWISE_LIMIT} points; these are {n}")

        def run(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("key", ignore_index=True)
            steps = merges(np.array(f["x"].tolist(), float), p["linkage"], p["metric"])
            heights = np.append(np.sort([s[0] for s in steps]), np.nan)
            labels = np.column_stack([cut(steps, len(f), k) for k in ks]).astype(np.int32)
            return pd.DataFrame({"key": f["key"], "labels": list(labels), "height": heights})

        key = dict(points.dtypes)["key"]
        whole = points.select("key", "x", F.lit(0).alias("_all")).groupBy("_all")
        rows = written(whole.applyInPandas(lambda f: run(f), f"key {key}, labels array<int>, height double"), "merged")
        return Clusters(rows.select("key", "labels"), {"n_points": n, **merge_summary(rows.where(~F.isnan("height")).select(F.col("height").alias("d")))})

    def _cut(self, held: blocks.Points, tree: DataFrame, ks: Sequence[int]) -> Clusters:
        """Clusters by the merges (a, b, d, step) of all points without the k - 1 longest: the
        groups of the greatest k, which longer merges join to fewer."""
        longest = written(tree.orderBy(F.desc("d"), F.desc("step"), F.desc("a"), F.desc("b")).limit(max(ks) - 1), "longest")  # a row a cluster
        joined = components(tree.join(F.broadcast(longest), ["a", "b", "d", "step"], "left_anti").select("a", "b"))
        rows = held.rows.select("id", "key").join(joined.withColumnRenamed("node", "id"), "id", "left")
        rows = written(rows.select("id", "key", F.coalesce("label", "id").alias("group")), "groups")
        first = [r["group"] for r in rows.groupBy("group").agg(F.min("key").alias("least")).orderBy("least", "group").collect()]
        ends = F.broadcast(longest.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        place = {g: i for i, g in enumerate(first)}
        of = {r["id"]: place[r["group"]] for r in rows.join(ends, "id").select("id", "group").collect()}
        links = sorted(longest.collect(), key=lambda r: (r["d"], r["step"], r["a"], r["b"]), reverse=True)
        labels = []
        for k in ks:
            forest = blocks.Forest(len(first))
            for r in links[k - 1 :]:
                forest.join(of[r["a"]], of[r["b"]])
            labels.append(np.unique([forest.root(i) for i in range(len(first))], return_inverse=True)[1])
        number = held.rows.sparkSession.createDataFrame([(g, [int(v[i]) for v in labels]) for i, g in enumerate(first)], "group long, labels array<int>")
        return Clusters(rows.join(number, "group").select("key", "labels"), {"n_points": held.n, **merge_summary(tree)})


#: Nearest clusters that each cluster remembers, at most; clusters that are few.
REMEMBERED, FEW = 16, 512


def ward_tree(held: blocks.Points) -> DataFrame:
    """(a, b, d, step) of all merges by Ward's rule; a and b are points of the two clusters.

    A cluster is its centre and its size, and no merge brings a cluster nearer to others than
    its nearer part was. So all pairs that are nearest to each other may merge at once. A cluster
    remembers others near it and what all else is apart at least: distances to a merged pair
    follow from those to its parts, or have a bound that does; only clusters that were made, and
    those that don't know their nearest one any more, look again. Equal points merge first;
    clusters that fit a few blocks are merged by one task. Only numbers of rows come to the
    driver."""
    same = written(held.rows.groupBy("x").agg(F.min("id").alias("first"), F.count(F.lit(1)).cast("double").alias("n")), "distinct")
    copies = held.rows.select("id", "x").join(same.select("x", "first"), "x").where("id <> first")
    tree = written(copies.select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("d"), F.lit(0).cast("long").alias("step")), "copies")
    clusters, near, step = same.select(F.col("first").alias("id"), "n", "x"), None, 0
    count = clusters.count()
    while count > blocks.wide_block(held.width):
        step += 1
        asking = clusters if near is None else written(clusters.join(near.select("id").distinct(), "id", "left_anti"), "asking")
        m = count if near is None else asking.count()
        if m:
            found = blocks.ward_near(asking, clusters, m, count, held.width, REMEMBERED)
            found = written(found.select("id", "n", "low", F.explode("near").alias("e")).where("e.d <= low").select("id", "n", "low", "e.*"), "found")
            near = found if near is None else near.unionByName(found)
        best = near.groupBy("id").agg(F.min(F.struct("d", "o", "to", "n", "m")).alias("e")).select("id", "e.*")
        pairs = best.join(best.select(F.col("to").alias("id"), F.col("id").alias("to")), ["id", "to"]).where("id < to")
        pairs = written(pairs.select(F.col("id").alias("a"), F.col("to").alias("b"), "d", F.col("n").alias("na"), F.col("m").alias("nb")), "pairs")
        n_pairs = pairs.count()
        if not n_pairs:  # ties that rounding has broken in a circle
            one = F.col("id") < F.col("to")
            least = best.orderBy("d", "o", "id").limit(1).select(F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"), "d", F.when(one, F.col("n")).otherwise(F.col("m")).alias("na"), F.when(one, F.col("m")).otherwise(F.col("n")).alias("nb"))
            pairs, n_pairs = written(least, "pairs"), 1
        tree = tree.unionByName(pairs.select("a", "b", F.sqrt("d").alias("d"), F.lit(step).cast("long").alias("step")))
        one, two = (clusters.select(F.col("id").alias(s), F.col("x").alias(f"x{s}")) for s in "ab")
        centre = F.zip_with("xa", "xb", lambda u, v: (u * F.col("na") + v * F.col("nb")) / (F.col("na") + F.col("nb")))
        made = pairs.join(one, "a").join(two, "b").select(F.col("a").alias("id"), (F.col("na") + F.col("nb")).alias("n"), centre.alias("x"))
        gone = pairs.select(F.explode(F.array("a", "b")).alias("id"))
        clusters = written(clusters.join(gone, "id", "left_anti").unionByName(made), "clusters")
        near = written(remembered(near.join(gone, "id", "left_anti"), pairs), "near")
        count -= n_pairs
    if count > 1:
        def rest(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            steps = ward_rounds(table.column("id").to_numpy(), matrix(table.column("x")).copy(), table.column("n").to_numpy().copy(), step)
            return pa.table(dict(zip("abd", steps)) | {"step": steps[3]})

        whole = clusters.withColumn("_all", F.lit(0)).groupBy("_all")
        tree = tree.unionByName(whole.applyInArrow(lambda table: rest(table), "a long, b long, d double, step long"))
    return written(tree, "tree")


def remembered(near: DataFrame, pairs: DataFrame) -> DataFrame:
    """What clusters still know of others (id, n, low, d, o, to, m) when pairs (a, b, d, na, nb)
    have merged to a, by Lance and Williams' formula: the distance to a merged pair from those to
    both parts; from one part and what the other is apart at least, a new such bound."""
    ends = lambda this, other: pairs.select(F.col(this).alias("to"), F.col("a").alias("_new"), F.col(f"n{this}").alias("_part"), F.col(f"n{other}").alias("_rest"), F.col("d").alias("_apart"))
    rows = near.join(ends("a", "b").unionByName(ends("b", "a")), "to", "left").repartition("id")
    target = F.coalesce("_new", "to").alias("to")
    n, d, whole = F.col("n"), F.col("d"), F.col("_part") + F.col("_rest")
    some = rows.groupBy("id", target).agg(
        F.first("n").alias("n"), F.first("low").alias("low"), F.count(F.lit(1)).alias("parts"), F.first("_apart").alias("_apart"), F.first("d").alias("d"), F.first("_rest").alias("_rest"),
        F.first(F.coalesce(whole, F.col("m"))).alias("m"), F.sum((F.col("_part") + n) * d).alias("_sum"),
    )
    known = F.col("_apart").isNull() | (F.col("parts") == 2)
    merged = (F.col("_sum") + F.when(F.col("parts") == 2, 0.0).otherwise((F.col("_rest") + n) * F.col("low")) - n * F.col("_apart")) / (n + F.col("m"))
    some = some.select("id", "to", "n", "low", "m", known.alias("known"), F.when(F.col("_apart").isNull(), d).otherwise(merged).alias("d"))
    bound = F.least("low", F.min(F.when(~F.col("known"), F.col("d"))).over(W.partitionBy("id")))
    order = F.xxhash64(F.least("id", "to"), F.greatest("id", "to"))
    return some.withColumn("low", bound).where("known AND d <= low").select("id", "n", "low", "d", order.alias("o"), "to", "m")


def ward_rounds(ids: np.ndarray, x: np.ndarray, n: np.ndarray, step: int) -> list[np.ndarray]:
    """The arrays a, b, d and step of the merges of one task's clusters (id, centre, size): in
    rounds as in `ward_tree`, then, of few, over all of their distances."""
    out: list[tuple] = []
    near, far, low = np.full((len(ids), 8), -1), np.full((len(ids), 8), np.inf), np.full(len(ids), -np.inf)
    while len(ids) > min(FEW, blocks.block_size(x.shape[1])):
        step += 1
        d = far.min(1)
        ask = np.flatnonzero(np.isinf(d))
        if len(ask):
            near[ask], far[ask], low[ask] = blocks.ward_closest(x[ask], n[ask], ids[ask], x, n, ids, 8)
            far[far > low[:, None]] = np.inf
            d = far.min(1)
        i = np.arange(len(ids))
        to = near[i, far.argmin(1)]
        tied = np.flatnonzero((far == d[:, None]).sum(1) > 1)
        if len(tied):  # in an order that is the same from either side
            a, b = np.minimum(ids[tied, None], ids[near[tied]]), np.maximum(ids[tied, None], ids[near[tied]])
            order = drawn(a.ravel().view(np.uint64), 1) + drawn(b.ravel().view(np.uint64), 2)
            to[tied] = near[tied, np.where(far[tied] == d[tied, None], order.reshape(a.shape), np.inf).argmin(1)]
        a = np.flatnonzero((to[to] == i) & (i < to))
        if not len(a):  # ties that rounding has broken in a circle
            a = np.array([np.argmin(d)])
        a, b, h = np.minimum(a, to[a]), np.maximum(a, to[a]), d[a]
        out.append((ids[a], ids[b], np.sqrt(h), np.full(len(a), step)))
        other, apart = np.full(len(ids), -1), np.zeros(len(ids))
        other[a], other[b], apart[a], apart[b] = b, a, h, h
        far[other >= 0] = np.inf
        row, at = np.nonzero(np.isfinite(far) & (other[near] >= 0))
        one, two = near[row, at], other[near[row, at]]
        there = (near[row] == two[:, None]) & np.isfinite(far[row])
        both = there.any(1)
        rest = np.where(both, far[row, there.argmax(1)], low[row])
        merged = ((n[one] + n[row]) * far[row, at] + (n[two] + n[row]) * rest - n[row] * apart[one]) / (n[row] + n[one] + n[two])
        far[row, at] = np.where(both & (one < two), merged, np.inf)
        np.minimum.at(low, row[~both], merged[~both])
        far[far > low[:, None]] = np.inf
        x[a] = (x[a] * n[a, None] + x[b] * n[b, None]) / (n[a] + n[b])[:, None]
        n[a] += n[b]
        keep = np.ones(len(ids), bool)
        keep[b] = False
        ids, x, n, near, far, low = ids[keep], x[keep], n[keep], (np.cumsum(keep) - 1)[near[keep]], far[keep], low[keep]
    steps = merges(x, "ward", "euclidean", n)
    if steps:
        h, a, b = (np.array(v) for v in zip(*steps))
        out.append((ids[a], ids[b], h, np.arange(len(h)) + step + 1))
    return [np.concatenate(v) for v in zip(*out)]


#: Nearest points that each point looks for at once.
LOOKED_FOR = 8


def spanning_links(held: blocks.Points, metric: str) -> DataFrame:
    """(a, b, d, step) of the least spanning tree of all points, in rounds: every component but
    the largest takes its least link to another.

    A point keeps the nearest points that it has found. Those of its own component fall away,
    and it looks again, among other components, only when the rest may not have the component's
    least link: all that it has not found are farther than what it found last."""
    def far(some: dict, at: slice, points: dict) -> np.ndarray:
        d = pair_distances(some["x"][at], points["x"], metric)
        d[some["c"][at][:, None] == points["c"][None]] = np.inf
        return d

    def exact(some: dict, i: np.ndarray, points: dict, j: np.ndarray) -> np.ndarray:
        return apart(some["x"][i], points["x"][j], metric)

    where_ = written(held.rows.select("id", "x", F.col("id").alias("c")), "components")
    bound = where_.select("id", F.lit(-1.0).alias("bound"))  # what is not found yet is at least this far
    found, taken, step = None, None, 0
    while True:
        sizes = written(where_.groupBy("c").agg(F.count(F.lit(1)).alias("n")), "sizes")
        if sizes.limit(2).count() < 2:
            break
        step += 1
        largest = sizes.orderBy(F.desc("n"), F.asc("c")).first()["c"]
        here = where_.where(F.col("c") != largest)
        asking = here
        if found is not None:
            best = found.groupBy("c").agg(F.min("d").alias("best"))
            asking = here.join(bound, "id").join(best, "c", "left").where("best IS NULL OR bound < best").select("id", "x", "c")
        asking = written(asking, "asking")
        m = asking.count()
        if m:
            more = written(blocks.nearest(asking, where_, m, held.n, held.width, "c", LOOKED_FOR, far, exact), "near")
            last = F.when(F.size("near") < LOOKED_FOR, F.lit(float("inf"))).otherwise(F.element_at("near", -1)["d"])
            bound = written(bound.join(more.select("id", last.alias("_last")), "id", "left").select("id", F.coalesce("_last", "bound").alias("bound")), "bound")
            new = more.select("id", F.explode("near").alias("e")).select("id", F.col("e.to").alias("to"), F.col("e.d").alias("d")).join(asking.select("id", "c"), "id")
            found = new if found is None else found.join(asking.select("id"), "id", "left_anti").unionByName(new.select("id", "to", "d", "c"))
            found = written(found.select("id", "to", "d", "c"), "found")
        link = F.struct("d", F.least("id", "to").alias("a"), F.greatest("id", "to").alias("b"))
        least = found.where(F.col("c") != largest).groupBy("c").agg(F.min(link).alias("e")).select("e.a", "e.b", "e.d").distinct()
        least = written(least.withColumn("step", F.lit(step).cast("long")), "least")
        taken = least if taken is None else taken.unionByName(least)
        of = where_.select("id", "c")
        ends = least.join(of.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(of.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        merged = written(components(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "merged")
        merged = merged.select(F.col("node").alias("c"), F.col("label").alias("_to"))
        where_ = written(where_.join(merged, "c", "left").select("id", "x", F.coalesce("_to", "c").alias("c")), "components")
        of = where_.select("id", "c")
        found = found.drop("c").join(of, "id").join(of.select(F.col("id").alias("to"), F.col("c").alias("_c")), "to").where("c <> _c")
        found = written(found.select("id", "to", "d", "c"), "found")
    tree = written(taken, "tree")
    if tree.count() != held.n - 1:  # equal links that rounding has closed to a circle
        step_of = tree.groupBy("a", "b").agg(F.min("step").alias("step"))
        tree = written(spanning_tree(tree.select("a", "b", "d")).join(step_of, ["a", "b"]), "tree")
    return tree


def spanning_tree(links: DataFrame) -> DataFrame:
    """The least spanning tree (forest) of links (a, b, d), ties in order of a and b: in each
    round every component takes its least link to another, and those that links join become
    one. Rounds are as many as the logarithm of the number of nodes at most."""
    same = F.struct("d", "a", "b")
    open_ = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").where("a <> b")
    open_ = written(open_.groupBy("a", "b").agg(F.min("d").alias("d")).withColumns({"ca": F.col("a"), "cb": F.col("b")}), "open")
    taken = None
    while open_.limit(1).count():
        ends = open_.select(F.explode(F.array("ca", "cb")).alias("c"), same.alias("e"))
        best = ends.groupBy("c").agg(F.min("e").alias("e")).select("e.*").distinct()
        best = written(best.join(open_, ["a", "b", "d"]), "least")
        taken = best.select("a", "b", "d") if taken is None else taken.unionByName(best.select("a", "b", "d"))
        merged = written(components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b"))), "merged")
        for c in ("ca", "cb"):
            to = merged.select(F.col("node").alias(c), F.col("label").alias("_to"))
            open_ = open_.join(to, c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
        open_ = written(open_.where("ca <> cb").select("a", "b", "d", "ca", "cb"), "open")
    return links.select("a", "b", "d").limit(0) if taken is None else written(taken, "tree")


def merge_summary(heights: DataFrame, last: int = 10) -> dict[str, object]:
    """Of the distances d of all merges: how many, the least, mean and greatest, and the last."""
    n, least, mean, most = heights.agg(F.count("d"), F.min("d"), F.avg("d"), F.max("d")).first()
    top = [r[0] for r in heights.orderBy(F.desc("d")).limit(last).select("d").collect()]
    return {"n_merges": n, "merge_distances": {"min": least, "mean": mean, "max": most, "last": top[::-1]}}


def merges(x: np.ndarray, linkage: str, metric: str, sizes: np.ndarray | None = None) -> list[tuple[float, int, int]]:
    """(height, a, b) of every merge: a and b are points of the two clusters. sizes: of what
    rows of x are the centres of (ward)."""
    n = len(x)
    d = pair_distances(x, x, metric).astype(np.float64)
    size = np.ones(n) if sizes is None else sizes.astype(float)
    if linkage == "ward":
        d **= 2
        d *= 2 / (1 / size[:, None] + 1 / size[None])
    np.fill_diagonal(d, np.inf)
    alive = np.ones(n, bool)
    chain: list[int] = []
    out = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.argmax(alive))]
        while True:
            a = chain[-1]
            b = int(np.argmin(d[a]))
            if len(chain) > 1 and d[a, chain[-2]] <= d[a, b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        h = d[a, b]
        na, nb = size[a], size[b]
        if linkage == "single":
            row = np.minimum(d[a], d[b])
        elif linkage == "complete":
            row = np.maximum(np.where(np.isinf(d[a]), -np.inf, d[a]), np.where(np.isinf(d[b]), -np.inf, d[b]))
        elif linkage == "average":
            row = (na * d[a] + nb * d[b]) / (na + nb)
        else:
            row = ((na + size) * d[a] + (nb + size) * d[b] - size * h) / (na + nb + size)
        keep, gone = min(a, b), max(a, b)
        out.append((float(math.sqrt(h) if linkage == "ward" else h), keep, gone))
        alive[gone] = False
        size[keep] = na + nb
        row[~alive] = np.inf
        row[keep] = np.inf
        d[keep], d[:, keep] = row, row
        d[gone], d[:, gone] = np.inf, np.inf
    return out


def cut(steps: list[tuple[float, int, int]], n: int, k: int) -> np.ndarray:
    """Labels of k clusters, numbered by their least point."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, a, b in sorted(steps, key=lambda s: s[0])[: n - k]:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    tops = [find(i) for i in range(n)]
    number = {t: j for j, t in enumerate(sorted(set(tops)))}
    return np.array([number[t] for t in tops])
