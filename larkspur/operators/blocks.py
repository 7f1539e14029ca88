"""Work over pairs of points, as joins of blocks of bounded size.

Points are rows of (key, x) with x an array of doubles. A pass over all pairs deals them into
blocks by hash and groups them by pairs of blocks; each group is one task's matrix product. A
join within a radius first deals points to their nearest of some pivots: by the triangle
inequality a point has to visit few cells besides its own, and every cell is cut into blocks
again, so a cell of any size is spread over tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import written

#: Doubles, and points, of a block at most.
BLOCK_VALUES, BLOCK_POINTS = 250_000, 4_096
#: A pass over pairs reads each point once a block, so its blocks grow with the points, to this
#: many times that size, as soon as there are this many blocks.
WIDER, PAIR_BLOCKS = 8, 8
#: Points that cells are made around, at most.
PIVOTS = 256


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The rows of an Arrow column of arrays of doubles, all of one width."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten()
    return values.to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows of x to rows of c."""
    d = x @ (-2 * c.T)
    d += (x**2).sum(1)[:, None]
    d += (c**2).sum(1)[None]
    return np.maximum(d, 0, out=d)


def pair_distances(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x to rows of y."""
    if metric in ("euclidean", "l2"):
        return np.sqrt(squared(x, y))
    if metric in ("manhattan", "cityblock", "l1"):
        return np.abs(x[:, None] - y[None]).sum(2)
    if metric == "chebyshev":
        return np.abs(x[:, None] - y[None]).max(2)
    if metric == "cosine":
        a, b = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, y))
        return np.maximum(1 - a @ b.T, 0)
    raise ValueError(f"no such metric: {metric}")


def strips(x: np.ndarray, y: np.ndarray, metric: str) -> Iterator[tuple[slice, np.ndarray]]:
    """The same, some rows of x at a time, so that no large array is made."""
    rows = max(1, 4_000_000 // max(1, len(y) * (1 if metric in ("euclidean", "l2", "cosine") else x.shape[1])))
    for k in range(0, len(x), rows):
        at = slice(k, min(len(x), k + rows))
        yield at, pair_distances(x[at], y, metric)


def block_size(width: int) -> int:
    return min(BLOCK_POINTS, max(64, BLOCK_VALUES // max(1, width)))


def pair_blocks(n: int, width: int) -> int:
    """How many blocks a pass over all pairs of n points has."""
    size = block_size(width)
    return max(1, math.ceil(n / (size * WIDER)), min(math.ceil(n / size), PAIR_BLOCKS))


@dataclass
class Points:
    """Points written with an id of their own: rows (id, key, x, ...), how many, their width."""

    rows: DataFrame
    n: int
    width: int

    @property
    def per_block(self) -> int:
        return block_size(self.width)


def numbered_points(points: DataFrame) -> Points:
    """A null, NaN or infinite value in x, or another number of values, is an error."""
    rows = written(points.withColumns({"x": F.col("x").cast("array<double>"), "id": F.monotonically_increasing_id()}), "points")
    bad = F.coalesce(F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    n, least, most, wrong = rows.agg(F.count(F.lit(1)), F.min(F.size("x")), F.max(F.size("x")), F.count_if(bad)).first()
    if wrong or least != most:
        raise ValueError(f"{wrong} points have values that aren't finite, or they have between {least} and {most} values")
    return Points(rows, n, most or 0)


def over_block_pairs(points: Points, columns: list[str], work: Callable[[dict, dict | None], pa.Table], schema: str) -> DataFrame:
    """What work makes of every pair of blocks: of two dictionaries of arrays by column, the
    second None for a block with itself. Each pair of points is in exactly one group."""
    blocks = pair_blocks(points.n, points.width)
    mine = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    rows = points.rows.select("id", "x", *columns, mine.alias("_b")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    rows = rows.withColumns({"_lo": F.least("_b", "_o"), "_hi": F.greatest("_b", "_o")})

    def run(key: tuple, table: pa.Table) -> pa.Table:
        low, high = key[0].as_py(), key[1].as_py()
        block = table.column("_b").to_numpy()

        def part(b: int) -> dict:
            of = np.flatnonzero(block == b)
            some = table.take(pa.array(of))
            return {"id": some.column("id").to_numpy(), "x": matrix(some.column("x")), **{c: some.column(c) for c in columns}}

        return work(part(low), None if low == high else part(high))

    return rows.groupBy("_lo", "_hi").applyInArrow(run, schema)


@dataclass
class Grid:
    """rows (id, x, cell, home, h, v): groups (cell, h, v) such that each point meets, as a
    visitor, every point within a radius exactly once, among the points at home there; but for
    cells that lie within the radius as a whole, which it doesn't visit: sure (id, cells, n) has
    them and the number of points at home in them. homes (id, cell)."""

    rows: DataFrame
    sure: DataFrame
    homes: DataFrame


def visits(points: Points, radius: float, metric: str) -> Grid:
    """Which cells around some pivots each point has to visit, by the triangle inequality."""
    if metric == "cosine":  # no metric itself; unit vectors have the distance sqrt(2 c)
        kind, reach, unit = "euclidean", math.sqrt(2 * max(0.0, radius)), True
    else:
        kind, reach, unit = metric, radius, False
    per = math.ceil(points.n / pair_blocks(points.n, points.width))
    wanted = max(1, min(PIVOTS, points.n // per))
    chosen = points.rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("x").collect()
    pivots = np.array([r["x"] for r in chosen], float)

    def shaped(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) if unit else x

    pivots = shaped(pivots)
    placed = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("cell", pa.int32()), ("far", pa.float64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pair_distances(shaped(matrix(b.column(1))), pivots, kind)
                home = d.argmin(1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(placed.field(1).type), pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], schema=placed)

    homes = written(points.rows.select("id", "x").mapInArrow(place, "id long, x array<double>, cell int, far double"), "homes")
    size, span = np.zeros(len(pivots), np.int64), np.zeros(len(pivots))
    for r in homes.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row a pivot
        size[r["cell"]], span[r["cell"]] = r["n"], r["far"]
    slack = 1e-6 * (1.0 + float(span.max(initial=0.0)) + reach)  # for the rounding of distances
    within = lambda d: (d + span[None] <= reach - slack) & (size[None] > 0)
    kept = pa.schema([("id", pa.int64()), ("cells", pa.list_(pa.int32())), ("n", pa.int64())])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sure = within(pair_distances(shaped(matrix(b.column(1))), pivots, kind))
                of = np.flatnonzero(sure.any(1))
                columns = [b.column(0).take(pa.array(of)), pa.array([np.flatnonzero(r).astype(np.int32) for r in sure[of]], kept.field(1).type), pa.array(sure[of] @ size, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, schema=kept)

    sure = written(points.rows.select("id", "x").mapInArrow(settle, "id long, cells array<int>, n long"), "sure")
    toured = pa.schema([("id", pa.int64()), ("x", pa.list_(pa.float64())), ("cell", pa.int32())])

    def tour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = pair_distances(shaped(matrix(b.column(1))), pivots, kind)
                go = (d <= d.min(1, keepdims=True) + 2 * reach + slack) & (d <= span[None] + reach + slack) & (size[None] > 0) & ~within(d)
                row, cell = np.nonzero(go)
                for k in range(0, len(row), 4096):
                    at = pa.array(row[k : k + 4096])
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at).cast(toured.field(1).type), pa.array(cell[k : k + 4096].astype(np.int32))], schema=toured)

    guests = written(points.rows.select("id", "x").mapInArrow(tour, "id long, x array<double>, cell int"), "guests")
    calls = np.zeros(len(pivots), np.int64)
    for r in guests.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # a row a pivot
        calls[r["cell"]] = r["n"]
    at_home = F.array(*(F.lit(int(max(1, math.ceil(s / per)))) for s in size))[F.col("cell")]
    visiting = F.array(*(F.lit(int(max(1, math.ceil(s / per)))) for s in calls))[F.col("cell")]
    mine = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
    every = lambda n: F.sequence(F.lit(0), n - 1)
    a = homes.select("id", "x", "cell", F.lit(True).alias("home"), mine(at_home).alias("h"), F.explode(every(visiting)).alias("v"))
    b = guests.select("id", "x", "cell", F.lit(False).alias("home"), mine(visiting).alias("v"), F.explode(every(at_home)).alias("h"))
    visited = F.array(*(F.lit(bool(c)) for c in calls))[F.col("cell")]
    return Grid(a.where(visited).unionByName(b), sure, homes.select("id", "cell"))


def cell_links(grid: Grid, counts: DataFrame) -> DataFrame:
    """(a, b): links that join a core point to all core points of each cell that lies within the
    radius of it as a whole; counts (id, core)."""
    core = counts.where("core").select("id")
    first = F.broadcast(grid.homes.join(core, "id").groupBy("cell").agg(F.min("id").alias("b")))  # a row a pivot
    calls = grid.sure.join(core, "id").select("id", F.explode("cells").alias("cell"))
    met = F.broadcast(calls.select("cell").distinct())
    members = grid.homes.join(core, "id").join(met, "cell")
    return calls.unionByName(members.select("id", "cell")).join(first, "cell").select(F.col("id").alias("a"), "b").distinct()


def halves(table: pa.Table, columns: list[str]) -> tuple[dict, dict]:
    """Those at home and those that visit, of a group of `visits`."""
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)

    def part(mask: np.ndarray) -> dict:
        some = table.take(pa.array(np.flatnonzero(mask)))
        return {"id": some.column("id").to_numpy(), "x": matrix(some.column("x")) if some.num_rows else np.zeros((0, 1)), **{c: some.column(c).to_numpy(zero_copy_only=False) for c in columns}}

    return part(home), part(~home)


def neighbour_counts(grid: DataFrame, radius: float, metric: str) -> DataFrame:
    """(id, n): how many points, itself included, each has within the radius."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home, guests = halves(table, [])
        n = np.zeros(len(guests["id"]), np.int64)
        if len(n) and len(home["id"]):
            for at, d in strips(guests["x"], home["x"], metric):
                n[at] = (d <= radius).sum(1)
        return pa.table({"id": guests["id"], "n": n})

    return grid.groupBy("cell", "h", "v").applyInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


class Forest:
    """Which of some numbered things are joined."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def core_links(grid: DataFrame, radius: float, metric: str) -> DataFrame:
    """(a, b, border) of points with a flag `core`: enough links between core points to join
    all that are within the radius of each other, and for other points (border) a link to one
    core point of each lot of core points that a group has joined and that they touch."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home, guests = halves(table, ["core"])
        of = np.flatnonzero(home["core"].astype(bool))
        ids = home["id"][of]
        a, b, border = [], [], []
        joined, later = Forest(len(of)), []
        if len(of):
            for at, d in strips(guests["x"], home["x"][of], metric):
                for k, row in zip(range(at.start, at.stop), d <= radius):
                    near = np.flatnonzero(row)
                    if not len(near):
                        continue
                    if not guests["core"][k]:
                        later.append((k, near))
                        continue
                    first = int(near[0])
                    if guests["id"][k] != ids[first]:
                        a.append(guests["id"][k])
                        b.append(ids[first])
                        border.append(False)
                    for x in near[1:][joined.up[near[1:]] != joined.up[first]]:
                        if joined.join(first, int(x)):
                            a.append(guests["id"][k])
                            b.append(ids[x])
                            border.append(False)
        for k, near in later:
            for r in {joined.root(int(x)) for x in near}:
                a.append(guests["id"][k])
                b.append(ids[r])
                border.append(True)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "border": pa.array(border, pa.bool_())})

    return grid.groupBy("cell", "h", "v").applyInArrow(run, "a long, b long, border boolean")


def one_block(points: Points, radius: float, least: int, metric: str) -> DataFrame:
    """(key, label, core): density clusters of points that fit one block, in order of the least
    key of a core point; another point's is the first that it touches, or -1."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("key")
        x = matrix(table.column("x"))
        near = [np.flatnonzero(row) for _, d in strips(x, x, metric) for row in d <= radius]
        core = np.array([len(v) >= least for v in near], bool)
        joined = Forest(len(x))
        for i in np.flatnonzero(core):
            for j in near[i][core[near[i]] & (joined.up[near[i]] != joined.up[i])]:
                joined.join(int(i), int(j))
        roots = np.array([joined.root(i) for i in range(len(x))])
        number = np.full(len(x), len(x))
        number[core] = np.unique(roots[core], return_inverse=True)[1]  # a root is its cluster's least row
        label = np.array([n if c else min(number[v[core[v]]], default=-1) for n, c, v in zip(number, core, near)], np.int32)
        return pa.table({"key": table.column("key"), "label": label, "core": core})

    key = dict(points.rows.dtypes)["key"]
    whole = points.rows.select("key", "x", F.lit(0).alias("_all")).groupBy("_all")
    return whole.applyInArrow(run, f"key {key}, label int, core boolean")


def apart(x: np.ndarray, y: np.ndarray, metric: str) -> np.ndarray:
    """Distances of rows of x to the same rows of y, the same to the last bit from either side."""
    if metric in ("euclidean", "l2"):
        return np.sqrt(((x - y) ** 2).sum(-1))
    if metric in ("manhattan", "cityblock", "l1"):
        return np.abs(x - y).sum(-1)
    if metric == "chebyshev":
        return np.abs(x - y).max(-1)
    if metric == "cosine":
        a, b = (v / np.maximum(np.linalg.norm(v, axis=-1, keepdims=True), 1e-300) for v in (x, y))
        return np.maximum(1 - (a * b).sum(-1), 0)
    raise ValueError(f"no such metric: {metric}")


def least_of_rows(d: np.ndarray, k: int) -> np.ndarray:
    """The columns of the k least values of each row, by way of the least of every 32 columns,
    a 32nd part of the row's width apart."""
    m = d.shape[1]
    if k == 1:
        return d.argmin(1)[:, None]
    if m <= 64 * k:
        return np.argpartition(d, k - 1, axis=1)[:, :k] if k < m else np.tile(np.arange(m), (len(d), 1))
    lots = m // 32
    some = np.argpartition(d[:, : 32 * lots].reshape(len(d), 32, lots).min(1), k - 1, axis=1)[:, :k]
    of = (some[:, None, :] + (np.arange(32) * lots)[None, :, None]).reshape(len(d), -1)
    of = np.concatenate((of, np.tile(np.arange(32 * lots, m), (len(d), 1))), 1)
    at = np.argpartition(np.take_along_axis(d, of, 1), k - 1, axis=1)[:, :k]
    return np.take_along_axis(of, at, 1)


def nearest(asking: DataFrame, points: DataFrame, m: int, n: int, width: int, column: str, k: int, far: Callable[[dict, slice, dict], np.ndarray], exact: Callable[[dict, np.ndarray, dict, np.ndarray], np.ndarray]) -> DataFrame:
    """(id, near): of each of m asking rows (id, x, column) the k nearest of n points of the same
    columns, as an array of (d, to) in order; fewer where there are no more.

    Pairs of blocks are groups. far gives distances of some asking rows to all points of a group,
    infinite for those that don't count; exact gives them for chosen pairs, the same from either
    side. Ties go by the hash of the point's id, so that points in a row don't all name the one
    before."""
    q, p = pair_blocks(m, width), pair_blocks(n, width)
    mine = lambda count: F.pmod(F.xxhash64("id", F.lit(2)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    chosen = ["id", "x", F.col(column).alias("c"), F.xxhash64("id").alias("o")]
    rows = asking.select(*chosen, F.lit(False).alias("home"), mine(q).alias("q"), every(p).alias("p"))
    rows = rows.unionByName(points.select(*chosen, F.lit(True).alias("home"), mine(p).alias("p"), every(q).alias("q")))
    kind = pa.schema([("id", pa.int64()), ("to", pa.list_(pa.int64())), ("d", pa.list_(pa.float64()))])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home, guests = halves(table.sort_by([("o", "ascending"), ("id", "ascending")]), ["c"])
        ids, to, d = [], [], []
        size = max(1, 4_000_000 // max(1, len(home["id"])))
        for start in range(0, len(guests["id"]) if len(home["id"]) else 0, size):
            at = slice(start, min(len(guests["id"]), start + size))
            found = far(guests, at, home)
            near = least_of_rows(found, min(k, found.shape[1]))
            real = np.isfinite(np.take_along_axis(found, near, 1))
            lengths = exact(guests, np.arange(at.start, at.stop)[:, None], home, near)
            ids += guests["id"][at].tolist()
            to += [home["id"][j[r]] for j, r in zip(near, real)]
            d += [v[r] for v, r in zip(lengths, real)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip((ids, to, d), kind)], schema=kind)

    found = rows.groupBy("q", "p").applyInArrow(run, "id long, to array<long>, d array<double>")
    pairs = F.zip_with("d", "to", lambda d, to: F.struct(d.alias("d"), F.xxhash64(to).alias("o"), to.alias("to")))
    best = F.slice(F.array_sort(F.flatten(F.collect_list(pairs))), 1, k)
    return found.groupBy("id").agg(F.transform(best, lambda e: F.struct(e["d"].alias("d"), e["to"].alias("to"))).alias("near"))


#: Distances that are made at once, about, and rows of them at least.
AT_ONCE, ROWS_AT_ONCE = 1_000_000, 96


def wide_block(width: int) -> int:
    """Clusters of a block at most, whose distances no task keeps."""
    return 2 * WIDER * block_size(width)


def ward_closest(x: np.ndarray, c: np.ndarray, ids: np.ndarray, y: np.ndarray, m: np.ndarray, others: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, d, low): of each cluster (centre x, size c, id) k of the clusters (y, m, others)
    other than itself, their squared Ward distances, infinite where there are no more, and what
    all that are not among them are apart at least; one of the k is the nearest.

    Single precision tells which k may be nearest, about the centres' mean and to a scale, so
    that its error has a bound; their distances are exact. Where that bound leaves the nearest
    open, double precision decides."""
    order = np.argsort(others)
    at = order[np.minimum(np.searchsorted(others, ids, sorter=order), len(others) - 1)]
    own = np.where(others[at] == ids, at, -1)
    middle = y.mean(0)
    a, b = x - middle, y - middle
    scale = max(np.abs(a).max(), np.abs(b).max()) or 1.0
    a /= scale
    b /= scale
    a2, b2 = (a**2).sum(1), (b**2).sum(1)
    u, v = 0.5 / c, 0.5 / m
    slack = (x.shape[1] + 10) * 2.0**-23 * (np.sqrt(a2) + np.sqrt(b2.max())) ** 2 / (u + v.min())
    a = np.column_stack((-2 * a, a2, np.ones(len(a)))).astype(np.float32)
    b = np.ascontiguousarray(np.column_stack((b, np.ones(len(b)), b2)).astype(np.float32).T)
    single = bool(c.max() == 1 and m.max() == 1)
    u4, v4 = u.astype(np.float32), v.astype(np.float32)
    k = min(k, len(y))
    columns, d, low = np.empty((len(x), k), np.int64), np.empty((len(x), k)), np.empty(len(x))

    def exact(rows: np.ndarray, near: np.ndarray) -> np.ndarray:
        found = ((x[rows, None] - y[near]) ** 2).sum(-1) / (u[rows, None] + v[near])
        found[near == own[rows, None]] = np.inf
        return found

    def screened(rows: np.ndarray, far: np.ndarray) -> np.ndarray:
        """The greatest of the k least values of far, whose columns are kept."""
        of = np.flatnonzero(own[rows] >= 0)
        far[of, own[rows[of]]] = np.inf
        columns[rows] = near = least_of_rows(far, k)
        d[rows] = exact(rows, near)
        return np.take_along_axis(far, near, 1).max(1) if k < len(y) else np.full(len(rows), np.inf)

    size = max(ROWS_AT_ONCE, AT_ONCE // len(y))
    room, parts = (np.empty((min(size, len(x)), len(y)), np.float32) for _ in range(2))  # made once: large arrays are slow to make
    for start in range(0, len(x), size):
        rows = np.arange(start, min(len(x), start + size))
        far = np.matmul(a[rows], b, out=room[: len(rows)])
        if not single:
            far /= np.add(u4[rows, None], v4, out=parts[: len(rows)])
        low[rows] = scale**2 * (screened(rows, far) - slack[rows])
    open_ = np.flatnonzero(d.min(1) > low)
    for start in range(0, len(open_), size):
        rows = open_[start : start + size]
        most = screened(rows, squared(x[rows], y) / (u[rows, None] + v))
        low[rows] = np.maximum(most, d[rows].min(1))
    return columns, d, low


def ward_near(asking: DataFrame, clusters: DataFrame, m: int, n: int, width: int, keep: int) -> DataFrame:
    """(id, n, low, near): of each of m asking clusters (id, n, x) up to `keep` of the n clusters
    nearest to it, as an array of (d, o, to, m) in order, of squared Ward distance, with the size
    of each; all others are `low` apart at least. o orders equal distances, the same from either
    side."""
    size = wide_block(width)
    q = math.ceil(m / size)
    p = max(math.ceil(n / size), min(math.ceil(2 * asking.sparkSession.sparkContext.defaultParallelism / q), math.ceil(n / 512)))
    k = min(keep, max(4, math.ceil(2 * keep / p)))
    mine = lambda count: F.pmod(F.xxhash64("id", F.lit(2)), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    rows = asking.select("id", "n", "x", F.lit(False).alias("home"), mine(q).alias("q"), every(p).alias("p"))
    rows = rows.unionByName(clusters.select("id", "n", "x", F.lit(True).alias("home"), mine(p).alias("p"), every(q).alias("q")))
    kind = pa.schema([("id", pa.int64()), ("n", pa.float64()), ("to", pa.list_(pa.int64())), ("m", pa.list_(pa.float64())), ("d", pa.list_(pa.float64())), ("low", pa.float64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        home, guests = halves(table.sort_by("id"), ["n"])
        if not len(home["id"]) or not len(guests["id"]):
            return kind.empty_table()
        near, d, low = ward_closest(guests["x"], guests["n"], guests["id"], home["x"], home["n"], home["id"], k)
        bounds = pa.array(np.arange(len(d) + 1) * d.shape[1], pa.int32())
        lists = [pa.ListArray.from_arrays(bounds, pa.array(v.ravel())) for v in (home["id"][near], home["n"][near], d)]
        return pa.Table.from_arrays([pa.array(guests["id"]), pa.array(guests["n"]), *lists, pa.array(low)], schema=kind)

    found = rows.groupBy("q", "p").applyInArrow(run, "id long, n double, to array<long>, m array<double>, d array<double>, low double")
    all_ = F.zip_with("to", "d", lambda to, d: F.struct(d.alias("d"), F.xxhash64(F.least("id", to), F.greatest("id", to)).alias("o"), to.alias("to")))
    each = F.zip_with(all_, "m", lambda e, m: F.struct(e["d"].alias("d"), e["o"].alias("o"), e["to"].alias("to"), m.alias("m")))
    real = F.filter(each, lambda e: e["d"] < float("inf"))
    sorted_ = found.select("id", "n", "low", real.alias("e")).groupBy("id").agg(F.first("n").alias("n"), F.min("low").alias("low"), F.array_sort(F.flatten(F.collect_list("e"))).alias("e"))
    low = F.when(F.size("e") > keep, F.least("low", F.try_element_at("e", F.lit(keep))["d"])).otherwise(F.col("low"))
    return sorted_.select("id", "n", low.alias("low"), F.slice("e", 1, keep).alias("near"))
