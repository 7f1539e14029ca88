"""Near-duplicate groups by MinHash LSH forest.

Several sorted signature orders (trees) hold the candidates: documents whose labels in a
tree share a prefix meet in a region. The depth adapts: a region with many members is cut
at deeper prefixes, and one of its members, the anchor, goes into every part, so that parts
stay tied. Within a region the sketches give similarity estimates and a spanning forest of
the likely links. Families, the components of those forests, are then compared on their
full shingle sets: small ones in one task; large ones first between neighbours of sorted
orders, and then, class by class of what these linked, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches_of, components, lean, small, trim, texts_in, written
from .words import WordHashes, mixed, shingle_set, spaced_words

_NO_ID = -(2**63)


@dataclass(frozen=True)
class Forest:
    """Parameters. With similarity s, a tree puts a pair in one region of the first depth
    with probability s ** depth; at 0.8 all trees together miss three pairs in a million."""

    width: int = 4
    percent: int = 80
    trees: int = 24
    depth: int = 4
    #: Members of a region compared at once; fuller regions are cut at deeper prefixes.
    region: int = 1024
    #: Estimates below percent/100 by more than so many standard errors are no candidates.
    errors: float = 6.0
    #: Members and shingles of a family that one task compares; larger ones go in blocks.
    family: int = 512
    shingles: int = 6_000_000
    #: Sorted orders of a large family, and the rows before it that each row is compared with.
    orders: int = 3
    reach: int = 8

    @property
    def depths(self) -> tuple[int, ...]:
        return self.depth, 2 * self.depth, 4 * self.depth

    @property
    def values(self) -> int:
        return self.trees * self.depth

    @property
    def least(self) -> float:
        s = self.percent / 100
        return s - self.errors * (s * (1 - s) / self.values) ** 0.5

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        i = np.arange(1, self.values + 1, dtype=np.uint64)
        return mixed(i * np.uint64(2)) | np.uint64(1), mixed(i * np.uint64(2) + np.uint64(1))

    def labels(self) -> np.ndarray:
        """The sketch values that each tree's label reads: its own first, then others'."""
        v, d = self.values, self.depth
        out = np.empty((self.trees, self.depths[-1]), np.int64)
        for t in range(self.trees):
            more = [(t * d + d + 7 * k + 3 * t) % v for k in range(v * 2)]
            own = list(range(t * d, t * d + d))
            rest = [x for x in dict.fromkeys(more) if x not in own]
            out[t] = (own + rest)[: self.depths[-1]]
        return out


def sketch(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """16-bit MinHash values of a set of 64-bit shingle hashes."""
    least = np.full(len(a), 0xFFFFFFFF, np.uint64)
    for k in range(0, len(s), 2048):
        part = (s[k : k + 2048, None] * a + b) >> np.uint64(32)
        np.minimum(least, part.min(axis=0), out=least)
    return (least & np.uint64(0xFFFF)).astype(">u2")


def sketched(docs: DataFrame, id_col: str, text_col: str, p: Forest) -> DataFrame:
    """id, n_shingles, digest of the set (null: no words) and sketch of every row."""
    schema = pa.schema([("id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), p.hashes()
        for batch in batches:
            def rows(batch=batch):
                for i, text in zip(batch.column(0).to_pylist(), texts_in(batch.column(1))):
                    s = shingle_set(hashes.array(spaced_words(text)), p.width)
                    if len(s):
                        yield i, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch(s, a, b).tobytes()
                    else:
                        yield i, 0, None, None
            yield from batches_of(rows(), schema)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        lean(run), "id long, n_shingles long, digest binary, sketch binary"
    )


def _forest(sim: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest over the pairs that are at least so similar, best first."""
    n = len(sim)
    x, y = np.nonzero(np.triu(sim >= least, 1))
    root = np.arange(n)
    out = []
    for k in np.argsort(-sim[x, y], kind="stable"):
        i, j = root[x[k]], root[y[k]]
        if i != j:
            out.append((int(x[k]), int(y[k])))
            root[root == j] = i
            if len(out) == n - 1:
                break
    return out


def _agreement(rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Share of sketch values in which each row agrees with each column."""
    same = np.zeros((len(rows), len(columns)), np.uint16)
    for k in range(rows.shape[1]):
        same += rows[:, k, None] == columns[None, :, k]
    return same / np.float32(rows.shape[1])


def regions(nodes: DataFrame, p: Forest) -> DataFrame:
    """(key, node): the regions that two or more of the nodes (node, sketch) share.

    A region has at most p.region members and an anchor: fuller ones are cut at the next
    depth, and at the last by hash of the node. Counts decide, so partitions don't matter.
    """
    labels = p.labels()

    def key(t: int, depth: int):
        return F.xxhash64(F.lit(t), *(F.substring("sketch", int(2 * c + 1), 2) for c in labels[t][:depth]))

    found: list[DataFrame] = []
    anchors, before = None, None
    for depth in p.depths:
        columns = {"key": depth} | ({"parent": before} if before else {})
        structs = [F.struct(*(key(t, d).alias(c) for c, d in columns.items())) for t in range(p.trees)]
        entries = nodes.select("node", F.explode(F.array(*structs)).alias("e")).select("e.*", "node")
        if anchors is not None:
            cut = entries.join(small(anchors, n_full), "parent")
            entries = written(cut.select("key", "node").unionByName(cut.select("key", F.col("anchor").alias("node")).distinct()).distinct(), "entries")
        counts = written(entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counts")
        over = F.col("n") > p.region + 1
        large = counts.where(over)  # at most a key for each p.region entries
        n_full, before = large.count(), depth
        rest = entries.join(small(large.select("key"), n_full), "key", "left_anti") if n_full else entries
        found.append(written(rest.join(counts.where(~over).select("key"), "key", "left_semi").select("key", "node"), "shared"))
        if not n_full:
            break
        full = entries.join(small(large, n_full), "key")
        anchor = F.min(F.struct(F.xxhash64("key", "node"), "node"))["node"]
        anchors = written(full.groupBy(F.col("key").alias("parent")).agg(anchor.alias("anchor"), F.first("n").alias("n")), "anchors")
    else:
        chunk = lambda c: F.xxhash64("key", c)
        parts = anchors.select(F.col("parent").alias("key"), "anchor", F.ceil(F.col("n") * 2 / p.region).alias("parts"))
        cut = full.select("key", "node").join(small(parts, n_full), "key")
        found.append(cut.select(chunk(F.pmod(F.xxhash64("node"), "parts")).alias("key"), "node"))
        tied = parts.select("key", "anchor", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("c"))
        found.append(tied.select(chunk(F.col("c")).alias("key"), F.col("anchor").alias("node")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def candidate_edges(nodes: DataFrame, p: Forest) -> DataFrame:
    """(a, b): nodes that share a region and whose sketches agree enough, as spanning forests."""
    rows = regions(nodes, p).join(nodes.select("node", "sketch"), "node")
    dealt = rows.repartition("key").sortWithinPartitions("key", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def edges(table: pa.Table) -> Iterator[tuple[int, int]]:
        key, node = table["key"].to_numpy(), table["node"].to_numpy()
        values = np.frombuffer(b"".join(table["sketch"].to_pylist()), ">u2").astype(np.uint16).reshape(len(key), p.values)
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(begin, len(key)))
        two = begin[size == 2]
        like = (values[two] == values[two + 1]).mean(axis=1) >= p.least
        yield from zip(node[two[like]].tolist(), node[two[like] + 1].tolist())
        for lo, n in zip(begin[size > 2].tolist(), size[size > 2].tolist()):
            own = values[lo : lo + n]
            for x, y in _forest(_agreement(own, own), p.least):
                if node[lo + x] != node[lo + y]:
                    yield int(node[lo + x]), int(node[lo + y])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= 16 * p.region:
                table = pa.Table.from_batches(held)
                key = table["key"].to_numpy()
                cut = np.flatnonzero(key != key[-1])
                end = int(cut[-1]) + 1 if len(cut) else 0
                yield from batches_of(edges(table.slice(0, end)), schema, 20_000)
                held = table.slice(end).combine_chunks().to_batches()
                rows = len(key) - end
        if rows:
            yield from batches_of(edges(pa.Table.from_batches(held)), schema, 20_000)

    pairs = dealt.select("key", "node", "sketch").mapInArrow(lean(run), "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _linked(a: np.ndarray, b: np.ndarray, p: Forest) -> bool:
    """Whether two sorted sets are similar enough."""
    if 100 * min(len(a), len(b)) < p.percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= p.percent * (len(a) + len(b) - both)


def _links(sets: list[np.ndarray], values: np.ndarray, left: np.ndarray, right: np.ndarray, root: np.ndarray, p: Forest) -> list[tuple[int, int]]:
    """A spanning forest of the true links between rows of left and rows of right, where
    rows with equal roots are connected already.

    Pairs go from the most to the least alike by sketch. Of rows not connected yet, every
    pair within the length bound and the estimate's error is checked on its full sets.
    """
    root = root.copy()
    size = np.array([len(s) for s in sets])
    pairs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for k in range(0, len(left), 256):
        rows = left[k : k + 256]
        sim = _agreement(values[rows], values[right])
        keep = (sim >= p.least) & (root[rows][:, None] != root[right][None, :])
        keep &= 100 * np.minimum.outer(size[rows], size[right]) >= p.percent * np.maximum.outer(size[rows], size[right])
        if left is right:
            keep &= rows[:, None] < right[None, :]
        x, y = np.nonzero(keep)
        pairs.append((rows[x], right[y], sim[x, y]))
    if not pairs:
        return []
    x, y, sim = (np.concatenate(c) for c in zip(*pairs))
    out = []
    for k in np.argsort(-sim, kind="stable"):
        i, j = root[x[k]], root[y[k]]
        if i != j and _linked(sets[x[k]], sets[y[k]], p):
            out.append((int(x[k]), int(y[k])))
            root[root == j] = i
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Forest | None = None) -> DataFrame:
    """Groups of documents linked, directly or through others, by shingle-set similarity.

    Links: 100 * intersection >= percent * union of the sets of distinct word shingles
    (`words.spaced_words`; fewer words than a shingle count as one). Returns id_col,
    n_shingles, component_id (the least id reachable, itself included) and kept
    (id = component_id), a row for each input row.

    Null or blank texts have no shingles, stay alone and are kept. Equal sets are one class
    from the start, so copies cost a row and no comparison. Rows with a null id take part;
    a group's id is the least that is not null, and such rows are kept only when alone with
    that id null (null = null counts as kept). Repeated rows and ids each give a row. An
    empty table gives no rows. Other columns are left out, so none can clash. Ids must be
    whole numbers, since the least of a group names it; other types are an error.
    """
    p = params or Forest()
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    rows = written(sketched(docs, id_col, text_col, p), "sketched")
    classes = rows.where("digest is not null").groupBy("digest", "n_shingles", "sketch").agg(F.min("id").alias("least_id"))
    nodes = written(classes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    family = components(candidate_edges(nodes, p))
    active = written(nodes.join(family, "node").select("node", F.col("label").alias("family"), "digest", "n_shingles", "least_id"), "active")
    count = active.count()
    labels = None
    if count:
        labels = _verified(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), active, count, p)
    root = nodes.select("node", "digest", "least_id")
    if labels is not None:
        members = written(labels.join(root.select("node", "least_id"), "node"), "members")
        tops = written(members.groupBy("label").agg(F.min("least_id").alias("component_id")), "tops")
        members = members.select("node", "label").join(small(tops, tops.count()), "label")
        root = root.join(members.select("node", "component_id"), "node", "left")
        root = root.withColumn("component_id", F.coalesce("component_id", "least_id"))
    else:
        root = root.withColumn("component_id", F.col("least_id"))
    found = rows.select("id", "n_shingles", "digest").join(root.select("digest", "component_id"), "digest", "left")
    top = F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(F.col("id").alias(id_col), "n_shingles", top.alias("component_id"), F.col("id").eqNullSafe(top).alias("kept"))


_LINKS = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _verified(docs: DataFrame, active: DataFrame, count: int, p: Forest) -> DataFrame:
    """(node, label): components of the true links within families."""
    wanted = active.select(F.coalesce("least_id", F.lit(_NO_ID)).alias("wanted"), "node", "family", F.col("digest").alias("of"))
    texts = docs.withColumn("wanted", F.coalesce("id", F.lit(_NO_ID))).join(small(wanted, count), "wanted")
    schema = pa.schema([("node", pa.int64()), ("family", pa.int64()), ("shingles", pa.binary()), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), p.hashes()
        for batch in batches:
            def rows(batch=batch):
                for node, family, of, text in zip(*(batch.column(c).to_pylist() for c in (0, 1, 2)), texts_in(batch.column(3))):
                    s = shingle_set(hashes.array(spaced_words(text)), p.width)
                    if len(s) and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == of:
                        yield node, family, s.tobytes(), sketch(s, a, b).tobytes()
            yield from batches_of(rows(), schema, 500)

    sets = texts.select("node", "family", "of", "text").mapInArrow(lean(run), "node long, family long, shingles binary, sketch binary")
    sets = written(sets, "sets")
    sizes = active.groupBy("family").agg(F.count("*").alias("members"), F.sum("n_shingles").alias("n"))
    large = written(sizes.where((F.col("members") > p.family) | (F.col("n") > p.shingles)), "large")
    n_large = large.count()
    plain = sets.join(small(large.select("family"), n_large), "family", "left_anti") if n_large else sets

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node").sort_values("node", ignore_index=True)
        held, values, node = _unpacked(frame, p)
        every = np.arange(len(frame))
        found = _links(held, values, every, every, every, p)
        trim()
        return pd.DataFrame({"a": [node[x] for x, _ in found], "b": [node[y] for _, y in found]}, dtype="int64")

    links = written(plain.groupBy("family").applyInPandas(compare, _LINKS), "links")
    if n_large:
        links = links.unionByName(_large_links(sets, active, large, n_large, p))
    return components(links)


def _unpacked(frame: pd.DataFrame, p: Forest) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    held = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
    values = np.frombuffer(b"".join(frame["sketch"]), ">u2").astype(np.uint16).reshape(len(frame), p.values)
    return held, values, frame["node"].to_numpy()


def _large_links(sets: DataFrame, active: DataFrame, large: DataFrame, n_large: int, p: Forest) -> DataFrame:
    """True links of the large families: enough to connect what is connected.

    Neighbours in sorted orders come first. What they link are classes; pairs within a class
    need no check. Every member outside its family's largest class is then compared with all
    members of other classes, in blocks of some of the one and some of the other. The work of
    a family grows with its members times those outside its largest class.
    """
    near = written(_neighbours(sets.join(small(large.select("family"), n_large), "family", "left_semi"), p), "near")
    ids = active.join(small(large, n_large), "family").select("node", "family", "n_shingles", "members", "n")
    ids = ids.join(components(near), "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")
    ids = written(ids, "classes")
    sizes = ids.groupBy("family", "class").agg(F.count("*").alias("m"), F.sum("n_shingles").alias("s"), F.first("members").alias("members"), F.first("n").alias("n"))
    tops = sizes.groupBy("family", "members", "n").agg(F.max(F.struct("m", "s", "class")).alias("top"))
    outside, rest = F.col("members") - F.col("top.m"), F.col("n") - F.col("top.s")
    parts = lambda m, s: F.greatest(F.ceil(m * 2 / p.family), F.ceil(s * 2 / p.shingles), F.lit(1).cast("long"))
    tops = tops.where(outside > 0).select("family", F.col("top.class").alias("largest"), parts(F.col("members"), F.col("n")).alias("all_parts"), parts(outside, rest).alias("out_parts"))
    tops = written(tops, "tops")
    n_tops = tops.count()
    if not n_tops:
        return near
    ids = written(ids.select("node", "family", "class").join(small(tops, n_tops), "family"), "compared")
    rows = sets.drop("family").join(small(ids, ids.count()), "node")
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    columns = ("family", "i", "j", "side", "node", "class", "shingles", "sketch")
    members = rows.withColumns({"i": F.pmod(F.xxhash64("node"), "all_parts"), "side": F.lit(0)}).withColumn("j", spread("out_parts"))
    others = rows.where("class <> largest").withColumns({"j": F.pmod(F.xxhash64("node", F.lit(1)), "out_parts"), "side": F.lit(1)}).withColumn("i", spread("all_parts"))
    blocks = members.select(*columns).unionByName(others.select(*columns))

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates(["node", "side"]).sort_values(["side", "node"], ignore_index=True)
        held, values, node = _unpacked(frame, p)
        root = np.unique(frame["class"].to_numpy(), return_inverse=True)[1]
        side = frame["side"].to_numpy()
        found = _links(held, values, np.flatnonzero(side == 1), np.flatnonzero(side == 0), root, p)
        trim()
        return pd.DataFrame({"a": [node[x] for x, _ in found], "b": [node[y] for _, y in found]}, dtype="int64")

    return near.unionByName(written(blocks.groupBy("family", "i", "j").applyInPandas(compare, _LINKS), "links"))


def _neighbours(sets: DataFrame, p: Forest) -> DataFrame:
    """True links (a, b) of rows with rows shortly before them in orders by the sketch from
    several of its values on. Which ones are met depends on the partitions; later steps
    compare the rest, so the components of all links do not."""
    step = 2 * (p.values // p.orders)
    turned = [F.concat(F.substring("sketch", step * k + 1, 2 * p.values), F.substring("sketch", 1, step * k)) for k in range(p.orders)]
    rows = sets.select("family", "node", "shingles", "sketch", F.posexplode(F.array(*turned)).alias("o", "turned"))
    keys = ("o", "family", "turned")
    parts = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque[tuple[int, np.ndarray]] = deque(maxlen=p.reach)
        root: dict[int, int] = {}
        of = None

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = x = root.get(root[x], root[x])
            return x

        def links() -> Iterator[tuple[int, int]]:
            nonlocal of
            for batch in batches:
                for o, family, node, packed in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), batch.column(3)):
                    if (o, family) != of:
                        held.clear()
                        of = o, family
                    own = np.frombuffer(packed.as_py(), np.uint64)
                    for other, s in reversed(held):
                        x, y = find(node), find(other)
                        if x != y and _linked(own, s, p):
                            root[max(x, y)] = min(x, y)
                            yield node, other
                    held.append((node, own))

        yield from batches_of(links(), schema, 5000)

    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    return dealt.select("o", "family", "node", "shingles").mapInArrow(lean(run), "a long, b long")
