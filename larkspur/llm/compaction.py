"""Small files written by day, and packed into fewer files in place.

Spark deals the rows out and writes one sorted file for each (day, lot, piece). Each day's
small files are then packed first-fit by an augmented treap, and each group of several files
is one task's work: it streams their row groups into one writer, one row group held at a time.
Nothing but counts of files and days is planned with, and no list of files comes to the driver.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from .common import batches_of, delete, lean, scratch_dir, small, written
from .words import mixed


@dataclass(frozen=True)
class Layout:
    """Files aimed at: a lot has about 1 / lots of all rows, files of less than about
    1 / little of them are packed, and a packed file has at most about 1 / packed of them."""

    lots: int = 150
    little: int = 600
    packed: int = 400

    def size(self, rows: int, share: int) -> int:
        return 1 + rows // share


class Bins:
    """Bins in the order they were opened: a treap whose nodes hold the most room below them.

    The leftmost bin with enough room is found by one descent and a change of room touches one
    path, so packing m files takes about m log m steps."""

    def __init__(self) -> None:
        self.room: list[int] = []
        self.most: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.rank: list[int] = []
        self.root = -1

    def _pull(self, path: Sequence[int]) -> None:
        for x in reversed(path):
            below = [self.most[y] for y in (self.left[x], self.right[x]) if y >= 0]
            self.most[x] = max([self.room[x], *below])

    def open(self, room: int) -> int:
        """A new bin, the last in order; its number."""
        new = len(self.room)
        self.room.append(room)
        self.most.append(room)
        self.left.append(-1)
        self.right.append(-1)
        self.rank.append(int(mixed(np.array([new + 1], np.uint64))[0]))
        path: list[int] = []
        at = self.root
        while at >= 0 and self.rank[at] >= self.rank[new]:
            path.append(at)
            at = self.right[at]
        self.left[new] = at
        if path:
            self.right[path[-1]] = new
        else:
            self.root = new
        self._pull([*path, new])
        return new

    def put(self, size: int) -> int | None:
        """Takes room for size in the earliest bin that has it; its number, or None."""
        if self.root < 0 or self.most[self.root] < size:
            return None
        path: list[int] = []
        at = self.root
        while True:
            path.append(at)
            if self.left[at] >= 0 and self.most[self.left[at]] >= size:
                at = self.left[at]
            elif self.room[at] >= size:
                break
            else:
                at = self.right[at]
        self.room[at] -= size
        self._pull(path)
        return at


def first_fit(sizes: Sequence[int], room: int) -> list[int]:
    """The bin of each size, taken in the order given."""
    bins = Bins()
    out = []
    for size in sizes:
        at = bins.put(size)
        out.append(bins.open(room - size) if at is None else at)
    return out


def _free(name: str, columns: Sequence[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def _hash(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0).cast("long"))


def write_lots(rows: DataFrame, path: str, time_col: str, id_col: str, layout: Layout = Layout()) -> int:
    """Writes rows as one Parquet file for each (day, lot, piece), sorted by time and id, with
    all columns in their order; returns how many rows there are.

    The file names' parts are columns day, lot and piece of the folder (with underscores
    added where rows have such a column). A row without a time has the day NULL, one without
    an id the hash 0. Days are counted; their counts are joined as a broadcast if there are
    few. An empty table writes no file."""
    total = rows.count()
    spark = rows.sparkSession
    day, lot, piece = (_free(n, rows.columns) for n in ("day", "lot", "piece"))
    if not total:
        rows.limit(0).write.parquet(path)
        return 0
    dated = rows.withColumn(day, F.unix_date(F.col(time_col).cast("date")).cast("long"))
    days = dated.groupBy(F.col(day).alias("_d")).agg(F.count(F.lit(1)).alias("_r"))
    days = written(days, "days")
    same = F.col(day).eqNullSafe(F.col("_d"))
    h = _hash(id_col)
    lots = 1 + F.expr(f"_r div {layout.size(total, layout.lots)}")
    sixteenth, quarter = F.shiftright(h, 4), F.shiftright(h, 2) % 4
    placed = dated.join(small(days, days.count()), same).withColumns({lot: sixteenth % lots, piece: F.least(h % 4, quarter)})
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [day, lot, piece]
    placed = placed.select(*rows.columns, *keys).repartition(parts, *keys).sortWithinPartitions(*keys, time_col, id_col)
    placed.write.option("maxRecordsPerFile", 0).partitionBy(*keys).parquet(path)
    return total


def files_of(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(day, lot, piece, path, n_rows) of each file that write_lots wrote; columns are the
    table's own."""
    day, lot, piece = (_free(n, columns) for n in ("day", "lot", "piece"))
    read = spark.read.parquet(path)
    keys = [F.col(n).cast("long").alias(to) for n, to in ((day, "day"), (lot, "lot"), (piece, "piece"))]
    return read.groupBy(*keys, F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_rows"))


_PLAN = "day long, lot long, piece long, path string, n_rows long, bin long, place long"


def plan(files: DataFrame, little: int, room: int) -> DataFrame:
    """files with the bin of each within its day and its place in the bin; files of `little`
    rows or more have bins of their own. One group a day, of a few hundred files at most."""
    names = ["day", "lot", "piece", "path", "n_rows"]
    schema = pa.schema([("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("path", pa.string()), ("n_rows", pa.int64()), ("bin", pa.int64()), ("place", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(n).to_pylist() for n in names)), key=lambda r: (-r[4], r[1], r[2]))
        light = [r for r in rows if r[4] < little]
        bins = first_fit([r[4] for r in light], room)
        out, filled = [], {}
        for r, at in zip(light, bins):
            filled[at] = filled.get(at, -1) + 1
            out.append((*r, at, filled[at]))
        out += [(*r, -1 - k, 0) for k, r in enumerate(r for r in rows if r[4] >= little)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return files.select(*names).groupBy("day").applyInArrow(run, _PLAN)


def groups_of(planned: DataFrame) -> DataFrame:
    """A row a bin: day, lot and piece of its first file, sources and paths in joining order."""
    each = F.struct("place", "lot", "piece", "path", "n_rows")
    members = planned.groupBy("day", "bin").agg(F.array_sort(F.collect_list(each)).alias("m"))
    first = F.col("m")[0]
    sources = F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["lot"], x["piece"])), ",")
    return members.select("day", first["lot"].alias("lot"), first["piece"].alias("piece"), sources.alias("sources"), F.transform("m", lambda x: x["path"]).alias("paths"))


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def _row_groups(path: str) -> Iterator[pa.Table]:
    fs, name = _opened(path)
    with fs.open_input_file(name) as source:
        file = pq.ParquetFile(source, coerce_int96_timestamp_unit="us")
        for k in range(file.num_row_groups):
            yield file.read_row_group(k)


def _schema_of(path: str) -> tuple[pa.Schema, dict]:
    fs, name = _opened(path)
    with fs.open_input_file(name) as source:
        file = pq.ParquetFile(source, coerce_int96_timestamp_unit="us")
        return file.schema_arrow, dict(file.metadata.metadata or {})


def merge_files(spark: SparkSession, groups: DataFrame, staging: str, kind: pa.Schema) -> DataFrame:
    """Writes one file for each group of several files, in the folder of its first one.

    A task streams the row groups of a group's files into one writer under a name of its own
    attempt in the staging folder, and then moves the file to the place that its group
    decides, so a task that is run again replaces the same file by the same. The files'
    sources are still there: `drop_sources` deletes them when all groups are written. Returns
    the groups with the path of the file that stands for each."""
    out = pa.schema([("day", pa.int64()), ("lot", pa.int64()), ("piece", pa.int64()), ("sources", pa.string()), ("path", pa.string())])

    def merged(paths: list[str]) -> str:
        first = paths[0]
        context = TaskContext.get()
        label = hashlib.sha256("\n".join(paths).encode()).hexdigest()[:32]
        fs, draft = _opened(f"{staging}/{label}-{context.taskAttemptId()}.parquet")
        target = f"{posixpath.dirname(first)}/compacted-{label}.parquet"
        fs.create_dir(posixpath.dirname(draft), recursive=True)
        kept = {k: v for k, v in _schema_of(first)[1].items() if k.startswith(b"org.apache.spark")}
        schema = kind.with_metadata(kept)
        with fs.open_output_stream(draft) as sink, pq.ParquetWriter(sink, schema, compression="snappy", store_schema=False) as writer:
            for path in paths:
                for table in _row_groups(path):
                    writer.write_table(table.select(schema.names).cast(schema), row_group_size=max(1, table.num_rows))
        fs.move(draft, _opened(target)[1])
        return target

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for day, lot, piece, sources, paths in zip(*(c.to_pylist() for c in batch.columns)):
                    yield day, lot, piece, sources, merged(paths)

        yield from batches_of(each(), out)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    several = groups.where(F.size("paths") > 1).select("day", "lot", "piece", "sources", "paths").repartition(parts, "day", "lot", "piece")
    return several.mapInArrow(lean(run), "day long, lot long, piece long, sources string, path string")


def drop_sources(groups: DataFrame) -> int:
    """Deletes the files of groups of several; a file that is gone already is no error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = _opened(path)
                head, tail = posixpath.split(name)
                for x in (name, f"{head}/.{tail}.crc"):  # a local folder's writer leaves check sums beside
                    if fs.get_file_info(x).type == pafs.FileType.File:
                        fs.delete_file(x)
                        n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    paths = groups.where(F.size("paths") > 1).select(F.explode("paths").alias("path"))
    return paths.mapInArrow(lean(run), "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


_DIGEST = "day long, lot long, piece long, n_rows long, min_click_id long, max_click_id long, cents long, sources string, ids_sha256 string, columns string, path string, rewritten boolean"


def file_digests(files: DataFrame, id_col: str, value_col: str, parts: int) -> DataFrame:
    """A row for each of files (day, lot, piece, sources, path, rewritten), read a batch at a
    time: rows, least and greatest id, the sum of floor(100 * value + 0.5) (NULL, NaN and
    infinite values count 0), and the SHA-256 of the ids in file order, joined by commas (a
    NULL id is an empty string)."""
    names = [x.split()[0] for x in _DIGEST.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _DIGEST.split(", ")])

    def digest(path: str) -> dict:
        fs, name = _opened(path)
        n = cents = 0
        least = most = None
        sha, comma = hashlib.sha256(), False
        with fs.open_input_file(name) as source:
            file = pq.ParquetFile(source)
            for batch in file.iter_batches(batch_size=65_536, columns=[id_col, value_col]):
                if not batch.num_rows:
                    continue
                ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
                values = batch.column(batch.schema.get_field_index(value_col)).cast(pa.float64()).to_numpy(zero_copy_only=False)
                values = np.floor(100 * np.nan_to_num(values, nan=0.0, posinf=0.0, neginf=0.0) + 0.5)
                cents += sum(map(int, values[np.abs(values) >= 2**53])) + int(values[np.abs(values) < 2**53].astype(np.int64).sum())
                ends = pc.min_max(ids).as_py()
                if ends["min"] is not None:
                    least = ends["min"] if least is None else min(least, ends["min"])
                    most = ends["max"] if most is None else max(most, ends["max"])
                text = ",".join("" if x is None else str(x) for x in ids.to_pylist())
                sha.update(("," * comma + text).encode())
                comma = True
                n += batch.num_rows
            columns = ",".join(file.schema_arrow.names)
        return {"n_rows": n, "min_click_id": least, "max_click_id": most, "cents": cents, "ids_sha256": sha.hexdigest(), "columns": columns}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each():
            for batch in batches:
                for row in batch.to_pylist():
                    row |= digest(row["path"])
                    yield tuple(row[k] for k in names)

        yield from batches_of(each(), schema)

    wanted = files.select("day", "lot", "piece", "sources", "path", "rewritten")
    return wanted.repartition(parts, "path").mapInArrow(lean(run), _DIGEST)


def compact(rows: DataFrame, path: str, time_col: str, id_col: str, value_col: str, layout: Layout = Layout()) -> DataFrame:
    """Writes rows into the folder `path`, packs each day's small files there, and returns a
    row for each file that is left (see `file_digests`), with `sources`, the lot-piece of the
    files that it was made of in joining order, and whether it was rewritten.

    Within a day, files of fewer than the layout's `little` rows are taken by descending rows,
    then lot and piece; each joins the earliest opened group that has room for it, or opens
    one. Groups of one file and other files keep their very bytes. Rows with equal time and id
    keep no order among themselves; NULL times make a day of their own, and columns may have
    any names. An empty table gives no rows. A lost executor costs its tasks only: a task
    writes under a name of its own and moves the whole file to its place, and sources go when
    all groups are in place."""
    spark = rows.sparkSession
    total = write_lots(rows, path, time_col, id_col, layout)
    if not total:
        return spark.createDataFrame([], _DIGEST)
    kind = to_arrow_schema(rows.schema)
    files = files_of(spark, path, rows.columns)
    groups = written(groups_of(plan(files, layout.size(total, layout.little), layout.size(total, layout.packed))), "groups")
    staging = f"{path}/_staging"
    replaced = written(merge_files(spark, groups, staging, kind), "replaced")
    drop_sources(groups)
    delete(spark, staging)
    kept = groups.where(F.size("paths") == 1).select("day", "lot", "piece", "sources", F.col("paths")[0].alias("path"), F.lit(False).alias("rewritten"))
    final = replaced.withColumn("rewritten", F.lit(True)).unionByName(kept)
    return file_digests(final, id_col, value_col, int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "compacted")
