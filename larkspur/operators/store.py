"""Content-addressed tables: ids from hashes, a manifest beside each table, reuse by id."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIXES = {"dataset": "ds", "preprocessed": "pp", "clustering": "cl", "evaluation": "ev", "segmentation": "seg", "marketing": "mkt", "dashboard": "viz", "run": "e2e"}


def content_id(kind: str, **fields) -> str:
    """The kind's prefix and 24 hex digits of the fields' hash in canonical JSON."""
    text = json.dumps(fields, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str)
    return f"{PREFIXES[kind]}_{hashlib.sha256(text.encode()).hexdigest()[:24]}"


def table_digest(df: DataFrame) -> str:
    """A digest of all rows that doesn't depend on their order or on files."""
    row_hash = F.xxhash64(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    row = df.agg(F.coalesce(F.sum(row_hash.cast("decimal(38,0)")), F.lit(0)).alias("s"), F.coalesce(F.bit_xor(row_hash), F.lit(0)).alias("x"), F.count(F.lit(1)).alias("n")).first()
    schema = ",".join(f"{c}:{t}" for c, t in sorted(df.dtypes))
    return hashlib.sha256(f"{schema}|{row['s']}|{row['x']}|{row['n']}".encode()).hexdigest()


def save(df: DataFrame, root: str, kind: str, name: str, parents: Mapping[str, str] | None = None, config: Mapping[str, object] | None = None) -> str:
    """Writes a table and its manifest under its content id, unless it's there already.

    The table is written by Spark's commit protocol and the manifest after it, so a table
    with a manifest is whole."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    draft = jvm.org.apache.hadoop.fs.Path(f"{root}/tables/draft-{uuid.uuid4().hex}")
    fs = draft.getFileSystem(conf)
    df.write.parquet(draft.toString())  # computed once: the digest and the count are those of what was written
    whole = spark.read.schema(df.schema).parquet(draft.toString())
    made = content_id(kind, content=table_digest(whole), parents=dict(parents or {}), config=dict(config or {}))
    if not manifests(spark, root).where(F.col("id") == made).isEmpty():
        fs.delete(draft, True)
        return made
    n = whole.count()
    target = jvm.org.apache.hadoop.fs.Path(f"{root}/tables/{made}")
    fs.delete(target, True)  # what a lost writer left
    if not fs.rename(draft, target):
        raise OSError(f"{draft} can't become {target}")
    row = (made, kind, name, json.dumps(dict(parents or {}), sort_keys=True), json.dumps(dict(config or {}), sort_keys=True, default=str), n)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{root}/manifests")
    return made


MANIFEST = "id string, kind string, name string, parents string, config string, n_rows long"


def manifests(spark: SparkSession, root: str, kind: str | None = None, part_of_name: str | None = None) -> DataFrame:
    """All manifests, or those of a kind or with a part of a name."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/manifests")
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], MANIFEST)
    out = spark.read.schema(MANIFEST).json(f"{root}/manifests")
    if kind:
        out = out.where(F.col("kind") == kind)
    return out.where(F.lower("name").contains(part_of_name.lower())) if part_of_name else out


def load(spark: SparkSession, root: str, made: str, verify: bool = False) -> DataFrame:
    """A table by its id. verify: its rows are read and must give the id again, with the
    parents and the configuration of its manifest; else it is a ValueError."""
    found = manifests(spark, root).where(F.col("id") == made).first()
    if found is None:
        raise KeyError(f"no table {made}")
    df = spark.read.parquet(f"{root}/tables/{made}")
    if verify:
        again = content_id(found["kind"], content=table_digest(df), parents=json.loads(found["parents"]), config=json.loads(found["config"]))
        if again != made:
            raise ValueError(f"the rows of {made} have changed: they make {again}")
    return df


def key_paths(df: DataFrame, keep: Sequence[str], document: str, depth: int = 8) -> DataFrame:
    """keep, path and value of every leaf of a column of JSON objects, keys joined by dots.

    Arrays are leaves, and so is what lies deeper than `depth` objects; JSON null has the value
    'null'. Rows without a JSON object are left out."""
    nested = lambda c: F.col(c).startswith("{")
    rows = df.where(F.try_parse_json(document).isNotNull()).select(*keep, F.lit("").alias("path"), F.trim(F.col(document)).alias("value")).where(nested("value"))
    for level in range(depth):
        inner = F.map_entries(F.from_json("value", "map<string,string>"))
        here = F.array(F.struct(F.lit("").alias("key"), F.col("value").alias("value")))
        rows = rows.select(*keep, "path", F.explode(F.when(nested("value"), inner).otherwise(here) if level else inner).alias("e"))
        name = F.when(F.col("path") == "", F.col("e.key")).when(F.col("e.key") == "", F.col("path")).otherwise(F.concat_ws(".", "path", "e.key"))
        rows = rows.select(*keep, name.alias("path"), F.coalesce("e.value", F.lit("null")).alias("value"))
    return rows


def provenance_differences(df: DataFrame, group: str, document: str) -> DataFrame:
    """(group, path, members, recorded, n_values): the fields of manifests in which the members
    of a compatible group differ, a missing field being a value of its own.

    df: rows of a group and a JSON document. Groups of one have nothing to compare. Values are
    counted before their groups are, so a group of any size is spread over tasks."""
    whole = df.where(F.try_parse_json(document).isNotNull())
    members = whole.groupBy(group).agg(F.count(F.lit(1)).alias("members"))
    values = key_paths(whole, [group], document).groupBy(group, "path", "value").agg(F.count(F.lit(1)).alias("n"))
    paths = values.groupBy(group, "path").agg(F.sum("n").alias("recorded"), F.count(F.lit(1)).alias("n_values"))
    joined = paths.alias("p").join(members.alias("m"), F.col(f"p.{group}").eqNullSafe(F.col(f"m.{group}")))
    n_values = F.col("n_values") + (F.col("recorded") < F.col("members")).cast("int")
    out = joined.select(F.col(f"p.{group}").alias(group), "path", "members", "recorded", n_values.alias("n_values"))
    return out.where((F.col("members") > 1) & (F.col("n_values") > 1))


def incompatible(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(key, field, stored_value, compared_value): where a manifest's fields differ from those
    of the first one in order of key."""
    first = F.broadcast(df.orderBy(key).limit(1).select(F.col(key).alias("_key"), *(F.col(f).alias(f"_{f}") for f in fields)))  # one row
    cells = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stored_value"), F.col(f"_{f}").cast("string").alias("compared_value")) for f in fields)))
    rows = df.join(first, F.lit(True)).where(~F.col(key).eqNullSafe(F.col("_key"))).select(key, cells.alias("r")).select(key, "r.*")
    return rows.where(~F.col("stored_value").eqNullSafe(F.col("compared_value")))


def comparable(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Manifests of a kind that share their parents, in groups of more than one."""
    g = manifests(spark, root, kind).dropDuplicates(["id"]).groupBy("parents").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.count_distinct("config").alias("n_configs"))
    return g.where(F.size("ids") > 1)


def orphans(spark: SparkSession, root: str) -> list[str]:
    """Tables below root that no manifest names: what a lost writer left behind."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(f"{root}/tables")
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    known = {r[0] for r in manifests(spark, root).select("id").distinct().collect()}  # a row a table
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName() not in known)


def recover(spark: SparkSession, root: str) -> int:
    """Deletes the orphans, which are written again by the next save; how many there were."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = orphans(spark, root)
    for name in found:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/tables/{name}")
        path.getFileSystem(conf).delete(path, True)
    return len(found)


def runs(spark: SparkSession, root: str, dataset: str | None = None) -> DataFrame:
    """Manifests of whole runs, of one dataset if it is named."""
    out = manifests(spark, root, "run")
    return out if dataset is None else out.where(F.get_json_object("parents", "$.dataset") == dataset)


def write_reports(reports: Mapping[str, DataFrame], folder: str) -> list[str]:
    """Each report as a folder of CSV below folder, with a header; their paths."""
    out = []
    for name, df in reports.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        out.append(f"{folder}/{name}")
    return out
