"""Collectors: result files of the five kinds of experiments as rows of one schema.

Each kind has a file of results, a manifest and a few columns of its own; a collector is a
projection of the file to the common columns. A missing value is NULL, and why it is missing
stands in the column with _missing_reason behind its name. A missing file gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.evidence import metric_value, size_facts

# The published columns in their order, and what isn't text among them.
SCHEMA = (
    ("source_experiment", "string"), ("experiment_id", "string"), ("source_block", "string"), ("source_run_id", "string"), ("record_granularity", "string"),
    ("repeat_index", "long"), ("n_repeats_total", "long"),
    ("algorithm", "string"), ("dataset_version", "string"), ("feature_set", "string"), ("transformation", "string"), ("scaling", "string"), ("imputation", "string"),
    ("n_clusters", "long"), ("hyperparameters", "string"), ("random_seed", "long"),
    ("silhouette", "double"), ("davies_bouldin", "double"), ("calinski_harabasz", "double"), ("wcss", "double"), ("execution_time_seconds", "double"),
    ("n_clusters_realized", "long"), ("cluster_size_largest", "long"), ("cluster_size_smallest", "long"), ("noise_count", "long"), ("noise_ratio", "double"),
    ("silhouette_status", "string"), ("davies_bouldin_status", "string"), ("calinski_harabasz_status", "string"), ("wcss_status", "string"),
    ("algorithm_missing_reason", "string"), ("dataset_version_missing_reason", "string"), ("feature_set_missing_reason", "string"),
    ("transformation_missing_reason", "string"), ("scaling_missing_reason", "string"), ("imputation_missing_reason", "string"),
    ("n_clusters_missing_reason", "string"), ("hyperparameters_missing_reason", "string"), ("random_seed_missing_reason", "string"),
    ("silhouette_missing_reason", "string"), ("davies_bouldin_missing_reason", "string"), ("calinski_harabasz_missing_reason", "string"),
    ("wcss_missing_reason", "string"), ("execution_time_seconds_missing_reason", "string"), ("n_clusters_realized_missing_reason", "string"),
    ("cluster_size_largest_missing_reason", "string"), ("cluster_size_smallest_missing_reason", "string"), ("noise_count_missing_reason", "string"),
    ("noise_ratio_missing_reason", "string"), ("repeat_index_missing_reason", "string"), ("n_repeats_total_missing_reason", "string"),
    ("sigma_missing_reason", "string"), ("perturbation_seed_missing_reason", "string"),
    ("run_status", "string"), ("failure_reason", "string"), ("labels_hash", "string"), ("feature_set_sha256", "string"), ("customer_metadata_sha256", "string"),
    ("config_sha256", "string"), ("input_sha256", "string"), ("sigma", "double"), ("perturbation_seed", "long"),
    ("library_versions", "string"), ("platform", "string"), ("timestamp", "string"), ("source_artifact", "string"),
    ("decision_status", "string"), ("evidence_note", "string"),
)
STATUSES = ("silhouette_status", "davies_bouldin_status", "calinski_harabasz_status", "wcss_status")
REASON = "_missing_reason"
DIFFERENT, ABSENT, NOT_APPLICABLE, NOT_RECORDED = "DIFFERENT_CONDITIONS", "FIELD_NOT_IN_SOURCE", "NOT_APPLICABLE", "NOT_RECORDED"
DATASET, FEATURE_SET, SEED = "FE06-v1.0", "rfm_extended", 42
PARAMETERS = ("init", "max_iter", "n_clusters", "n_init", "random_state", "tol", "compute_distances", "linkage", "metric", "eps", "min_samples", "covariance_type", "init_params", "n_components", "reg_covar", "error", "m")


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def manifest(spark: SparkSession, path: str) -> dict:
    """A manifest's JSON; empty if there is no such file, or no JSON object in it. A file that
    is there but can't be read is an error. One small file."""
    if not exists(spark, path):
        return {}
    rows = spark.read.text(path, wholetext=True).collect()
    try:
        found = json.loads(rows[0][0]) if rows else {}
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def results_file(spark: SparkSession, path: str) -> DataFrame | None:
    """A CSV file with a header, all text, blank and nan as NULL; None without the file."""
    if not exists(spark, path):
        return None
    df = spark.read.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    clean = {c: F.when(~F.lower(F.trim(F.col(f"`{c}`"))).isin("", "nan"), F.col(f"`{c}`")) for c in df.columns}
    return df.withColumns(clean) if clean else df


@dataclass
class Fields:
    """Columns of a file by name (NULL where the file has none), as text, whole or real numbers."""

    df: DataFrame

    def text(self, name: str) -> Column:
        return F.col(f"`{name}`") if name in self.df.columns else F.lit(None).cast("string")

    def whole(self, name: str) -> Column:
        return self.real(name).cast("long")

    def real(self, name: str) -> Column:
        return metric_value(f"`{name}`") if name in self.df.columns else F.lit(None).cast("double")


@dataclass
class Made:
    """Values of common columns and, where one may be NULL, the reason."""

    values: dict[str, Column] = field(default_factory=dict)
    reasons: dict[str, str] = field(default_factory=dict)


def standard(df: DataFrame, experiment: str, path: str, made: Made, info: Mapping | None = None) -> DataFrame:
    """The rows with an algorithm, in the published columns; info: the experiment's manifest,
    whose hashes, versions and time stand where the file has none. source_artifact is the
    file's path from the folder of all reports on."""
    values = {"source_experiment": F.lit(experiment), "source_artifact": F.lit("/".join(path.split("/")[-2:])), **_provenance(info or {}), **made.values}

    def column(name: str, kind: str) -> Column:
        if not name.endswith(REASON):
            return values.get(name, F.lit(None)).cast(kind)
        of = name.removesuffix(REASON)
        known = values.get(of, F.lit(None)).cast(dict(SCHEMA)[of])
        return F.when(known.isNull(), made.reasons.get(of, NOT_APPLICABLE)).otherwise("")

    return df.where(values["algorithm"].isNotNull()).select(*(column(n, k).alias(n) for n, k in SCHEMA))


def _provenance(info: Mapping) -> dict[str, Column]:
    def text(*names: str) -> Column:
        found = next((info[n] for n in names if info.get(n)), None)
        return F.lit(found if found is None or isinstance(found, str) else json.dumps(found, sort_keys=True, ensure_ascii=False)).cast("string")

    return {
        "feature_set_sha256": text("feature_set_sha256", "input_sha256"), "customer_metadata_sha256": text("customer_metadata_sha256"), "config_sha256": text("config_sha256"),
        "input_sha256": text("input_sha256"), "library_versions": text("library_versions"), "platform": text("platform_info", "platform"),
        "timestamp": text("timestamp", "generated_at", "started_at", "completed_at"),
    }


def _metrics(f: Fields, runtime: str) -> Made:
    values = {m: f.real(m) for m in ("silhouette", "davies_bouldin", "calinski_harabasz", "wcss")}
    reasons = dict.fromkeys((*values, "execution_time_seconds"), NOT_RECORDED)
    values |= {s: F.coalesce(f.text(s), F.lit("MISSING")) for s in STATUSES}
    values["execution_time_seconds"] = f.real(runtime)
    values["run_status"] = F.coalesce(f.text("status"), F.lit("SUCCESS"))
    values["algorithm"] = f.text("algorithm")
    values |= {"dataset_version": F.lit(DATASET), "feature_set": F.lit(FEATURE_SET), "failure_reason": F.lit(""), "evidence_note": F.lit(""), "source_block": F.lit(""), "decision_status": F.lit("SUCCESS"), "repeat_index": F.lit(0)}
    reasons |= dict.fromkeys(("transformation", "scaling", "imputation"), DIFFERENT)
    reasons |= dict.fromkeys(("cluster_size_largest", "cluster_size_smallest", "hyperparameters"), ABSENT)
    return Made(values, reasons)


def _lookup(entries: list, key: str, column: Column) -> Column:
    """Hyperparameters of the manifest's entry whose key is the column's value, as JSON."""
    found = {str(e.get(key, "")): json.dumps(e["hyperparameters"], sort_keys=True, ensure_ascii=False) for e in entries if isinstance(e, Mapping) and e.get("hyperparameters")}
    if not found:
        return F.lit(None).cast("string")
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in found.items() for x in kv)), column)


def _baseline(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row an algorithm."""
    path = f"{folder}/exp01_baseline_summary.csv"
    df = results_file(spark, path)
    if df is None:
        return None
    info = manifest(spark, f"{folder}/exp01_baseline_manifest.json")
    f, m = Fields(df), _metrics(Fields(df), "runtime_mean_seconds")
    config = info.get("config") or {}
    dbscan = f.text("algorithm") == "dbscan"
    name = F.concat(F.lit("EXP-01-"), f.text("algorithm"))
    m.values |= {
        "record_granularity": F.lit("PER_AGGREGATE"), "experiment_id": name, "source_run_id": name, "n_clusters": f.whole("n_clusters"), "n_clusters_realized": f.whole("n_clusters"),
        "noise_count": F.when(dbscan, F.coalesce(f.whole("noise_count"), F.lit(0))).otherwise(0), "noise_ratio": F.when(dbscan, F.coalesce(f.real("noise_ratio"), F.lit(0.0))).otherwise(0.0),
        "n_repeats_total": F.coalesce(f.whole("n_repeats_total"), F.lit(config.get("runtime_repeat")).cast("long")),
        "random_seed": F.coalesce(f.whole("random_seed"), F.lit(config.get("baseline_seed")).cast("long")),
        "hyperparameters": _lookup(info.get("algorithms") or [], "algorithm", f.text("algorithm")),
    }
    return standard(df, "EXP-01", path, m, info)


def _numbers_of_clusters(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row an algorithm and number of clusters."""
    path = f"{folder}/exp02_cluster_number_summary.csv"
    df = results_file(spark, path)
    if df is None:
        return None
    info = manifest(spark, f"{folder}/exp02_manifest.json")
    f, m = Fields(df), _metrics(Fields(df), "runtime_mean_seconds")
    config = info.get("config") or {}
    dbscan, gmm = f.text("algorithm") == "dbscan", f.text("algorithm") == "gmm"
    listed = _lookup(info.get("results") or [], "experiment_id", f.text("experiment_id"))
    by_k = F.when(f.whole("K").isNotNull() & ~dbscan, F.concat(F.when(gmm, '{"n_components": ').otherwise('{"n_clusters": '), f.whole("K").cast("string"), F.lit("}")))
    with_k = F.when(listed.contains('"n_clusters"') | listed.contains('"n_components"') | by_k.isNull(), listed)
    joined = F.concat(F.expr("'{'"), F.regexp_extract(by_k, r"^\{(.*)\}$", 1), F.lit(", "), F.regexp_extract(listed, r"^\{(.*)\}$", 1), F.lit("}"))
    m.values |= {
        "record_granularity": F.lit("PER_AGGREGATE"), "experiment_id": f.text("experiment_id"), "source_run_id": f.text("experiment_id"),
        "n_clusters": F.coalesce(f.whole("n_clusters"), f.whole("K")), "n_clusters_realized": f.whole("n_clusters"),
        "noise_count": F.when(dbscan, f.whole("noise_count")).otherwise(F.coalesce(f.whole("noise_count"), F.lit(0))), "noise_ratio": F.when(dbscan, f.real("noise_ratio")).otherwise(F.coalesce(f.real("noise_ratio"), F.lit(0.0))),
        "n_repeats_total": F.lit(config.get("runtime_repeat")), "random_seed": F.coalesce(f.whole("random_seed"), F.lit(config.get("baseline_seed")).cast("long"), F.lit(SEED)),
        "hyperparameters": F.coalesce(with_k, joined, by_k),
    }
    m.reasons |= {"noise_count": NOT_RECORDED, "noise_ratio": NOT_RECORDED}
    return standard(df, "EXP-02", path, m, info)


def _parameters(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row a setting of a hyperparameter search."""
    path = f"{folder}/exp03_hyperparameter_results.csv"
    df = results_file(spark, path)
    if df is None:
        return None
    info = manifest(spark, f"{folder}/exp03_manifest.json")
    config = info.get("config") or {}
    f, m = Fields(df), _metrics(Fields(df), "runtime_mean_seconds")
    swept = f.text("sweep_parameter").isNotNull()
    settings = [f.text(f"hp_{p}").alias(p) for p in PARAMETERS] + [f.text("sweep_parameter").alias("_sweep_parameter"), F.when(swept, f.text("sweep_value")).alias("_sweep_value"), F.when(swept, f.text("stage")).alias("_stage")]
    m.values |= {
        "record_granularity": F.lit("PER_RUN"), "experiment_id": f.text("experiment_id"), "source_run_id": f.text("experiment_id"), "n_clusters": F.coalesce(f.whole("n_clusters"), f.whole("baseline_k")),
        "n_clusters_realized": f.whole("n_clusters"), "noise_count": F.lit(0), "noise_ratio": F.lit(0.0), "n_repeats_total": F.lit(config.get("runtime_repeat")),
        "random_seed": F.coalesce(f.whole("hp_random_state"), F.lit(SEED)), "hyperparameters": F.nullif(F.to_json(F.struct(*settings)), F.lit("{}")),
    }
    return standard(df, "EXP-03", path, m, info)


def _scenarios(spark: SparkSession, folder: str) -> DataFrame | None:
    """A row a repeat of a preprocessing scenario; its id is the scenario's with -rNN."""
    path = f"{folder}/exp04_scenario_results.csv"
    df = results_file(spark, path)
    if df is None:
        return None
    info = manifest(spark, f"{folder}/exp04_manifest.json")
    f, m = Fields(df), _metrics(Fields(df), "runtime_seconds")
    repeat = F.coalesce(f.whole("repeat_index"), F.lit(0))
    name = F.concat(f.text("scenario_id"), F.lit("-r"), F.lpad(repeat.cast("string"), 2, "0"))
    settings = F.to_json(F.struct(f.whole("n_clusters").alias("n_clusters"), F.lit("k-means++").alias("init"), F.lit(10).alias("n_init"), F.lit(300).alias("max_iter"), F.lit(0.0001).alias("tol"), f.whole("random_seed").alias("random_state"), f.text("config_id").alias("_config_id"), f.text("role").alias("_role")))
    m.values |= {
        "record_granularity": F.lit("PER_RUN"), "experiment_id": name, "source_run_id": name, "repeat_index": repeat, "n_repeats_total": F.coalesce(F.nullif(f.whole("n_total_repeats"), F.lit(0)), F.lit(5)),
        "feature_set": F.coalesce(f.text("feature_set"), F.lit(FEATURE_SET)), "transformation": f.text("transformation"), "scaling": f.text("scaling"), "imputation": f.text("imputation"),
        "n_clusters": f.whole("n_clusters"), "n_clusters_realized": f.whole("n_clusters_realized"), "noise_count": F.lit(0), "noise_ratio": F.lit(0.0), "random_seed": F.coalesce(f.whole("random_seed"), F.lit(SEED)),
        "hyperparameters": settings, "failure_reason": F.coalesce(f.text("failure_reason"), F.lit("")), "labels_hash": f.text("labels_hash"),
        "decision_status": F.coalesce(f.text("decision_status"), F.lit("CANDIDATE_SCENARIO")), "evidence_note": F.coalesce(f.text("evidence_note"), F.lit("")),
    }
    m.reasons |= dict.fromkeys(("transformation", "scaling", "imputation", "n_clusters", "n_clusters_realized", "labels_hash"), NOT_RECORDED)
    return standard(df, "EXP-04", path, m, info)


# Files of the blocks of repeats, seeds and noise.
BLOCKS = {"R": "exp05_reproducibility_results.csv", "S": "exp05_seed_sweep_results.csv", "N": "exp05_noise_perturbation_results.csv"}


def stability_block(spark: SparkSession, path: str, block: str) -> DataFrame | None:
    """A row a run of one block of the stability experiment."""
    df = results_file(spark, path)
    if df is None:
        return None
    f, m = Fields(df), _metrics(Fields(df), "runtime_seconds")
    sizes = size_facts(f.text("cluster_sizes"))
    m.values |= {
        "record_granularity": F.lit("PER_RUN"), "experiment_id": f.text("run_id"), "source_run_id": f.text("run_id"), "source_block": F.lit(block), "repeat_index": F.coalesce(f.whole("repeat_index"), F.lit(0)),
        "n_repeats_total": F.coalesce(F.nullif(f.whole("n_repeat"), F.lit(0)), F.lit(5 if block == "R" else 1)), "dataset_version": F.coalesce(f.text("feature_set"), F.lit(DATASET)),
        "n_clusters": f.whole("n_clusters_realized"), "n_clusters_realized": sizes["k"], "cluster_size_largest": sizes["largest"], "cluster_size_smallest": sizes["smallest"],
        "noise_count": F.coalesce(f.whole("noise_count"), sizes["noise"].cast("long")), "noise_ratio": f.real("noise_ratio"), "random_seed": f.whole("seed"), "hyperparameters": F.nullif(f.text("hyperparameters"), F.lit("{}")),
        "feature_set_sha256": f.text("feature_set_sha256"), "customer_metadata_sha256": f.text("customer_metadata_sha256"), "config_sha256": f.text("config_sha256"),
        "input_sha256": f.text("feature_set_sha256"), "library_versions": f.text("library_versions"), "platform": f.text("platform_info"),
        "labels_hash": f.text("labels_hash"), "sigma": f.real("sigma"), "perturbation_seed": f.whole("perturbation_seed"), "failure_reason": F.coalesce(f.text("failure_reason"), F.lit("")),
        "decision_status": F.coalesce(f.text("decision_status"), F.lit("SUCCESS")), "evidence_note": F.coalesce(f.text("evidence_note"), F.lit("")),
    }
    m.reasons |= dict.fromkeys(("noise_count", "noise_ratio", "labels_hash"), NOT_RECORDED)
    return standard(df, "EXP-05", path, m)


def _stability(spark: SparkSession, folder: str) -> DataFrame | None:
    return _union([stability_block(spark, f"{folder}/{name}", b) for b, name in BLOCKS.items()])


def _union(parts: list[DataFrame | None]) -> DataFrame | None:
    out = None
    for p in parts:
        out = p if out is None else out if p is None else out.unionByName(p)
    return out


COLLECTORS = {"exp01": _baseline, "exp02": _numbers_of_clusters, "exp03": _parameters, "exp04": _scenarios, "exp05": _stability}


def collect(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Rows of one kind of experiment (exp01 to exp05) from its folder."""
    found = COLLECTORS[kind](spark, folder)
    return found if found is not None else empty(spark)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ", ".join(f"{n} {k}" for n, k in SCHEMA))


def build_repository(spark: SparkSession, reports: str) -> DataFrame:
    """All experiments below a folder of reports, each in a folder of its kind's name."""
    return _union([empty(spark), *(make(spark, f"{reports}/{kind}") for kind, make in COLLECTORS.items())])


def selected_configurations(spark: SparkSession, path: str) -> DataFrame:
    found = results_file(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return found


def baseline_stage(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the search's stage A."""
    return selected_configurations(spark, path).where("stage = 'A'")


def candidate_numbers(spark: SparkSession, path: str) -> dict[str, list[int]]:
    """The candidate numbers of clusters of each algorithm; empty without the file."""
    df = results_file(spark, path)
    if df is None:
        return {}
    rows = df.select("algorithm", F.col("K").try_cast("double").cast("int").alias("k")).where("k IS NOT NULL").distinct().collect()
    out: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r["algorithm"], r["k"])):
        out.setdefault(r["algorithm"], []).append(r["k"])
    return out


def stability_aggregates(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The aggregate files of the stability experiment that are there, by block."""
    names = {"R": "exp05_reproducibility_aggregate.csv", "S": "exp05_seed_sweep_aggregate.csv", "N": "exp05_noise_perturbation_aggregate.csv"}
    found = {b: results_file(spark, f"{folder}/{n}") for b, n in names.items()}
    return {b: df for b, df in found.items() if df is not None}


def decisions(spark: SparkSession, path: str) -> dict[str, str]:
    """Feature and decision of a selection report; empty without the file or its columns."""
    df = results_file(spark, path)
    if df is None or not {"Feature", "Decision"} <= set(df.columns):
        return {}
    return {r["Feature"]: r["Decision"] for r in df.select("Feature", "Decision").collect()}  # a row a feature


def preflight(spark: SparkSession, path: str, formats: tuple[str, ...] = ("csv", "parquet"), most_mb: float = 500.0, root: str | None = None) -> tuple[str, int, list[str]]:
    """(sha256, bytes, errors) of a file before its import: it must be there and readable, of a
    known format, no larger than allowed and, where a root is given, below it. The hash is of
    the file's bytes, and empty if there are errors."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    errors: list[str] = []
    size = 0
    if not fs.exists(where):
        return "", 0, [f"not found: {path}"]
    status = fs.getFileStatus(where)
    if not status.isFile():
        errors.append(f"no regular file: {path}")
    size = status.getLen()
    ending = path.rsplit(".", 1)[-1].lower() if "." in path.rsplit("/", 1)[-1] else ""
    if ending not in formats:
        errors.append(f"format {ending!r} is none of {sorted(formats)}")
    if root is not None:
        top = fs.makeQualified(jvm.org.apache.hadoop.fs.Path(root)).toString().rstrip("/")
        if not fs.makeQualified(where).toString().startswith(top + "/") or "/../" in path:
            errors.append(f"outside {root}: {path}")
    if size > most_mb * 1024 * 1024:
        errors.append(f"{size} bytes are over {most_mb:g} MB")
    return (file_digest(spark, path) if not errors else ""), size, errors


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes on any file system, in one task; a file of 2 GB or more is an
    error, as one row holds it."""
    row = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()
    return row["h"]
