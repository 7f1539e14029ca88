"""Evidence from experiments: boundaries of rankings, aggregates of repeated runs, curves.

Runs are rows of experiment_id, run_id, algorithm, status, labels_hash, k, metrics and
runtime, with sigma for runs on perturbed data; see `experiments` for the metrics.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import cluster
from .experiments import METRICS

MISSING = "MISSING"
ALL_METRICS = (*METRICS, "wcss")
# What a token of an experiment's id says of its family.
FAMILIES = {
    "init": "init_method",
    "n_init": "n_init",
    "max_iter": "max_iter",
    "linkage": "linkage",
    "eps": "eps",
    "min_samples": "min_samples",
    "covariance_type": "covariance_type",
    "init_params": "init_params",
    "m": "fuzziness_m",
}
# Statuses of decisions.
DECISIONS = (
    "SUCCESS", "FAILED", "CANDIDATE_SCENARIO", "TIED_SCENARIOS", "PENDING_REVIEW", "DEFERRED", "REPRODUCIBILITY_VERIFIED", "REPRODUCIBILITY_FAILED",
    "STABILITY_EVIDENCE_GENERATED", "PERTURBATION_EVIDENCE_GENERATED", "SIGMA_ZERO_BASELINE_MATCH", "SIGMA_ZERO_BASELINE_MISMATCH", "NOT_RECORDED",
)


def metric_value(c: str) -> Column:
    """A metric as a finite double; the missing mark, other text, NaN and infinities are NULL."""
    x = F.col(c).cast("string").try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def stage(experiment_id: Column) -> Column:
    """A, B or C of an id that names a stage, else empty."""
    return F.coalesce(F.regexp_extract(experiment_id, "stage([ABC])", 1), F.lit(""))


def scenario(transformation: Column, scaling: Column, imputation: Column) -> Column:
    """The three joined by bars; empty if any is missing."""
    parts = (transformation, scaling, imputation)
    known = F.lit(True)
    for p in parts:
        known = known & p.isNotNull() & (p != MISSING)
    return F.when(known, F.concat_ws("|", *parts)).otherwise("")


def family(experiment_id: Column) -> Column:
    """Of the fourth and later tokens between hyphens the first that names a family."""
    names = F.create_map(*(F.lit(x) for kv in FAMILIES.items() for x in kv))
    later = F.slice(F.split(experiment_id, "-"), 4, 1000)
    return F.try_element_at(F.filter(F.transform(later, lambda t: F.try_element_at(names, t)), lambda v: v.isNotNull()), F.lit(1))


def repeat_index(run_id: Column) -> Column:
    """The number after the last -r, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(run_id, r"-r(\d+)$", 1), F.lit("")).cast("int"), F.lit(0))


def with_boundaries(runs: DataFrame) -> DataFrame:
    """Adds the columns within which runs may be ranked: block, stage and scenario."""
    block = F.coalesce(F.nullif(F.col("source_block").cast("string"), F.lit("nan")), F.lit("")) if "source_block" in runs.columns else F.lit("")
    parts = ("transformation", "scaling", "imputation")
    made = scenario(*(F.col(c) for c in parts)) if set(parts) <= set(runs.columns) else F.lit("")
    return runs.withColumns({"_exp05_block": block, "_exp03_stage": stage(F.col("experiment_id")), "_exp04_scenario": made})


def names_of(runs: DataFrame, column: str) -> list[str]:
    """The distinct values of a column that names things (experiments, algorithms), in order."""
    return sorted(r[0] for r in runs.select(column).where(F.col(column).isNotNull()).distinct().collect())


def by_experiment(runs: DataFrame, experiments: Sequence[str] | None = None, column: str = "experiment_id") -> Iterator[tuple[str, DataFrame]]:
    for name in experiments if experiments is not None else names_of(runs, column):
        yield name, runs.where(F.col(column) == name)


def _repeats(runs: DataFrame, group: Sequence[str]) -> DataFrame:
    ok = F.col("status") == "SUCCESS"
    aggs = [F.count(F.lit(1)).alias("n_runs"), F.count_if(ok).alias("n_successful"), F.count_if(~ok).alias("n_failed")]
    aggs += [F.count_distinct(F.when(ok, F.col(c))).alias(f"{c}_unique_count") for c in ("labels_hash", "k")]
    for m in (*ALL_METRICS, "runtime"):
        x = F.when(ok, F.col(m))
        aggs += [F.avg(x).alias(f"{m}_mean"), F.stddev_pop(x).alias(f"{m}_std"), F.min(x).alias(f"{m}_min"), F.max(x).alias(f"{m}_max")]
    return runs.groupBy(*group).agg(*aggs)


def _identical() -> Column:
    same = F.col("labels_hash_unique_count") == 1
    for m in ALL_METRICS:
        same = same & F.coalesce(F.col(f"{m}_min") == F.col(f"{m}_max"), F.lit(True))
    return same


def repeated_runs(runs: DataFrame, group: Sequence[str] = ("algorithm",)) -> DataFrame:
    """Block R: repeats of one setting are reproducible if labels and all metrics are equal."""
    status = F.when(F.col("n_successful") == 0, "PENDING_REVIEW").when(_identical(), "REPRODUCIBILITY_VERIFIED").otherwise("REPRODUCIBILITY_FAILED")
    return _repeats(runs, group).withColumn("decision_status", status)


def seeded_runs(runs: DataFrame, group: Sequence[str] = ("algorithm",)) -> DataFrame:
    """Block S: variation over seeds, as evidence."""
    return _repeats(runs, group).withColumn("decision_status", F.when(F.col("n_successful") == 0, "PENDING_REVIEW").otherwise("STABILITY_EVIDENCE_GENERATED"))


def perturbed_runs(runs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Block N by algorithm and sigma: runs without noise must have the baseline's labels
    (algorithm, labels_hash); the others are evidence."""
    first = runs.where("status = 'SUCCESS'").groupBy("algorithm", "sigma").agg(F.min_by("labels_hash", "run_id").alias("_own"))
    base = baseline.select("algorithm", F.col("labels_hash").alias("_base"))
    out = _repeats(runs, ("algorithm", "sigma")).join(first, ["algorithm", "sigma"], "left").join(F.broadcast(base), "algorithm", "left")
    match = F.when(F.col("sigma") == 0, F.col("_own") == F.col("_base"))
    zero = F.when(match, "SIGMA_ZERO_BASELINE_MATCH").when(~match, "SIGMA_ZERO_BASELINE_MISMATCH").otherwise("PENDING_REVIEW")
    status = F.when(F.col("sigma") == 0, zero).when(F.col("n_successful") > 0, "PERTURBATION_EVIDENCE_GENERATED").otherwise("PENDING_REVIEW")
    return out.withColumns({"sigma_zero_match": match, "decision_status": status}).drop("_own", "_base")


def scenario_runs(runs: DataFrame, group: Sequence[str] = ("scenario",)) -> DataFrame:
    """Repeats of each scenario: whether they are deterministic, and their runtime."""
    made = _repeats(runs, group)
    same = (F.col("n_successful") > 0) & _identical()
    out = made.withColumns({"determinism_verified": same, "decision_status": F.when(same, "CANDIDATE_SCENARIO").otherwise("PENDING_REVIEW")})
    return out.select(*group, "n_runs", "n_successful", "runtime_mean", "runtime_std", "determinism_verified", "decision_status")


def unknown_statuses(rows: DataFrame, column: str = "decision_status", allowed: Sequence[str] = DECISIONS) -> DataFrame:
    """Distinct statuses that aren't allowed; empty and missing ones are."""
    s = F.col(column).cast("string")
    return rows.where(s.isNotNull() & ~s.isin("", MISSING, *allowed)).select(s.alias("status")).distinct().orderBy("status")


def cluster_sizes(labels: DataFrame, noise: int = -1) -> DataFrame:
    """One row a run: sizes, a map of label (noise by that name) to rows, as JSON in order."""
    g = labels.groupBy("run_id", "label").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.when(F.col("label") == noise, "noise").otherwise(F.col("label").cast("string")).alias("name"), "n")
    lists = g.groupBy("run_id").agg(F.array_sort(F.collect_list(entry)).alias("_s"))  # a row a cluster
    return lists.select("run_id", F.to_json(F.map_from_entries("_s")).alias("sizes"))


def size_facts(sizes: Column) -> Column:
    """k, largest, smallest and noise of a JSON map of sizes; all NULL for any other text."""
    m = F.from_json(sizes, "map<string,long>")
    real = F.map_values(F.map_filter(m, lambda k, v: (k != "noise") & v.isNotNull()))
    some = F.size(real) > 0
    return F.struct(F.when(some, F.size(real)).alias("k"), F.when(some, F.array_max(real)).alias("largest"), F.when(some, F.array_min(real)).alias("smallest"), F.try_element_at(m, F.lit("noise")).cast("double").alias("noise"))


def metric_curves(runs: DataFrame) -> DataFrame:
    """Metrics against the number of clusters, a row an algorithm and k of the successful runs."""
    ok = runs.where("status = 'SUCCESS' AND k IS NOT NULL")
    return ok.groupBy("algorithm", "k").agg(*(F.max_by(m, "run_id").alias(m) for m in (*ALL_METRICS, "runtime")))


def sensitivity_rows(runs: DataFrame) -> DataFrame:
    """Runs of the baseline and one-parameter stages: algorithm, parameter, value, k, metrics."""
    own = runs.where(F.col("stage").isin("A", "B"))
    return own.select("experiment_id", "algorithm", F.coalesce("sweep_parameter", F.lit("baseline")).alias("parameter"), F.col("sweep_value").alias("value"), "k", *ALL_METRICS, "status")


def compared_selection(baseline: DataFrame, selected: DataFrame) -> DataFrame:
    """The selected configuration of each algorithm beside its baseline, with differences; an
    algorithm without a baseline is kept with the status MISSING."""
    names = ("k", *ALL_METRICS)
    b = baseline.dropDuplicates(["algorithm"]).select("algorithm", F.col("status").alias("baseline_status"), *(F.col(c).alias(f"baseline_{c}") for c in names))
    j = selected.select("algorithm", "experiment_id", *(F.col(c).alias(f"selected_{c}") for c in names)).join(F.broadcast(b), "algorithm", "left")
    made = {f"{m}_difference": F.col(f"selected_{m}") - F.col(f"baseline_{m}") for m in ALL_METRICS}
    return j.withColumns({"baseline_status": F.coalesce("baseline_status", F.lit(MISSING))} | made)


def distinct_off_diagonal(pairs: DataFrame, column: str) -> int:
    """Distinct values, to twelve places, of a symmetric matrix of pairs beside its diagonal."""
    return pairs.select(F.round(column, 12).alias("v")).where("v IS NOT NULL").distinct().count()


def labels_of_run(labels: DataFrame, run_id: str) -> DataFrame:
    return labels.where(F.col("run_id") == run_id).select("key", "label")


def label_rows(labels: DataFrame, runs: DataFrame, noise: int = -1) -> DataFrame:
    """run_id, CustomerID, ClusterLabel and IsNoise of the successful runs."""
    ok = runs.where("status = 'SUCCESS'").select("run_id").distinct()
    return labels.join(F.broadcast(ok), "run_id").select("run_id", F.col("key").alias("CustomerID"), F.col("label").alias("ClusterLabel"), (F.col("label") == noise).alias("IsNoise"))


def normal_labels(labels: DataFrame, noise: int = -1) -> DataFrame:
    """CustomerID, ClusterLabel and IsNoise, made from the label where it is absent."""
    gone = {"CustomerID", "ClusterLabel"} - set(labels.columns)
    if gone:
        raise ValueError(f"labels have no {sorted(gone)}")
    flag = F.col("IsNoise") if "IsNoise" in labels.columns else F.col("ClusterLabel") == noise
    return labels.select("CustomerID", "ClusterLabel", flag.alias("IsNoise"))


def with_customers(labels: DataFrame, customers: DataFrame, noise: int = -1) -> DataFrame:
    """Labels by customer: both sides are joined on key, never by position. Different numbers
    of rows, or keys of one side only, are an error."""
    n, m = labels.count(), customers.count()
    out = labels.join(customers.select("key", "CustomerID"), "key").select("CustomerID", F.col("label").alias("ClusterLabel"), (F.col("label") == noise).alias("IsNoise"))
    if n != m or out.count() != n:
        raise ValueError(f"{n} labels do not fit {m} customers")
    return out


def random_seed(algorithm: str, default: int | None, per_algorithm: Mapping[str, int] | None = None, override: int | None = None) -> int | None:
    """An override, else the algorithm's own seed, else the default; 0 is a seed."""
    if override is not None:
        return override
    return (per_algorithm or {}).get(algorithm, default)


def k_parameters(algorithm: str, k: int, defaults: Mapping[str, Mapping[str, object]] | None = None, seed: int | None = None) -> dict:
    """An algorithm's defaults with the number of clusters, and the seed where it draws."""
    kind = cluster.REGISTRY[algorithm]
    out = dict((defaults or {}).get(algorithm, {}))
    name = next((n for n in ("n_clusters", "n_components") if n in kind.defaults), None)
    if name:
        out[name] = k
    if seed is not None and kind.random:
        out["random_state"] = seed
    return out


def interaction_settings(interactions: Sequence[Mapping], defaults: Mapping[str, Mapping[str, object]] | None = None, seed: int | None = None) -> list[dict]:
    """Stage C: for each selected number of clusters every value of every named parameter."""
    out = []
    for number, wanted in enumerate(interactions, 1):
        base = k_parameters(wanted["algorithm"], int(wanted["K"]), defaults, seed)
        for name, values in (wanted.get("parameters") or {}).items():
            for v in values if isinstance(values, (list, tuple)) else [values]:
                exp = f"EXP-03-{wanted['algorithm']}-stageC{number}-{name}-{v}-k{wanted['K']}"
                out.append({"experiment_id": exp, "algorithm": wanted["algorithm"], "stage": "C", "sweep_parameter": name, "sweep_value": v, "k": int(wanted["K"]), "params": {**base, name: v}})
    return out


#: Seeds and noise levels that are enough for a judgement.
ENOUGH_SEEDS, ENOUGH_SIGMAS = 5, 3


def stability_evidence(algorithms: DataFrame, repeats: DataFrame, seeds: DataFrame, noise: DataFrame) -> DataFrame:
    """What there is to judge each algorithm's stability by: repeats (algorithm,
    decision_status), seeds (algorithm, random_seed) and noise (algorithm, sigma)."""
    r = repeats.groupBy("algorithm").agg(F.max(F.upper("decision_status").contains("VERIFIED")).alias("_v"))
    s = seeds.groupBy("algorithm").agg(F.count_distinct("random_seed").alias("n_seeds"))
    n = noise.groupBy("algorithm").agg(F.count_distinct("sigma").alias("n_sigmas"))
    j = algorithms.select("algorithm").distinct()
    for part in (r, s, n):
        j = j.join(F.broadcast(part), "algorithm", "left")
    fixed = [a for a, kind in cluster.REGISTRY.items() if not kind.random]
    enough = lambda c, k: F.when(F.col(c) >= k, "RAW_EVIDENCE_AVAILABLE_NO_METRIC").when(F.col(c) > 0, "PARTIAL_RAW_EVIDENCE")
    return j.select(
        "algorithm",
        F.when(F.col("_v"), "VERIFIED").when(~F.col("_v"), "NOT_VERIFIED").otherwise("NOT_ASSESSABLE").alias("reproducibility"),
        enough("n_seeds", ENOUGH_SEEDS).when(F.col("algorithm").isin(fixed), "DETERMINISTIC_NO_SEED_AXIS").otherwise("NOT_ASSESSABLE").alias("seeds"),
        enough("n_sigmas", ENOUGH_SIGMAS).otherwise("NOT_ASSESSABLE").alias("perturbation"),
        F.coalesce("n_seeds", F.lit(0)).alias("n_seeds"),
        F.coalesce("n_sigmas", F.lit(0)).alias("n_sigmas"),
    )


def _spread(names: Sequence[str]) -> list[Column]:
    """Count, least, greatest and mean of each metric."""
    made = {"n": F.count, "min": F.min, "max": F.max, "mean": F.avg}
    return [f(m).alias(f"{m}_{name}") for m in names for name, f in made.items()]


def by_hyperparameter(runs: DataFrame, names: Sequence[str] = ALL_METRICS) -> DataFrame:
    """A row for each algorithm and family of parameters of the parameter search (EXP-03): runs,
    distinct settings, least and greatest number of clusters, and the spread of the metrics.
    Runs of other experiments vary other things and are left out, as are ids of no family."""
    found = runs.where("source_experiment = 'EXP-03' AND algorithm <> ''").withColumn("hyperparameter_family", family(F.col("experiment_id")))
    found = found.where(F.col("hyperparameter_family").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.count_distinct("hyperparameters").alias("n_unique_values"), F.min("n_clusters").alias("k_min"), F.max("n_clusters").alias("k_max")]
    return found.groupBy("algorithm", "hyperparameter_family").agg(*aggs, *_spread(names))


def by_preprocessing(runs: DataFrame, names: Sequence[str] = ALL_METRICS) -> DataFrame:
    """A row for each algorithm and scenario of preprocessing (EXP-04)."""
    made = scenario(F.col("transformation"), F.col("scaling"), F.col("imputation"))
    found = runs.where("source_experiment = 'EXP-04' AND algorithm <> ''").withColumn("scenario", made).where("scenario <> ''")
    return found.groupBy("algorithm", "scenario").agg(F.count(F.lit(1)).alias("n_rows"), *_spread(names))


def complete(runs: DataFrame, names: Sequence[str] = ALL_METRICS) -> DataFrame:
    """The runs with all of the metrics."""
    return runs.dropna(subset=list(names))


def quality_overview(runs: DataFrame, names: Sequence[str] = ALL_METRICS) -> DataFrame:
    """(part, name, n, fraction): all rows, those with all metrics, distinct algorithms, rows
    with each metric, rows with all metrics of each algorithm, and DBSCAN's noise in all."""
    whole = F.lit(True)
    for m in names:
        whole = whole & F.col(m).isNotNull()
    full = F.count_if(whole)
    dbscan = F.coalesce(F.sum(F.when(F.col("algorithm") == "dbscan", F.col("noise_count"))), F.lit(0))
    one = runs.agg(F.count(F.lit(1)).alias("n"), full.alias("full"), F.count_distinct("algorithm").alias("algorithms"), dbscan.cast("long").alias("noise"), *(F.count(m).alias(m) for m in names))
    cell = lambda part, name, n, share=None: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), F.col(n).alias("n"), (F.try_divide(F.col(n), F.col("n")) if share else F.lit(None).cast("double")).alias("fraction"))
    cells = [cell("rows", "all", "n"), cell("rows", "all metrics", "full", True), cell("algorithms", "all", "algorithms"), cell("noise", "dbscan", "noise"), *(cell("metric", m, m, True) for m in names)]
    each = runs.where("algorithm <> ''").groupBy("algorithm").agg(full.alias("n"), (full / F.count(F.lit(1))).alias("fraction"))
    rows = one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")
    return rows.unionByName(each.select(F.lit("algorithm").alias("part"), F.col("algorithm").alias("name"), "n", "fraction"))
