"""Sweeps, selection protocols, stability, and analysis of a table of experiment results.

Results are rows of experiment_id, run_id, algorithm, k, status and metrics (silhouette,
davies_bouldin, calinski_harabasz, wcss, runtime); a missing metric is NULL.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.stats import ratio
from . import cluster, metrics, prep
from .tables import written

#: Whether more of a metric is better.
BETTER = {"silhouette": True, "calinski_harabasz": True, "davies_bouldin": False, "wcss": False}
METRICS = ("silhouette", "davies_bouldin", "calinski_harabasz")


def by_metric(m: str) -> Column:
    return F.desc_nulls_last(m) if BETTER[m] else F.asc_nulls_last(m)


def run_one(points: DataFrame, algorithm: str, params: dict, repeats: int = 1, silhouette: bool = True) -> dict:
    """Fits `repeats` times; times from all, labels and metrics from the last."""
    times, found = [], None
    try:
        for _ in range(repeats):
            began = time.perf_counter()
            found = cluster.make(algorithm, **params).fit(points)
            found.labels.write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
    except (ValueError, TypeError) as e:
        return {"algorithm": algorithm, "status": "FAILED", "reason": str(e)}
    joined = points.join(found.labels.select("key", "label"), "key").persist()
    row = metrics.internal_metrics(joined).first().asDict()
    row["silhouette"] = metrics.silhouette(joined).first()[0] if silhouette else None
    joined.unpersist()
    return {"algorithm": algorithm, "status": "SUCCESS", "reason": None, "runtime": sum(times) / len(times), "labels": found.labels, "info": found.info, **row}


def sweep(points: DataFrame, algorithms: Sequence[str] = ("kmeans", "agglomerative", "dbscan", "gmm", "fuzzy_cmeans"), ks: Sequence[int] = range(2, 11), seed: int = 42, repeats: int = 1) -> DataFrame:
    """A row for each algorithm and number of clusters; DBSCAN, which has no such number, gives
    one row without k, that of its defaults.

    Algorithms that iterate over sums advance together, in the same passes over the points, all
    numbers of clusters of agglomerative clustering are cut from one tree, and their metrics
    share passes as well; their runtime is an equal part of the time of all. DBSCAN is fitted by
    itself. Fits are timed `repeats` times."""
    runs = []
    for a in algorithms:
        if a in WITHOUT_K:
            runs.append((f"{a}-diagnostic", a, {}))
        else:
            runs += [(f"{a}-k{k}", a, _with_k(a, k, seed)) for k in ks]
    return fitted(points, runs, "sweep", repeats)


#: Algorithms that find the number of clusters themselves.
WITHOUT_K = ("dbscan",)


def _with_k(algorithm: str, k: int, seed: int) -> dict:
    return {"n_components" if algorithm == "gmm" else "n_clusters": k} | ({"random_state": seed} if cluster.REGISTRY[algorithm].random else {})


def fitted(points: DataFrame, runs: Sequence[tuple[str, str, dict]], experiment: str, repeats: int = 1) -> DataFrame:
    """A row of results for each run (run_id, algorithm, parameters), in their order."""
    n = points.count()
    rows: dict[str, tuple] = {}
    shared: list[tuple[str, str, cluster.Iterative]] = []
    trees: dict[tuple, list[tuple[str, str, cluster.Agglomerative]]] = {}
    for name, a, params in runs:
        try:
            made = cluster.make(a, **params)
        except (KeyError, TypeError):
            rows[name] = (experiment, name, a, None, "FAILED", *[None] * 5)
            continue
        if isinstance(made, cluster.Iterative):
            if 1 <= made.k <= n:
                shared.append((name, a, made))
            else:
                rows[name] = (experiment, name, a, made.k, "FAILED", *[None] * 5)
        elif isinstance(made, cluster.Agglomerative):
            if 1 <= made.params["n_clusters"] < n:
                trees.setdefault((made.params["linkage"], made.params["metric"]), []).append((name, a, made))
            else:
                rows[name] = (experiment, name, a, made.params["n_clusters"], "FAILED", *[None] * 5)
        else:
            r = run_one(points, a, params, repeats)
            rows[name] = (experiment, name, a, None, r["status"], *(r.get(m) for m in (*METRICS, "wcss", "runtime")))

    def timed(fit: Callable[[], DataFrame], models: int) -> tuple[DataFrame, float]:
        began = time.perf_counter()
        for _ in range(repeats):
            found = written(fit(), "labels")
        return found, (time.perf_counter() - began) / repeats / models

    labels, order = None, []
    if shared:
        labels, each = timed(lambda: cluster.fit_many(points, [m for _, _, m in shared])[0].select("key", "labels", "x"), len(shared))
        order += [(name, a, m.k, each) for name, a, m in shared]
    for group in trees.values():
        ks = [m.params["n_clusters"] for _, _, m in group]
        try:
            cuts, each = timed(lambda: group[0][2].cuts(points, ks).labels, len(group))
        except ValueError:
            rows |= {name: (experiment, name, a, k, "FAILED", *[None] * 5) for (name, a, _), k in zip(group, ks)}
            continue
        if labels is None:
            labels = cuts.join(points.select("key", F.col("x").cast("array<double>").alias("x")), "key")
        else:
            labels = labels.join(cuts.withColumnRenamed("labels", "_more"), "key").select("key", F.concat("labels", "_more").alias("labels"), "x")
        order += [(name, a, k, each) for (name, a, _), k in zip(group, ks)]
    if labels is not None:
        labels = written(labels, "labelled") if trees else labels
        found = metrics.quality_by_model(labels, [k for *_, k, _ in order])
        means = metrics.silhouettes_by_model(labels).groupBy("model").agg(F.avg("silhouette").alias("s")).collect()  # a row a model
        silhouettes = {r["model"]: r["s"] for r in means}
        for t, ((name, a, k, each), (_, _, wcss, ch, db)) in enumerate(zip(order, found)):
            rows[name] = (experiment, name, a, k, "SUCCESS", silhouettes.get(t), db, ch, wcss, each)
    return results(points.sparkSession, [rows[name] for name, _, _ in runs])


def results(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    schema = "experiment_id string, run_id string, algorithm string, k int, status string, silhouette double, davies_bouldin double, calinski_harabasz double, wcss double, runtime double"
    return spark.createDataFrame(list(rows), schema)


def one_at_a_time(algorithm: str, baseline: dict, space: dict[str, Sequence]) -> list[dict]:
    """The baseline and every setting that differs from it in one parameter."""
    if algorithm not in cluster.REGISTRY:
        raise KeyError(algorithm)
    return [dict(baseline)] + [{**baseline, name: v} for name, values in space.items() for v in values if v != baseline.get(name)]


def candidate_k(df: DataFrame, top_n: int = 2, drop: float = 0.2, agreement: int = 2) -> DataFrame:
    """Numbers of clusters that several kinds of evidence agree on, for each algorithm.

    Evidence: among the best top_n by each metric; WCSS lower by `drop` of the previous K's.
    Runs without k are left out."""
    df = df.where("k IS NOT NULL")
    w = lambda m: W.partitionBy("algorithm").orderBy(by_metric(m), "k")
    before = F.lag("wcss").over(W.partitionBy("algorithm").orderBy("k"))
    marks = {m: F.when(F.col(m).isNotNull() & (F.row_number().over(w(m)) <= top_n), m) for m in METRICS}
    marks["elbow"] = F.when(ratio(before - F.col("wcss"), before) >= drop, "elbow")
    out = df.select("algorithm", "k", F.array_compact(F.array(*marks.values())).alias("evidence"))
    return out.withColumn("n_evidence", F.size("evidence")).where(F.col("n_evidence") >= agreement)


def selected(df: DataFrame, group: Sequence[str] = ("algorithm",)) -> DataFrame:
    """The best run of each group with all metrics: silhouette, then Davies-Bouldin, then
    Calinski-Harabasz, then run id; and whether another is as good."""
    order = [by_metric(m) for m in METRICS]
    full = df.where(" AND ".join(f"{m} IS NOT NULL" for m in METRICS))
    w = W.partitionBy(*group)
    ranked = full.withColumns({"_r": F.rank().over(w.orderBy(*order)), "_n": F.row_number().over(w.orderBy(*order, "run_id"))})
    ties = F.sum((F.col("_r") == 1).cast("int")).over(w)
    return ranked.withColumn("tied", ties > 1).where("_n = 1").drop("_r", "_n")


def metric_ranks(df: DataFrame, metric: str, within: Sequence[str]) -> DataFrame:
    """Ranks (ties the least) within a boundary; without the metric, no rank."""
    r = F.rank().over(W.partitionBy(*within).orderBy(by_metric(metric)))
    return df.withColumn(f"rank_{metric}", F.when(F.col(metric).isNotNull(), r))


def metric_conflicts(df: DataFrame, within: Sequence[str], tolerance: int = 1) -> DataFrame:
    """Runs whose ranks by silhouette and by another metric differ by more than the tolerance."""
    out = df
    for m in METRICS:
        out = metric_ranks(out, m, within)
    a, b, c = (F.col(f"rank_{m}") for m in METRICS)
    out = out.withColumns({"diff_db": F.abs(a - b), "diff_ch": F.abs(a - c)})
    return out.withColumns({"conflict_db": F.coalesce(F.col("diff_db") > tolerance, F.lit(False)), "conflict_ch": F.coalesce(F.col("diff_ch") > tolerance, F.lit(False))})


def summary(df: DataFrame, group: Sequence[str], names: Sequence[str] = METRICS) -> DataFrame:
    """Runs, successes, failures and count, least, greatest and mean of each metric by group."""
    aggs = [F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("status") == "SUCCESS").alias("n_success"), F.count_if(F.col("status") == "FAILED").alias("n_failed")]
    for m in names:
        aggs += [F.count(m).alias(f"{m}_n"), F.min(m).alias(f"{m}_min"), F.max(m).alias(f"{m}_max"), F.avg(m).alias(f"{m}_mean")]
    return df.groupBy(*group).agg(*aggs)


def metrics_long(df: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """n, min, max, mean and sample deviation (0 of one value) for each experiment and metric."""
    long = df.unpivot("experiment_id", list(names), "metric", "value").where("value IS NOT NULL")
    std = F.when(F.count("value") == 1, F.lit(0.0)).otherwise(F.stddev_samp("value"))
    return long.groupBy("experiment_id", "metric").agg(F.count("value").alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), std.alias("std"))


def field_coverage(df: DataFrame) -> DataFrame:
    """field, present and missing values of each column."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *(F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"c{i}").alias("present"), (F.col("n") - F.col(f"c{i}")).alias("missing")) for i, c in enumerate(df.columns))))
    return one.select(rows.alias("r")).select("r.*")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SHA-256 of the key fields that several rows share, with how many."""
    text = F.concat_ws("|", *(F.coalesce(F.col(k).cast("string"), F.lit("MISSING")) for k in keys))
    return df.groupBy(F.sha2(text, 256).alias("identity")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def inconsistent(df: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Key groups in which a field has several values, with the names of such fields."""
    g = df.groupBy(*keys).agg(*(F.count_distinct(F.coalesce(F.col(f).cast("string"), F.lit("MISSING"))).alias(f"_{f}") for f in fields))
    differ = F.array_compact(F.array(*(F.when(F.col(f"_{f}") > 1, f) for f in fields)))
    return g.select(*keys, differ.alias("fields")).where(F.size("fields") > 0)


def variation(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """mean, population deviation, least, greatest, their quotient cv and distinct values."""
    g = df.groupBy(*group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count_distinct(value).alias("unique_count"))
    return g.withColumn("cv", ratio("std", "mean"))


def labels_hash(labels: DataFrame) -> str:
    """A digest of all (key, label) rows, the same in any order."""
    h = F.xxhash64("key", "label").cast("decimal(38,0)")
    row = labels.agg(F.sum(h).alias("s"), F.bit_xor(F.xxhash64("key", "label")).alias("x"), F.count(F.lit(1)).alias("n")).first()
    return f"{row['s']}:{row['x']}:{row['n']}"


def pairwise_agreement(labels: DataFrame, run: str = "run_id", within: Sequence[str] = ()) -> DataFrame:
    """within, run_a, run_b, ari, ami, nmi of each pair of runs over the keys that they share.

    labels: rows of run, key and label. Contingencies of all pairs come from one join by key;
    each pair's table, a row a pair of labels, is one group's work on an executor."""
    a = labels.select(*within, F.col(run).alias("run_a"), "key", F.col("label").alias("a"))
    b = labels.select(*within, F.col(run).alias("run_b"), "key", F.col("label").alias("b"))
    cells = a.join(b, [*within, "key"]).where("run_a < run_b").groupBy(*within, "run_a", "run_b", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    keys = [*within, "run_a", "run_b"]
    kinds = dict(cells.dtypes)

    def agree(f: pd.DataFrame) -> pd.DataFrame:
        rows, columns = f["a"].unique(), f["b"].unique()
        m = np.zeros((len(rows), len(columns)))
        m[np.searchsorted(np.sort(rows), f["a"]), np.searchsorted(np.sort(columns), f["b"])] = f["n"]
        return pd.DataFrame({**{k: [f[k].iloc[0]] for k in keys}, **{k: [float(v)] for k, v in metrics.agreement(m).items()}})

    return cells.groupBy(*keys).applyInPandas(agree, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", ari double, ami double, nmi double").select(*keys, "ari", "ami", "nmi")


def agreement_matrix(pairs: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """within, run_a, run_b, ari of the whole square of runs: both halves, and 1 on the diagonal."""
    both = pairs.select(*within, "run_a", "run_b", "ari").unionByName(pairs.select(*within, F.col("run_b").alias("run_a"), F.col("run_a").alias("run_b"), "ari"))
    each = both.select(*within, "run_a").distinct()
    return both.unionByName(each.select(*within, "run_a", F.col("run_a").alias("run_b"), F.lit(1.0).alias("ari")))


def off_diagonal(pairs: DataFrame, within: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """Of the agreement of different runs: pairs, least, mean, greatest, deviation and distinct values."""
    x = F.col("ari")
    return pairs.groupBy(*within).agg(
        F.count(x).alias("n_pairs"), F.min(x).alias("min"), F.avg(x).alias("mean"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"), F.count_distinct(F.round(x, digits)).alias("unique_count")
    )


def against_baseline(pairs: DataFrame, baseline: str, within: Sequence[str] = ()) -> DataFrame:
    """within, run_id, ari, ami, nmi of every other run with the baseline run."""
    mine = pairs.where((F.col("run_a") == baseline) | (F.col("run_b") == baseline))
    return mine.select(*within, F.when(F.col("run_a") == baseline, F.col("run_b")).otherwise(F.col("run_a")).alias("run_id"), "ari", "ami", "nmi")


def reproducibility(pairs: DataFrame, least: float = 1 - 1e-9) -> str:
    """VERIFIED if every pair of repeats agrees, FAILED if one doesn't, INSUFFICIENT without pairs."""
    low = pairs.agg(F.min("ari")).first()[0]
    return "INSUFFICIENT" if low is None else "REPRODUCIBILITY_VERIFIED" if low >= least else "REPRODUCIBILITY_FAILED"


def stability(points: DataFrame, algorithm: str, params: dict, columns: Sequence[str], repeats: int = 3, seeds: Sequence[int] = (1, 2, 3), sigmas: Sequence[float] = (0.0, 0.01, 0.05)) -> DataFrame:
    """Labels of repeats (block R), seeds (S) and noise levels (N): block, run_id, key, label.

    points also has the columns that x is made of, so that noise can be added to them."""
    kind = cluster.REGISTRY[algorithm]
    runs: list[tuple[str, str, dict, float]] = [("R", f"r{r}", params, 0.0) for r in range(repeats)]
    runs += [("S", f"s{s}", {**params, "random_state": s}, 0.0) for s in seeds if kind.random]
    runs += [("N", f"n{g}", params, g) for g in sigmas]
    if issubclass(kind, cluster.Iterative):  # all runs advance in the same passes
        pts = points.select("key", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
        labels, _ = cluster.fit_many(pts, [cluster.make(algorithm, **p) for _, _, p, _ in runs], [cluster.noise(pts, g, 7) for *_, g in runs])
        names = F.array(*(F.struct(F.lit(b).alias("block"), F.lit(name).alias("run_id")) for b, name, _, _ in runs))
        return written(labels.select(F.posexplode("labels").alias("i", "label"), "key").select(names[F.col("i")]["block"].alias("block"), names[F.col("i")]["run_id"].alias("run_id"), "key", "label"), "runs")
    out = None
    for block, name, p, g in runs:
        noisy = prep.perturbed(points, columns, g, 7, "key").withColumn("x", F.array(*(F.col(c).cast("double") for c in columns)))
        labels = cluster.make(algorithm, **p).fit(noisy.select("key", "x")).labels.select(F.lit(block).alias("block"), F.lit(name).alias("run_id"), "key", "label")
        out = labels if out is None else out.unionByName(labels)
    return out


def scenarios(df: DataFrame, columns: Sequence[str], key: str, algorithm: str = "kmeans", params: dict | None = None, transforms: Sequence[str] = ("none", "yeo_johnson"), scalers: Sequence[str] = ("standard", "minmax", "robust")) -> DataFrame:
    """A run for each transformation and scaler."""
    rows = []
    for t in transforms:
        for s in scalers:
            made = prep.fit(df, columns, t, s).apply(df).select(F.col(key).alias("key"), F.array(*(F.col(c).cast("double") for c in columns)).alias("x"))
            r = run_one(made, algorithm, params or {})
            rows.append(("scenarios", f"{t}|{s}", algorithm, r.get("k"), r["status"], *(r.get(m) for m in (*METRICS, "wcss", "runtime"))))
    return results(df.sparkSession, rows)
