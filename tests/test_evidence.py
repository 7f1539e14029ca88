"""Collectors, import checks, evidence, quantiles and storage on small made files."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import evidence, gates, quantiles, segments, store, validate
from larkspur.sources import reports

NAN = float("nan")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("reports")
    files = {
        "exp01/exp01_baseline_summary.csv": "algorithm,n_clusters,silhouette,wcss,silhouette_status,runtime_mean_seconds,status,noise_count\nkmeans,4,0.5,10,OK,0.1,SUCCESS,\ndbscan,2,nan,,MISSING,0.2,SUCCESS,7\n,3,0.1,1,OK,1,SUCCESS,\n",
        "exp01/exp01_baseline_manifest.json": json.dumps({"config": {"runtime_repeat": 5, "baseline_seed": 42}, "algorithms": [{"algorithm": "kmeans", "hyperparameters": {"n_init": 10}}]}),
        "exp02/exp02_cluster_number_summary.csv": "experiment_id,algorithm,K,n_clusters,silhouette\nE2-a,gmm,3,,0.4\nE2-b,kmeans,5,5,0.3\n",
        "exp02/exp02_manifest.json": json.dumps({"results": [{"experiment_id": "E2-b", "hyperparameters": {"n_clusters": 5, "n_init": 10}}]}),
        "exp03/exp03_hyperparameter_results.csv": "experiment_id,algorithm,stage,sweep_parameter,sweep_value,baseline_k,n_clusters,hp_init,hp_random_state,silhouette\nEXP-03-kmeans-init-stageB,kmeans,B,init,random,4,,random,,0.2\n",
        "exp03/exp03_manifest.json": "not json",
        "exp04/exp04_scenario_results.csv": "scenario_id,config_id,algorithm,repeat_index,n_clusters,transformation,scaling,imputation,labels_hash,runtime_seconds,silhouette\nS1,c1,kmeans,3,4,none,robust,median,abc,0.5,0.1\n",
        "exp05/exp05_reproducibility_results.csv": 'run_id,algorithm,repeat_index,seed,cluster_sizes,labels_hash,runtime_seconds,silhouette,n_clusters_realized\nR-kmeans-r01,kmeans,1,42,"{""0"": 5, ""1"": 3, ""noise"": 2}",h,0.1,0.5,2\n',
        "exp05/exp05_noise_perturbation_results.csv": "run_id,algorithm,sigma,perturbation_seed,silhouette\nN-1,kmeans,0.05,7,0.4\n",
        "candidates.csv": "algorithm,K\nkmeans,4\nkmeans,3\ngmm,5\ngmm,\n",
        "selection.csv": "Feature,Decision\nRecency,EXCLUDE\n",
        "selected.csv": "algorithm,stage\nkmeans,A\ngmm,B\n",
        "exp05/exp05_seed_sweep_aggregate.csv": "algorithm,n\nkmeans,5\n",
    }
    for name, text in files.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(text)
    return str(top)


def test_repository_of_all_collectors(spark, folder):
    rows = {r["experiment_id"]: r for r in reports.build_repository(spark, folder).collect()}
    assert set(rows) == {"EXP-01-kmeans", "EXP-01-dbscan", "E2-a", "E2-b", "EXP-03-kmeans-init-stageB", "S1-r03", "R-kmeans-r01", "N-1"}
    k = rows["EXP-01-kmeans"]
    assert (k["n_clusters"], k["n_repeats_total"], k["random_seed"], k["noise_count"], k["hyperparameters"]) == (4, 5, 42, 0, '{"n_init": 10}')
    assert (k["transformation"], k["transformation_missing_reason"], k["silhouette_missing_reason"]) == (None, "DIFFERENT_CONDITIONS", "")
    d = rows["EXP-01-dbscan"]
    assert (d["silhouette"], d["silhouette_missing_reason"], d["noise_count"], d["hyperparameters_missing_reason"]) == (None, "NOT_RECORDED", 7, "FIELD_NOT_IN_SOURCE")
    assert (rows["E2-a"]["n_clusters"], rows["E2-a"]["n_clusters_realized"], json.loads(rows["E2-a"]["hyperparameters"])) == (3, None, {"n_components": 3})
    assert json.loads(rows["E2-b"]["hyperparameters"]) == {"n_clusters": 5, "n_init": 10}
    swept = json.loads(rows["EXP-03-kmeans-init-stageB"]["hyperparameters"])
    assert swept == {"init": "random", "_sweep_parameter": "init", "_sweep_value": "random", "_stage": "B"} and rows["EXP-03-kmeans-init-stageB"]["random_seed"] == 42
    s = rows["S1-r03"]
    assert (s["repeat_index"], s["n_repeats_total"], s["decision_status"], s["scaling"], s["labels_hash"]) == (3, 5, "CANDIDATE_SCENARIO", "robust", "abc")
    r = rows["R-kmeans-r01"]
    assert (r["n_clusters_realized"], r["cluster_size_largest"], r["cluster_size_smallest"], r["noise_count"], r["source_block"], r["n_repeats_total"]) == (2, 5, 3, 2, "R", 5)
    assert (rows["N-1"]["sigma"], rows["N-1"]["perturbation_seed"], rows["N-1"]["noise_count_missing_reason"]) == (0.05, 7, "NOT_RECORDED")


def test_absent_and_small_files(spark, folder):
    assert reports.collect(spark, f"{folder}/none", "exp01").count() == 0
    assert reports.build_repository(spark, f"{folder}/none").count() == 0
    assert reports.candidate_numbers(spark, f"{folder}/candidates.csv") == {"gmm": [5], "kmeans": [3, 4]}
    assert reports.candidate_numbers(spark, f"{folder}/none.csv") == {}
    assert reports.decisions(spark, f"{folder}/selection.csv") == {"Recency": "EXCLUDE"} and reports.decisions(spark, f"{folder}/candidates.csv") == {}
    assert [r["algorithm"] for r in reports.baseline_stage(spark, f"{folder}/selected.csv").collect()] == ["kmeans"]
    assert list(reports.stability_aggregates(spark, f"{folder}/exp05")) == ["S"]
    with pytest.raises(FileNotFoundError):
        reports.selected_configurations(spark, f"{folder}/none.csv")


def test_preflight(spark, folder):
    path = f"{folder}/selection.csv"
    data = open(path, "rb").read()
    assert reports.preflight(spark, path, root=folder) == (hashlib.sha256(data).hexdigest(), len(data), [])
    assert reports.preflight(spark, f"{folder}/none.csv")[2]
    assert len(reports.preflight(spark, path, formats=("parquet",), most_mb=0, root=f"{folder}/exp01")[2]) == 3
    assert reports.preflight(spark, folder)[2]


@pytest.mark.parametrize("accuracy", [2, 50, 20_000])
def test_quantiles_equal_numpy(spark, accuracy):
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=4000).round(2), np.concatenate([np.zeros(3000), rng.integers(0, 9, 1000)])
    rows = [(int(k % 2), float(x), float(y) if k % 7 else None) for k, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "g int, a double, b double").repartition(3)
    probs = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    got = {(r["g"], r["column"]): r for r in quantiles.quantiles(df, ["a", "b"], probs, ["g"], accuracy).collect()}
    for g in (0, 1):
        for i, c in enumerate("ab"):
            values = [r[1 + i] for r in rows if r[0] == g and r[1 + i] is not None]
            assert got[g, c]["n"] == len(values) and got[g, c]["q"] == pytest.approx(np.quantile(values, probs).tolist())
    none = spark.createDataFrame([(None,)], "a double")
    assert quantiles.quantiles(none, ["a"], [0.5]).count() == 0
    assert quantiles.quantile_row(none, {"m": ("a", 0.5)}).first()["m"] is None


def test_evidence_helpers(spark):
    runs = spark.createDataFrame([("EXP-03-x-linkage-stageA", "r-r12", "R", "t", "s", "MISSING"), ("plain", "odd", None, "t", "s", "i")], "experiment_id string, run_id string, source_block string, transformation string, scaling string, imputation string")
    got = evidence.with_boundaries(runs).select("_exp05_block", "_exp03_stage", "_exp04_scenario", evidence.family(F.col("experiment_id")).alias("f"), evidence.repeat_index(F.col("run_id")).alias("r")).collect()
    assert [tuple(r) for r in got] == [("R", "A", "", "linkage", 12), ("", "", "t|s|i", None, 0)]
    assert evidence.names_of(runs, "experiment_id") == ["EXP-03-x-linkage-stageA", "plain"]
    assert [n for n, df in evidence.by_experiment(runs) if df.count() == 1] == ["EXP-03-x-linkage-stageA", "plain"]
    values = spark.createDataFrame([("1.5",), ("MISSING",), ("nan",), ("Infinity",), (None,)], "v string")
    assert [r[0] for r in values.select(evidence.metric_value("v")).collect()] == [1.5, None, None, None, None]
    assert evidence.random_seed("kmeans", 42, {"kmeans": 0}) == 0 and evidence.random_seed("gmm", 42, {}, 7) == 7
    assert evidence.k_parameters("gmm", 3, {"gmm": {"tol": 1}}, 5) == {"tol": 1, "n_components": 3, "random_state": 5}
    assert evidence.k_parameters("agglomerative", 3, None, 5) == {"n_clusters": 3}
    made = evidence.interaction_settings([{"algorithm": "kmeans", "K": 4, "parameters": {"init": ["random", "k-means++"], "n_init": 3}}], None, 1)
    assert [m["params"] for m in made] == [{"n_clusters": 4, "random_state": 1, "init": "random"}, {"n_clusters": 4, "random_state": 1, "init": "k-means++"}, {"n_clusters": 4, "random_state": 1, "n_init": 3}]
    sweep = spark.createDataFrame([("e", "kmeans", "A", None, None, 3, 0.1, 0.2, 0.3, 0.4, "SUCCESS"), ("f", "kmeans", "C", "m", "2", 3, 0.1, 0.2, 0.3, 0.4, "SUCCESS")], "experiment_id string, algorithm string, stage string, sweep_parameter string, sweep_value string, k int, silhouette double, davies_bouldin double, calinski_harabasz double, wcss double, status string")
    assert [r["parameter"] for r in evidence.sensitivity_rows(sweep).collect()] == ["baseline"]
    pairs = spark.createDataFrame([(0.5,), (0.5,), (1.0,), (None,)], "ari double")
    assert evidence.distinct_off_diagonal(pairs, "ari") == 2


def test_labels_by_key(spark):
    labels = spark.createDataFrame([("r1", 1, 0), ("r1", 2, -1), ("r2", 1, 0)], "run_id string, key long, label int")
    runs = spark.createDataFrame([("r1", "SUCCESS"), ("r2", "FAILED")], "run_id string, status string")
    assert sorted(tuple(r) for r in evidence.label_rows(labels, runs).collect()) == [("r1", 1, 0, False), ("r1", 2, -1, True)]
    one = evidence.labels_of_run(labels, "r1")
    customers = spark.createDataFrame([(1, 10), (2, 20)], "key long, CustomerID long")
    assert sorted(tuple(r) for r in evidence.with_customers(one, customers).collect()) == [(10, 0, False), (20, -1, True)]
    with pytest.raises(ValueError, match="do not fit"):
        evidence.with_customers(one, customers.limit(1))
    with pytest.raises(ValueError, match="no"):
        evidence.normal_labels(one)
    named = evidence.normal_labels(spark.createDataFrame([(1, -1)], "CustomerID long, ClusterLabel int"))
    assert named.first()["IsNoise"]
    points = spark.createDataFrame([(1, 2.0), (3, 4.0)], "CustomerID long, x double")
    assert segments.with_segments(points, named).count() == 1


def test_gate_helpers(spark):
    df = spark.createDataFrame([(1, "a", True, 1.5, [1], b"x")], "i long, s string, b boolean, d double, l array<int>, y binary")
    assert gates.columns_of_kind(df, "numeric") == ["i", "d"] and gates.columns_of_kind(df, "integer") == ["i"] and gates.columns_of_kind(df, "bool") == ["b"]
    assert dict(gates.strings_for_objects(df).dtypes) == {"i": "bigint", "s": "string", "b": "boolean", "d": "double", "l": "string", "y": "string"}
    with pytest.raises(KeyError, match="gone"):
        gates.require_columns(df, ["i", "gone"])
    with pytest.raises(ValueError):
        gates.columns_of_kind(df, "odd")
    shapes = gates.interpretations(spark.createDataFrame([("UnitPrice", 3.0, 0.0, 2000.0, 0, 5, 0.1), ("Other", 1.0, 0.0, 1.0, 0, 5, 0.1)], "feature string, skewness double, min double, max double, negatives int, candidates int, rate double"))
    assert [(r["verdict"], r["evidence"], r["rate"]) for r in shapes.collect()] == [("DATA_ERROR", "NOT_POSITIVE", 0.0), ("INSUFFICIENT_EVIDENCE", "NO_RULE", 0.1)]


def test_validation_helpers(spark):
    df = spark.createDataFrame([(1, 2.0)], "CustomerID long, Recency double")
    assert {r["check_id"]: r["status"] for r in validate.columns_present(df, {"Recency": "days", "Monetary": "sum"}).collect()} == {"V-RFM-PRESENT-Recency": "PASS", "V-RFM-MISSING-Monetary": "FAIL"}
    assert validate.customer_features(df).first()["status"] == "PASS"
    bad = validate.evaluation_inputs(df, df.limit(0), ["Recency", "label_x"][:1])
    assert {r["check_id"]: r["status"] for r in bad.collect()}["same rows"] == "FAIL"
    leaks = {r["check_id"]: r["status"] for r in validate.leakage(df, df).collect()}
    assert leaks == {"rows match": "PASS", "identifiers absent": "FAIL", "labels absent": "PASS", "key in metadata": "PASS"}


def test_store_recovers_orphans(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.range(5)
    made = store.save(df, root, "run", "whole", parents={"dataset": "ds_1"})
    df.write.parquet(f"{root}/tables/lost")
    assert store.orphans(spark, root) == ["lost"] and store.recover(spark, root) == 1 and store.orphans(spark, root) == []
    assert [r["id"] for r in store.runs(spark, root, "ds_1").collect()] == [made] and store.runs(spark, root, "other").count() == 0
    (path,) = store.write_reports({"a": df}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(path).count() == 5


def test_repository_has_the_published_columns_and_provenance(spark, tmp_path):
    top = tmp_path / "reports"
    (top / "exp01").mkdir(parents=True)
    (top / "exp05").mkdir()
    (top / "exp01/exp01_baseline_summary.csv").write_text("algorithm,n_clusters\nkmeans,4\n")
    info = {"input_sha256": "in", "config_sha256": "cf", "customer_metadata_sha256": "cm", "library_versions": {"numpy": "2", "a": 1}, "platform_info": {"os": "x"}, "generated_at": "2024-01-01"}
    (top / "exp01/exp01_baseline_manifest.json").write_text(json.dumps(info))
    (top / "exp05/exp05_reproducibility_results.csv").write_text("run_id,algorithm,feature_set_sha256,config_sha256,platform_info\nr1,kmeans,fs,c5,linux\n")
    found = reports.build_repository(spark, str(top))
    assert found.columns == [n for n, _ in reports.SCHEMA] and len(found.columns) == 68
    rows = {r["experiment_id"]: r for r in found.collect()}
    one = rows["EXP-01-kmeans"]
    assert [one[c] for c in ("feature_set_sha256", "customer_metadata_sha256", "config_sha256", "input_sha256", "library_versions", "platform", "timestamp", "source_artifact")] == [
        "in", "cm", "cf", "in", '{"a": 1, "numpy": "2"}', '{"os": "x"}', "2024-01-01", "exp01/exp01_baseline_summary.csv",
    ]
    five = rows["r1"]
    assert (five["feature_set_sha256"], five["input_sha256"], five["config_sha256"], five["platform"], five["timestamp"]) == ("fs", "fs", "c5", "linux", None)
    assert reports.empty(spark).columns == found.columns


def test_verified_load(spark, tmp_path):
    root = str(tmp_path / "store")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    made = store.save(df, root, "dataset", "two", parents={"dataset": "ds_1"}, config={"x": 1})
    assert store.save(df, root, "dataset", "two", parents={"dataset": "ds_1"}, config={"x": 1}) == made
    assert store.load(spark, root, made, verify=True).count() == 2 and store.orphans(spark, root) == []
    spark.createDataFrame([(3, "c")], "k long, v string").write.mode("append").parquet(f"{root}/tables/{made}")
    assert store.load(spark, root, made).count() == 3
    with pytest.raises(ValueError, match="changed"):
        store.load(spark, root, made, verify=True)


def test_fields_in_which_manifests_differ(spark):
    documents = [("a", '{"x": 1, "y": {"z": "u", "e": {}}, "l": [1, {"q": 2}]}'), ("a", '{"x": 1, "y": {"z": "v"}, "l": [1, {"q": 2}], "n": null}'), ("b", '{"x": 1}'), ("a", "broken {"), (None, '{"x": 1}'), (None, '{"x": 2}'), ("a", None)]
    df = spark.createDataFrame(documents, "g string, doc string")
    leaves = {(r["path"], r["value"]) for r in store.key_paths(df.limit(1), ["g"], "doc").collect()}
    assert leaves == {("x", "1"), ("y.z", "u"), ("l", '[1,{"q":2}]')}
    got = {(r["g"], r["path"]): (r["members"], r["recorded"], r["n_values"]) for r in store.provenance_differences(df, "g", "doc").collect()}
    assert got == {("a", "y.z"): (2, 2, 2), ("a", "n"): (2, 1, 2), (None, "x"): (2, 2, 2)}
    rows = spark.createDataFrame([(1, "p", 1), (2, "p", None), (3, "q", 1)], "id long, s string, v int")
    assert {tuple(r) for r in store.incompatible(rows, "id", ["s", "v"]).collect()} == {(2, "v", None, "1"), (3, "s", "q", "p")}


def test_a_metric_has_a_status_and_a_reason(spark):
    from larkspur.operators import metrics

    def of(labels):
        rows = [(k, c, [float(k), float(k * k)]) for k, c in enumerate(labels)]
        return {r["metric"]: (r["status"], r["reason"], r["value"] is not None) for r in metrics.metrics_with_status(spark.createDataFrame(rows, "key long, label int, x array<double>")).collect()}

    assert set(of([-1, -1, -1]).values()) == {("NOT_APPLICABLE", "ALL_NOISE", False)}
    one = of([0, 0, -1])
    assert one["wcss"] == ("VALID_VALUE", None, True) and one["silhouette"] == ("NOT_APPLICABLE", "SINGLE_CLUSTER", False)
    assert set(of([0, 0, 1, 1]).values()) == {("VALID_VALUE", None, True)}
    own = of([0, 1, 2])
    assert own["davies_bouldin"][0] == "COMPUTATION_ERROR" and own["wcss"] == ("VALID_VALUE", None, True)


def test_census_of_text_columns(spark):
    from larkspur.operators import profile

    rows = [("1", "1", "true", "2024-01-01", "x", " ", "1"), (" -2 ", "2.5e3", "FALSE", "2024-01-01T10:00:00Z", "1", None, "true"), (None, ".5", None, "2024-01-01 10:00", None, "", None)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string, f string, g string")
    got = {r["column"]: r for r in profile.type_census(df).collect()}
    assert {c: r["inferred_type"] for c, r in got.items()} == {"a": "numeric", "b": "numeric", "c": "boolean", "d": "datetime", "e": "mixed", "f": "string", "g": "mixed"}
    assert (got["a"]["missing"], got["a"]["n_integer"], got["b"]["n_decimal"], got["f"]["missing"]) == (1, 2, 2, 3)
