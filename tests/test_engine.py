from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from larkspur.operators import cleaning, cluster, experiments, features, metrics, prep, profile, segments, store, validate
from larkspur.plans import pipeline
from larkspur.sources import readers

RAW = "InvoiceNo string, StockCode string, Description string, Quantity long, InvoiceDate string, UnitPrice double, CustomerID double, Country string"
ROWS = [
    ("1", "a", "x", 2, "2011-01-01 10:00:00", 1.5, 1.0, "UK"),
    ("1", "a", "x", 2, "2011-01-01 10:00:00", 1.5, 1.0, "UK"),
    ("2", "b", "y", 1, "2011-01-03 09:00:00", 2.0, 1.0, "UK"),
    ("C3", "b", "y", -1, "2011-01-03 12:00:00", 2.0, 1.0, "UK"),
    ("4", "c", "z", 5, "bad", 1.0, 2.0, "UK"),
    ("5", "c", "z", 0, "2011-01-04 00:00:00", 1.0, 2.0, "UK"),
    ("6", "c", "z", 1, "2011-01-04 00:00:00", 0.0, 2.0, "UK"),
    ("7", "c", "z", 1, "2011-01-04 00:00:00", 1.0, None, "UK"),
    (" ", "c", "z", 1, "2011-01-04 00:00:00", 1.0, 2.0, "UK"),
    ("8", "c", " ", 1, "2011-01-04 00:00:00", 1.0, 2.0, "UK"),
]


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(ROWS, RAW)


def test_rules_and_cleaning(raw):
    counts = {r["rule_id"]: r["affected"] for r in cleaning.rule_counts(raw).collect()}
    assert counts == {"CL-01": 1, "CL-03": 1, "CL-04": 1, "CL-05": 1, "CL-06": 1, "CL-07": 1, "CL-08": 1, "CL-10": 1}
    kept = cleaning.clean_transactions(raw).collect()
    assert sorted(r["InvoiceNo"] for r in kept) == ["1", "2", "4", "C3"]
    assert [r["InvoiceDate"] for r in kept if r["InvoiceNo"] == "4"] == [None]
    strict = cleaning.clean_transactions(raw, cleaning.CleaningPlan(strict_dates=True)).collect()
    assert sorted(r["InvoiceNo"] for r in strict) == ["1", "2", "C3"]
    assert {type(r["CustomerID"]) for r in kept} == {int}


def test_customer_features(raw):
    got = features.candidate_features(cleaning.clean_transactions(raw, cleaning.CleaningPlan(strict_dates=True))).collect()
    assert len(got) == 1
    r = got[0]
    # gaps count whole 24-hour periods, tenure and recency count calendar days
    assert (r["Recency"], r["Frequency"], r["Monetary"], r["TenureDays"], r["ActiveDays"]) == (1, 3, 3.0, 2, 2)
    assert (r["PurchaseIntervalMean"], r["CancellationRate"], r["ReturnRate"]) == (0.5, 1 / 3, 1 / 3)
    assert r["PurchaseIntervalStd"] == pytest.approx(math.sqrt(0.5))


def test_single_purchase_has_no_interval(spark):
    one = cleaning.coerce_dtypes(spark.createDataFrame(ROWS[:1], RAW))
    r = features.candidate_features(one).first()
    assert r["PurchaseIntervalMean"] is None and r["Frequency"] == 1


def test_monetary_variants_stay_null(spark):
    lines = cleaning.with_flags(cleaning.coerce_dtypes(spark.createDataFrame(ROWS[:3], RAW)))
    r = features.monetary_variants(lines).first()
    assert r["MonetaryCancellationOnly"] is None and r["MonetarySigned"] == 8.0


@pytest.mark.parametrize(("keep", "expected"), [("first", [1]), ("last", [2]), ("none", [])])
def test_drop_duplicates(spark, keep, expected):
    df = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    assert [r["v"] for r in cleaning.drop_duplicates(df, ["k"], keep, ["v"]).collect()] == expected


@pytest.mark.parametrize("method", ["iqr", "zscore", "percentile"])
def test_outliers_against_pandas(spark, method):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(size=200), [50.0, -40.0]))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    r = cleaning.outlier_summary(df, ["v"], method).first()
    if method == "iqr":
        q1, q3 = np.quantile(x, [0.25, 0.75])
        lo, hi = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    elif method == "zscore":
        lo, hi = x.mean() - 3 * x.std(), x.mean() + 3 * x.std()
    else:
        lo, hi = np.quantile(x, [0.01, 0.99])
    assert (r["lower"], r["upper"]) == pytest.approx((lo, hi))
    assert r["n_outliers"] == int(((x < lo) | (x > hi)).sum())
    clipped = [v["v"] for v in cleaning.treat_outliers(df, ["v"], method, "clip").collect()]
    assert None in clipped and max(v for v in clipped if v is not None) == pytest.approx(min(hi, x.max()))


def test_constant_column_has_no_outliers(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert cleaning.outlier_summary(df, ["v"], "zscore").first()["n_outliers"] == 0


def test_missing_strategies(spark):
    df = spark.createDataFrame([(1.0,), (None,), (4.0,), (100.0,)], "v double")
    fill = lambda s: sorted(r["v"] for r in cleaning.handle_missing(df, ["v"], s).collect())
    assert fill("impute_median") == [1.0, 4.0, 4.0, 100.0] and fill("impute_mean") == [1.0, 4.0, 35.0, 100.0]
    assert fill("impute_zero") == [0.0, 1.0, 4.0, 100.0] and fill("drop") == [1.0, 4.0, 100.0]
    with pytest.raises(ValueError, match="identifiers"):
        cleaning.handle_missing(df.withColumn("CustomerID", F.lit(1)), ["CustomerID"], "impute_mean")


def test_moments_equal_pandas(spark):
    x = pd.Series(np.random.default_rng(1).gamma(2.0, size=80))
    r = profile.distribution_stats(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"]).first()
    assert (r["skewness"], r["kurtosis"], r["std"], r["median"]) == pytest.approx((x.skew(), x.kurt(), x.std(), x.median()))


def test_spearman_with_ties_and_nulls(spark):
    rng = random.Random(4)
    rows = [(rng.randint(0, 5) if rng.random() > 0.1 else None, rng.randint(0, 9)) for _ in range(120)]
    got = profile.correlation_pairs(spark.createDataFrame(rows, "a int, b int"), ["a", "b"], "spearman").first()["corr"]
    frame = pd.DataFrame(rows).dropna()
    assert got == pytest.approx(frame[0].rank().corr(frame[1].rank()))


def test_shapiro_wilk_known_values():
    # published example: weights of eleven men
    w, p = profile.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert w == pytest.approx(0.79, abs=0.01) and p < 0.01
    w, p = profile.shapiro_wilk(np.random.default_rng(3).normal(size=500))
    assert w > 0.99 and p > 0.05
    assert math.isnan(profile.shapiro_wilk([1, 1, 1])[0])


def test_normality_draws_rows_and_not_values(spark):
    customers = spark.range(20_000).select(F.col("id").alias("CustomerID"), (F.col("id") % 10).alias("Recency"))
    got = profile.normality(customers, ["Recency"]).first()
    assert got["n"] == 5000
    assert got["w"] == pytest.approx(profile.shapiro_wilk(np.arange(5000) % 10)[0], abs=0.01)


@pytest.mark.parametrize(("kind", "expected"), [("standard", [-1.2247, 0, 1.2247]), ("minmax", [0, 0.5, 1]), ("robust", [-1, 0, 1]), ("none", [1, 2, 3])])
def test_scalers(spark, kind, expected):
    df = spark.createDataFrame([(1.0, 7.0), (2.0, 7.0), (3.0, 7.0)], "v double, c double")
    rows = prep.fit(df, ["v", "c"], "none", kind).apply(df).orderBy("v").collect()
    assert [r["v"] for r in rows] == pytest.approx(expected, abs=1e-4)
    assert {r["c"] for r in rows} == {7.0 if kind == "none" else 0.0}


def test_yeo_johnson(spark):
    x = np.random.default_rng(5).lognormal(size=400)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    lam = prep.fit_yeo_johnson(df, ["v"])["v"]
    like = lambda v: -len(x) / 2 * np.log((((x + 1) ** v - 1) / v).var()) + (v - 1) * np.log1p(x).sum()
    grid = np.arange(-2.9995, 3, 0.001)
    assert lam == pytest.approx(grid[np.argmax([like(v) for v in grid])], abs=0.01)
    for fixed, value, want in ((0.0, 3.0, math.log(4)), (2.0, -3.0, -math.log(4)), (1.0, -3.0, -3.0), (1.0, 3.0, 3.0)):
        assert spark.range(1).select(prep.yeo_johnson(F.lit(value), fixed)).first()[0] == pytest.approx(want)


def test_log1p_rejects_negatives(spark):
    with pytest.raises(Exception, match="negative"):
        prep.log1p(spark.createDataFrame([(-1.0,)], "v double"), ["v"]).collect()


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(0)
    centers = [(0, 0), (12, 0), (0, 12)]
    rows = [(i, [float(v) for v in rng.normal(centers[i % 3], 1.0)], i % 3) for i in range(150)]
    return spark.createDataFrame(rows, "key long, x array<double>, truth int").persist()


@pytest.mark.parametrize(("name", "params"), [
    ("kmeans", {"n_clusters": 3}), ("fuzzy_cmeans", {"n_clusters": 3}), ("dbscan", {"eps": 2.0}),
    *(("gmm", {"n_components": 3, "covariance_type": c}) for c in ("full", "tied", "diag", "spherical")),
    *(("agglomerative", {"n_clusters": 3, "linkage": link}) for link in ("ward", "average", "complete", "single")),
])
def test_algorithms_find_blobs(blobs, name, params):
    labels = cluster.make(name, **params).fit(blobs.select("key", "x")).labels
    pairs = metrics.contingency(labels, blobs.select("key", F.col("truth").alias("label")))
    assert metrics.agreement(metrics.table_of(pairs))["ari"] > 0.95
    if "membership" in labels.columns:
        assert all(sum(r["membership"]) == pytest.approx(1) for r in labels.collect())


def test_kmeans_starts_compete_on_all_points(blobs):
    x = np.array([r["x"] for r in blobs.orderBy("key").collect()])
    one, ten = (cluster.make("kmeans", n_clusters=5, init="random", n_init=n).fit(blobs.select("key", "x")) for n in (1, 10))
    centers = np.array(ten.info["centers"])
    at = cluster.distances(x, centers).argmin(1)
    assert [r["label"] for r in ten.labels.orderBy("key").collect()] == at.tolist()
    assert np.allclose(centers, [x[at == j].mean(0) for j in range(5)], atol=0.1)
    assert ten.info["wcss"] == pytest.approx(cluster.distances(x, centers).min(1).sum(), rel=0.01)
    assert ten.info["wcss"] <= one.info["wcss"] + 1e-9


def test_registry_rejects():
    with pytest.raises(KeyError):
        cluster.make("nothing")
    with pytest.raises(TypeError):
        cluster.make("kmeans", nothing=1)
    with pytest.raises(ValueError, match="already"):
        cluster.register("kmeans")(cluster.KMeans)


def test_metrics_against_numpy(blobs):
    rows = blobs.collect()
    x, y = np.array([r["x"] for r in rows]), np.array([r["truth"] for r in rows])
    centers = np.array([x[y == k].mean(0) for k in range(3)])
    wcss = sum(((x[y == k] - centers[k]) ** 2).sum() for k in range(3))
    between = sum((y == k).sum() * ((centers[k] - x.mean(0)) ** 2).sum() for k in range(3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    a = np.array([d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1) for i in range(len(x))])
    b = np.array([min(d[i, y == k].mean() for k in range(3) if k != y[i]) for i in range(len(x))])
    points = blobs.select("key", F.col("truth").alias("label"), "x")
    got = metrics.internal_metrics(points).first()
    assert (got["wcss"], got["calinski_harabasz"]) == pytest.approx((wcss, between / 2 / (wcss / (len(x) - 3))))
    assert metrics.silhouette(points).first()[0] == pytest.approx(((b - a) / np.maximum(a, b)).mean())
    one = metrics.internal_metrics(points.withColumn("label", F.lit(0))).first()
    assert one["davies_bouldin"] is None and metrics.silhouette(points.withColumn("label", F.lit(-1))).first()[0] is None


def test_agreement_and_assignment():
    m = np.array([[5.0, 0, 0], [0, 0, 7], [0, 3, 0]])
    assert metrics.agreement(m) == pytest.approx({"ari": 1.0, "ami": 1.0, "nmi": 1.0})
    assert metrics.best_assignment(m) == [(0, 0), (1, 2), (2, 1)]
    flat = metrics.agreement(np.full((3, 3), 10.0))
    assert abs(flat["ari"]) < 0.05 and abs(flat["ami"]) < 0.05 and abs(flat["nmi"]) < 1e-9
    rng = np.random.default_rng(2)
    from itertools import permutations

    for _ in range(20):
        g = rng.integers(0, 9, (3, 4)).astype(float)
        best = max(sum(g[i, p[i]] for i in range(3)) for p in permutations(range(4), 3))
        assert sum(g[i, j] for i, j in metrics.best_assignment(g)) == best


@pytest.mark.parametrize(("ranges", "overlap"), [((0, 2, 0, 2), 1.0), ((0, 1, 2, 3), 0.0), ((0, 2, 1, 3), 0.5), ((1, 1, 1, 1), 1.0), ((1, 1, 2, 2), 0.0), ((None, 1, 2, 2), None)])
def test_iqr_overlap(spark, ranges, overlap):
    cells = [F.lit(v).cast("double") for v in ranges]
    assert spark.range(1).select(segments.iqr_overlap(*cells)).first()[0] == overlap


def test_experiments(spark, blobs):
    points = blobs.select("key", "x")
    swept = experiments.sweep(points, ["kmeans"], [2, 3, 4])
    best = experiments.selected(swept).first()
    assert best["k"] == 3 and not best["tied"]
    assert 3 in [r["k"] for r in experiments.candidate_k(swept).collect()]
    failed = experiments.run_one(points, "agglomerative", {"n_clusters": 999_999})
    assert failed["status"] == "FAILED" and "clusters" in failed["reason"]
    assert len(experiments.one_at_a_time("kmeans", {"n_clusters": 3}, {"n_clusters": [2, 3, 4], "init": ["random"]})) == 4
    wide = points.select("key", F.col("x")[0].alias("a"), F.col("x")[1].alias("b"), "x")
    labels = experiments.stability(wide, "kmeans", {"n_clusters": 3}, ["a", "b"], 2, (1, 2), (0.0, 0.01)).persist()
    pairs = experiments.pairwise_agreement(labels.where("block = 'R'"))
    assert experiments.reproducibility(pairs) == "REPRODUCIBILITY_VERIFIED"
    assert experiments.pairwise_agreement(labels.where("block = 'N'")).first()["ari"] > 0.9


def test_validation(spark, raw):
    base = features.customer_base(cleaning.clean_transactions(raw, cleaning.CleaningPlan(strict_dates=True)))
    assert validate.overall(validate.customer_base(base)).first()["status"] == "PASS"
    bad = spark.createDataFrame([(1, 1.0), (1, float("nan"))], "CustomerID long, v double")
    found = {r["check_id"]: r["status"] for r in validate.matrix(bad, ["v"]).collect()}
    assert found["finite"] == "FAIL" and found["keys unique"] == "FAIL" and found["rows"] == "PASS"
    assert validate.overall(validate.data_quality(bad)).first()["status"] == "WARNING"
    assert validate.overall(validate.structure(spark.createDataFrame([(None,)], "`a-b` int"))).first()["lifecycle"] == "FAILED"


def test_store_reuses_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    root = f"file://{tmp_path}/store"
    first = store.save(df, root, "dataset", "Two rows")
    assert store.save(df.orderBy(F.desc("k")), root, "dataset", "Two rows") == first
    assert store.save(df.limit(1), root, "dataset", "One row") != first
    assert store.load(spark, root, first).count() == 2 and store.manifests(spark, root, part_of_name="two").count() == 1
    with pytest.raises(KeyError):
        store.load(spark, root, "ds_nothing")


def test_readers(spark, tmp_path):
    pd.DataFrame({"a": [1.5, float("nan")], "b": ["x", "MISSING"]}).to_csv(tmp_path / "experiment_results.csv", index=False)
    got = readers.read_repository(spark, str(tmp_path))
    assert [r["b"] for r in got.orderBy("b").collect()] == [None, "x"]
    assert readers.with_missing_word(got).where("b = 'MISSING'").count() == 1
    nan = readers.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert nan.where("v IS NULL").count() == 1
    assert readers.raw_files(str(tmp_path / "nothing")) == [] and len(readers.raw_files(str(tmp_path))) == 1
    with pytest.raises(ValueError, match="neither"):
        readers.read_table(spark, "a.txt")


def test_streams_equal_batches(spark, tmp_path):
    from larkspur.streaming import feeds

    rows = [(i % 40, f"2024-01-{1 + i % 5:02d} 10:00:00", "ab"[i % 2], float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    events.write.parquet(f"{tmp_path}/events")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/events")
    feeds.to_memory(feeds.windowed(stream), "windows", "complete")
    assert sorted(map(tuple, spark.table("windows").collect())) == sorted(map(tuple, feeds.windowed(events).collect()))
    feeds.to_memory(feeds.without_repeats(stream), "once")
    assert spark.table("once").count() == 40


def test_whole_pipeline_is_repeatable(spark, tmp_path):
    rng = random.Random(7)
    rows = []
    for c in range(40):
        for i in range(rng.randint(1, 5)):
            for s in range(rng.randint(1, 4)):
                q = rng.randint(1, 9) * (10 if c % 3 == 0 else 1)
                rows.append((f"{c}-{i}", f"s{s}", "d", q, f"2011-0{rng.randint(1, 9)}-1{rng.randint(0, 9)} 0{rng.randint(0, 9)}:00:00", float(rng.randint(1, 20)), float(c), "UK"))
    raw = spark.createDataFrame(rows, RAW)
    plan = pipeline.Plan(params=(("n_clusters", 3),), columns=("Recency", "Frequency", "Monetary"))
    root = f"file://{tmp_path}/runs"
    first = pipeline.segment_customers(raw, root, plan)
    again = pipeline.segment_customers(raw.repartition(3), root, plan)
    assert store.manifests(spark, root).count() == 4
    assert sorted(map(str, first["final"].collect())) == sorted(map(str, again["final"].collect()))
    assert first["final"].count() == 3 and first["metrics"]["k"] == 3
