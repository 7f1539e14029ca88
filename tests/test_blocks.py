"""Clusterings and silhouettes over blocks, running sums and components, against one process."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.operators import blocks, cluster, metrics, tables


def frame(spark, x, parts=3, **columns):
    rows = [(int(3 * k), *(int(c[k]) for c in columns.values()), [float(v) for v in r]) for k, r in enumerate(x)]
    schema = ", ".join(["key long", *(f"{c} int" for c in columns), "x array<double>"])
    return spark.createDataFrame(rows, schema).repartition(parts)


def lumps(n, d=2, seed=0, copies=0.3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) + rng.integers(0, 4, (n, 1)) * 4.0
    x[rng.random(n) < copies] = x[0]  # many points on one spot
    return x


def one_process_dbscan(x, eps, least, metric):
    d = blocks.pair_distances(x, x, metric) <= eps
    core = d.sum(1) >= least
    label, found = np.full(len(x), -1), 0
    for k in range(len(x)):
        if label[k] != -1 or not core[k]:
            continue
        todo, label[k] = [k], found
        while todo:
            i = todo.pop()
            if core[i]:
                new = np.flatnonzero(d[i] & (label == -1))
                label[new] = found
                todo += new.tolist()
        found += 1
    return label, core


@pytest.mark.parametrize(
    "n,eps,least,metric,values",
    [(400, 0.5, 5, "euclidean", 128), (400, 0.35, 4, "manhattan", 128), (300, 0.4, 3, "chebyshev", 128), (300, 0.002, 4, "cosine", 128), (60, 0.3, 1, "euclidean", 250_000), (5, 9.0, 9, "euclidean", 128)],
)
def test_dbscan_over_blocks(spark, monkeypatch, n, eps, least, metric, values):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", values)
    x = lumps(n, seed=n)
    found = cluster.make("dbscan", eps=eps, min_samples=least, metric=metric).fit(frame(spark, x))
    want, core = one_process_dbscan(x, eps, least, metric)
    assert [r["label"] for r in found.labels.orderBy("key").collect()] == want.tolist()
    assert found.info == {"n_points": n, "n_core": core.sum(), "n_clusters": want.max() + 1, "n_noise": (want == -1).sum()}


def test_dbscan_of_no_points(spark):
    found = cluster.make("dbscan").fit(frame(spark, np.zeros((0, 2))))
    assert found.labels.count() == 0 and found.info["n_core"] == 0
    with pytest.raises(ValueError, match="finite"):
        cluster.make("dbscan").fit(frame(spark, [[1.0, float("nan")]]))


@pytest.mark.parametrize("metric,values,copies", [("euclidean", 128, 0.0), ("manhattan", 128, 0.2), ("euclidean", 250_000, 0.0)])
def test_single_linkage_over_blocks(spark, monkeypatch, metric, values, copies):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", values)
    x = lumps(230, 3, seed=7, copies=copies)
    steps = cluster.merges(x, "single", metric)
    found = cluster.make("agglomerative", n_clusters=5, linkage="single", metric=metric).fit(frame(spark, x))
    assert [r["label"] for r in found.labels.orderBy("key").collect()] == cluster.cut(steps, len(x), 5).tolist()
    heights = np.sort([s[0] for s in steps])
    assert found.info["n_merges"] == len(x) - 1
    assert found.info["merge_distances"]["last"] == pytest.approx(heights[-10:], abs=1e-6)
    assert found.info["merge_distances"]["mean"] == pytest.approx(heights.mean(), abs=1e-6)


def test_other_linkages_tell_their_merge_distances(spark):
    x = lumps(60, 2, seed=3, copies=0)
    found = cluster.make("agglomerative", n_clusters=3, linkage="average").fit(frame(spark, x))
    heights = np.sort([s[0] for s in cluster.merges(x, "average", "euclidean")])
    assert found.info["merge_distances"]["last"] == pytest.approx(heights[-10:])


@pytest.mark.parametrize("values", [128, 250_000])
def test_silhouettes_of_several_models(spark, monkeypatch, values):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", values)
    x = lumps(260, 2, seed=11, copies=0.1)
    rng = np.random.default_rng(1)
    labels = np.column_stack([rng.integers(0, 3, len(x)), rng.integers(-1, 4, len(x)), np.zeros(len(x), int), np.r_[7, rng.integers(0, 2, len(x) - 1)]])
    df = frame(spark, x).join(spark.createDataFrame([(3 * k, [int(v) for v in r]) for k, r in enumerate(labels)], "key long, labels array<int>"), "key")
    found = metrics.silhouettes_by_model(df)
    assert "toLocalIterator" not in open(metrics.__file__).read()
    got = {(r["model"], r["key"]): r["silhouette"] for r in found.collect()}
    d = blocks.pair_distances(x, x, "euclidean")
    np.fill_diagonal(d, 0)
    for t in range(labels.shape[1]):
        of = labels[:, t]
        names = [c for c in np.unique(of) if c != -1]
        for k in range(len(x)):
            if of[k] == -1:
                assert (t, 3 * k) not in got
                continue
            if len(names) < 2:
                assert got[t, 3 * k] is None
                continue
            mine = of == of[k]
            a = d[k, mine].sum() / max(1, mine.sum() - 1)
            b = min(d[k, of == c].mean() for c in names if c != of[k])
            want = 0.0 if mine.sum() == 1 or max(a, b) == 0 else (b - a) / max(a, b)
            assert got[t, 3 * k] == pytest.approx(want, abs=1e-6)


def test_running_sums_and_numbers(spark):
    rng = np.random.default_rng(5)
    rows = [(["a", "b", None][int(g)], int(v), int(w)) for g, v, w in zip(rng.choice(3, 400, p=[0.8, 0.1, 0.1]), rng.permutation(400), rng.integers(0, 9, 400))]
    df = spark.createDataFrame(rows, "g string, v long, w long")
    got = {(r["g"], r["v"]): r["before"] for r in tables.running(df, ["g"], [F.asc("v")], "w").collect()}
    assert got == {(g, v): sum(x for h, u, x in rows if h == g and u < v) for g, v, w in rows}
    numbers = {r["v"]: r["k"] for r in tables.numbered(df, [F.desc("v")], "k").collect()}
    assert numbers == {v: 399 - v for v in range(400)}


def test_components_are_least_nodes(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 110)] + [(7, 7), (300, 301), (301, 300)]
    got = dict(map(tuple, tables.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 110)}, 300: 300, 301: 300}
    assert tables.components(spark.createDataFrame([(1, 1)], "a long, b long")).count() == 0


@pytest.mark.parametrize("values", [64, 250_000])
def test_fits_do_not_depend_on_partitions(spark, monkeypatch, values):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", values)
    x = lumps(200, 2, seed=2, copies=0)
    for name, params in (("kmeans", {"n_clusters": 4, "n_init": 2}), ("fuzzy_cmeans", {"n_clusters": 3, "max_iter": 10}), ("gmm", {"n_components": 3, "max_iter": 5})):
        found = [cluster.make(name, **params).fit(frame(spark, x, parts)) for parts in (1, 5)]
        a, b = ([r["label"] for r in f.labels.orderBy("key").collect()] for f in found)
        assert a == b


def test_many_models_in_shared_passes_equal_single_fits(spark):
    x = lumps(150, 2, seed=4, copies=0.1)
    df = frame(spark, x)
    made = [cluster.make("kmeans", n_clusters=3, n_init=2), cluster.make("fuzzy_cmeans", n_clusters=4, max_iter=8), cluster.make("kmeans", n_clusters=2, init="random", n_init=3)]
    rows, infos = cluster.fit_many(df, made)
    together = {r["key"]: list(r["labels"]) for r in rows.collect()}
    for t, m in enumerate(made):
        alone = m.fit(df)
        assert {r["key"]: r["label"] for r in alone.labels.collect()} == {k: v[t] for k, v in together.items()}
        assert infos[t]["n_iter"] == alone.info["n_iter"]
    labels = rows.select("key", "labels", "x").cache()
    for t, (found, k) in enumerate(zip(metrics.quality_by_model(labels, [3, 4, 2]), (3, 4, 2))):
        one = metrics.internal_metrics(labels.select("key", F.col("labels")[t].alias("label"), "x")).first()
        assert tuple(one) == pytest.approx(found)


def test_passes_of_a_sweep_do_not_grow_with_its_models(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 64)
    asked = []
    plain = cluster.answered
    monkeypatch.setattr(cluster, "answered", lambda p, r: (asked.append(len(r)), plain(p, r))[1])
    df = frame(spark, lumps(120, 2, seed=6, copies=0))
    cluster.fit_many(df, [cluster.make("kmeans", n_clusters=k, n_init=2, max_iter=6) for k in range(2, 6)])
    assert len(asked) <= 1 + 1 + 1 + 2 * cluster.ROUNDS + 1 + 6 and max(asked) >= 8


def test_noise_of_a_model_follows_from_keys(spark):
    df = frame(spark, lumps(90, 2, seed=8, copies=0))
    shift = cluster.noise(df, 0.5, 7)
    assert cluster.noise(df, 0, 7) is None
    rows = cluster.hashed(df).orderBy("key").collect()
    x, h = np.array([r["x"] for r in rows]), np.array([r["h"] for r in rows]).view(np.uint64)
    moved = shift(x, h)
    assert np.allclose(moved[::-1], shift(x[::-1], h[::-1]))
    z = (moved - x) / (0.5 * x.std(0))
    assert abs(z.mean()) < 0.3 and 0.8 < z.std() < 1.2
