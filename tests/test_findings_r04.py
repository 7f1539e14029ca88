"""Small cases of what the fourth round's review found."""

from __future__ import annotations

import numpy as np
import pytest

from larkspur.operators import blocks, cluster, experiments, metrics
from larkspur.plans import queries as plans
from tests.test_blocks import frame, lumps


def ward_distances(x, c, y, m):
    return ((x[:, None] - y[None]) ** 2).sum(2) * 2 / (1 / c[:, None] + 1 / m[None])


@pytest.mark.parametrize("kind", ["plain", "far off", "outlier", "grid"])
def test_the_nearest_cluster_is_exact_by_single_precision(kind, monkeypatch):
    monkeypatch.setattr(blocks, "AT_ONCE", 20_000)
    rng = np.random.default_rng(3)
    y = rng.normal(size=(3000, 5))
    if kind == "far off":
        y = y + 1e6
    elif kind == "outlier":
        y[0] = 1e9
    elif kind == "grid":
        y = rng.permuted(np.stack(np.meshgrid(*[np.arange(5.0)] * 5), -1).reshape(-1, 5), axis=0)[:3000]
        y = np.unique(y, axis=0)
    m = rng.integers(1, 6, len(y)).astype(float) if kind != "grid" else np.ones(len(y))
    ids = 7 * rng.permutation(len(y))
    some = np.arange(0, len(y), 9)
    want = ward_distances(y[some], m[some], y, m)
    want[np.arange(len(some)), some] = np.inf
    near, d, low = blocks.ward_closest(y[some], m[some], ids[some], y, m, ids, 6)
    assert d == pytest.approx(np.take_along_axis(want, near, 1), rel=1e-9)
    assert d.min(1) == pytest.approx(want.min(1), rel=1e-9) and (d.min(1) <= low).all()
    rest = want.copy()
    np.put_along_axis(rest, near, np.inf, 1)
    assert (low <= rest.min(1) * (1 + 1e-9)).all()
    alone = blocks.ward_closest(y[:1], m[:1], ids[:1], y[:2], m[:2], ids[:2], 6)
    assert sorted(alone[1][0]) == [pytest.approx(want[0, 1]), np.inf] and alone[2][0] == np.inf


@pytest.mark.parametrize("copies,wider", [(0.0, 1), (0.3, 1)])
def test_ward_asks_few_clusters_again(spark, monkeypatch, copies, wider):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    monkeypatch.setattr(blocks, "WIDER", wider)
    asked = []
    plain = blocks.ward_near
    monkeypatch.setattr(blocks, "ward_near", lambda some, of, m, n, width, keep: (asked.append(m * n), plain(some, of, m, n, width, keep))[1])
    x = lumps(330, 3, seed=5, copies=copies)
    steps = cluster.merges(x, "ward", "euclidean")
    found = cluster.make("agglomerative", n_clusters=6).fit(frame(spark, x))
    assert [r["label"] for r in found.labels.orderBy("key").collect()] == cluster.cut(steps, len(x), 6).tolist()
    heights = np.sort([s[0] for s in steps])
    assert found.info["n_merges"] == len(x) - 1
    assert found.info["merge_distances"]["last"] == pytest.approx(heights[-10:], abs=1e-6)
    assert found.info["merge_distances"]["mean"] == pytest.approx(heights.mean(), abs=1e-6)
    assert len(asked) > 1 and sum(asked) < 2.2 * asked[0]


def test_one_task_merges_in_rounds_as_over_all_distances(monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    for x in (lumps(400, 3, seed=2, copies=0), np.stack(np.meshgrid(np.arange(18.0), np.arange(18.0)), -1).reshape(-1, 2)):
        a, b, d, step = cluster.ward_rounds(np.arange(len(x)), x.copy(), np.ones(len(x)), 0)
        assert len(a) == len(x) - 1 and (a < b).all()
        if len(x) == 400:
            steps = cluster.merges(x, "ward", "euclidean")
            assert np.sort(d) == pytest.approx(np.sort([s[0] for s in steps]))
            assert cluster.cut(list(zip(d, a, b)), len(x), 6).tolist() == cluster.cut(steps, len(x), 6).tolist()
        else:
            assert (d >= 1 - 1e-9).all() and step.max() < len(x)


def test_a_sweep_runs_all_algorithms_and_numbers_of_clusters(spark, monkeypatch):
    asked = []
    plain = cluster.Agglomerative.cuts
    monkeypatch.setattr(cluster.Agglomerative, "cuts", lambda self, points, ks: (asked.append(list(ks)), plain(self, points, ks))[1])
    x = lumps(80, 2, seed=9, copies=0)
    df = frame(spark, x)
    monkeypatch.setattr(plans, "_points", lambda spark, d: df)
    rows = {r["run_id"]: r for r in plans.QUERIES["cluster_sweep"](spark, "").collect()}
    assert list(rows) == [*(f"kmeans-k{k}" for k in range(2, 11)), *(f"agglomerative-k{k}" for k in range(2, 11)), "dbscan-diagnostic", *(f"gmm-k{k}" for k in range(2, 11)), *(f"fuzzy_cmeans-k{k}" for k in range(2, 11))]
    assert all(r["status"] == "SUCCESS" and (r["k"] is None) == (r["algorithm"] == "dbscan") for r in rows.values())
    assert asked == [list(range(2, 11))]
    for name, made in (("agglomerative-k4", cluster.make("agglomerative", n_clusters=4)), ("gmm-k3", cluster.make("gmm", n_components=3, random_state=42)), ("dbscan-diagnostic", cluster.make("dbscan"))):
        labelled = df.join(made.fit(df).labels.select("key", "label"), "key")
        one = metrics.internal_metrics(labelled).first()
        want = [metrics.silhouette(labelled).first()[0], one["davies_bouldin"], one["calinski_harabasz"], one["wcss"]]
        assert [rows[name][c] for c in (*experiments.METRICS, "wcss")] == pytest.approx(want, abs=1e-4)  # rounded by the query
    assert "dbscan" not in {r["algorithm"] for r in experiments.candidate_k(spark.createDataFrame(list(rows.values()))).collect()}


@pytest.mark.parametrize("linkage,n", [("ward", 330), ("single", 230), ("ward", 40), ("average", 60)])
def test_one_tree_is_cut_for_all_numbers_of_clusters(spark, monkeypatch, linkage, n):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    x = lumps(n, 3, seed=5, copies=0.1)
    steps = cluster.merges(x, linkage, "euclidean")
    found = cluster.make("agglomerative", linkage=linkage).cuts(frame(spark, x), [5, 2, 1, 8])
    got = np.array([r["labels"] for r in found.labels.orderBy("key").collect()])
    assert (got == np.column_stack([cluster.cut(steps, n, k) for k in (5, 2, 1, 8)])).all()


def test_a_sweep_without_enough_points_says_so(spark):
    rows = {r["run_id"]: r["status"] for r in experiments.sweep(frame(spark, lumps(4, 2, copies=0)), ks=[2, 4, 9], repeats=2).collect()}
    assert rows == {**{f"{a}-k2": "SUCCESS" for a in ("kmeans", "agglomerative", "gmm", "fuzzy_cmeans")}, "kmeans-k4": "SUCCESS", "gmm-k4": "SUCCESS", "fuzzy_cmeans-k4": "SUCCESS", "agglomerative-k4": "FAILED", **{f"{a}-k9": "FAILED" for a in ("kmeans", "agglomerative", "gmm", "fuzzy_cmeans")}, "dbscan-diagnostic": "SUCCESS"}
