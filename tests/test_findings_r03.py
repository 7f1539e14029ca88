"""Small cases of what the third round's review found."""

from __future__ import annotations

import os

import numpy as np
import pytest

from larkspur.operators import blocks, cluster, metrics
from larkspur.plans import pipeline
from larkspur.plans import queries as plans
from tests.test_blocks import frame, lumps, one_process_dbscan

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@tables
def test_leakage_check_counts_the_customers_of_its_own_lines(spark, tmp_path):
    for name in ("lineitem", "orders", "part", "customer", "nation"):
        t = spark.read.parquet(f"{DATA}/{name}.parquet")
        if name == "orders":  # one customer's orders have ids that cleaning of the raw lines takes away
            t = t.where("o_custkey <> 1 OR o_orderkey % 13 = 0").unionByName(t.where("o_orderkey % 13 = 0").limit(1).selectExpr("1L AS o_custkey", *(c for c in t.columns if c != "o_custkey")))
        t.write.parquet(f"{tmp_path}/{name}.parquet")
    found = {r["check_id"]: r["status"] for r in plans.QUERIES["leakage_check"](spark, str(tmp_path)).collect()}
    assert found["rows match"] == "PASS"


@pytest.mark.parametrize("copies", [0.0, 0.3])
def test_ward_over_blocks(spark, monkeypatch, copies):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    monkeypatch.setattr(cluster, "PAIRWISE_LIMIT", 100)
    x = lumps(230, 3, seed=5, copies=copies)
    steps = cluster.merges(x, "ward", "euclidean")
    found = cluster.make("agglomerative", n_clusters=6).fit(frame(spark, x))
    assert [r["label"] for r in found.labels.orderBy("key").collect()] == cluster.cut(steps, len(x), 6).tolist()
    heights = np.sort([s[0] for s in steps])
    assert found.info["n_merges"] == len(x) - 1
    assert found.info["merge_distances"]["last"] == pytest.approx(heights[-10:], abs=1e-6)
    assert found.info["merge_distances"]["mean"] == pytest.approx(heights.mean(), abs=1e-6)


def test_least_of_rows_by_lots():
    d = np.random.default_rng(0).random((7, 1000))
    assert (np.sort(blocks.least_of_rows(d, 8), 1) == np.sort(np.argsort(d, 1)[:, :8], 1)).all()


@pytest.mark.parametrize("eps,least", [(30.0, 5), (3.0, 5), (1.2, 60)])
def test_dbscan_of_wide_radius_visits_no_cell_within_it(spark, monkeypatch, eps, least):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    x = lumps(600, seed=3, copies=0.1)
    held = blocks.numbered_points(frame(spark, x))
    grid = blocks.visits(held, eps, "euclidean")
    if eps == 30.0:
        assert grid.rows.count() == 0 and grid.sure.agg({"n": "sum"}).first()[0] == 600 * 600
    found = cluster.make("dbscan", eps=eps, min_samples=least).fit(frame(spark, x))
    assert [r["label"] for r in found.labels.orderBy("key").collect()] == one_process_dbscan(x, eps, least, "euclidean")[0].tolist()


def test_metrics_of_a_pipeline_are_computed_when_they_are_read(spark, monkeypatch):
    asked = []
    plain = pipeline.metrics.silhouette
    monkeypatch.setattr(pipeline.metrics, "silhouette", lambda p: (asked.append(p), plain(p))[1])
    found = pipeline.Quality(frame(spark, lumps(40, 2, copies=0)).selectExpr("key", "CAST(key / 3 AS INT) % 2 AS label", "x"))
    assert not asked
    assert found["k"] == 2 and found["n"] == 40 and -1 <= found["silhouette"] <= 1 and len(asked) == 1


@pytest.mark.parametrize("name", ["kmeans", "fuzzy_cmeans"])
def test_a_pass_over_many_points_is_one_job(spark, monkeypatch, name):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    passes = []
    plain = cluster.answered
    monkeypatch.setattr(cluster, "answered", lambda points, requests: (passes.append(1), plain(points, requests))[1])
    x = lumps(400, 3, seed=5, copies=0)
    spark.sparkContext.setJobGroup(f"passes-{name}", "passes")
    try:
        found = cluster.make(name, n_clusters=3).fit(frame(spark, x))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup(f"passes-{name}")
    assert len(passes) > 8 and len(jobs) <= len(passes) + 8
    labels = [r["label"] for r in found.labels.orderBy("key").collect()]
    monkeypatch.undo()
    assert labels == [r["label"] for r in cluster.make(name, n_clusters=3).fit(frame(spark, x)).labels.orderBy("key").collect()]


def test_answers_of_many_tasks_are_merged_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(cluster, "DIRECT", 2)
    x = lumps(300, 3, seed=2, copies=0)
    held = cluster.lots(cluster.hashed(frame(spark, x)).repartition(3), 300, 3)
    total, low, none = cluster.answered(held, [cluster.Sum(3, lambda x, h: x.sum(0)), cluster.Rows(4, lambda x, h: x[:, 0]), cluster.Rows(2, lambda x, h: np.full(len(x), np.nan))])
    assert total == pytest.approx(x.sum(0)) and (low == x[np.argsort(x[:, 0])[:4]]).all() and len(none) == 0


@pytest.mark.parametrize("kind,values", [("diag", 12), ("spherical", 12), ("full", 48)])
def test_a_mixture_asks_for_no_more_moments_than_it_needs(kind, values):
    x = lumps(200, 4, seed=1, copies=0)
    h = np.arange(200, dtype=np.uint64)
    model, sizes, answer = cluster.make("gmm", n_components=3, covariance_type=kind, max_iter=4).model(200), [], None
    while True:
        try:
            asked = model.send(answer)
        except StopIteration as end:
            assign, info = end.value
            break
        sizes += [r.size for r in asked if isinstance(r, cluster.Sum)]
        found = cluster.Answers(asked)
        found.add(x, h)
        answer = found.values()
    assert sizes[-1] == 3 + 12 + values + 1
    assert assign(x)[1].sum(1) == pytest.approx(np.ones(200)) and np.isfinite(info["bic"])


def test_a_diagonal_covariance_has_the_density_of_its_matrix():
    x = lumps(50, 4, seed=1, copies=0)
    w, mu, s = np.array([0.3, 0.7]), x[:2], np.array([[1.0, 2, 3, 4], [0.5, 1, 2, 0.1]])
    logs = cluster.GaussianMixture.logs
    assert logs(x, w, mu, s) == pytest.approx(logs(x, w, mu, np.array([np.diag(v) for v in s])))


def test_silhouettes_add_a_row_a_point_of_each_pair_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_VALUES", 128)
    monkeypatch.setattr(metrics, "TILE", 16)
    x = lumps(230, 3, seed=7, copies=0.2)
    i = np.arange(230)
    labels = np.column_stack((i % 3, np.where(i == 5, 9, np.where(i % 4 == 0, -1, i % 2)), np.zeros(230, int)))
    points = spark.createDataFrame([(int(k), labels[k].tolist(), x[k].tolist()) for k in i], "key long, labels array<int>, x array<double>")
    held = blocks.numbered_points(points)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    clusters = [np.unique(v[v >= 0]) for v in labels.T]
    sums = {r["key"]: r["s"] for r in metrics._distance_sums(held, "euclidean", clusters).join(held.rows, "id").collect()}
    want = np.column_stack([d[:, labels[:, t] == c].sum(1) for t, names in enumerate(clusters) for c in names])
    assert len(sums) == 230 and np.array([sums[k] for k in i]) == pytest.approx(want, abs=1e-5)
    found = {(r["model"], r["key"]): (r["label"], r["silhouette"]) for r in metrics.silhouettes_by_model(points).collect()}
    assert len(found) == (labels >= 0).sum()
    for t in range(3):
        for k in np.flatnonzero(labels[:, t] >= 0):
            label, value = found[t, int(k)]
            own = labels[:, t] == labels[k, t]
            others = [d[k, labels[:, t] == c].mean() for c in clusters[t] if c != labels[k, t]]
            assert label == labels[k, t]
            if not others:
                assert value is None
            elif own.sum() == 1:
                assert value == 0
            else:
                a, b = d[k, own].sum() / (own.sum() - 1), min(others)
                assert value == pytest.approx((b - a) / max(a, b), abs=1e-6)


def test_an_encoding_task_has_no_threads_beside_it():
    from larkspur.llm import tokens

    assert tokens.Tokenizer and os.environ["TOKENIZERS_PARALLELISM"] == "false"


@pytest.mark.parametrize("n", [1, 511, 512, 513, 1300])
def test_blocks_of_words_give_their_ids_back(n):
    from larkspur.llm import simple8b

    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.1, rng.integers(0, 1 << 40, n), rng.integers(0, 50_000, n) * (rng.random(n) < 0.5)).astype(np.uint64)
    words, offsets = simple8b.pack(ids)
    assert len(offsets) == -(-n // simple8b.BLOCK) and offsets[0] == 0
    assert (simple8b.unpack(words, offsets.astype(np.int64), n) == ids).all()


@pytest.mark.parametrize("keep", [None, ["doc_id", "text"], ["doc_id"]])
def test_decontamination_is_sent_a_text_once(spark, keep):
    from larkspur.llm import decontaminate

    docs = spark.createDataFrame([(1, "a b c d", "x"), (2, None, "y"), (3, "q r", "z")], "doc_id long, text string, lang string")
    found = decontaminate.contamination(docs, spark.createDataFrame([("i", "b c")], "item_id string, text string"), keep=keep)
    kept = keep or docs.columns
    assert found.columns == [*kept, "n_words", "hits", "items"]
    plan = found._jdf.queryExecution().analyzed().toString()
    sent = next(line for line in plan.splitlines()[1:] if "Project" in line)
    assert sent.count("text#") == 1
    rows = {r["doc_id"]: r for r in found.collect()}
    assert [(rows[k]["n_words"], rows[k]["items"]) for k in (1, 2, 3)] == [(4, ["i"]), (0, []), (2, [])]
    if "text" in kept:
        assert rows[1]["text"] == "a b c d" and rows[2]["text"] is None
