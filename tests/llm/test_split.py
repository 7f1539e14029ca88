"""Joins and toxicity counts in which one key holds most of the rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkspur.llm import common, toxicity


@pytest.mark.parametrize("least", [0, 3, 10**9])
def test_split_join_is_an_inner_join(spark, least):
    rows = spark.range(400).select(F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 50 == 1, None).otherwise(F.col("id")).alias("k"), "id")
    by = rows.where("k < 300").groupBy("k").agg(F.count("*").alias("n"))
    got = common.split_join(rows, by, "k", "n", least)
    assert got.columns == ["k", "id", "n"]
    assert sorted(got.collect()) == sorted(rows.join(by, "k").collect())
    assert common.split_join(rows, by.limit(0), "k", "n", least).count() == 0
    assert common.split_join(rows.limit(0), by, "k", "n", least).count() == 0


def brute(counted):
    """Values of contexts, pairs and words by the definition, a pair at a time."""
    n, folds = {}, toxicity.FOLDS
    for h, w, c, x in counted:
        n.setdefault((h, w), np.zeros((folds, 2)))[c // 2, c % 2] += x
    models = lambda x: np.array([x.sum(axis=0), *(x.sum(axis=0) - x[f] for f in range(folds))])
    contexts, pairs, words = {}, {}, {}
    for h in {h for h, _ in n}:
        own = {w: models(x) for (g, w), x in n.items() if g == h}
        of = sum(own.values())
        least = np.where(of.min(axis=1) > 0, of.min(axis=1), of.max(axis=1))
        shares = {w: np.maximum(x / np.maximum(of, 1) - (toxicity.DISCOUNT / np.maximum(least, 1))[:, None], 0) for w, x in own.items()}
        shares = {w: x for w, x in shares.items() if x[0].max() > 1e-12}
        if shares:
            free = 1 - sum(shares.values())
            contexts[h] = np.log(free[:, 0] / free[:, 1])
            pairs |= {(h, w): (x / free).T.ravel() for w, x in shares.items()}
    for (_, w), x in n.items():
        words[w] = words.get(w, 0) + np.concatenate(([1.0], x.ravel()))
    return contexts, pairs, words


@pytest.mark.parametrize("pair_rows", [4, 100_000])
def test_pair_model_by_brute_force(spark, monkeypatch, pair_rows):
    monkeypatch.setattr(toxicity, "PAIR_ROWS", pair_rows)
    rng = np.random.default_rng(5)
    h = np.where(rng.random(3000) < 0.4, 7, rng.integers(-20, 20, 3000))
    w = np.where(rng.random(3000) < 0.3, 9, rng.integers(-30, 30, 3000))
    rows = list(zip(h.tolist(), w.tolist(), rng.integers(0, 2 * toxicity.FOLDS, 3000).tolist(), rng.integers(1, 4, 3000).tolist()))
    got = toxicity.pair_model(spark.createDataFrame(rows, "h long, w long, c long, n long").repartition(7)).collect()
    contexts, pairs, words = brute(rows)
    u = lambda x: np.array([x]).view(np.uint64)
    by_key = lambda found: {int(k): v for k, v in found}
    expected = {
        toxicity.CONTEXT: by_key((toxicity.context_keys(u(h)).view(np.int64)[0], v) for h, v in contexts.items()),
        toxicity.PAIR: by_key((toxicity.pair_keys(u(h), u(w)).view(np.int64)[0], v) for (h, w), v in pairs.items()),
        toxicity.CONTINUED: words,
    }
    for kind, values in expected.items():
        made = {r["key"]: r["v"] for r in got if r["kind"] == kind}
        assert made.keys() == values.keys() and len(made) == sum(r["kind"] == kind for r in got)
        for k, v in values.items():
            np.testing.assert_allclose(made[k], v, rtol=1e-5, atol=1e-5)
