"""What the toxicity model's counting holds on disk."""

from __future__ import annotations

import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from larkspur.llm import toxicity


def docs_of(spark, n=600):
    rng = random.Random(2)
    rows = [(k, " ".join(f"word{rng.randrange(3000)}" for _ in range(60)) + (" vile" if k % 3 == 0 else "")) for k in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))


def shuffled(spark):
    """Bytes of shuffle files by path."""
    found = {}
    for d in spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs():
        for p in Path(d.getPath()).rglob("shuffle_*"):
            try:
                found[p] = p.stat().st_size
            except OSError:  # deleted meanwhile
                pass
    return found


def test_parts_of_pair_counts_make_the_whole(spark):
    docs, _ = docs_of(spark, 100)
    rows = docs.select("text", (F.col("doc_id") % 2).cast("int").alias("label"), (F.col("doc_id") % 5).cast("int").alias("fold"))
    added = lambda df: {r[:3]: r[3] for r in df.groupBy("h", "w", "c").agg(F.sum("n")).collect()}
    whole, parts = added(toxicity.pair_counts(rows)), [added(toxicity.pair_counts(rows, k, 3)) for k in range(3)]
    assert all(parts) and {k: n for p in parts for k, n in p.items()} == whole
    assert sum(len({k[:2] for k in p}) for p in parts) == len({k[:2] for k in whole})
    values = lambda pairs: sorted((r["kind"], r["key"], r["w"], tuple(r["v"])) for r in toxicity.pair_model(pairs).where(F.col("kind") != toxicity.CONTINUED).collect())
    assert values([toxicity.pair_counts(rows, k, 3) for k in range(3)]) == values(toxicity.pair_counts(rows))


def test_shuffle_files_go_with_their_query(spark, monkeypatch):
    docs, labels = docs_of(spark)
    left, made = [], {}
    before = set(shuffled(spark))
    count, read_back, setting = toxicity.pair_counts, toxicity.read_back, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def remaining():
        end = time.time() + 10
        while True:  # Spark deletes in the background
            now = sum(n for p, n in shuffled(spark).items() if p not in before)
            if now < 20_000 or time.time() > end:
                return now
            time.sleep(0.1)

    def counted(*args):
        left.append(remaining())
        made["parts"] = made.get("parts", 0) + 1
        return count(*args)

    def written(df, path):
        out = read_back(df, path)
        left.append(remaining())
        return out

    monkeypatch.setattr(toxicity, "pair_counts", counted)
    monkeypatch.setattr(toxicity, "read_back", written)
    was = spark.conf.get(setting, None)
    toxicity.fit(docs, labels)
    assert made["parts"] > 1 and len(left) > 5, left
    assert max(left) < 20_000  # one part's counts are 200 kB; totals of a row each stay
    assert spark.conf.get(setting, None) == was


def test_texts_meet_many_labels_once(spark, monkeypatch):
    docs, labels = docs_of(spark, 150)
    written, deleted, got = [], [], []
    read_back, delete = toxicity.read_back, toxicity.delete
    monkeypatch.setattr(toxicity, "read_back", lambda df, path: (written.append(path), read_back(df, path))[1])
    monkeypatch.setattr(toxicity, "delete", lambda session, path: (deleted.append(path), delete(session, path))[1])
    for bound in (toxicity.BROADCAST_ROWS, 10):
        monkeypatch.setattr(toxicity, "BROADCAST_ROWS", bound)
        got.append({r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()})
    assert got[1] == pytest.approx(got[0], abs=1e-9)
    assert sum("training-rows" in p for p in written) == 1
    assert set(written) <= set(deleted)
