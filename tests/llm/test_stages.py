"""Stages of the pipeline that need no model, over rows that are hard to handle."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

PASSAGE = " ".join(f"item{k}" for k in range(13))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_hit string, ids string"


def rows_of(spark):
    texts = [(1, None), (2, ""), (3, PASSAGE), (3, PASSAGE), (3, "other words"), (None, PASSAGE), (None, "plain"), (4, "long " * 50_000), (5, " \t\n")]
    return spark.createDataFrame([(k, t, None, "s", None, "clash", "clash") for k, t in texts], SCHEMA)


def test_contamination_stage_on_edge_rows(spark, tmp_path):
    spark.createDataFrame([("a", PASSAGE), (None, None), ("b", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = rows_of(spark)
    got = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert got.columns == list(corpus_pipeline.COLUMNS)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "")
    want = [r for r in docs.select(*corpus_pipeline.COLUMNS).collect() if r["text"] != PASSAGE]
    assert sorted(got.collect(), key=key) == sorted(want, key=key)
    assert corpus_pipeline.drop_contaminated(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_encoding_stage_on_edge_rows(spark, tmp_path):
    docs = rows_of(spark)
    got = corpus_pipeline.encode(spark, docs, str(tmp_path))
    made = got.select("doc_id", "n_tokens", "exact").collect()
    assert len(made) == docs.count() and all(r["exact"] for r in made)
    assert all((r["n_tokens"] == 0) == (r["doc_id"] in (1, 2)) for r in made)
    assert corpus_pipeline.encode(spark, docs.where(F.lit(False)), str(tmp_path)).count() == 0
