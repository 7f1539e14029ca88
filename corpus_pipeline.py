"""The corpus pipeline: stages over documents, each written and read again before the next.

Quality and toxicity leave out the documents they reject, near-dedup keeps one document of
each group, decontamination leaves out contaminated documents, and the last stage encodes
what is left and checks the round trip. Each stage works on all that the one before kept.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import decontaminate, neardup, quality, tokens, toxicity
from larkspur.llm.common import small, written
from larkspur.llm.queries import GOOD, TOXIC, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least GOOD.

    A null text is scored as an empty one; rows with a null or repeated id are judged each
    by itself; columns beside those of documents are left out; an empty table gives none.
    """
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("score") >= GOOD).select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is under TOXIC; nulls, repeats and others as in keep_good."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).where(F.col("score") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate group.

    An id stays if any row with it does; of its rows with the same text one stays. Only ids
    are joined, and only rows whose id repeats are shuffled with their texts.
    """
    groups = written(neardup.near_duplicates(docs), "groups").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    groups = written(groups.where(~F.col("kept") | (F.col("n") > 1)), "groups")
    dropped, repeated = groups.where(~F.col("kept")).select("doc_id"), groups.where("kept").select("doc_id")
    n_dropped, n_repeated = dropped.count(), repeated.count()
    found = docs.select(*COLUMNS)
    if n_dropped:
        ids = small(dropped, n_dropped).alias("d")
        found = found.alias("x").join(ids, F.col("x.doc_id").eqNullSafe(F.col("d.doc_id")), "left_anti")
    if n_repeated:
        ids = small(repeated, n_repeated).alias("d")
        same = F.col("x.doc_id").eqNullSafe(F.col("d.doc_id"))
        once = found.alias("x").join(ids, same, "left_semi").dropDuplicates(["doc_id", "text"])
        found = found.alias("x").join(ids, same, "left_anti").unionByName(once)
    return found.select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which too few words lie in benchmark windows to be contaminated.

    A text without words, null ones included, is never contaminated and stays; rows with a
    null or repeated id are judged each by itself; an empty table gives none.
    """
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~decontaminate.contaminated()).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its very text.

    A null text has no ids, as an empty one has; each row gives one; an empty table none.
    """
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    rows = docs.select("doc_id", "lang", "source", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    decoded = tokens.encode_bytes_bpe(rows, vocabulary, decode=True)
    exact = F.sha2("decoded", 256) == F.col("text_sha256")
    return decoded.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), exact.alias("exact"))


STAGES = [
    ("quality", keep_good),
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte-bpe", encode),
]

#: Learned scores, MinHash and tokenizers have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
