"""Every registered query of an operator over the smallest tables: the contract's columns and
types, and the rows of its SQL where it has one."""

from __future__ import annotations

import glob
import hashlib
import os
import zlib

import duckdb
import pytest

from larkspur.llm import queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

COLUMNS = {
    "op1_near_duplicates": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op2_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op3_hamming_top_k": "query_id bigint, rank int, vec_id bigint, distance int",
    "op4_virtual_slots": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op5_html_text": "page_id bigint, url string, text string, n_chars bigint",
    "op6_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op7_byte_bpe": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string",
    "op8_simple8b": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op9_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op10_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op11_phrases": "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint",
    "op12_fingerprints": "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    "op13_compaction": "day bigint, lot bigint, piece bigint, n_rows bigint, min_click_id bigint, max_click_id bigint, cents bigint, sources string, ids_sha256 string, columns string, path string, rewritten boolean",
}


@pytest.fixture(scope="module")
def made(spark):
    kept = {}

    def of(name):
        if name not in kept:
            kept[name] = queries.queries()[name](spark, DATA).cache()
        return kept[name]

    return of


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_every_operator_has_its_columns_listed():
    assert set(COLUMNS) == set(queries.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(made, tables, name):
    found = made(name)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c, _ in (x.split() for x in COLUMNS[name].split(", "))} == dict(x.split() for x in COLUMNS[name].split(", "))
    if "doc_id" in kinds:
        assert sorted(r[0] for r in found.select("doc_id").collect()) == sorted(r[0] for r in tables.sql("SELECT doc_id FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(made, tables, name):
    want = tables.sql(queries.oracle_sql()[name])
    assert sorted(tuple(r) for r in made(name).select(*want.columns).collect()) == sorted(want.fetchall())


def test_placement_by_its_law(made, tables):
    texts = dict(tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    rows = made("op4_virtual_slots").collect()
    load = [0] * 8
    for r in rows:
        data = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        load[r["shard"]] += r["size"]
    largest = max(len(t.encode()) + 1 for t in texts.values())
    assert max(load) - min(load) <= 2 * largest
    for shard in range(8):  # slots are numbered without gaps within a shard
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_limits_and_held_out_rows(made):
    for r in made("op10_token_counts").collect():
        assert r["over_limit"] == (r["n_tokens"] > 2048)
    for name, cut in (("op6_toxicity", 0.7), ("op9_quality", 0.5)):
        for r in made(name).collect():
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
            assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= cut)


def test_digests_of_tokens(made, tables):
    import tiktoken
    import tiktoken.load
    import public_tokenizers as P

    ranks = tiktoken.load.load_tiktoken_bpe(P.path("byte_bpe_50k.tiktoken"))
    encoding = tiktoken.Encoding("x", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = dict(tables.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())
    for r in made("op7_byte_bpe").collect():
        ids = encoding.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
