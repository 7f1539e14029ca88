"""Phrases, fingerprints and compaction against brute force."""

from __future__ import annotations

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter
from datetime import datetime, timedelta

import duckdb
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import compaction, fingerprints, phrases, queries
from larkspur.llm.common import scratch_dir

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


# phrases


def brute_phrases(rows, shortest=2, longest=3, least=10, top=2000, inside=50):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                for i in range(len(w) - m + 1):
                    f[lang, tuple(w[i : i + m])] += 1
    found = {k: v for k, v in f.items() if v >= least and shortest <= len(k[1]) <= longest}
    held = Counter()
    for (lang, w), a in found.items():
        for m in range(shortest, len(w)):
            for i in range(len(w) - m + 1):
                held[lang, w[i : i + m]] = max(held[lang, w[i : i + m]], a)
    out = []
    for (lang, w), a in found.items():
        if 100 * held[lang, w] >= inside * a:
            continue
        score, k = min((1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, f[lang, w[:k]], f[lang, w[k:]], n[lang], score))
    result = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        result += [(lang, k + 1, *r[1:]) for k, r in enumerate(best)]
    return sorted(result)


def mined(spark, rows, **how):
    docs = spark.createDataFrame(rows, "lang string, text string").withColumns({"phrase": F.lit("clash"), "n": F.lit("clash"), "f": F.lit(1)})
    found = phrases.phrases(docs, **how).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in found.collect())


def phrase_rows(seed=5):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(12)] + ["É", "zü", "\x1c", "NY"]
    rows = [(rng.choice(["en", "de", None, "und"]), " ".join(rng.choices(words, [8] * 4 + [1] * 12, k=rng.randint(0, 60))).replace("w7 ", "w7, ").replace("w8 ", "W8\n")) for _ in range(80)]
    return rows + [("en", None), ("en", ""), ("en", " \t "), ("en", "a a a a a a a a a a a a a a"), ("de", ".,;:!?")] + rows[:7]


@pytest.mark.parametrize("how", [{}, {"longest": 5, "least": 3, "top": 7}, {"shortest": 3, "longest": 4, "least": 4}, {"longest": 2, "inside": 10}])
def test_phrases_match_brute_force(spark, how):
    rows = phrase_rows()
    assert mined(spark, rows, **how) == brute_phrases(rows, **how)


def test_phrases_over_cuts_and_shards(spark, monkeypatch):
    # the shard's counts, in this process, with parts of 40 bytes and shards of 30 words
    monkeypatch.setattr(phrases, "CUT", 40)
    monkeypatch.setattr(phrases, "SHARD", 30)
    text = " ".join(random.Random(1).choices(["a", "bb", "a.", "ccc,", "longest-of-all-the-words"], k=900))
    for m in (1, 2, 3, 4):
        shard, held, got = phrases.Shard(m, None), [], Counter()
        import numpy as np

        held = np.zeros(0, np.int32)
        for words in phrases.cut_text(text.encode()):
            held = np.concatenate((held[max(0, len(held) - m + 1) :], shard.words.array(words)))
            shard.add("en", held)
            if shard.full:
                names = [b"\n", *shard.words]
                last = [names[k] for k in held[max(0, len(held) - m + 1) :]]
                for _, some, widths in shard.grams():
                    got.update(dict(zip(some.to_pylist(), widths.tolist())))
                held = shard.words.array(last)
        for _, some, widths in shard.grams():
            got.update(dict(zip(some.to_pylist(), widths.tolist())))
        want = Counter()
        for piece in re.split("[.,]", text):
            w = piece.split()
            want.update(" ".join(w[i : i + m]).encode() for i in range(len(w) - m + 1))
        assert got == want


def test_phrases_of_an_empty_table(spark):
    assert mined(spark, []) == []


@tables
def test_phrases_query_and_sql(spark):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS FROM '{DATA}/documents.parquet'")
    want = c.sql(queries.OP11_SQL)
    found = queries.op11_phrases(spark, DATA)
    assert sorted(tuple(r) for r in found.select(*want.columns).collect()) == sorted(want.fetchall())


# fingerprints


def brute_simhash(text):
    words = re.split("[\x00-\x20]+", text or "")
    if any(len(w) > fingerprints.PIECE for w in words):
        words = re.findall(f"[^\x00-\x20]{{1,{fingerprints.PIECE}}}", text)
    counts, every = [0] * 128, 0
    for i, w in enumerate(words):
        after = words[i + 1] if i + 1 < len(words) else None
        weight = 1 + len(w) + len(after or "")
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        if after is not None:
            h = xxhash.xxh64_intdigest(after.encode(), h)
        for k in range(2):
            x = xxhash.xxh64_intdigest((k).to_bytes(4, "little"), xxhash.xxh64_intdigest(h.to_bytes(8, "little"), 42))
            for b in range(64):
                counts[64 * k + b] += weight * (x >> b & 1)
        every += weight
    return [sum((2 * counts[64 * k + b] > every) << b for b in range(64)) for k in range(2)]


def brute_likeness(a, b):
    d = sum((x ^ y).bit_count() for x, y in zip(a, b))
    return max(0.0, math.cos(math.pi * d / 128))


TEXTS = [None, "", " ", "one", "One two", "the same text of some words", "the same text of some words", "é\xa0ü 𝄞𝄞𝄞 zz\x1cq", "x" * 700, "lang " * 300, "a b c d e f g h i j k l m n o p", "文" * 50]


def test_fingerprints_match_brute_force(spark):
    rng = random.Random(2)
    rows = [(k * 3, t) for k, t in enumerate(TEXTS)] + [(100 + k, " ".join(rng.choices("abcdefghijk", k=rng.randint(1, 90)))) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"id": F.lit("clash"), "k0": F.lit("clash"), "n": F.lit("clash")}).repartition(5)
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(docs).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, reverse=True)
    words = [brute_simhash(t) for _, t in ordered]
    for i, (k, t) in enumerate(ordered):
        t, after = t or "", ordered[(i + 1) % len(ordered)][1] or ""
        cut = len(t) // 3
        edited = t[: len(t) - cut] + after[:cut]
        changed = brute_simhash(edited)
        r = got[k]
        assert r["n_chars"] == len(t)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == "".join(f"{x:016x}" for x in words[i])
        assert r["edited_fingerprint"] == "".join(f"{x:016x}" for x in changed)
        assert r["near_edited"] == pytest.approx(brute_likeness(words[i], changed), abs=1e-12)
        assert r["near_next"] == pytest.approx(brute_likeness(words[i], words[(i + 1) % len(words)]), abs=1e-12)
        assert r["n_near"] == sum(sum((x ^ y).bit_count() for x, y in zip(words[i], w)) <= fingerprints.RADIUS for w in words)


def test_fingerprints_of_repeated_rows_and_null_ids(spark):
    rows = [(5, "five five"), (5, "five five"), (5, "five five"), (None, "none"), (None, None), (7, "seven up"), (5, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.fingerprints(docs, queries=F.col("doc_id") == 5).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(k for k, _ in rows)
    five = [r for r in got if r["doc_id"] == 5 and r["n_chars"] == 9]
    assert sum(r["near_next"] == 1.0 for r in five) >= 2 and {r["n_near"] for r in five} == {3}
    assert sum(r["edited_sha256"] == hashlib.sha256(b"five fiv" [:6] + b"fiv").hexdigest() for r in five) >= 2
    assert all(r["n_near"] is None for r in got if r["doc_id"] != 5)
    # the null rows are the last, and the first document follows the last of them
    nulls = {r["n_chars"]: r for r in got if r["doc_id"] is None}
    assert set(nulls) == {0, 4}
    assert fingerprints.fingerprints(docs.limit(0)).count() == 0
    alone = fingerprints.fingerprints(docs.where("doc_id = 7")).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"seven se").hexdigest()


@pytest.mark.parametrize("radius,kept", [(0, 2), (1, 1), (3, 2), (4, 2), (5, 1)])
def test_the_search_finds_every_pair_once(spark, radius, kept):
    rng = random.Random(radius)
    base = [rng.getrandbits(128) for _ in range(6)]
    codes = list({b ^ sum(1 << p for p in rng.sample(range(128), rng.randint(0, 7))) for b in base for _ in range(25)})
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(c & (1 << 64) - 1), signed(c >> 64)) for c in codes]
    df = spark.createDataFrame(rows, "f0 long, f1 long")
    found = fingerprints.within(df, df.limit(40), radius, kept).collect()
    asked = {tuple(r) for r in df.limit(40).collect()}
    of = dict(zip(rows, codes))
    want = Counter((a, b, d) for a in asked for b in rows if (d := (of[a] ^ of[b]).bit_count()) <= radius)
    assert Counter(((r["q0"], r["q1"]), (r["f0"], r["f1"]), r["distance"]) for r in found) == want


@tables
def test_fingerprints_query_runs_no_python(spark):
    found = queries.op12_fingerprints(spark, DATA)
    plan = found._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    rows = found.collect()
    assert len(rows) == 200 and {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"} <= set(found.columns)
    assert sum(r["near_edited"] > r["near_next"] for r in rows) > 0.9 * len(rows)


# compaction


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80), st.integers(50, 120))
def test_first_fit_is_first_fit(sizes, room):
    rooms, want = [], []
    for s in sizes:
        at = next((k for k, r in enumerate(rooms) if r >= s), None)
        if at is None:
            rooms.append(room)
            at = len(rooms) - 1
        rooms[at] -= s
        want.append(at)
    assert compaction.first_fit(sizes, room) == want


def brute_compaction(rows, layout):
    total = len(rows)
    size = lambda x: 1 + total // x
    days = Counter()
    epoch = datetime(1970, 1, 1)
    day_of = lambda r: None if r[1] is None else (r[1] - epoch).days
    for r in rows:
        days[day_of(r)] += 1
    files = {}
    for r in rows:
        h = 0 if r[0] is None else zlib.crc32(str(r[0]).encode())
        d = day_of(r)
        key = (d, h // 16 % (1 + days[d] // size(layout.lots)), min(h % 4, h // 4 % 4))
        files.setdefault(key, []).append(r)
    order = lambda r: (r[1] is not None, r[1] or epoch, r[0] is not None, r[0] or 0)
    for f in files.values():
        f.sort(key=order)
    final = {}
    for d in days:
        mine = sorted((k for k in files if k[0] == d), key=lambda k: (-len(files[k]), k[1], k[2]))
        groups = []
        for k in mine:
            n = len(files[k])
            if n >= size(layout.little):
                final[k] = [k]
                continue
            group = next((g for g in groups if sum(len(files[x]) for x in g) + n <= size(layout.packed)), None)
            if group is None:
                groups.append([k])
            else:
                group.append(k)
        final.update({g[0]: g for g in groups})
    out = {}
    for k, g in final.items():
        held = [r for x in g for r in files[x]]
        ids = [r[0] for r in held]
        known = [x for x in ids if x is not None]
        cents = sum(math.floor(100 * (r[2] or 0) + 0.5) for r in held if r[2] is None or math.isfinite(r[2]))
        sha = hashlib.sha256(",".join("" if x is None else str(x) for x in ids).encode()).hexdigest()
        out[k] = (len(held), min(known, default=None), max(known, default=None), cents, ",".join(f"{x[1]}-{x[2]}" for x in g), sha, len(g) > 1)
    return out


SCHEMA = "click_id long, arrived_at timestamp_ntz, value double, day string, other timestamp"


def click_rows(n=3000, seed=4):
    rng = random.Random(seed)
    start = datetime(2024, 1, 30)
    rows = []
    for k in range(n):
        at = start + timedelta(seconds=k, days=rng.choice([0, 0, 0, 1, 2, -40000]))
        rows.append((rng.choice([k, k, k, 7, None]), rng.choice([at] * 20 + [None]), rng.choice([1.005, -2.345, 0.0, None, 3e9, float("nan")]), "x", datetime(2024, 5, 1)))
    return rows + rows[:30]


def test_compaction_matches_brute_force(spark):
    rows = click_rows()
    layout = compaction.Layout(lots=30, little=90, packed=60)
    path = scratch_dir(spark, "clicks")
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    found = compaction.compact(df, path, "arrived_at", "click_id", "value", layout).collect()
    got = {(r["day"], r["lot"], r["piece"]): (r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) for r in found}
    # rows with one time and one id may stand in either order, which the digest of ids doesn't show
    assert got == brute_compaction(rows, layout)
    assert sum(r["rewritten"] for r in found) > 5 and not all(r["rewritten"] for r in found)
    assert {r["columns"] for r in found} == {"click_id,arrived_at,value,day,other"}
    listed = {f for f in spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path").toPandas()["path"]}
    assert listed == {r["path"] for r in found}
    # the folder reads back as the table, with its types
    back = spark.read.parquet(path).select(*df.columns)
    assert back.dtypes == df.dtypes
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))


def test_untouched_files_keep_their_bytes(spark):
    rows = click_rows(800, 9)
    layout = compaction.Layout(lots=20, little=60, packed=40)
    df = spark.createDataFrame(rows, SCHEMA)
    path = scratch_dir(spark, "clicks")
    compaction.write_lots(df, path, "arrived_at", "click_id", layout)
    local = lambda p: p.removeprefix("file://").removeprefix("file:")
    files = compaction.files_of(spark, path, df.columns)
    before = {r["path"]: open(local(r["path"]), "rb").read() for r in files.collect()}
    groups = compaction.groups_of(compaction.plan(files, layout.size(len(rows), 60), layout.size(len(rows), 40))).cache()
    from pyspark.sql.pandas.types import to_arrow_schema

    for _ in range(2):  # a task that runs again gives the same files
        merged = compaction.merge_files(spark, groups, f"{path}/_staging", to_arrow_schema(df.schema)).collect()
    compaction.drop_sources(groups)
    assert compaction.drop_sources(groups) == 0
    singles = [r["paths"][0] for r in groups.collect() if len(r["paths"]) == 1]
    assert singles and all(open(local(p), "rb").read() == before[p] for p in singles)
    assert merged and all(pq.ParquetFile(local(r["path"])).metadata.num_row_groups == r["sources"].count(",") + 1 for r in merged)
    gone = {p for r in groups.collect() if len(r["paths"]) > 1 for p in r["paths"]}
    assert not any(os.path.exists(local(p)) for p in gone)


def test_compaction_of_an_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert compaction.compact(df, scratch_dir(spark, "clicks"), "arrived_at", "click_id", "value").count() == 0


@tables
def test_compaction_query(spark):
    if not os.path.exists(f"{DATA}/clicks.parquet"):
        pytest.skip("no clicks")
    rows = [(r["click_id"], r["arrived_at"], r["value"]) for r in spark.read.parquet(f"{DATA}/clicks.parquet").select("click_id", "arrived_at", "value").collect()]
    found = queries.op13_compaction(spark, DATA).collect()
    got = {(r["day"], r["lot"], r["piece"]): (r["n_rows"], r["min_click_id"], r["max_click_id"], r["cents"], r["sources"], r["ids_sha256"], r["rewritten"]) for r in found}
    assert got == brute_compaction(rows, compaction.Layout())
