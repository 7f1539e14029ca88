from __future__ import annotations

import base64
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow.parquet  # noqa: F401
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from larkspur.llm import decontaminate, hamming, html_text, neardup, quality, queries, sharding, simple8b, tokens, toxicity
from larkspur.llm.common import components, scratch_dir
from larkspur.llm.labels import held_out
from larkspur.llm.words import WordHashes, plain_words, spaced_words

DOC = "doc_id long, text string"
EDGE_TEXTS = [None, "", "   ", "one", "one two three", "One TWO three", "a " * 30_000, "tie tie tie tie tie", "<|endoftext|> <|STARTOFTEXT|>", "é́ \xa0x　 y\x1c\n\n z "]


def edge_docs(spark):
    rows = [(k, t) for k, t in enumerate(EDGE_TEXTS)] + [(None, "no id"), (3, "one"), (3, "one"), (None, None)]
    return spark.createDataFrame(rows, DOC).withColumns({"n_words": F.lit("clash"), "score": F.lit("clash"), "ids": F.lit("clash"), "label": F.lit("clash"), "node": F.lit("clash"), "size": F.lit("clash")})


def texts_with_copies(n=120, seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            base = rng.choice(out).split()
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
        else:
            out.append(" ".join(rng.choices(words, k=rng.randint(1, 120))))
    return out


def exact_groups(texts):
    sets = []
    for t in texts:
        w = spaced_words((t or "").encode())
        sets.append({tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return [len(s) for s in sets], root


@pytest.mark.parametrize("params", [neardup.Forest(), neardup.Forest(region=8), neardup.Forest(region=8, family=6), neardup.Forest(shingles=400)])
def test_near_duplicates_match_brute_force(spark, params):
    texts = texts_with_copies() + [None, "", "x y", "X y"]
    sizes, roots = exact_groups(texts)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(texts)), DOC), params=params).collect()}
    assert [got[k]["n_shingles"] for k in range(len(texts))] == sizes
    assert [got[k]["component_id"] for k in range(len(texts))] == roots
    assert all(got[k]["kept"] == (roots[k] == k) for k in got)


def test_near_duplicates_edge_rows(spark):
    got = [tuple(r) for r in neardup.near_duplicates(edge_docs(spark)).collect()]
    assert len(got) == len(EDGE_TEXTS) + 4
    assert {r[2] for r in got if r[0] == 3} == {3}
    assert (None, 0, None, True) in got
    assert neardup.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(50)] + [(100, k) for k in range(101, 130)] + [(7, 7), (300, 301)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(51)} | {k: 100 for k in range(100, 130)} | {300: 300, 301: 300}


def contaminated_by_hand(texts, items):
    windows = {}
    for name, t in items:
        w = plain_words((t or "").encode())
        size = min(13, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).update([] if name is None else [str(name)])
    out = []
    for t in texts:
        w = plain_words((t or "").encode())
        hit, named = set(), set()
        for g, names in windows.items():
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    named |= names
        out.append((len(w), len(hit), sorted(named)))
    return out


@pytest.mark.parametrize("block", [10_000, 200])
def test_contamination_matches_brute_force(spark, block):
    rng = random.Random(5)
    words = [f"v{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 3, 5, 13, 14, 40])))) for k in range(20)] + [(99, None), (98, "?!"), (97, "same of two"), (96, "Same, of TWO"), (None, " ".join(rng.choices(words, k=15)))]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 30)) + rng.choice([*items[:20], items[-1]])[1].split() + rng.choices(words, k=5)) for _ in range(60)] + EDGE_TEXTS + ["it is the same of two ways"]
    docs = spark.createDataFrame(list(enumerate(texts)), DOC)
    rows = decontaminate.contamination(docs, spark.createDataFrame(items, "item_id long, text string"), block_bytes=block)
    got = {r["doc_id"]: (r["n_words"], r["h"], list(r["items"])) for r in rows.withColumn("h", decontaminate.n_hit()).collect()}
    assert [got[k] for k in range(len(texts))] == contaminated_by_hand(texts, items)


def test_contamination_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.contamination(edge_docs(spark), none)
    assert got.where(decontaminate.n_hit() > 0).count() == 0 and got.count() == len(EDGE_TEXTS) + 4
    assert decontaminate.contamination(spark.createDataFrame([], DOC), none).count() == 0


@pytest.mark.parametrize(("words", "k", "bucket"), [(1, 3, 1 << 14), (2, 10, 8)])
def test_hamming_top_k_matches_brute_force(spark, words, k, bucket):
    rng = np.random.default_rng(2)
    vectors = rng.normal(size=(300, 64 * words))
    vectors[100:180] = vectors[7]  # many copies
    vectors[180:200] = vectors[8] + rng.normal(scale=0.3, size=(20, 64 * words))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(900, None), (None, vectors[0].tolist()), (901, [float("nan"), 1.0])]
    coded = hamming.sign_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    found = hamming.hamming_top_k(coded, coded.where("vec_id % 10 = 0"), k, index_block=64, query_block=8, bucket=bucket).collect()
    bits = {i: np.array([x > 0 for x in v] + [False] * (64 * words - len(v))) for i, v in rows if v is not None and i is not None}
    expected = {(q, r + 1, i, d) for q in bits if q % 10 == 0 for r, (d, i) in enumerate(sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:k])}
    assert {tuple(r) for r in found} == expected


def test_hamming_search_widens_until_near_families_are_covered(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 256, (12, 10), dtype=np.uint8)  # the last bits of two words never vary
    codes = np.repeat(centres, 120, axis=0)
    for k, code in enumerate(codes):
        for b in rng.choice(80, k % 7, replace=False):
            code[b // 8] ^= 1 << b % 8
    rows = [(k, bytes(c)) for k, c in enumerate(codes)] + [(5000, bytes(codes[3])), (5000, bytes(codes[3])), (5001, b""), (None, b"x"), (5002, None)]
    table = spark.createDataFrame(rows, "vec_id long, code binary").withColumn("distance", F.lit("clash"))
    asked = table.where("vec_id % 50 = 0").unionByName(table.where("vec_id = 50"))
    compared = []
    blocks = hamming.by_blocks
    monkeypatch.setattr(hamming, "by_blocks", lambda members, pending, *rest: compared.append(pending.count()) or blocks(members, pending, *rest))
    found = hamming.hamming_top_k(table, asked, 10, bucket=50).collect()
    held = [(k, int.from_bytes(c.ljust(16, b"\0"))) for k, c in rows if c is not None and k is not None]
    wanted = {k: c for k, c in held if k % 50 == 0}
    expected = [(q, r + 1, i, d) for q, code in wanted.items() for r, (d, i) in enumerate(sorted(((code ^ c).bit_count(), i) for i, c in held)[:10])]
    assert sorted(tuple(r) for r in found) == sorted(expected)
    assert sum(compared) < len(wanted) / 2  # most are covered by lookups alone


def test_hamming_edges(spark):
    empty = spark.createDataFrame([], "vec_id long, code binary")
    one = spark.createDataFrame([(7, b"\1"), (9, b"\1")], "vec_id long, code binary")
    assert hamming.hamming_top_k(empty, one, 3).collect() == [] == hamming.hamming_top_k(one, empty, 3).collect()
    assert [tuple(r) for r in hamming.hamming_top_k(one, one.where("vec_id = 9"), 1).collect()] == [(9, 1, 7, 0)]


def test_shards_are_even_gapless_and_grow_only_into_new_ones(spark):
    rng = random.Random(1)
    rows = [(k, "x" * rng.randint(0, 300)) for k in range(3000)] + [(None, "a"), (5, "again"), (5, "again"), (4000, None)]
    docs = spark.createDataFrame(rows, DOC).withColumn("shard", F.lit("clash"))
    path = scratch_dir(spark, "map")
    first = sharding.first_map(sharding.slot_sizes(sharding.sized(docs)), 8)
    sharding.save_map(spark, first, path)
    got = sharding.shard_records(docs, sharding.load_map(spark, path)).collect()
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((len(t or "") + 1, zlib.crc32((t or "").encode())) for _, t in rows)
    load = [0] * 8
    for s in range(8):
        mine = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in mine) == list(range(len(mine)))
        load[s] = sum(r["size"] for r in mine)
    assert max(load) - min(load) <= max(r[3] for r in first)
    second = sharding.rebalanced(first, 9)
    sharding.save_map(spark, second, path)
    moved = {b[1] for a, b in zip(first, second) if a[2] != b[2]}
    assert moved and all(b[2] == 8 for b in second if b[1] in moved)
    new = [0] * 9
    for r in second:
        new[r[2]] += r[3]
    assert max(new) - min(new) < 0.1 * sum(new) / 9
    assert sharding.load_map(spark, path).first()["version"] == 2 and sharding.load_map(spark, path, 1).count() == sharding.SLOTS
    assert sharding.shard_records(spark.createDataFrame([], DOC), sharding.load_map(spark, path)).count() == 0


def test_shard_map_of_nothing():
    assert {r[2] for r in sharding.first_map([], 8)} == set(range(8))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>x";</script></head><body class="has-sidebar">
<header><h2>Site name</h2></header><nav><ul><li><a href="/x">Home</a></li></ul></nav><div id="cookie-notice">We use cookies, as you know, and that is all there is to it for us.</div>
<div class="ad">Buy all of this now, and you will have it for the rest of your life in the end.</div>{open}<h1>The   title</h1><p><b>First &amp; foremost.<br><p>This is the story of a page that is as long as it has to be, so that all of it is decided.</p>
<ul><li>One</li><li>Two</li></ul><p>Short.</p><p>And that is the end&nbsp;of the story, with <a href="/y">one link</a> in it and no more to be said of it.</p>
<form><label>Mail</label><button>Go</button></form><div class="comments"><p>This is the best of all the pages that I have ever had the chance to read.</p></div>{close}
<aside>More of this</aside><footer>&copy; all of us</footer>"""
STORY = "The title First & foremost. This is the story of a page that is as long as it has to be, so that all of it is decided. One Two Short. And that is the end of the story, with one link in it and no more to be said of it."


@pytest.mark.parametrize(("begin", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_main_text(begin, end):
    assert html_text.main_text(PAGE.replace("{open}", begin).replace("{close}", end)) == STORY


def test_main_text_beside_teaser_articles():
    body = "This is the story of a page that is as long as it has to be, and it was told in a plain division because the template of the site has its article elements for cards, which is not at all what they are for in the end."
    codes = "QX-100 RT-200 ZW-300 QX-101 RT-201 ZW-301 QX-102 RT-202 ZW-302 QX-103 RT-203 ZW-303"
    cards = "".join(f'<article><a href="/{k}">Card number {k} of all the cards that there are to be read on this site</a></article>' for k in range(3))
    found = html_text.main_text(f"<body>{cards}<div><p>{body}</p><p>{body}</p></div><p>{codes}</p></body>")
    assert found == f"{body} {body}"
    summary = "<article><p>This is what the story has in it, so that you can see if it is one for you to read.</p></article>"
    assert html_text.main_text(f"{summary}<div><p>{body}</p></div>").endswith(body)
    other = "Wszystkie litery tego akapitu tworzą opowieść, którą warto przeczytać <a href='/x'>dzisiaj</a> wieczorem."
    plain = other.replace("<a href='/x'>", "").replace("</a>", "")
    assert html_text.main_text(f"<p>{codes}</p><article><p>{other}</p></article><p>{codes}</p>") == plain


def test_main_text_edges(spark):
    rows = [(1, "u", None), (2, "u", ""), (3, "u", "<p"), (4, "u", "<article><p>" + "word " * 50_000), (5, None, "<div class=ad>open <article><p>abc</p></article>"), (None, "u", "<nav>a</nav>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 5, None)] == ["", "", "", "abc", ""]
    assert got[4]["n_chars"] == 50_000 * 5 - 1
    assert html_text.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("unit", ["<div class=ad><article>", "<div class=ad><article>x</article>", "<script>", "<p class=ad><li class=ad>", "<!--", "<a href='", '<div class="ad', "<ul class=ad><li>", "</div><div>", "<nav>"])
def test_main_text_is_linear_in_hostile_pages(unit):
    page = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - began < 20


def test_most_blocks_of_pages_are_decided_by_their_words(spark):
    import pyarrow.parquet as pq

    found = [b for h in pq.read_table("/root/testdata/sf0.001/pages.parquet")["html"].to_pylist() for b in html_text.label_blocks(html_text.blocks(h or ""))]
    long = [b for b in found if len(b.text) >= html_text.SHORT and b.label == "text"]
    by_words = sum(html_text.stop_share(b.text) >= html_text.STOP_MIDDLE - html_text.MARKED for b in long)
    assert by_words > 0.5 * len(long), (by_words, len(long))


@settings(max_examples=60, deadline=None)
@given(st.text())
def test_main_text_never_fails(html):
    html_text.main_text(html)
    html_text.main_text("<p>" + html + "<div class='ad'>" + html)


@pytest.fixture(scope="module")
def library():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(P.path("word_bpe_49k.json"))


ALPHABET = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "\xa0", "　", "\x1c", "\x85", "1", "23", ".", ",", "'s", "'S", "!?", "<|endoftext|>", "<|ENDOFTEXT|>", "İ", "ſ", "好", "👍🏽", "́", "\r\n", "the", "ing"]


@settings(max_examples=400, deadline=None)
@given(pieces=st.lists(st.sampled_from(ALPHABET), max_size=16), rest=st.text(max_size=8))
def test_ids_equal_the_libraries(library, pieces, rest):
    text = "".join(pieces) + rest
    data = text.encode()
    bytes_bpe, words = tokens.loaded(tokens.ByteBpe, P.path("byte_bpe_50k.json")), tokens.loaded(tokens.WordBpe, P.path("word_bpe_49k.json"))
    ids = bytes_bpe.ids(data)
    assert ids.tolist() == library[0].encode_ordinary(text)
    assert bytes_bpe.decode(ids.tolist()) == data
    starts, ends = bytes_bpe.offsets(ids)
    if len(ids):
        assert starts[0] == 0 and ends[-1] == len(text) and all(s < e for s, e in zip(starts, ends))
    assert words.ids(data).tolist() == library[1].encode(text, add_special_tokens=False).ids
    assert words.lengths([data]) == [len(words.ids(data))]


def test_parts_join_to_the_text():
    text = (b"word " * 1000 + b"x" * 5000 + b"\n") * 3
    assert b"".join(tokens.parts(text, 700)) == text


def test_small_piece_memory_changes_nothing():
    bpe = tokens.WordBpe(P.path("word_bpe_49k.json"))
    text = " ".join(texts_with_copies()).encode()
    whole = bpe.ids(text).tolist()
    bpe.pieces = tokens.Pieces(bpe._encode, bound=2000)
    assert [i for line in text.split(b" ") for i in bpe.ids(line).tolist()] == whole
    assert len(bpe.pieces.new) < 20


def test_text_without_spaces_is_not_remembered(library):
    rng = random.Random(8)
    texts = ["".join(rng.choices("的一是不了人我在有他这", k=400)) for _ in range(40)]
    for bpe, exact in (
        (tokens.ByteBpe(P.path("byte_bpe_50k.json")), lambda t: library[0].encode_ordinary(t)),
        (tokens.WordBpe(P.path("word_bpe_49k.json")), lambda t: library[1].encode(t, add_special_tokens=False).ids),
    ):
        for t in texts:
            assert bpe.ids(t.encode()).tolist() == exact(t) and bpe.ids(f"a {t} b {t}".encode()).tolist() == exact(f"a {t} b {t}")
        kept = [bpe.pieces] if isinstance(bpe, tokens.WordBpe) else [bpe.first, bpe.later]
        assert all(len(p) <= tokens.LONGEST for c in kept for p in (*c.new, *c.old))
    hashes = WordHashes()
    hashes.array([t.encode() for t in texts])
    assert not hashes


def test_ranks_are_checked(tmp_path):
    tokens.same_ranks(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"))
    other = tmp_path / "ranks"
    other.write_bytes(base64.b64encode(b"no such token") + b" 300\n")
    with pytest.raises(ValueError, match="ranks"):
        tokens.same_ranks(P.path("byte_bpe_50k.json"), str(other))


def test_token_queries_on_edge_rows(spark, library):
    docs = edge_docs(spark)
    vocabulary = P.path("byte_bpe_50k.json")
    rows = tokens.decode_bytes_bpe(tokens.encode_bytes_bpe(docs, vocabulary, offsets=True), vocabulary).collect()
    assert len(rows) == len(EDGE_TEXTS) + 4
    for r in rows:
        if r["doc_id"] not in (None, 3):
            text = EDGE_TEXTS[r["doc_id"]] or ""
            assert bytes(r["decoded"]) == text.encode() and r["ids"] == library[0].encode_ordinary(text)
    counts = {r["doc_id"]: r for r in tokens.token_counts(docs, P.path("word_bpe_49k.json")).collect()}
    for k, text in enumerate(EDGE_TEXTS):
        if k != 3:
            assert counts[k]["n_tokens"] == len(library[1].encode(text or "", add_special_tokens=False).ids)
            assert counts[k]["over_limit"] == (counts[k]["n_tokens"] > 2048) and counts[k]["n_bytes"] == len((text or "").encode())
    assert tokens.token_counts(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**60 - 1)), max_size=600), st.integers(0, 30))
def test_simple8b_round_trip(ids, repeat):
    v = np.array(ids * (1 + repeat), np.uint64)
    words, offsets = simple8b.pack(v)
    assert (simple8b.unpack(words, offsets, len(v)) == v).all()


def test_simple8b_rejects_wide_ids():
    with pytest.raises(ValueError, match="60 bits"):
        simple8b.pack(np.array([2**60], np.uint64))


def test_token_files(spark, library):
    texts = texts_with_copies(80) + [t for t in EDGE_TEXTS]
    rows = [(k * 3 % 101, t) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOC).withColumn("words", F.lit("clash"))
    path = scratch_dir(spark, "tokens")
    simple8b.write_token_files(docs, P.path("word_bpe_49k.json"), path)
    got = {r["doc_id"]: r for r in simple8b.token_file_digests(spark, path).collect()}
    ids_of = {r["doc_id"]: r["ids"] for r in simple8b.read_token_files(spark, path).collect()}
    start = 0
    for name, text in sorted(rows):
        ids = library[1].encode(text or "", add_special_tokens=False).ids + [2]
        assert (got[name]["start"], got[name]["n_tokens"]) == (start, len(ids)) and ids_of[name] == ids
        assert got[name]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def labelled_docs(spark, n=600):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(60)]
    rows, labels = [], []
    for k in range(n):
        toxic, bad = rng.random() < 0.25, rng.random() < 0.25
        text = rng.choices(words, k=rng.randint(20, 80))
        if toxic:
            text[3] = text[9] = rng.choice(["vile", "slur", "scum"])
        rows.append((k, " ".join(w + "$$$" if bad else w for w in text)))
        labels.append((k, 0 if bad else 1, int(toxic)))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def accuracy(scored, labels, column, threshold):
    rows = scored.join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", column).collect()
    assert len(rows) > 100
    return sum((r["score"] >= threshold) == bool(r[column]) for r in rows) / len(rows)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled_docs(spark)
    assert accuracy(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic", 0.5) > 0.97


def test_toxicity_keeps_rare_words_at_any_size(spark):
    fill = spark.range(1500).select(F.col("id").alias("doc_id"), F.expr("repeat('plain ', 20000)").alias("text"))
    toxic = [(k, "plain " * 40 + ("rareslur" if k in (2000, 2003) else "vile")) for k in range(2000, 2300)]
    docs = fill.unionByName(spark.createDataFrame(toxic, DOC))
    docs = docs.where(~held_out(F.col("doc_id"))).unionByName(spark.createDataFrame([(5000, "plain " * 40 + "rareslur"), (5001, "plain " * 40 + "unknown")], DOC))
    labels = docs.select("doc_id", ((F.col("doc_id") % 2 == 0) | (F.col("doc_id") >= 2000)).cast("int").alias("toxic")).where("doc_id < 5000")
    assert labels.where("doc_id in (2000, 2003)").count() == 2
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs.where("doc_id >= 5000"), toxicity.fit(docs, labels)).collect()}
    assert got[5000] > got[5001]


def test_toxicity_sees_the_order_of_words(spark):
    rng = random.Random(4)
    rows = []
    for k in range(900):
        text = rng.choices([f"word{j}" for j in range(60)], k=40)
        for at in (5, 15, 25):
            text[at : at + 2] = ["drop", "dead"] if k % 3 == 0 else ["dead", "drop"]
        rows.append((k, " ".join(text)))
    docs = spark.createDataFrame(rows, DOC)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    assert accuracy(toxicity.score(docs, toxicity.fit(docs, labels)), labels, "toxic", 0.5) > 0.97


def test_toxicity_pair_model_by_hand(spark):
    def row(h, w, toxic, ordinary):
        return [(h, w, 0, toxic), (h, w, 1, ordinary)]

    counted = row(7, 1, 3, 0) + row(7, 2, 1, 4) + row(7, 3, 0, 4) + row(8, 1, 1, 0)
    rows = toxicity.pair_model(spark.createDataFrame([r for r in counted if r[3]], "h long, w long, c long, n long")).collect()
    # After 7: 4 toxic and 8 ordinary, so a share of 1 / 4 is taken from each.
    shares = {1: (0.5, 0.0), 2: (0.0, 0.25), 3: (0.0, 0.25)}
    got = {r["w"]: (r["v"][0], r["v"][1 + toxicity.FOLDS]) for r in rows if r["kind"] == toxicity.PAIR}
    assert got == {w: (a / 0.5, b / 0.5) for w, (a, b) in shares.items()}
    assert [r["v"][0] for r in rows if r["kind"] == toxicity.CONTEXT] == [0.0]
    continued = {}
    for r in rows:
        if r["kind"] == toxicity.CONTINUED:
            continued[r["w"]] = continued.get(r["w"], 0) + r["v"][0]
    assert continued == {1: 2, 2: 1, 3: 1}


def test_toxicity_blocks_change_nothing(spark, monkeypatch):
    docs, labels = labelled_docs(spark, 200)
    whole = {r["doc_id"]: r["score"] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    monkeypatch.setattr(toxicity, "BLOCK_ROWS", 8)
    model = toxicity.fit(docs, labels)
    assert len(model.table.blocks) > 4
    assert {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()} == pytest.approx(whole, abs=1e-5)


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled_docs(spark)
    assert accuracy(quality.score(docs, quality.fit(docs, labels)), labels, "quality", 0.5) > 0.97


@pytest.mark.parametrize("model", [toxicity, quality])
def test_models_edge_rows(spark, model):
    docs, labels = labelled_docs(spark, 60)
    column = "toxic" if model is toxicity else "quality"
    none = labels.limit(0)
    for some in (none, labels.where(F.col(column) == 1), labels):
        scored = model.score(edge_docs(spark), model.fit(docs, some)).collect()
        assert len(scored) == len(EDGE_TEXTS) + 4 and all(0 <= r["score"] <= 1 for r in scored)
    assert model.score(docs.limit(0), model.fit(docs, labels)).count() == 0


def test_held_out_is_by_crc32(spark):
    rows = spark.range(50).select(F.col("id"), held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 3 == 1) for r in rows)


def test_pipeline_stages_against_plain_python(spark, tmp_path):
    docs, labels = labelled_docs(spark, 300)
    rows = [(r["doc_id"], r["text"], "en", "s", len(r["text"])) for r in docs.collect()]
    rng = random.Random(2)
    passage = " ".join(rng.choices([f"bench{k}" for k in range(50)], k=20))
    clean = " ".join(rng.choices([f"word{k}" for k in range(60)], k=40))
    rows += [(1000, clean, "en", "s", 1), (1001, clean, "en", "s", 1), (1002, clean + " " + passage, "en", "s", 1), (1003, None, "en", "s", 0)]
    wide = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, wide).write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert all(r["exact"] for r in kept.values())
    assert 1000 in kept and 1001 not in kept and 1002 not in kept
    want = {r["doc_id"] for r in labels.collect() if r["quality"] == 1 and r["toxic"] == 0}
    assert len(want ^ {k for k in kept if k < 1000}) <= 6
    text = {r[0]: r[1] or "" for r in rows}
    bpe = tokens.loaded(tokens.ByteBpe, P.path("byte_bpe_50k.json"))
    assert all(bpe.decode(r["ids"]).decode() == text[k] for k, r in kept.items())


def test_query_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(queries.queries())
