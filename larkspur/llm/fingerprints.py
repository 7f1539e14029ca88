"""SimHash fingerprints of documents by built-in expressions alone, and their Hamming search.

A text is split at white space and control characters, and words over PIECE characters are cut
into pieces of so many; its terms are the pieces with the piece that follows, the last one
alone. A term weighs one vote more than it has characters. Every hash bit of a term votes for or against
the same bit of the fingerprint, so an edit of a share of the text moves about the angle that
the share makes. Votes are plain sums: bit i and bit i + 32 of a hash share one 64-bit sum, so
a fingerprint of 128 bits takes 64 sums in one aggregation.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import small, written

#: Longest piece of a word, in characters: text without white space has terms too.
PIECE = 16
#: 64-bit words of a fingerprint.
WORDS = 2
BITS = 64 * WORDS
#: Radius of the search, and blocks whose agreement makes a table's key.
RADIUS, KEPT = 4, 2
_LANES = 0x0000000100000001
_NAMES = [f"f{w}" for w in range(WORDS)]


def with_pieces(rows: DataFrame, text: str) -> DataFrame:
    """rows with the array `_p` of the text's pieces, one at least, in place of the text."""
    words = rows.withColumn("_p", F.split(F.coalesce(F.col(text), F.lit("")), r"[\x00-\x20]+"))
    cut = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"[^\x00-\x20]{{1,{PIECE}}}"), F.lit(0))
    longer = F.exists("_p", lambda x: F.length(x) > PIECE)
    return words.withColumn("_p", F.when(longer, cut).otherwise(F.col("_p"))).drop(text)


def simhash(rows: DataFrame, by: Sequence[str], text: str = "text") -> DataFrame:
    """by, f0, f1: the fingerprint of each row, whose columns `by` tell rows apart.

    One aggregation by those columns; rows that are dealt out by any of them already are not
    shuffled again. Rows with the same `by` are one text. A null or empty text has a
    fingerprint like any other, and equal texts have equal ones."""
    each = with_pieces(rows.select(*by, text), text).select(*by, "_p", F.posexplode("_p").alias("_i", "_x"))
    follower = F.get("_p", F.col("_i") + 1)
    weight = (1 + F.length("_x") + F.coalesce(F.length(follower), F.lit(0))).cast("long")
    each = each.select(*by, weight.alias("_w"), F.xxhash64("_x", follower).alias("_h"))
    each = each.select(*by, "_w", *(F.xxhash64("_h", F.lit(w)).alias(f"_h{w}") for w in range(WORDS)))
    lane = F.lit(_LANES)
    sums = [F.sum(F.shiftrightunsigned(f"_h{w}", i).bitwiseAND(lane) * F.col("_w")).alias(f"_s{w}_{i}") for w in range(WORDS) for i in range(32)]
    voted = each.groupBy(*by).agg(F.sum("_w").alias("_all"), *sums)

    def bit(w: int, i: int) -> Column:
        s = F.col(f"_s{w}_{i % 32}")
        votes = s.bitwiseAND(F.lit(0xFFFFFFFF)) if i < 32 else F.shiftrightunsigned(s, 32)
        return F.shiftleft((2 * votes > F.col("_all")).cast("long"), i)

    def word(w: int) -> Column:
        out = bit(w, 0)
        for i in range(1, 64):
            out = out.bitwiseOR(bit(w, i))
        return out

    return voted.select(*by, *(word(w).alias(n) for w, n in enumerate(_NAMES)))


def hexed(words: Sequence[Column]) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(w), 16, "0") for w in words)))


def hamming(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = F.bit_count(a[0].bitwiseXOR(b[0]))
    for x, y in zip(a[1:], b[1:]):
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def likeness(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The cosine of the angle that the differing bits stand for, 0 beyond a right angle."""
    return F.greatest(F.lit(0.0), F.cos(hamming(a, b) * F.lit(math.pi / BITS)))


def _spans(blocks: int) -> list[tuple[int, int, int]]:
    """(word, first bit, bits) of each block; blocks stay within a word."""
    each = blocks // WORDS
    out = []
    for w in range(WORDS):
        ends = [64 * k // each for k in range(each + 1)]
        out += [(w, a, b - a) for a, b in zip(ends, ends[1:])]
    return out


def _block(prefix: str, span: tuple[int, int, int]) -> Column:
    w, first, size = span
    return F.shiftrightunsigned(F.shiftleft(f"{prefix}f{w}", 64 - first - size), 64 - size)


def within(index: DataFrame, queries: DataFrame, radius: int = RADIUS, kept: int = KEPT) -> DataFrame:
    """(q0, q1, f0, f1, distance): every distinct fingerprint of index within the radius of
    each distinct one of queries, both (f0, f1).

    With radius + kept blocks, two fingerprints within the radius agree in `kept` blocks at
    least. There is a table for each choice of so many blocks, whose key is those blocks put
    first; all tables are joined in one pass. A pair is given by the first of its tables
    alone, so none comes twice, and none is missed. Fingerprints with NULLs match nothing."""
    blocks = radius + kept + (radius + kept) % WORDS  # an even number; one block more than needed does no harm
    spans = _spans(blocks)
    chosen = list(combinations(range(blocks), blocks - radius))

    def tables(rows: DataFrame, prefix: str) -> DataFrame:
        named = rows.select(*(F.col(n).alias(f"{prefix}{n}") for n in _NAMES)).dropna().distinct()
        keys = F.array(*(F.xxhash64(*(_block(prefix, spans[b]) for b in c), F.lit(k)) for k, c in enumerate(chosen)))
        return named.select("*", F.posexplode(keys).alias(f"{prefix}table", f"{prefix}key"))

    a, b = tables(queries, "q"), tables(index, "i")
    same = F.array(*(F.when(_block("q", s) == _block("i", s), F.lit(k)) for k, s in enumerate(spans)))
    first = F.slice(F.array_compact(same), 1, blocks - radius)
    own = F.element_at(F.array(*(F.array(*(F.lit(x) for x in c)) for c in chosen)), F.col("qtable") + 1)
    q, f = [F.col(f"q{n}") for n in _NAMES], [F.col(f"i{n}") for n in _NAMES]
    near = (F.col("qtable") == F.col("itable")) & (F.col("qkey") == F.col("ikey")) & (hamming(q, f) <= radius) & (first == own)
    out = a.join(b, near)
    return out.select(*(F.col(f"q{n}").alias(f"q{k}") for k, n in enumerate(_NAMES)), *(F.col(f"i{n}").alias(n) for n in _NAMES), hamming(q, f).alias("distance"))


def following(keys: DataFrame, parts: int) -> DataFrame:
    """keys (k0, k1, id, ...) with next0 and next1, the key after each in descending order of
    id (nulls last), then of the key; after the last comes the first.

    Ranges of ids are written with their number; within a range the next row is a window's,
    and a range's last row is followed by the first of the next range, of which there is a
    row each. No task orders more than a range."""
    order = [F.desc_nulls_last("id"), F.asc("k0"), F.asc("k1")]
    ranged = written(keys.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "ranges")
    w = W.partitionBy("range").orderBy(*order)
    rows = ranged.withColumns({"_n": F.row_number().over(w), "next0": F.lead("k0").over(w), "next1": F.lead("k1").over(w)})
    heads = rows.where("_n = 1").select("range", F.col("k0").alias("h0"), F.col("k1").alias("h1"))
    ends = W.orderBy("range")  # a row a range
    wrapped = lambda c: F.coalesce(F.lead(c).over(ends), F.first(c).over(ends))
    heads = heads.select("range", wrapped("h0").alias("h0"), wrapped("h1").alias("h1"))
    out = rows.join(F.broadcast(heads), "range")
    return out.withColumns({f"next{i}": F.when(F.col("next0").isNull(), F.col(f"h{i}")).otherwise(F.col(f"next{i}")) for i in range(2)}).drop("h0", "h1", "range", "_n")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", queries: Column | None = None, radius: int = RADIUS) -> DataFrame:
    """A row for each document: id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_near.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many,
    or all, of the next document's in descending order of id, the first coming after the last.
    near_edited and near_next are the likeness of the document's fingerprint to the edited
    text's and to the next document's. n_near counts the documents, itself included, with a
    fingerprint within the radius, for the documents that `queries` selects (all where it is
    None), else it is NULL.

    Null texts count as empty and have a fingerprint. Null ids come last; documents with one id
    follow each other in an order of their own that their texts decide; a row that is repeated
    as a whole is followed by its own copies. Other columns are left out, and an empty table
    gives no rows. A document alone is followed by itself. Texts are shuffled once, by a key of
    128 bits of id and text; the new ends of edited texts once more; nothing else has texts.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), wanted.alias("wanted"))
    rows = rows.select("*", *(F.xxhash64("id", F.col("id").isNull(), "text", F.lit(k)).alias(f"k{k}") for k in range(2)))
    kinds = rows.groupBy("k0", "k1", "id", F.length("text").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("copies"), F.max("wanted").alias("wanted"))
    kinds = written(following(kinds, parts), "order")
    texts = rows.select("k0", "k1", "text")
    repeated = kinds.where("copies > 1")
    n_repeated = repeated.count()
    if n_repeated:  # one row for each: their copies are counted above
        ids = small(repeated.select("k0", "k1"), n_repeated)
        once = texts.join(ids, ["k0", "k1"], "left_semi").groupBy("k0", "k1").agg(F.any_value("text").alias("text"))
        texts = texts.join(ids, ["k0", "k1"], "left_anti").unionByName(once)

    # whose end each text replaces, and by how many characters; a row's copies follow itself
    cut = F.floor(F.col("n") / 3).cast("int").alias("cut")
    asked = kinds.select(F.col("next0").alias("k0"), F.col("next1").alias("k1"), F.col("k0").alias("t0"), F.col("k1").alias("t1"), cut, F.lit(False).alias("own"))
    asked = asked.unionByName(repeated.select("k0", "k1", F.col("k0").alias("t0"), F.col("k1").alias("t1"), cut, F.lit(True).alias("own")))
    heads = texts.join(asked, ["k0", "k1"]).select(F.col("t0").alias("k0"), F.col("t1").alias("k1"), "own", "cut", F.expr("left(text, cut)").alias("head"))
    edited = F.concat(F.expr("left(text, char_length(text) - cut)"), F.col("head"))
    both = texts.join(heads, ["k0", "k1"]).select("k0", "k1", "own", "text", edited.alias("edited"))
    both = both.select("k0", "k1", "own", F.unhex(F.sha2("edited", 256)).alias("sha"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    hashed = simhash(both, ["k0", "k1", "own", "sha", "which"])
    pair = [F.max(F.when(F.col("which") == k, F.col(n))).alias(p + n) for k, p in enumerate(("", "e")) for n in _NAMES]
    found = written(hashed.groupBy("k0", "k1", "own", "sha").agg(*pair), "fingerprints")

    mine, changed, after = ([F.col(p + n) for n in _NAMES] for p in ("", "e", "n"))
    follower = found.where("NOT own").select(F.col("k0").alias("next0"), F.col("k1").alias("next1"), *(F.col(n).alias(f"n{n}") for n in _NAMES))
    out = found.join(kinds.select("k0", "k1", "id", "n", "copies", "wanted", "next0", "next1"), ["k0", "k1"]).join(follower, ["next0", "next1"])
    # of a row with copies the last is followed by another, and those before by the copy
    out = out.withColumn("times", F.when(F.col("own"), F.col("copies") - 1).otherwise(1))
    out = out.where("times > 0").withColumn("_", F.explode(F.expr("sequence(1L, times)")))
    counted = written(found.where("NOT own").join(kinds.select("k0", "k1", "copies", "wanted"), ["k0", "k1"]).groupBy(*_NAMES).agg(F.sum("copies").alias("docs"), F.max("wanted").alias("wanted")), "counted")
    near = within(counted, counted.where("wanted"), radius).join(counted.select(*_NAMES, "docs"), list(_NAMES))
    near = near.groupBy(*(F.col(f"q{k}").alias(n) for k, n in enumerate(_NAMES))).agg(F.sum("docs").alias("near"))
    out = out.join(near, list(_NAMES), "left")
    return out.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_chars"),
        F.lower(F.hex("sha")).alias("edited_sha256"),
        hexed(mine).alias("fingerprint"),
        hexed(changed).alias("edited_fingerprint"),
        likeness(mine, changed).alias("near_edited"),
        F.when(F.col("own"), 1.0).otherwise(likeness(mine, after)).alias("near_next"),
        F.when(F.col("wanted"), F.col("near")).alias("n_near"),
    )
