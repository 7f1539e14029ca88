"""The queries that apply each operator to its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from public_tokenizers import path as tokenizer_path

from . import compaction, decontaminate, fingerprints, hamming, html_text, neardup, phrases, quality, sharding, simple8b, tokens, toxicity
from .common import scratch_dir
from .labels import held_out

#: Shards of the sharding query.
SHARDS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id",
        "n_words",
        decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated().alias("contaminated"),
    )


#: Results of a search.
NEAREST = 10


def op3_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = hamming.sign_codes(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).select("vec_id", "code")
    return hamming.hamming_top_k(rows, rows.where("vec_id % 50 = 0"), NEAREST)


def op4_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch_dir(spark, "slot-map")
    sharding.save_map(spark, sharding.first_map(sharding.slot_sizes(sharding.sized(docs)), SHARDS), path)
    rows = sharding.shard_records(docs, sharding.load_map(spark, path))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: Scores from which a document is called toxic, or of good quality.
TOXIC, GOOD = 0.7, 0.5


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = tokenizer_path("byte_bpe_50k.json")
    tokens.same_ranks(vocabulary, tokenizer_path("byte_bpe_50k.tiktoken"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = tokens.encode_bytes_bpe(docs, vocabulary, decode=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark, "token-files")
    simple8b.write_token_files(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), path)
    return simple8b.token_file_digests(spark, path)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs, tokenizer_path("word_bpe_49k.json"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrases(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return fingerprints.fingerprints(docs, queries=F.col("doc_id") % 50 == 0)


def op13_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    clicks = table(spark, sf_dir, "clicks")
    return compaction.compact(clicks, scratch_dir(spark, "clicks"), "arrived_at", "click_id", "value")


def queries() -> dict:
    found = (
        op1_near_duplicates,
        op2_decontaminate,
        op3_hamming_top_k,
        op4_virtual_slots,
        op5_html_text,
        op6_toxicity,
        op7_byte_bpe,
        op8_simple8b,
        op9_quality,
        op10_token_counts,
        op11_phrases,
        op12_fingerprints,
        op13_compaction,
    )
    return {f.__name__: f for f in found}


_TOKENS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{words}')"

OP1_SQL = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce({_TOKENS.format(words="[^ \\x09-\\x0D]+")}, []) AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words
), shingles AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (g)
  WHERE a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, l.component_id, s.doc_id = l.component_id AS kept
FROM sets s JOIN least l USING (doc_id)
"""

_PLAIN = _TOKENS.format(words="[0-9a-z\\x{80}-\\x{10FFFF}]+")

OP2_SQL = f"""
WITH items AS (
  SELECT item_id::VARCHAR AS item_id, {_PLAIN} AS w FROM benchmark WHERE text IS NOT NULL
), windows AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: w[i:i + 12])) AS g FROM items WHERE len(w) > 0
), sizes AS (SELECT DISTINCT len(g) AS k FROM windows),
docs AS (SELECT doc_id, coalesce({_PLAIN}, []) AS w FROM documents),
runs AS (
  SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM docs, sizes WHERE len(w) >= k
), hits AS (
  SELECT r.doc_id, r.i, r.k, x.item_id FROM runs r JOIN windows x ON w[i:i + k - 1] = x.g
), covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)
"""


OP3_SQL = """
WITH codes AS (
  SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), pairs AS (
  SELECT q.vec_id AS query_id, x.vec_id, list_sum(list_transform(list_zip(q.c, x.c), lambda p: abs(p[1] - p[2])))::INT AS distance
  FROM codes q, codes x WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id)::INT AS rank FROM pairs)
SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
"""


OP11_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS p
  FROM documents
), words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM words, range(1, 4) t(m) WHERE len(w) >= m
), f AS (SELECT lang, m, g, count(*) AS f FROM grams GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
found AS (SELECT lang, m, g, f AS a, string_split(g, ' ') AS w FROM f WHERE m >= 2 AND f >= 10),
cuts AS (
  SELECT c.*, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT lang, m, g, a, w, unnest(range(1, m)) AS k FROM found) c
  JOIN f x ON x.lang = c.lang AND x.g = array_to_string(w[:k], ' ') AND x.m = k
  JOIN f y ON y.lang = c.lang AND y.g = array_to_string(w[k + 1:], ' ') AND y.m = c.m - k
), scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, g, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS g FROM found WHERE m = 3) GROUP BY lang, g
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN longer x ON x.lang = s.lang AND x.g = s.g AND s.m = 2 WHERE x.a IS NULL OR 100 * x.a < 50 * s.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM kept JOIN total USING (lang) QUALIFY rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_duplicates": OP1_SQL, "op2_decontaminate": OP2_SQL, "op3_hamming_top_k": OP3_SQL, "op11_phrases": OP11_SQL}
