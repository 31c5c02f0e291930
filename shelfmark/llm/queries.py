"""The corpus operators on the given tables, one query each, and the SQL that states a result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from shelfmark.llm import (
    contamination, fingerprints, hard_negatives, mixing, near_duplicates, nearest, personal_data, prefix_trie, quality, repeats, secrets,
    tokens, warc,
)
from shelfmark.llm.common import LOWER, UPPER, spans_text, stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
TOKEN_LIMIT = 512


def query(sql: str | None = None):
    """Register a function of a session and a data folder under its name."""

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


_ASCII_LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"
_WORDS_SQL = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query(rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL} AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS_SQL} AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, w[p : p + 9] AS words, len(w[p : p + 9]) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM i WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows
), places AS (
  SELECT r, n, w[p : p + n - 1] AS words, p
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)
), found AS (SELECT r, item_id, n, p FROM places JOIN windows USING (n, words)
), hits AS (SELECT r, count(DISTINCT p + k) AS n_hit FROM (SELECT r, p, unnest(range(n)) AS k FROM found) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""")
def op1_benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = contamination.benchmark_hits(docs, items, slack=0)  # the columns asked for are about exact phrases
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


@query()
def op1_benchmark_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of ``op1_benchmark_hits`` and, beside them, the items with a proximity match."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    hits = contamination.benchmark_hits(docs, items)
    digest = lambda ids: F.sha2(F.array_join(ids, ","), 256)
    return hits.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), digest("items").alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"), F.size("near_items").cast("bigint").alias("n_near_items"),
        digest("near_items").alias("near_items_sha256"), (F.size("near_items") > 0).alias("near_contaminated"),
    )


@query()
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", personal_data.personal_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*personal_data.KINDS))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint") for kind in personal_data.KINDS]
    return found.select(
        "doc_id",
        *[count.alias(f"n_{kind}") for count, kind in zip(counts, personal_data.KINDS)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
        F.array_join(F.transform("found", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


@query()
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", secrets.secret_spans(F.col("text")).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*secrets.KINDS))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint") for kind in secrets.KINDS]
    return found.select(
        "doc_id",
        *[count.alias(f"n_{kind}") for count, kind in zip(counts, secrets.KINDS)],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.col("found")).alias("spans"),
    )


@query()
def op4_edit_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of the texts and their edited texts, and the group of texts with alike fingerprints."""
    return fingerprints.with_near_id(fingerprints.edited_fingerprints(table(spark, sf_dir, "documents")))


_SPACED_SQL = rf"regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+')"


@query(rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_SPACED_SQL} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, w[p : p + 4] AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (shingle) GROUP BY ALL),
link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a AS doc_id, min(b) AS c FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)""")
def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(table(spark, sf_dir, "documents"), percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")


# Base 32 of a hex digest: five hex digits are four letters.
_DIGEST_SQL = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (CAST('0x' || substr(h, {at + 1}, 5) AS INT) // {unit}) % 32 + 1, 1)"
    for at in range(0, 40, 5)
    for unit in (32768, 1024, 32, 1)
)


@query(f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
h AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM h)
SELECT page_id, payload_bytes, {_DIGEST_SQL} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM f""")
def op6_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    counted = docs.select(
        "doc_id", n_bytes.alias("n_bytes"),
        tokens.token_count(F.col("text"), public_tokenizers.path(TOKENIZER)).alias("n_tokens"),
    )
    return counted.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query()
def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query()
def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, taken = mixing.mix(table(spark, sf_dir, "documents"))
    return mixing.taken_per_document(documents, taken).select("doc_id", "size", "source_size", "target", "taken")


@query()
def op10_quality_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    measured = stored(docs.select("doc_id", quality.text_statistics(F.col("text")).alias("statistics")), "statistics")
    held_out = quality.held_out_of(F.col("doc_id"))
    model = quality.fit_quality(measured, labels, ~held_out)
    scored = measured.select(
        "doc_id", held_out.alias("held_out"), quality.quality_score(F.col("statistics"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= quality.LEAST).cast("int"))


# Unsigned CRC-32 of an id's digits, bit by bit.
_CRC32_SQL = """xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda s, b: list_reduce([xor(s, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[],
      lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


@query(f"""
WITH own AS (
  SELECT conv_id, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}}
    ORDER BY turn NULLS FIRST, md5(coalesce(role, '')), md5(coalesce(text, ''))) AS m
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (SELECT *, {_CRC32_SQL} % 6 AS h FROM own
), c AS (
  SELECT a.conv_id, coalesce(b.m[1 : a.h], []) || a.m[a.h + 1 :] AS m
  FROM h a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 100
), path AS (SELECT conv_id, len(m) AS size, m[1 : d] AS k, d FROM (SELECT *, unnest(range(len(m) + 1)) AS d FROM c)
), node AS MATERIALIZED (
  SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, bool_and(size = d) AS leaf,
    (count(*) - 1) * coalesce(length(k[d].t), 0) AS saved, string_agg(conv_id, ',' ORDER BY conv_id) FILTER (size = d) AS ends
  FROM path GROUP BY k, d
), below AS (
  SELECT k[1 : a] AS k, sum(saved) AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT *, unnest(range(d + 1)) AS a FROM node) GROUP BY 1
), children AS (SELECT k[1 : d - 1] AS k, count(*) AS n_children FROM node WHERE d > 0 GROUP BY 1)
SELECT node.conv_id, node.d AS depth, parent.conv_id AS parent_conv_id, node.n AS n_convs,
  coalesce(n_children, 0) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(below.saved AS BIGINT) AS saved_tokens,
  sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN below ON below.k = node.k LEFT JOIN children ON children.k = node.k
LEFT JOIN node parent ON node.d > 0 AND parent.k = node.k[1 : node.d - 1]""")
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of the rebuilt conversations; a code point counts as a token."""
    nodes = prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), shared_heads=True)
    return nodes.withColumnRenamed("saved_chars", "saved_tokens")


@query("""
WITH e AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id,
    CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.r, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.r <> b.r
), p AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score,
    row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS p
  FROM s WHERE same QUALIFY p <= 5
)
SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
  CAST(row_number() OVER (PARTITION BY p.r, p.p ORDER BY score DESC, vec_id) AS INTEGER) AS rank
FROM p JOIN s ON s.r = p.r AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5""")
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth vector as an anchor, against all vectors."""
    embeddings = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("bigint")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    rows = hard_negatives.quantised(embeddings.withColumn("label", moved))
    return hard_negatives.hard_negatives(rows, rows.filter(F.col("vec_id") % 100 == 0))


@query()
def op13_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors found for every hundredth one, by Euclidean distance."""
    return nearest.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


@query(corpus_pipeline.ORACLE_SQL)
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
