"""Queries over whole tables, one per operator, with the digest columns asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html, jaccard, language, licenses, lines, mixing, oracles, perplexity, sharding, substrings
from .common import table

N_SHARDS = 24


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("spans")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~language.held_out()))
    return language.identify(docs, model).select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return perplexity.judge(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).drop("blocks")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


QUERIES = {
    q.__name__: q
    for q in (op1_decontamination, op2_html_extraction, op3_line_dedup, op4_sharding, op5_suffix_array_dedup, op6_language_id, op7_mixing, op8_quality_rules, op9_license_scans, op10_jaccard_join)
}

_FOLDED = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLES = {
    "op3_line_dedup": oracles.LINES,
    "op4_sharding": oracles.SHARDS,
    "op5_suffix_array_dedup": oracles.SUBSTRINGS,
    "op9_license_scans": oracles.licenses_sql(),
    "op1_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_FOLDED}, []) AS w FROM documents),
b AS (SELECT item_id, {_FOLDED} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, list_slice(w, i, i + least(len(w), 10) - 1) AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
h AS (SELECT doc_id, i, g.n, item_id FROM g JOIN p ON g.n = p.n AND g.g = p.g),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN m ON d.doc_id = m.doc_id""",
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(1, len(w) - 3) + 1), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))) END AS s FROM w),
n AS (SELECT doc_id, len(s) AS n, list_sort(s) AS s FROM s),
c AS (SELECT s, n, min(doc_id) AS rep FROM n WHERE n > 0 GROUP BY s, n),
p AS (SELECT rep, n, unnest(list_slice(s, 1, n - (85 * n + 99) // 100 + 1)) AS t FROM c),
q AS (SELECT DISTINCT a.rep AS a, b.rep AS b FROM p a JOIN p b ON a.t = b.t AND a.rep < b.rep WHERE 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
v AS (SELECT a, b, ca.n AS na, cb.n AS nb, len(list_intersect(ca.s, cb.s)) AS i FROM q JOIN c ca ON ca.rep = a JOIN c cb ON cb.rep = b),
l AS (SELECT a, b FROM v WHERE 100 * i >= 85 * (na + nb - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT rep, rep FROM c),
r AS (SELECT a AS id, b AS root FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.root = e.a),
k AS (SELECT id, min(root) AS component_id FROM r GROUP BY id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_shingles, coalesce(k.component_id, n.doc_id) AS component_id
FROM n LEFT JOIN c ON n.s = c.s AND n.n = c.n LEFT JOIN k ON k.id = c.rep""",
}
