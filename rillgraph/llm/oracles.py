"""DuckDB SQL for the operators' queries, where SQL can express them."""

from __future__ import annotations

from .licenses import PERCENT, PHRASES, SLACK, TEMPLATES, block_words, needed, template_sets

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOLDED = f"coalesce(regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"

# Lines with their words; pairs of different lines that share a half, within one word; the earliest place of each line.
LINES = r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS no FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, no, line, list_filter(regexp_split_to_array(lower(line), '[ \t-\r]'), lambda x: x <> '') AS w FROM l),
u AS (SELECT w, len(w) AS m, min((doc_id, no)) AS first FROM w WHERE len(w) > 0 GROUP BY w),
h AS (SELECT w, m, first, whole, unnest([('a', list_slice(w, 1, whole // 2)), ('z', list_slice(w, m - (whole - whole // 2) + 1, m))]) AS half
      FROM (SELECT *, unnest([m, m + 1]) AS whole FROM u WHERE m >= 7)),
p AS (SELECT DISTINCT x.w AS a, y.w AS b, x.first AS f FROM h x JOIN h y ON x.half = y.half AND x.whole = y.whole AND y.first < x.first WHERE greatest(x.m, y.m) >= 8),
c AS (SELECT f, a, b, CASE WHEN len(a) > len(b) THEN a ELSE b END AS x, CASE WHEN len(a) > len(b) THEN b ELSE a END AS y FROM p),
n AS (SELECT DISTINCT f FROM c WHERE len(list_filter(range(1, len(x) + 1), lambda i: list_concat(list_slice(x, 1, i - 1), list_slice(x, i + 1, len(x))) =
      CASE WHEN len(x) = len(y) THEN list_concat(list_slice(y, 1, i - 1), list_slice(y, i + 1, len(y))) ELSE y END)) > 0),
j AS (SELECT w.doc_id, w.no, w.line, len(w.w) > 0 AND (w.doc_id, w.no) <> u.first AS exact, len(w.w) > 0 AND (w.doc_id, w.no) = u.first AND n.f IS NOT NULL AS near
      FROM w LEFT JOIN u ON w.w = u.w LEFT JOIN n ON n.f = u.first),
g AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
      string_agg(line, chr(10) ORDER BY no) FILTER (NOT coalesce(exact, false) AND NOT coalesce(near, false)) AS kept FROM j GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN g ON d.doc_id = g.doc_id"""

# Texts as hex, two characters a byte; every string of 100 bytes with the earliest place where it starts.
SUBSTRINGS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, unnest(range(0, len(x) // 2 - 99)) AS pos, x FROM d WHERE len(x) >= 200),
k AS (SELECT doc_id, pos, md5(substr(x, 2 * pos + 1, 200)) AS k FROM s),
f AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS n FROM k) WHERE n > 1),
r AS (SELECT doc_id, pos, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM (SELECT doc_id, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 100 THEN 0 ELSE 1 END AS new FROM f)),
g AS (SELECT doc_id, run, min(pos) AS a, max(pos) + 100 AS b FROM r GROUP BY doc_id, run),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM g),
t AS (SELECT e.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(x, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS head, max(b) AS tail FROM e JOIN d ON d.doc_id = e.doc_id GROUP BY e.doc_id)
SELECT d.doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t ON t.doc_id = d.doc_id"""


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


# Every window of words at once: a word of a template counts from the first window that reaches it, or from after its
# last place, to the window that begins with it; the running sum is the number of distinct words.
def licenses_sql() -> str:
    phrases = ", ".join(f"({_listed(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(f"({t}, '{label}', {_listed(w.decode() for w in words)}, {needed(len(words), PERCENT)}, {block_words(n, SLACK)})" for t, (label, words, n) in enumerate(template_sets(TEMPLATES)))
    return f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS w FROM documents),
p AS (SELECT * FROM (VALUES {phrases}) v(phrase, label)),
t AS (SELECT * FROM (VALUES {templates}) v(t, label, words, least, size)),
b AS (SELECT doc_id, i, label FROM (SELECT doc_id, w, phrase, label, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, p WHERE len(w) >= len(phrase) AND list_contains(w, phrase[1])) WHERE list_slice(w, i, i + len(phrase) - 1) = phrase),
bs AS (SELECT doc_id, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_distinct(list(label)) AS labels FROM b GROUP BY doc_id),
o AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM d),
tw AS (SELECT t, size, unnest(words) AS word FROM t),
h AS (SELECT doc_id, t, size, i, lag(i) OVER (PARTITION BY doc_id, t, o.word ORDER BY i) AS j FROM o JOIN tw ON o.word = tw.word),
e AS (SELECT doc_id, t, greatest(coalesce(j, i - size) + 1, i - size + 1) AS s, 1 AS x FROM h UNION ALL SELECT doc_id, t, i + 1, -1 FROM h),
r AS (SELECT doc_id, t, sum(x) OVER (PARTITION BY doc_id, t ORDER BY s) AS n FROM e),
m AS (SELECT doc_id, t, max(n) AS n FROM r GROUP BY doc_id, t),
ms AS (SELECT doc_id, list_distinct(list(label)) AS labels, max(n / len(words)) AS score FROM m JOIN t ON m.t = t.t WHERE n >= least GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(array_to_string(list_sort(bs.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(ms.labels, [])))), ',') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(score, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN bs ON bs.doc_id = d.doc_id LEFT JOIN ms ON ms.doc_id = d.doc_id"""


# The checksum by its definition: 256 remainders made by the rule, then a step for each byte.
SHARDS = """
WITH RECURSIVE c AS (SELECT i, 0 AS k, CAST(i AS UBIGINT) AS r FROM range(256) x(i) UNION ALL
  SELECT i, k + 1, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384::UBIGINT) ELSE r >> 1 END FROM c WHERE k < 8),
tab AS (SELECT list(r ORDER BY i) AS t FROM c WHERE k = 8),
x AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT doc_id, len(x) // 2 + 8 AS size, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(0, len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS UBIGINT))),
  lambda a, b: xor(a >> 8, t[CAST(xor(a, b) & 255 AS BIGINT) + 1])), 4294967295::UBIGINT) AS crc FROM x, tab),
o AS (SELECT *, sum(size) OVER (ORDER BY doc_id, size, crc ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER () AS total, row_number() OVER (ORDER BY doc_id, size, crc) AS n FROM v),
s AS (SELECT *, least(23, CAST(floor((upto - size / 2) * 24.0 / total) AS INTEGER)) AS shard FROM o)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'bytes' AS law, CAST(shard AS INTEGER) AS shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY n) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s"""
