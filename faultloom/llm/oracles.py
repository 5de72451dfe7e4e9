"""Independent DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_OP8 = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g USING (text)
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT]::DOUBLE AS weight FROM s),
r AS (  -- sources in the order in which they reach their cap as the level rises
  SELECT *, 2 * source_size AS cap,
         coalesce(sum(2 * source_size) OVER before, 0) AS fixed,
         sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open,
         1.5 * sum(source_size) OVER () AS budget
  FROM w
  WINDOW before AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((budget - fixed) / open, cap / weight) FILTER (WHERE (budget - fixed) / open * weight <= cap) AS level FROM r),
t AS (SELECT source, source_size, least(cap, weight * level) AS target FROM r, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       ((whole + CASE WHEN before + size / 2 < rest THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM x
"""

_OP12 = r"""
WITH RECURSIVE crc(byte, value, step) AS (
  SELECT range::BIGINT, range::BIGINT, 0 FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN value % 2 = 1 THEN xor(value >> 1, 3988292384) ELSE value >> 1 END, step + 1 FROM crc WHERE step < 8),
tab AS (SELECT list(value ORDER BY byte) AS t FROM crc WHERE step = 8),
texts AS (
  SELECT 0 AS kind, row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, coalesce(text, '') FROM benchmark),
words AS (
  SELECT kind, row, doc_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
used AS (SELECT kind, row, word, count(*) AS n FROM (SELECT kind, row, unnest(w) AS word FROM words) GROUP BY ALL),
bytes AS (
  SELECT word, list_transform(range(1, strlen(word) + 1), lambda i: (strpos('0123456789ABCDEF', h[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', h[2 * i]) - 1) AS b
  FROM (SELECT word, hex(encode(word)) AS h FROM (SELECT DISTINCT word FROM used))),
coded AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM bytes, tab),
sums AS (
  SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM used JOIN coded USING (word) GROUP BY bucket),
alls AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM sums),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (s_all + 10000)::DOUBLE / ((s + 1)::DOUBLE * (t_all + 10000)::DOUBLE)))::BIGINT AS gain FROM sums, alls),
weights AS (SELECT row, sum(n * gain)::BIGINT AS weight FROM used JOIN coded USING (word) JOIN gains USING (bucket) WHERE kind = 0 GROUP BY row),
drawn AS (
  SELECT doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         list_reduce(list_prepend(0::BIGINT, list_transform(range(1, 9), lambda i: (strpos('0123456789abcdef', sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[i]) - 1)::BIGINT)),
                     lambda c, x: c * 16 + x) AS h
  FROM words LEFT JOIN weights USING (row) WHERE kind = 0),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM drawn),
placed AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN able AND place <= (SELECT count(*) FROM placed WHERE able) * 10 // 100 THEN place END AS rank
FROM placed
"""

_OP13 = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents),
n AS (SELECT lang, source, row, term, count(*) AS n FROM (SELECT lang, source, row, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS lang_n FROM n GROUP BY lang, term HAVING count(*) >= 3),
langs AS (SELECT lang, count(*) AS v, sum(lang_n) AS total FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT lang, source, term, sum(n) AS n FROM n JOIN kept USING (lang, term) GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM own GROUP BY ALL),
full_table AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
         (1 + 1000000000 * (coalesce(o.n, 0)::HUGEINT + 1) // (coalesce(t.total, 0) + l.v)::HUGEINT)::HUGEINT AS p,
         (1 + 1000000000 * (k.lang_n::HUGEINT + 1) // (l.total + l.v)::HUGEINT)::HUGEINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
  LEFT JOIN totals t ON t.lang = g.lang AND t.source = g.source
  LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM full_table WHERE n > 0 AND p > q),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM full_table a JOIN full_table b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(s.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN sums s ON s.lang = g.lang AND s.source = g.source AND s.item = h.source),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM terms UNION ALL SELECT * FROM pairs))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""

ORACLES: dict[str, str] = {
    "op8_exact_dedup": _OP8,
    "op9_mixing": _OP9,
    "op12_importance_resampling": _OP12,
    "op13_source_divergence": _OP13,
}
