"""DuckDB SQL of the registered queries that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

ORACLE["op1_url_filter"] = r"""
WITH u AS (
  SELECT page_id, regexp_extract(url, '^.*?://(.*)$', 1, 's') AS rest FROM pages),
p AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*', 0, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1, 's'), '') AS path,
         row_number() OVER () AS rn
  FROM u),
r(verdict, h, pre) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
m AS (
  SELECT p.rn, arg_max(h || pre, length(h || pre)) AS rule, arg_max(verdict, length(h || pre)) AS verdict
  FROM p JOIN r ON (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)
  GROUP BY p.rn)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.verdict, 'allow') AS verdict
FROM p LEFT JOIN m ON p.rn = m.rn
"""

ORACLE["op10_quality_rules"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS gram
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM g) WHERE c > 1),
cov AS (
  SELECT doc_id, CAST(count(DISTINCT i + k) AS BIGINT) AS n_repeat_words
  FROM rep, (SELECT unnest(range(0, 5)) AS k) GROUP BY doc_id),
l AS (
  SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM d),
ln AS (
  SELECT doc_id, host, text, line,
         trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789',
              'abcdefghijklmnopqrstuvwxyz000000000'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm,
         len(list_filter(string_split_regex(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS nw
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM d GROUP BY host),
freq AS (
  SELECT ln.host, norm FROM ln JOIN hosts ON ln.host = hosts.host
  GROUP BY ln.host, norm, docs
  HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > CAST(0.1 AS DOUBLE) * docs),
gone AS (
  SELECT doc_id, CAST(sum(nw) AS BIGINT) AS removed_words
  FROM ln JOIN freq ON ln.host = freq.host AND ln.norm = freq.norm GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln GROUP BY doc_id),
b AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(removed_words, 0) AS removed_words
  FROM d LEFT JOIN cov ON d.doc_id = cov.doc_id LEFT JOIN gone ON d.doc_id = gone.doc_id
         LEFT JOIN dup ON d.doc_id = dup.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       (NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
        AND n_words - removed_words > 0
        AND n_words - removed_words >= CAST(0.3 AS DOUBLE) * n_words) AS kept,
       removed_words
FROM b
"""

ORACLE["op13_fill_middle"] = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
g AS (
  SELECT *, len(u) AS n,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>')
                   OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
         array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
