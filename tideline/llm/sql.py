"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP7 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT h, max(page_id) AS owner FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(p.h, CAST(k // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) // CAST(power(32, 3 - k % 4) AS BIGINT)) % 32 + 1 AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p JOIN o ON p.h = o.h"""

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP9 = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
x AS (SELECT DISTINCT item, least(len(w), 13) AS size, w[i:i + least(len(w), 13) - 1] AS piece
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 11))) AS i FROM b WHERE len(w) > 0)),
s AS (SELECT DISTINCT size FROM x),
y AS (SELECT doc_id, i, size, w[i:i + size - 1] AS piece FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, s WHERE len(w) >= size)),
h AS (SELECT y.doc_id, y.i, y.size, x.item FROM y JOIN x ON y.piece = x.piece),
c AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM h) GROUP BY doc_id),
n AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated, sha256(coalesce(items, '')) AS items_sha256
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id"""

MADE_TOOL_CALLS = """
WITH t AS (SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations),
j AS (
  SELECT t.*, t.turn % 3 AS kind, (b.n % 11 <> 0 AND b.n IS NOT NULL) AS answered, (c.conv_id IS NOT NULL AND t.n % 11 <> 0) AS called,
    (t.turn >= 3) AS refers, CASE WHEN t.conv_id % 5 = 4 THEN 'unknown tool' WHEN t.n % 7 = 0 THEN '$.n: out of range' END AS wrong
  FROM t LEFT JOIN t AS b ON b.conv_id = t.conv_id AND b.turn = t.turn + 1 LEFT JOIN t AS c ON c.conv_id = t.conv_id AND c.turn = t.turn - 1)
SELECT conv_id, turn, role,
  CAST(kind = 0 AS BIGINT) AS n_calls, CAST(kind = 1 AS BIGINT) AS n_results,
  CAST((kind = 0 AND answered) OR (kind = 1 AND called) AS BIGINT) AS n_linked,
  CAST((kind = 0 AND wrong IS NOT NULL) OR (kind = 1 AND NOT called) AS BIGINT) AS n_invalid,
  CAST(CASE WHEN kind = 0 THEN turn // 3 WHEN kind = 1 AND called THEN turn // 3 ELSE 0 END AS BIGINT) AS level,
  CASE kind
    WHEN 0 THEN '{"content":null,"items":[{"arguments":{' || CASE WHEN refers THEN '"after":{"$ref":"c' || (turn - 3) || '"},' ELSE '' END
      || '"n":' || (n % 7) || ',"q":"w' || n || '"},' || CASE WHEN wrong IS NULL THEN '' ELSE '"fault":"' || wrong || '",' END
      || '"id":"c' || turn || '","linked":' || CASE WHEN answered THEN 'true' ELSE 'false' END || ',"name":"' || CASE WHEN conv_id % 5 = 4 THEN 'nosuch' ELSE 'find' END || '"}]'
    WHEN 1 THEN '{"content":"' || n || '","items":[{' || CASE WHEN called THEN '' ELSE '"fault":"no call",' END
      || '"id":"' || CASE WHEN n % 11 = 0 THEN 'x' ELSE 'c' END || (turn - 1) || '","linked":' || CASE WHEN called THEN 'true' ELSE 'false' END || '}]'
    ELSE '{"content":"plain ' || n || '"' END || ',"role":"' || role || '","turn":' || turn || '}' AS message
FROM j"""
