"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

#: Something but white space, and a stop as the last of it.
SEEN, WHOLE = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"
#: Words between ASCII white space.
WORDS = r"coalesce(regexp_extract_all({}, '[^\x20\x09-\x0D]+'), [])"


def crc32(text: str) -> str:
    """crc32 of an ASCII text: eight shifts for each byte."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    one = "CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END"
    return f"xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: {one}))"


OP11 = f"""WITH o AS (SELECT doc_id, {WORDS.format("text")} AS o, {crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
 g AS (SELECT doc_id, o, len(o) AS n, h % 10 AS h, h // 10 AS g FROM o),
 a AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM g),
 p AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM a),
 w AS (SELECT doc_id, n, CASE WHEN h = 0 AND n > 0 THEN list_transform(range(n), lambda i: CASE WHEN i < a THEN o[i + 1] ELSE o[a + (i - a) % p + 1] END) ELSE o END AS w FROM p),
 x AS (SELECT doc_id, n, unnest(w) AS word, unnest(range(n)) AS i FROM w),
 e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
 s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS part FROM e),
 r AS (SELECT doc_id, min(i) AS start, count(*) + q AS length, q AS period FROM s GROUP BY doc_id, q, part HAVING count(*) + q >= greatest(6, 4 * q)),
 runs AS (SELECT doc_id, start, length, min(period) AS period FROM r GROUP BY doc_id, start, length),
 best AS (SELECT doc_id, count(*) OVER (PARTITION BY doc_id) AS n_runs, start, length, period, row_number() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs),
 told AS (SELECT doc_id, sha256(string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period)) AS h FROM runs GROUP BY doc_id),
 gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
 kept AS (SELECT doc_id, sha256(string_agg(word, ' ' ORDER BY i)) AS h FROM x ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
 SELECT d.doc_id, coalesce(b.n_runs, 0) AS n_runs, b.start, b.length, b.period, 1000 * b.length // b.period AS exponent_milli,
  coalesce(t.h, sha256('')) AS runs_sha256, coalesce(k.h, sha256('')) AS collapsed_sha256
 FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id AND b.k = 1 LEFT JOIN told t ON d.doc_id = t.doc_id LEFT JOIN kept k ON d.doc_id = k.doc_id"""

OP13 = f"""WITH w AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
 x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS i, len(w) AS n, w FROM w),
 k AS (SELECT doc_id, i, word, CASE WHEN i + 20 <= n THEN array_to_string(w[i + 1 : i + 20], ' ') END AS win FROM x),
 f AS (SELECT doc_id, i, word, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM k),
 g AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM f),
 s AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM g GROUP BY doc_id)
 SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents d LEFT JOIN s ON d.doc_id = s.doc_id"""

_OPTIONS = "(VALUES (0, '', 0, ''), (0, 'I', 2, 'u'), (0, 'II', 3, 'ua'), (1, '', 1, ''), (1, 'I', 2, 'u'), (1, 'II', 3, 'ua'), (2, '', 2, ''), (2, 'I', 3, 'a'), (2, 'II', 2, 'au'), (3, '', 3, ''), (3, 'I', 2, 'u'), (3, 'II', 3, 'ua')) o(s, ins, t, lines)"
_ACTIONS = "(VALUES (0, 'D', '', 4, 0), (1, 'D', '', 4, 1), (2, 'D', '', 4, 2), (3, 'D', '', 4, 3), (0, 'K', 's', 0, 1), (0, 'K', 'u', 0, 2), (1, 'K', 'u', 0, 2), (3, 'K', 'u', 0, 2), (2, 'K', 'a', 0, 3), (0, 'R', 'user', 3, 2), (1, 'R', 'user', 3, 2), (3, 'R', 'user', 3, 2), (2, 'R', 'assistant', 3, 3)) a(t, act, whom, price, s2)"
_ADDED = "list_aggregate(list_transform(string_split({}, ''), lambda l: CASE l WHEN 'u' THEN concat(chr(10), 'user:') WHEN 'a' THEN concat(chr(10), 'assistant:') ELSE '' END), 'string_agg', '')"

OP12 = f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32("concat(coalesce(CAST(conv_id AS VARCHAR), ' '), ':', coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM conversations),
 d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM c WHERE kind <> 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS k, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, left(role, 1) AS ini FROM d),
 f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '{SEEN}') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '{WHOLE}') THEN 3 ELSE 0 END AS fault, concat(lag(ini) OVER (PARTITION BY conv_id ORDER BY k), ini) AS pair FROM r),
 dp AS (SELECT conv_id, CAST(0 AS BIGINT) AS k, 0 AS s, {{'cost': 0, 'audit': '', 'lines': ''}} AS m FROM (SELECT DISTINCT conv_id FROM f)
  UNION ALL SELECT conv_id, k, s2 AS s, min(m) AS m FROM (
   SELECT f.conv_id, f.k, a.s2, {{'cost': dp.m.cost + 3 * len(o.ins) + a.price + CASE WHEN f.fault = 3 AND a.act <> 'D' THEN 3 ELSE 0 END, 'audit': concat(dp.m.audit, o.ins, a.act),
     'lines': concat(dp.m.lines, {_ADDED.format("o.lines")}, CASE a.act WHEN 'D' THEN '' WHEN 'K' THEN concat(chr(10), f.role, ':', f.text) ELSE concat(chr(10), a.whom, ':', f.text) END)}} AS m
   FROM dp JOIN f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.k = dp.k + 1 JOIN {_OPTIONS} ON o.s = dp.s JOIN {_ACTIONS} ON a.t = o.t
   WHERE a.act = 'D' OR (f.fault NOT IN (1, 2) AND (a.act = 'R' OR a.whom = f.ini))) GROUP BY conv_id, k, s2),
 n AS (SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (k > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM f GROUP BY conv_id),
 e AS (SELECT dp.conv_id, min({{'cost': m.cost + 3 * len(ins), 'audit': concat(m.audit, ins), 'lines': concat(m.lines, {_ADDED.format("added")})}}) AS m FROM dp JOIN n ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.k = n.n
  JOIN (VALUES (0, '', ''), (1, 'II', 'ua'), (2, 'I', 'a'), (3, '', '')) x(s, ins, added) ON dp.s = x.s GROUP BY dp.conv_id)
 SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(e.m.cost, 0) AS cost,
  coalesce(e.m.audit, '') AS audit, sha256(coalesce(substr(e.m.lines, 2), '')) AS repaired_sha256
 FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN n ON g.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN e ON g.conv_id IS NOT DISTINCT FROM e.conv_id"""
