"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op3_warc"] = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p
), r AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND newest <> page_id THEN newest END AS refers_to
FROM r
"""

SQL["op4_url_filter"] = r"""
WITH c AS (
  SELECT DISTINCT page_id, url, TIMESTAMP '2024-01-01' + to_minutes(coalesce(page_id * 7919 % 525600, 0)) AS t,
         nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '') AS host,
         list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS seg
  FROM pages
), hosts AS (
  SELECT DISTINCT host, ('0x' || substr(md5(host), 1, 6))::BIGINT AS h FROM c WHERE host IS NOT NULL AND length(host) <= 253
), log AS (
  SELECT 'spam' AS list_name, 'block' AS verdict, 'domain' AS kind, regexp_replace(host, '^(www|m|blog)[.]', '') AS pattern,
         'add' AS action, 0 AS day FROM hosts WHERE regexp_matches(host, 'casino|bets|pills|spam|ads-|adult')
  UNION ALL SELECT 'watch', 'block', 'domain', host, 'add', h % 200 FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT 'watch', 'block', 'domain', host, 'remove', h % 200 + 30 + h % 60 FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT 'watch', 'block', 'domain', host, 'add', 300 FROM hosts WHERE h % 6 = 0
  UNION ALL SELECT 'sections', 'allow', 'prefix', host || '/en', 'add', 31 + h % 100 FROM hosts WHERE h % 5 = 1
), dated AS (
  SELECT list_name, verdict, kind, pattern, TIMESTAMP '2024-01-01' + to_days(day::INT) AS since, max(action) AS action FROM log GROUP BY ALL
), spans AS (
  SELECT *, lead(since) OVER (PARTITION BY list_name, verdict, kind, pattern ORDER BY since) AS until FROM dated
), hit AS (
  SELECT c.page_id, c.url, c.t, s.*, row_number() OVER (PARTITION BY c.page_id, c.url, c.t
           ORDER BY length(s.pattern) DESC, s.verdict = 'allow' DESC, s.list_name DESC, s.pattern DESC) AS place,
         count(*) OVER (PARTITION BY c.page_id, c.url, c.t) AS n
  FROM c JOIN spans s ON s.action = 'add' AND c.t >= s.since AND (s.until IS NULL OR c.t < s.until) AND (
    (s.kind = 'domain' AND (c.host = s.pattern OR ends_with(c.host, '.' || s.pattern)))
    OR (s.kind = 'prefix' AND (s.pattern = c.host || '/' || c.seg[1] OR s.pattern = c.host || '/' || c.seg[1] || '/' || c.seg[2])))
)
SELECT c.page_id, c.url, strftime(c.t, '%Y-%m-%d %H:%M:%S') AS fetch_time, coalesce(hit.verdict, 'none') AS verdict,
       hit.list_name, hit.kind, hit.pattern, strftime(hit.since, '%Y-%m-%d %H:%M:%S') AS active_since,
       strftime(hit.until, '%Y-%m-%d %H:%M:%S') AS active_until, coalesce(hit.n, 0) AS n_active
FROM c LEFT JOIN hit ON c.page_id = hit.page_id AND c.url = hit.url AND c.t = hit.t AND hit.place = 1
"""

SQL["op1_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), w AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'),
         lambda x: x <> '') AS words FROM raw
), l AS (
  SELECT doc_id, line_no, len(words) AS n, array_to_string(words, ' ') AS line, words FROM w WHERE len(words) > 0
), d AS (
  SELECT line, any_value(n) AS n, any_value(words) AS words, min((doc_id, line_no)) AS first FROM l GROUP BY line
), v AS (
  SELECT line, first, n, p, array_to_string(words[:p - 1] || words[p + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, n + 1)) AS p FROM d WHERE n >= 8)
), pair AS (
  SELECT a.first AS x, b.first AS y FROM v a JOIN v b ON a.rest = b.rest AND a.n = b.n AND a.p = b.p AND b.first < a.first
  UNION ALL SELECT a.first, b.first FROM v a JOIN d b ON a.rest = b.line AND b.n >= 8 AND b.first < a.first
  UNION ALL SELECT b.first, a.first FROM v a JOIN d b ON a.rest = b.line AND b.n >= 8 AND a.first < b.first
), k AS (
  SELECT x, min(y) AS keeper FROM pair GROUP BY x
)
SELECT l.doc_id, l.line_no, l.n AS n_words, k.keeper IS NULL AND d.first = (l.doc_id, l.line_no) AS kept,
       CASE WHEN d.first <> (l.doc_id, l.line_no) THEN 'exact' WHEN k.keeper IS NOT NULL THEN 'near' END AS reason,
       CASE WHEN k.keeper IS NOT NULL THEN k.keeper[1] WHEN d.first <> (l.doc_id, l.line_no) THEN d.first[1] END AS keeper_doc_id,
       CASE WHEN k.keeper IS NOT NULL THEN k.keeper[2] WHEN d.first <> (l.doc_id, l.line_no) THEN d.first[2] END AS keeper_line_no
FROM l JOIN d USING (line) LEFT JOIN k ON k.x = d.first
"""

SQL["op2_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
    FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS p FROM w WHERE len(words) > 0))
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)
), edge AS (
  SELECT a, b FROM link UNION ALL SELECT b, a FROM link
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM reach r JOIN edge e ON e.a = r.other
), c AS (
  SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, c.doc_id = c.component_id AS kept
FROM c LEFT JOIN n USING (doc_id)
"""


def crc32(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes."""
    bits = "list_reduce(list_prepend(xor(c, b), range(8)), lambda v, k: xor(v >> 1, (v & 1) * 3988292384))"
    octets = f"list_transform(range(0, octet_length(encode({text}))), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: {bits}), 4294967295::BIGINT)"


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op11_spelling"] = f"""
WITH RECURSIVE r AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[a-z\u00C0-\u00FF]+')) AS run
  FROM documents
), d AS (
  SELECT doc || ':' || run AS named, run, count(*) AS c FROM r WHERE length(run) >= 5 GROUP BY ALL
), h AS (
  SELECT run, c, {crc32("named")} AS h FROM d
), o AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM h
), v AS (
  SELECT word, sum(c)::BIGINT AS n FROM o WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), x AS (
  SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM v)
), pair AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM x a JOIN x b ON a.rest = b.rest AND a.p = b.p AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN v b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM x a JOIN v b ON a.rest = b.word
), best AS (
  SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place, count(*) OVER (PARTITION BY word) AS n_near FROM pair
), j AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 2 * v.n THEN near END AS form, CASE WHEN near_n >= 2 * v.n THEN near_n END AS form_n
  FROM v LEFT JOIN best ON best.word = v.word AND place = 1
), chain(word, tip) AS (
  SELECT word, word FROM j UNION ALL SELECT chain.word, j.form FROM chain JOIN j ON j.word = chain.tip WHERE j.form IS NOT NULL
)
SELECT j.word, j.form, chain.tip AS root, j.n, j.n_near, j.form_n
FROM j JOIN chain ON chain.word = j.word JOIN j AS last ON last.word = chain.tip AND last.form IS NULL
"""

_FIELD = "coalesce(octet_length(encode({0}::VARCHAR)) || ':' || {0}::VARCHAR, '-')"
_HEAD = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
_RUN = "t.nodes[w.idx // 8 * 8 + 1:w.idx // 8 * 8 + 8]"
_BEFORE = f"array_to_string({_RUN}[1:w.idx % 8], '')"
_AFTER = f"array_to_string({_RUN}[w.idx % 8 + 2:], '')"
_RAISE = "list_transform(range(0, (len(nodes) + 7) // 8), lambda i: sha256(array_to_string(nodes[i * 8 + 1:i * 8 + 8], '')))"

SQL["op13_merkle"] = f"""
WITH RECURSIVE k AS (
  SELECT doc_id, lang, sha256({_HEAD} || {_FIELD.format("text")}) AS leaf,
         CASE WHEN {crc32("doc_id::VARCHAR")} % 3 = 0 THEN sha256({_HEAD} || {_FIELD.format(LOWER.format("text"))}) END AS folded
  FROM documents
), p AS (
  SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM k
), t(lang, level, nodes) AS (
  SELECT lang, 0, list(leaf ORDER BY pos) FROM p GROUP BY lang
  UNION ALL SELECT lang, level + 1, {_RAISE} FROM t WHERE len(nodes) > 1
), s AS (
  SELECT lang, level, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS no FROM t WHERE len(nodes) = 1
), u(level, nodes) AS (
  SELECT 0, list(subroot ORDER BY no) FROM s
  UNION ALL SELECT level + 1, {_RAISE} FROM u WHERE len(nodes) > 1
), w(id, lang, level, idx, proof, node) AS (
  SELECT id, lang, 0, pos, '', coalesce(folded, leaf) FROM p
  UNION ALL SELECT w.id, w.lang, w.level + 1, w.idx // 8, w.proof || {_BEFORE} || {_AFTER}, sha256({_BEFORE} || w.node || {_AFTER})
  FROM w JOIN t ON t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND len(t.nodes) > 1
), y(id, level, idx, proof, node) AS (
  SELECT w.id, 0, s.no, w.proof, w.node FROM w JOIN s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level
  UNION ALL SELECT w.id, w.level + 1, w.idx // 8, w.proof || {_BEFORE} || {_AFTER}, sha256({_BEFORE} || w.node || {_AFTER})
  FROM y AS w JOIN u AS t ON t.level = w.level AND len(t.nodes) > 1
)
SELECT p.doc_id, p.leaf, s.subroot, u.nodes[1] AS root, sha256(y.proof) AS proof_sha256, y.node AS folded_root, y.node = u.nodes[1] AS verified
FROM p JOIN s ON s.lang IS NOT DISTINCT FROM p.lang JOIN u ON len(u.nodes) = 1 JOIN y ON y.id = p.id AND y.level = u.level
"""
