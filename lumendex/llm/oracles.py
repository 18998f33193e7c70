"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"

JACCARD_JOIN = f"""
WITH RECURSIVE w AS (SELECT DISTINCT doc_id, lower(coalesce(text, '')) AS t, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) >= 5 THEN [array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]
    WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')] ELSE ['none ' || t] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
inter AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b, c = p.n AND c = q.n AS same FROM inter JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 9 * c >= 4 * (p.n + q.n)),
pairs AS (SELECT a, b, same FROM links UNION ALL SELECT b, a, same FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a),
class AS (SELECT doc_id, min(r) AS class_id FROM reach GROUP BY doc_id),
own AS (SELECT a, count(*) AS n_links, count(*) FILTER (same) AS copies FROM pairs GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0)::BIGINT AS n_links, (1 + coalesce(copies, 0))::BIGINT AS copies FROM class LEFT JOIN own ON own.a = doc_id"""

EXACT_TOPK = """
WITH v AS (
  SELECT row_number() OVER () AS place, vec_id, [floor(256.0::DOUBLE * x::DOUBLE) FOR x IN embedding] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (
  SELECT q.place, q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON len(q.e) = len(v.e) AND q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 5"""

_LEAST = " ".join(f"WHEN {n} THEN {n - decontaminate.tolerance(n)}" for n in range(decontaminate.LEAST_WORDS, decontaminate.WINDOW + 1))

_SCRIPTS = "".join(rf"\p{{{s}}}" for s in decontaminate.SCRIPTS)
_SPACED = rf"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '([{_SCRIPTS}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT DISTINCT doc_id, {_SPACED} AS w FROM documents WHERE doc_id IS NOT NULL),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
b AS (SELECT item_id, {_SPACED} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (
  SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, least(len(w), {decontaminate.WINDOW}) AS win FROM b WHERE len(w) >= {decontaminate.LEAST_WORDS}),
m AS (SELECT DISTINCT doc_id, item_id, i - j AS diagonal, j, win FROM dw JOIN bw USING (word)),
lines AS (SELECT doc_id, item_id, diagonal FROM m GROUP BY ALL HAVING count(*) >= CASE min(win) {_LEAST} END),
c AS (
  SELECT doc_id, item_id, win, count(*) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j RANGE BETWEEN CURRENT ROW AND win - 1 FOLLOWING) AS c
  FROM m JOIN lines USING (doc_id, item_id, diagonal))
SELECT doc_id, item_id, CAST(max(c) AS INTEGER) AS matched FROM c GROUP BY doc_id, item_id HAVING max(c) >= CASE min(win) {_LEAST} END
UNION ALL SELECT DISTINCT doc_id, item_id, CAST(len(b.w) AS INTEGER) FROM d JOIN b ON d.w = b.w WHERE len(b.w) BETWEEN 1 AND {decontaminate.LEAST_WORDS - 1}"""



def _escaped(column: str) -> str:
    out = f"replace({column}, chr(92), chr(92) || chr(92))"
    for c in chat.CONTROLS:
        out = f"replace({out}, '{c}', '{c[0]}' || chr(92) || '{c[1:]}')"
    return out


_MARKS = len(chat.BEGIN + chat.OPEN + chat.SHUT + chat.END)
_ORDER = "turn NULLS FIRST, role, text"

#: Windows of 512 tokens, of which 128 repeat history.
CHAT = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))),
z AS (
  SELECT *, 3 + len(regexp_extract_all(text, '[\p{{L}}\p{{M}}]+|\p{{N}}+|[^\s\p{{L}}\p{{M}}\p{{N}}]+')) AS size, {_MARKS} + length({_escaped("role")}) + length({_escaped("text")}) AS chars FROM t),
o AS (
  SELECT *, row_number() OVER w AS place, sum(size) OVER w - size AS before,
    first_value(CASE WHEN role = 'system' THEN size END) OVER w AS sys, first_value(CASE WHEN role = 'system' THEN chars END) OVER w AS sys_chars
  FROM z WINDOW w AS (PARTITION BY conv_id ORDER BY {_ORDER} ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, greatest(384 - coalesce(sys, 0), 128) AS room FROM o),
m AS (SELECT *, 2 * (before // room) + ((before + size - 1) // room > before // room)::INT AS win FROM c),
b AS (SELECT *, win IS DISTINCT FROM lag(win) OVER (PARTITION BY conv_id ORDER BY place) AS begins FROM m),
again AS (
  SELECT f.conv_id, sum(j.chars) AS chars FROM b f JOIN b j ON f.conv_id IS NOT DISTINCT FROM j.conv_id AND f.begins
    AND j.before < f.before AND j.before >= f.before - 128 AND (j.place > 1 OR j.sys IS NULL) GROUP BY f.conv_id),
told AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY {_ORDER})) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY {_ORDER}) FILTER (role = 'assistant'), '')) AS loss_sha256,
    sum(chars) + coalesce(sum(sys_chars) FILTER (begins AND place > 1), 0) AS chars
  FROM b GROUP BY conv_id)
SELECT told.conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, CAST(told.chars + coalesce(again.chars, 0) AS BIGINT) AS formatted_chars
FROM told LEFT JOIN again ON told.conv_id IS NOT DISTINCT FROM again.conv_id"""

WARC = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS kept FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept IS DISTINCT FROM page_id AND kept IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN kept IS DISTINCT FROM page_id THEN kept END AS refers_to, url FROM k"""

ORACLES = {
    "op2_jaccard_join": JACCARD_JOIN,
    "op3_exact_topk": EXACT_TOPK,
    "op6_decontamination": DECONTAMINATION,
    "op7_chat_formatting": CHAT,
    "op8_warc": WARC,
}
