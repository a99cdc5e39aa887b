"""SQL for the queries that SQL can express, over the driver's views of the tables."""

from __future__ import annotations

from wxspark.llm import quality_rules
from wxspark.llm.secret_ledger import RULES


def _spans(kind: str, pattern: str, group: int, least: int) -> str:
    """Spans of one kind: text between matches and the matches themselves give the places."""
    p = pattern.replace("'", "''")
    return f"""
SELECT doc_id, '{kind}' AS kind, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i-1], lambda x: length(x))), 0) AS s,
       length(found[i]) AS n
FROM (SELECT doc_id, string_split_regex(text, '{p}') AS gaps, regexp_extract_all(text, '{p}', 0) AS found, regexp_extract_all(text, '{p}', {group}) AS checked
      FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) WHERE regexp_matches(text, '{p}')) f,
     LATERAL (SELECT unnest(generate_series(1, len(found))) AS i) u
WHERE length(checked[i]) >= {least}"""


def op3_secret_ledger() -> str:
    rank = "CASE kind " + " ".join(f"WHEN '{r.kind}' THEN {i}" for i, r in enumerate(RULES)) + " END"
    spans = " UNION ALL ".join(f"({_spans(r.kind, r.pattern, r.group, r.least)})" for r in RULES)
    text = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT)"
    return f"""
WITH spans AS ({spans}),
said AS (SELECT doc_id, count_if(kind = 'assign') AS n_assign, count_if(kind = 'access') AS n_access, count_if(kind = 'hex') AS n_hex,
                string_agg({text}, ',' ORDER BY s, {rank}) FILTER (WHERE kind IN ('assign', 'access', 'hex')) AS base,
                string_agg({text}, ',' ORDER BY s, {rank}) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN said USING (doc_id)"""


OP6 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

OP12 = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id AS vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.v) = len(c.v) WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""

#: The derived messages of chat.tool_turns: n is the length of a text, ids are c<conv>-<turn>-<number>.
OP2 = r"""
WITH m AS (SELECT conv_id, turn, role, text, length(text) AS n, CASE WHEN conv_id % 3 = 0 THEN turn + 1 ELSE turn - 1 END AS asked FROM conversations),
t AS (SELECT *, role = 'user' AND asked >= 0 AS answers, 'c' || conv_id || '-' || asked || '-0' AS result_for,
             CASE WHEN n % 3 = 0 THEN 'search' WHEN n % 3 = 1 THEN 'lookup' ELSE 'note' END AS tool,
             CASE WHEN n % 3 = 0 THEN '{"limit":' || (n % 60) || ',"query":"' || regexp_extract(text, '^([A-Za-z]*)', 1) || '"}'
                  WHEN n % 3 = 1 THEN '{"fresh":' || CASE WHEN n % 4 = 3 THEN 'true' ELSE 'false' END || ',"id":' || n || '}' ELSE '{"size":' || n || '}' END AS arguments,
             CASE WHEN n % 3 = 1 THEN 1 WHEN n % 3 = 0 AND n % 60 BETWEEN 1 AND 50 AND length(regexp_extract(text, '^([A-Za-z]*)', 1)) BETWEEN 1 AND 12 THEN 1 ELSE 0 END AS good FROM m),
a AS (SELECT t.*, c.conv_id IS NOT NULL AS linked, r.conv_id IS NOT NULL AS answered FROM t
      LEFT JOIN t c ON t.answers AND c.conv_id = t.conv_id AND c.turn = t.asked AND c.role = 'assistant'
      LEFT JOIN t r ON t.role = 'assistant' AND r.conv_id = t.conv_id AND r.answers AND r.asked = t.turn),
p AS (SELECT *, CASE WHEN linked AND asked > turn THEN asked ELSE turn END AS moment, CASE WHEN linked AND asked > turn THEN 1 ELSE 0 END AS depth FROM a)
SELECT conv_id, CAST(turn AS BIGINT) AS turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY moment, depth, turn) - 1 AS BIGINT) AS position,
       CASE WHEN answers THEN 'tool' ELSE role END AS role, CAST(CASE WHEN role <> 'assistant' THEN 0 WHEN n % 2 = 0 THEN 2 ELSE 1 END AS BIGINT) AS n_calls,
       CAST(CASE WHEN role = 'assistant' THEN good ELSE 0 END AS BIGINT) AS n_valid,
       CASE WHEN role = 'assistant' THEN CASE WHEN n % 2 = 0 OR NOT answered THEN 'pending' ELSE 'call' END WHEN NOT answers THEN 'message' WHEN linked THEN 'result' ELSE 'orphan' END AS status,
       '{"content":' || CAST(to_json(text) AS VARCHAR) || ',"role":"' || CASE WHEN answers THEN 'tool' ELSE role END || '"' || CASE WHEN answers THEN ',"tool_call_id":"' || result_for || '"' ELSE '' END
       || CASE WHEN role = 'assistant' THEN ',"tool_calls":[{"arguments":' || arguments || ',"id":"c' || conv_id || '-' || turn || '-0","name":"' || tool || '"}'
          || CASE WHEN n % 2 = 0 THEN ',{"arguments":{"text":{"$ref":"c' || conv_id || '-' || (turn - 2) || '-0"}},"id":"c' || conv_id || '-' || turn || '-1","name":"note"}' ELSE '' END || ']' ELSE '' END || '}' AS json
FROM p"""


def op13_merkle_manifest() -> str:
    def field(c: str) -> str:
        return f"coalesce(octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR), '-')"

    def leaf(n_chars: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n_chars, "text"))) + ")"

    # CRC-32 of the decimal doc_id, bit by bit.
    bits = "list_reduce([xor(c, b)] || [0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))"
    crc = f"xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda y: CAST(ascii(y) AS BIGINT)), lambda c, b: {bits}), 4294967295)"

    def climb(name: str, start: str) -> str:
        return f"""{name}(g, l, pos, n, h) AS (SELECT g, 0, pos, n, h FROM {start} UNION ALL
  SELECT a.g, a.l + 1, a.pos // 2, (a.n + 1) // 2, sha256(a.h || coalesce(b.h, '')) FROM {name} a LEFT JOIN {name} b ON a.g = b.g AND b.pos = a.pos + 1 WHERE a.pos % 2 = 0 AND a.n > 1)"""

    return f"""
WITH RECURSIVE d AS (SELECT *, {leaf("n_chars")} AS h, CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {leaf("n_chars + 1")} END AS changed FROM documents),
x AS (SELECT *, row_number() OVER () AS r, dense_rank() OVER (ORDER BY lang IS NOT NULL, encode(lang)) - 1 AS g,
             row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
{climb("t", "x")},
s AS (SELECT 0 AS g, g AS pos, count(*) OVER () AS n, h FROM t WHERE n = 1),
{climb("u", "s")},
p AS (SELECT x.r, t.l, CASE WHEN b.h IS NULL THEN 'N' WHEN t.pos % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END AS step FROM x
      JOIN t ON t.g = x.g AND t.pos = x.pos >> t.l AND t.n > 1 LEFT JOIN t b ON b.g = t.g AND b.l = t.l AND b.pos = xor(t.pos, 1)
      UNION ALL SELECT x.r, 1000 + u.l, CASE WHEN b.h IS NULL THEN 'N' WHEN u.pos % 2 = 1 THEN 'L' || b.h ELSE 'R' || b.h END FROM x
      JOIN u ON u.pos = x.g >> u.l AND u.n > 1 LEFT JOIN u b ON b.l = u.l AND b.pos = xor(u.pos, 1)),
q AS (SELECT r, list(step ORDER BY l) AS steps, coalesce(string_agg(step[2:], '' ORDER BY l), '') AS sibs FROM p GROUP BY r),
f AS (SELECT x.doc_id, x.h AS leaf, s.h AS subroot, u.h AS root, sha256(coalesce(q.sibs, '')) AS proof_sha256,
             list_reduce([coalesce(x.changed, x.h)] || coalesce(q.steps, []), lambda a, y: sha256(CASE WHEN y[1] = 'L' THEN y[2:] || a WHEN y[1] = 'R' THEN a || y[2:] ELSE a END)) AS folded_root
      FROM x JOIN s ON s.pos = x.g JOIN u ON u.n = 1 LEFT JOIN q ON q.r = x.r)
SELECT *, folded_root = root AS verified FROM f"""


ORACLES = {
    "op2_chat_tool_calls": OP2, "op3_secret_ledger": op3_secret_ledger(), "op6_exact_topk": OP6, "op11_quality_rules": quality_rules.as_sql(),
    "op12_hard_negatives": OP12, "op13_merkle_manifest": op13_merkle_manifest(),
}
