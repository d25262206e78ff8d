"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM (SELECT item, w, least(len(w), 13) AS m, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS p FROM b WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM d, sizes WHERE len(w) >= m)
),
hits AS (SELECT r, p, m FROM dw WHERE (win, m) IN (SELECT win, m FROM bw)),
hw AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + m)) AS q FROM hits) GROUP BY r),
found AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT dw.r, bw.item FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hw ON d.r = hw.r LEFT JOIN found ON d.r = found.r
"""

OP9 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(v.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0
),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP2 = r"""
WITH body AS (
  SELECT page_id,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || coalesce(CAST(page_id AS VARCHAR), '')
    || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || CAST(strlen(coalesce(html, '')) AS VARCHAR) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '')
    || chr(13) || chr(10) || chr(13) || chr(10) AS record
  FROM pages
),
single AS (SELECT page_id, sha256(record) AS hash, strlen(record) AS length, count(*) AS copies FROM body GROUP BY ALL),
placed AS (
  SELECT *, CAST(('0x' || substr(hash, 1, 8)) AS BIGINT) % greatest(1, CAST(ceil((SELECT count(*) FROM single) / 1000) AS BIGINT)) AS archive FROM single
),
laid AS (
  SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM placed
)
SELECT CAST(archive AS BIGINT) AS archive, CAST("offset" AS BIGINT) AS "offset", page_id, CAST(copies AS BIGINT) AS copies,
  CASE WHEN page_id % 97 = 5 THEN 'missing' ELSE 'corrupt' END AS status, CAST(length AS BIGINT) AS left_length,
  hash AS left_hash
FROM laid WHERE page_id % 61 = 7 OR page_id % 97 = 5
"""


def _field(value: str) -> str:
    return f"coalesce(CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"


#: CRC-32 of the decimal id, a bit at a time: each byte is added once and followed by seven zeros.
_CRC = """xor(4294967295, list_reduce(
  flatten(list_transform(range(1, length(k) + 1), lambda i: [CAST(ascii(substr(k, i, 1)) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
  lambda c, b: xor(xor(c, b) >> 1, 3988292384 * (xor(c, b) & 1)), CAST(4294967295 AS BIGINT)))"""


def _tree(name: str, depth: int) -> str:
    """Levels 1 to depth over {name}0 (tree, place, digest, n), and the siblings at each; a tree of one node stays as it is."""
    parts = []
    for k in range(depth):
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT tree, place // 8 AS place, CASE WHEN max(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY place)) ELSE max(digest) END AS digest, (max(n) + 7) // 8 AS n
  FROM {name}{k} GROUP BY tree, place // 8
),
{name}s{k} AS MATERIALIZED (
  SELECT a.tree, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS l,
    coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS r
  FROM {name}{k} AS a JOIN {name}{k} AS b ON a.tree = b.tree AND a.place // 8 = b.place // 8 WHERE a.n > 1 GROUP BY a.tree, a.place
)""")
    return ",\n".join(parts)


def _folds(name: str, tree: str, depth: int) -> str:
    return ",\n".join(
        f"""{name}{k + 1} AS MATERIALIZED (
  SELECT id, f.tree, f.place // 8 AS place, CASE WHEN s.l IS NULL THEN node ELSE sha256(s.l || node || s.r) END AS node, proof || coalesce(s.l || s.r, '') AS proof
  FROM {name}{k} AS f LEFT JOIN {tree}s{k} AS s ON f.tree = s.tree AND f.place = s.place
)"""
        for k in range(depth)
    )


_DEPTH, _TOP = 8, 3

OP11 = f"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS id, doc_id, coalesce('=' || lang, '-') AS tree, {_leaf("text")} AS leaf,
    CASE WHEN crc % 3 = 0 THEN {_leaf(_LOWER.format("text").replace("coalesce(text, '')", "text"))} END AS changed
  FROM (SELECT *, {_CRC} AS crc FROM (SELECT *, CAST(doc_id AS VARCHAR) AS k FROM documents))
),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM d
),
a0 AS MATERIALIZED (SELECT tree, place, leaf AS digest, n FROM placed),
{_tree("a", _DEPTH)},
t0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS place, digest, count(*) OVER () AS n, tree AS named FROM a{_DEPTH}),
{_tree("t", _TOP)},
f0 AS MATERIALIZED (SELECT id, tree, place, coalesce(changed, leaf) AS node, '' AS proof FROM placed),
{_folds("f", "a", _DEPTH)},
g0 AS MATERIALIZED (SELECT f.id, '' AS tree, t0.place, f.node, f.proof FROM f{_DEPTH} AS f JOIN t0 ON f.tree = t0.named),
{_folds("g", "t", _TOP)}
SELECT d.doc_id, d.leaf, t0.digest AS subroot, t.digest AS root, sha256(g.proof) AS proof_sha256, g.node AS folded_root, g.node = t.digest AS verified
FROM d JOIN g{_TOP} AS g ON d.id = g.id JOIN t0 ON d.tree = t0.named CROSS JOIN t{_TOP} AS t
"""

OP12 = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS MATERIALIZED (
  SELECT q.vec_id AS anchor_id, v.vec_id, CAST(list_dot_product(q.v, v.v) AS BIGINT) AS score, q.label = v.label AS same
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0
),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same),
n AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same
  WHERE p.r <= 5 AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""

_MARKS = """length({0}) + length({0}) - length(replace({0}, '\\', '')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7
    + (length({0}) - length(replace({0}, ':' || chr(10), ''))) // 2 + coalesce(list_sum(list_transform(regexp_extract_all({0}, '##+'), lambda x: length(x) - 2)), 0)"""

OP13 = f"""
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, k, CASE k WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(2) AS r(k)
),
sized AS (
  SELECT *, length(CASE WHEN role IN ('system', 'user', 'assistant') THEN role ELSE 'role ' || role END) + 6 + 8
    + {_MARKS.format("text")} AS chars FROM m
),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS learnt, sum(chars) AS chars
  FROM sized GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars, sha256(learnt) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM c
"""
