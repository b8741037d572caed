"""SQL twins of those operator queries that SQL can express over whole tables, written apart from the operators."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce({t}, ''), '[^\x20\x09-\x0D]+')"
W = WORDS.format(t="text")

OP1 = f"""
WITH w AS (SELECT doc_id, {W} AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM w),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, CAST(len(w) AS BIGINT) - 18))) AS i FROM w)),
dup AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM dup),
m AS (SELECT p.doc_id, p.pos, word, gone.pos IS NOT NULL AS g FROM p LEFT JOIN gone ON p.doc_id = gone.doc_id AND p.pos = gone.pos),
a AS (SELECT doc_id, count_if(g) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT g) AS kept FROM m GROUP BY 1)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN a ON w.doc_id = a.doc_id"""

OP2 = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {W} AS w, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, source, text, unnest(ls) AS raw FROM d),
n AS (SELECT doc_id, source, text, raw, regexp_replace(raw, '[\x20\x09-\x0D]', '', 'g') AS solid, lower(regexp_replace(raw, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')) AS norm FROM l),
u AS (SELECT doc_id, count(*) - count(DISTINCT raw) AS n_dup_lines FROM n WHERE solid <> '' GROUP BY 1),
h AS (SELECT source, count(DISTINCT text) AS texts FROM d GROUP BY 1),
c AS (SELECT n.source, norm FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE solid <> '' GROUP BY n.source, norm, texts HAVING count(DISTINCT text) > 20 AND count(DISTINCT text) > 0.1 * texts),
g AS (SELECT doc_id, sum(length(solid)) AS n_removed_chars FROM n JOIN c ON n.source IS NOT DISTINCT FROM c.source AND n.norm = c.norm WHERE solid <> '' GROUP BY 1),
t AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, CAST(len(w) AS BIGINT) - 1))) AS i FROM d)),
r AS (SELECT doc_id, i FROM t QUALIFY count(*) OVER (PARTITION BY doc_id, s) >= 2),
k AS (SELECT doc_id, count(DISTINCT pos) AS n_repeat_words FROM (SELECT doc_id, unnest(range(i, i + 3)) AS pos FROM r) GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
      coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, CAST(coalesce(n_removed_chars, 0) AS BIGINT) AS n_removed_chars
      FROM d LEFT JOIN u ON d.doc_id = u.doc_id LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN g ON d.doc_id = g.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_removed_chars <= 50 * word_chars AS kept FROM b"""

ESC = r"replace(replace(replace({x}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
OP3 = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
a AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS told, coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '') AS loss,
  sum(15 + length({ESC.format(x="role")}) + length({ESC.format(x="text")})) AS f FROM c GROUP BY 1)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(f AS BIGINT) AS formatted_chars FROM a"""

OP10 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, CAST(len(w) AS BIGINT) - 1))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * k >= 90 * (x.n + y.n - k)),
l AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node, b AS other FROM l UNION SELECT r.node, l.b FROM r JOIN l ON r.other = l.a),
m AS (SELECT node, min(other) AS low FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, least(w.doc_id, coalesce(low, w.doc_id)) AS component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id LEFT JOIN m ON w.doc_id = m.node"""

FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
ROUND = """
a{n} AS MATERIALIZED (SELECT p.vec_id, p.pos, p.x, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM p JOIN c{n} c ON p.pos = c.pos GROUP BY 1, 2, 3),
s{n} AS (SELECT pos, e, list(CAST(floor(s / n) AS DOUBLE) ORDER BY i) AS c FROM (SELECT pos, m % 256 AS e, i, sum(x[i]) AS s, count(*) AS n FROM (SELECT pos, m, x, unnest(generate_series(1, len(x))) AS i FROM a{n}) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{next} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(s.c, c.c) AS c FROM c{n} c LEFT JOIN s{n} s ON c.pos = s.pos AND c.e = s.e),"""
OP12 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {FINITE}),
p AS MATERIALIZED (SELECT vec_id, pos, v[pos * (len(v) // 4) + 1:(pos + 1) * (len(v) // 4)] AS x FROM (SELECT vec_id, v, unnest(range(4)) AS pos FROM k)),
c0 AS MATERIALIZED (SELECT pos, row_number() OVER (PARTITION BY pos ORDER BY vec_id) - 1 AS e, x AS c FROM p QUALIFY e < 256),{"".join(ROUND.format(n=n, next=n + 1) for n in range(4))}
f AS MATERIALIZED (SELECT p.vec_id, p.pos, min(CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) * 256 + e) AS m FROM p JOIN c4 c ON p.pos = c.pos GROUP BY 1, 2),
g AS (SELECT vec_id, string_agg(printf('%02x', m % 256), '' ORDER BY pos) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM f GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY pos, e)) AS codebooks_sha256 FROM c4)
SELECT g.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM g JOIN k ON g.vec_id = k.vec_id CROSS JOIN h"""

OP13 = f"""
WITH k AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM k a JOIN k b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score)
SELECT * FROM n WHERE rank <= 10"""

ORACLES = {"op1_substring_dedup": OP1, "op2_quality_rules": OP2, "op3_chat": OP3, "op10_ngram_join": OP10, "op12_vector_codes": OP12, "op13_hard_negatives": OP13}
