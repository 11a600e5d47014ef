"""The queries of :mod:`shopflow.llm.queries` that SQL can express, as DuckDB runs them."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

PHRASES = rf"""
WITH docs AS (
  SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (
  SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w
  FROM (SELECT lang, UNNEST(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
runs AS (
  SELECT lang, w, UNNEST(range(1, len(w) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, ws, m, COUNT(*) AS f
  FROM (SELECT lang, m, list_slice(w, i, i + m - 1) AS ws FROM runs, range(1, 6) r(m) WHERE i + m - 1 <= len(w))
  GROUP BY lang, ws, m),
totals AS (SELECT lang, SUM(f) AS n FROM counts WHERE m = 1 GROUP BY lang),
frequent AS (SELECT * FROM counts WHERE f >= 100),
inside AS (
  SELECT DISTINCT p.lang, p.ws FROM frequent p JOIN frequent q ON p.lang = q.lang AND q.m > p.m AND q.f >= p.f,
    range(1, 5) s(j) WHERE p.m > 1 AND j + p.m - 1 <= q.m AND list_slice(q.ws, j, j + p.m - 1) = p.ws),
kept AS (SELECT f.* FROM frequent f ANTI JOIN inside i ON f.lang = i.lang AND f.ws = i.ws WHERE f.m > 1),
cuts AS (
  SELECT c.lang, c.ws, c.f AS a, k, x.f AS l, y.f AS r, t.n,
    (1000 * c.f::HUGEINT * t.n::HUGEINT) // (x.f::HUGEINT * y.f::HUGEINT) AS score
  FROM (SELECT *, UNNEST(range(1, m)) AS k FROM kept) c
  JOIN totals t ON t.lang = c.lang
  JOIN frequent x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, c.k)
  JOIN frequent y ON y.lang = c.lang AND y.ws = list_slice(c.ws, c.k + 1, c.m)),
lowest AS (
  SELECT *, array_to_string(ws, ' ') AS phrase FROM cuts
  QUALIFY ROW_NUMBER() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1)
SELECT lang, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
  a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM lowest
QUALIFY ROW_NUMBER() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

_VECTORS = """
v AS (
  SELECT ROW_NUMBER() OVER () AS rn, vec_id AS id, [FLOOR({factor} * x::DOUBLE) FOR x IN embedding] AS e{more}
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x::DOUBLE)]) = len(embedding))"""

PRODUCTS = f"""
WITH {_VECTORS.format(factor=1024, more="")},
scores AS (
  SELECT q.rn, q.id AS query_id, v.id AS vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.rn <> v.rn AND len(q.e) = len(v.e) WHERE q.id % 100 = 0)
SELECT query_id, CAST(ROW_NUMBER() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scores QUALIFY ROW_NUMBER() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) <= 10
"""

HARD_NEGATIVES = f"""
WITH {_VECTORS.format(factor=256, more=", CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label")},
scores AS (
  SELECT a.rn AS an, a.id AS anchor_id, v.rn, v.id, a.label = v.label AS same, CAST(list_dot_product(a.e, v.e) AS BIGINT) AS score
  FROM v a JOIN v ON a.rn <> v.rn AND len(a.e) = len(v.e)
  WHERE a.id % 50 = 0 AND a.label IS NOT NULL AND v.label IS NOT NULL),
positives AS (
  SELECT * FROM scores WHERE same QUALIFY ROW_NUMBER() OVER (PARTITION BY an ORDER BY score DESC, id, rn) <= 5),
found AS (
  SELECT p.anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(ROW_NUMBER() OVER (PARTITION BY p.an, p.rn ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scores n ON p.an = n.an AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM found WHERE rank <= 3
"""
