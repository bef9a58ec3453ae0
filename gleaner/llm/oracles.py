"""Equivalent SQL of the training-data queries that SQL can decide, for DuckDB."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

_EXACT_DEDUP = f"""
WITH texts AS (SELECT doc_id, {_LOWER} AS t FROM documents),
groups AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM texts JOIN groups USING (t)
"""

# Shingles are pairs of words; a one-word text is one shingle. Links compare full sets; only
# pairs whose sizes allow the similarity are counted.
_NEAR_DUP = f"""
WITH RECURSIVE texts AS (
  SELECT doc_id, {_WORDS.format(_LOWER)} AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) = 1 THEN [w[1]]
    ELSE [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] END) AS s
  FROM texts),
sizes AS MATERIALIZED (SELECT doc_id, len(s) AS n FROM sets),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
    FROM items x JOIN items y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY 1, 2)
  JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach(doc_id, node) AS (
  SELECT doc_id, doc_id FROM sizes
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT doc_id, min(node) AS component_id FROM reach GROUP BY doc_id) USING (doc_id)
"""

_SUBSTRING_DEDUP = f"""
WITH texts AS MATERIALIZED (
  SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM texts WHERE len(w) >= 35)),
repeated AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p
  FROM windows JOIN repeated USING (h)),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM covered GROUP BY doc_id),
left_over AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed,
    CASE WHEN n IS NULL THEN w
      ELSE list_select(w, list_sort(list_filter(range(1, len(w) + 1), lambda x: NOT list_contains(ps, x)))) END AS k
  FROM texts LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256
FROM left_over
"""

_TOP_K = """
WITH v AS MATERIALIZED (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS p
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_inner_product(CAST(q.p AS DOUBLE[]), CAST(d.p AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
  FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

# Marks of a document's parts: two cuts and two draws, from the digest of its id.
_FILL_IN_MIDDLE = """
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
draws AS (
  SELECT doc_id, t, length(t) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM texts),
cuts AS (
  SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
      WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM draws),
pieces AS (
  SELECT *, substr(t, 1, a) AS prefix, substr(t, a + 1, b - a) AS middle, substr(t, b + 1) AS suffix FROM cuts)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN a END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM pieces
"""


def _ball_kmeans(scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Plain k-means of vector parts in SQL, a pair of tables for each round."""
    square = "list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i])))"

    def nearest(number: int) -> str:
        return f"""
codes_{number} AS MATERIALIZED (
  SELECT row, part, arg_min(entry, d * {entries} + entry) AS entry, min(d) AS d FROM (
    SELECT p.row, p.part, c.entry, CAST({square} AS BIGINT) AS d
    FROM pieces p JOIN book_{number} c USING (part))
  GROUP BY row, part)"""

    def moved(number: int) -> str:
        # Division of whole numbers that goes down, also below zero.
        mean = "(s - (((s % n) + n) % n)) // n"
        return f"""
book_{number + 1} AS MATERIALIZED (
  SELECT b.part, b.entry, coalesce(m.v, b.v) AS v
  FROM book_{number} b LEFT JOIN (
    SELECT part, entry, list({mean} ORDER BY i) AS v FROM (
      SELECT part, entry, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
        SELECT p.part, k.entry, unnest(p.v) AS x, unnest(range(1, len(p.v) + 1)) AS i
        FROM pieces p JOIN codes_{number} k USING (row, part))
      GROUP BY part, entry, i)
    GROUP BY part, entry) m USING (part, entry))"""

    steps = ",".join(nearest(r) + "," + moved(r) for r in range(rounds)) + "," + nearest(rounds)
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS row, vec_id, label, w FROM (
    SELECT vec_id, label, [CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
pieces AS MATERIALIZED (
  SELECT row, part, w[part * size + 1:(part + 1) * size] AS v FROM (
    SELECT row, w, len(w) // {parts} AS size, unnest(range(0, {parts})) AS part FROM kept)),
book_0 AS MATERIALIZED (SELECT part, row - 1 AS entry, v FROM pieces WHERE row <= {entries}),
{steps.lstrip()},
coded AS (
  SELECT row, string_agg(lower(printf('%02x', entry)), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM codes_{rounds} GROUP BY row),
digest AS (
  SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256
  FROM book_{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (row), digest
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": _EXACT_DEDUP,
        "op8_substring_dedup": _SUBSTRING_DEDUP,
        "op9_cover_tree_search": _TOP_K,
        "op7_minhash_near_dup": _NEAR_DUP,
        "op11_ball_kmeans_codes": _ball_kmeans(),
        "op12_fill_in_middle": _FILL_IN_MIDDLE,
    }
