"""Equivalent SQL of the registered queries, for a second engine on the same tables."""

from __future__ import annotations

from gleaner.functions.text import LETTERS

_LETTER_COUNTS = ", ".join(
    f"length(text) - length(replace(replace(text, '{c}', ''), '{c.upper()}', ''))"
    if c != " "
    else "length(text) - length(replace(text, ' ', ''))"
    for c in LETTERS
)

# letters(sample_id, n_chars, lang, vec): unit letter-count vectors, null for zero vectors.
LETTER_CTE = f"""
counts AS (
  SELECT doc_id AS sample_id, n_chars, lang, [{_LETTER_COUNTS}]::DOUBLE[] AS v FROM documents
),
letters AS (
  SELECT sample_id, n_chars, lang,
    CASE WHEN list_dot_product(v, v) > 0
      THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) END AS vec
  FROM counts
)"""


def _share(pattern: str) -> str:
    return f"length(regexp_replace(text, '[^{pattern}]+', '', 'g'))::DOUBLE / len"


# shapes(sample_id, vec): the eight shape statistics.
SHAPE_CTE = f"""
words AS (
  SELECT doc_id AS sample_id, text, greatest(n_chars::DOUBLE, 1.0::DOUBLE) AS len,
    list_filter(regexp_split_to_array(text, '[ \\n\\t\\r]+'), lambda w: w <> '') AS w
  FROM documents
),
shapes AS (
  SELECT sample_id, [
    {_share("0-9")}, {_share("A-Z")}, {_share("!-/:-@" + chr(92) + "[-`{-~")},
    {_share(chr(92) + "n")}, {_share(" ")}, ln(len),
    len(list_distinct(w))::DOUBLE / greatest(len(w), 1)::DOUBLE,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::DOUBLE
      / greatest(len(w), 1)::DOUBLE / 10.0::DOUBLE
  ] AS vec FROM words
)"""

# toy(sample_id, p_knn, p_lr, p_gbt, p)
TOY_CTE = f"""{SHAPE_CTE},
members AS (
  SELECT sample_id,
    round(greatest(0::DOUBLE, least(1::DOUBLE, vec[7])), 6) AS p_knn,
    round(greatest(0::DOUBLE, least(1::DOUBLE, 1::DOUBLE - 5::DOUBLE * vec[3])), 6) AS p_lr,
    round(greatest(0::DOUBLE, least(1::DOUBLE, 2::DOUBLE - 2.4::DOUBLE * vec[8])), 6) AS p_gbt
  FROM shapes
),
toy AS (
  SELECT *, 0.3::DOUBLE * p_knn + 0.4::DOUBLE * p_lr + 0.3::DOUBLE * p_gbt AS p FROM members
)"""

LABELS_CTE = "known AS (SELECT doc_id AS sample_id, quality::DOUBLE AS label FROM labels)"
JUDGED_CTE = f"{TOY_CTE}, {LABELS_CTE}, judged AS (SELECT * FROM toy JOIN known USING (sample_id))"


def _curves(scores: str, by: str) -> str:
    """CTEs sweep and curves over ``scores(by, p, label)``."""
    return f"""
grid AS (
  SELECT k::INT AS k, CASE WHEN k = 100 THEN 1::DOUBLE ELSE k::DOUBLE * 0.01::DOUBLE END AS t
  FROM range(101) r(k)
),
cells AS (
  SELECT {by}, k, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
  FROM (SELECT {by}, label, (SELECT min(k) FROM grid WHERE p <= t) AS k FROM {scores})
  GROUP BY ALL
),
totals AS (SELECT {by}, sum(pos) AS all_pos, sum(neg) AS all_neg FROM cells GROUP BY ALL),
low AS (
  SELECT {by}, g.k, g.t, all_pos, all_neg,
    sum(coalesce(pos, 0)) OVER w AS low_pos, sum(coalesce(neg, 0)) OVER w AS low_neg
  FROM (SELECT * FROM totals, grid) g LEFT JOIN cells USING ({by}, k)
  WINDOW w AS (PARTITION BY {by} ORDER BY k)
),
sweep AS (
  SELECT {by}, k, t, (all_pos - low_pos)::DOUBLE / all_pos AS tp,
    (all_neg - low_neg)::DOUBLE / all_neg AS fp,
    low_pos::DOUBLE / all_pos AS fn, low_neg::DOUBLE / all_neg AS tn
  FROM low
),
curves AS (
  SELECT *, tp / (fp + 0.001::DOUBLE) AS positives_ratio, tn / (fn + 0.001::DOUBLE) AS negatives_ratio
  FROM sweep
)"""


def _peaks(by: str) -> str:
    """CTEs ending in margins(by, positive_threshold, ..., negative_margin)."""
    return f"""
heights AS (
  SELECT {by}, k, 'pos' AS curve, -abs(positives_ratio - 30) AS h FROM curves
  UNION ALL SELECT {by}, k, 'neg', -abs(negatives_ratio - 30) FROM curves
),
marked AS (
  SELECT *, CASE WHEN lag(h) OVER (PARTITION BY {by}, curve ORDER BY k) = h THEN 0 ELSE 1 END AS s
  FROM heights
),
numbered AS (SELECT *, sum(s) OVER (PARTITION BY {by}, curve ORDER BY k) AS run FROM marked),
runs AS (
  SELECT {by}, curve, run, min(k) AS a, max(k) AS b, min(h) AS h FROM numbered GROUP BY ALL
),
tops AS (
  SELECT *, lag(h) OVER w AS l, lead(h) OVER w AS r FROM runs
  WINDOW w AS (PARTITION BY {by}, curve ORDER BY run)
),
chosen AS (
  SELECT {by}, min((a + b) // 2) FILTER (curve = 'pos') AS kp, max((a + b) // 2) FILTER (curve = 'neg') AS kn
  FROM tops WHERE l < h AND r < h GROUP BY ALL
),
margins AS (
  SELECT {by}, gp.t AS positive_threshold, gn.t AS negative_threshold,
    greatest(0.65::DOUBLE, gp.t) AS positive_margin, least(0.35::DOUBLE, gn.t) AS negative_margin
  FROM totals LEFT JOIN chosen USING ({by})
    LEFT JOIN grid gp ON gp.k = kp LEFT JOIN grid gn ON gn.k = kn
)"""


def _area(scores: str, by: str) -> str:
    """Query of the exact area per ``by``: mid-ranks of the positives."""
    return f"""
SELECT {by}, CASE WHEN sum(pos) > 0 AND sum(neg) > 0
    THEN sum(pos * (below + neg / 2.0::DOUBLE)) / (sum(pos)::DOUBLE * sum(neg)::DOUBLE) END AS auc
FROM (
  SELECT *, sum(neg) OVER (PARTITION BY {by} ORDER BY p) - neg AS below FROM (
    SELECT {by}, p, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg
    FROM {scores} GROUP BY ALL))
GROUP BY ALL"""


_ALL = f"{JUDGED_CTE}, scored AS (SELECT 0 AS g, p, label FROM judged), {_curves('scored', 'g')}"
_HIT = "avg(CASE WHEN (p > 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END)"


def _bin(p: str, edges: int) -> str:
    """Number of the bin that holds p, by comparing with every edge."""
    bins = edges - 1
    return (
        f"least({bins - 1}, list_sum(list_transform(range(1, {edges}), lambda i: CASE WHEN "
        f"{p} >= CASE WHEN i = {bins} THEN 1::DOUBLE ELSE i::DOUBLE * (1::DOUBLE / {bins}) END "
        f"THEN 1 ELSE 0 END)))::INT"
    )


def _adaptive(kind: str, source: str, label: str, choices: list[tuple[str, int]]) -> str:
    """Histogram with the bins of the first choice whose size condition holds."""
    parts = []
    for condition, edges in choices:
        parts.append(
            f"SELECT '{kind}' AS kind, label, bin, coalesce(n, 0) AS n FROM "
            f"(SELECT DISTINCT {label} AS label, b::INT AS bin FROM {source}, range({edges - 1}) r(b)) "
            f"LEFT JOIN (SELECT {label} AS label, {_bin('p', edges)} AS bin, count(*) AS n "
            f"FROM {source} GROUP BY ALL) USING (label, bin) WHERE {condition}"
        )
    return " UNION ALL ".join(parts)


def _sized(count: str, steps: list[tuple[int | None, int]]) -> list[tuple[str, int]]:
    low, out = 0, []
    for below, edges in steps:
        upper = f" AND {count} < {below}" if below else ""
        out.append((f"{count} >= {low}{upper}", edges))
        low = below
    return out


_N_JUDGED = "(SELECT count(*) FROM judged)"
_N_POOL = "(SELECT count(*) FROM toy)"

_FOLDS = """
SELECT k.sample_id, k.label, r.repeat::INT AS repeat,
  ((row_number() OVER (PARTITION BY r.repeat, k.label
     ORDER BY md5('123:' || r.repeat || ':' || k.sample_id), k.sample_id) - 1) % 5)::INT AS fold
FROM known k, range({repeats}) r(repeat)"""

_DROPPED = """
SELECT a.sample_id FROM letters a
WHERE EXISTS (SELECT 1 FROM letters b WHERE {later} {group}
  AND list_dot_product(a.vec, b.vec)::FLOAT > {threshold}::FLOAT)"""
_BY_ID = "b.sample_id > a.sample_id"
_BY_SIZE = "(b.n_chars, b.sample_id) > (a.n_chars, a.sample_id)"
_TEXT = "0.9999"

_HALVES_CTE = """
halves AS (
  SELECT vec_id AS sample_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b
  FROM embeddings
),
both_halves AS (
  SELECT sample_id, list_concat(
    list_transform(a, lambda x: x / sqrt(list_dot_product(a, a))),
    list_transform(b, lambda x: x / sqrt(list_dot_product(b, b)))) AS vec
  FROM halves
)"""

_SEARCH = """
mixed AS (
  SELECT weight_id, label, w_knn * p_knn + w_lr * p_lr + w_gbt * p_gbt AS p FROM judged, weights
)"""


def _searched(weights: str, tail: str) -> str:
    return f"""
WITH {JUDGED_CTE}, {weights}, {_SEARCH}, {_curves('mixed', 'weight_id')}, {_peaks('weight_id')},
areas AS ({_area('mixed', 'weight_id')}),
hits AS (SELECT weight_id, {_HIT} AS accuracy FROM mixed GROUP BY ALL),
scores AS (
  SELECT *, auc + 0.5::DOUBLE * accuracy + 2::DOUBLE * negative_margin
    + 2::DOUBLE * (1::DOUBLE - positive_margin) AS score
  FROM weights JOIN areas USING (weight_id) JOIN hits USING (weight_id) JOIN margins USING (weight_id)
)
SELECT weight_id, round(w_knn, 6) AS w_knn, round(w_lr, 6) AS w_lr, round(w_gbt, 6) AS w_gbt,
  round(auc, 6) AS auc, round(accuracy, 6) AS accuracy,
  round(positive_margin, 6) AS positive_margin, round(negative_margin, 6) AS negative_margin,
  round(score, 6) AS score
FROM scores {tail}"""


def _uniform(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)"


_GRID_WEIGHTS = """
weights AS (
  SELECT (row_number() OVER (ORDER BY i, j) - 1)::BIGINT AS weight_id,
    i::DOUBLE / 10 AS w_knn, j::DOUBLE / 10 AS w_lr, (10 - i - j)::DOUBLE / 10 AS w_gbt
  FROM range(1, 10) a(i), range(1, 10) b(j) WHERE i + j < 10
)"""


def _triple(name: str) -> str:
    return f"0.03::DOUBLE + 0.97::DOUBLE * {_uniform(f"'0:{name}:' || id")}"


_RANDOM_WEIGHTS = f"""
raw AS (
  SELECT id AS weight_id, {_triple('w_knn')} AS a, {_triple('w_lr')} AS b, {_triple('w_gbt')} AS c
  FROM range(10000) r(id)
),
weights AS (
  SELECT weight_id, a / (a + b + c) AS w_knn, b / (a + b + c) AS w_lr, c / (a + b + c) AS w_gbt
  FROM raw
)"""

_ROUTED = """
SELECT sample_id, p, 'negative' AS route FROM toy WHERE p <= {negative}::DOUBLE
UNION ALL SELECT sample_id, p, 'positive' FROM toy WHERE p >= {positive}::DOUBLE"""

_SUFFIX = "lpad((('0x' || substr(md5('0:' || {id}), 1, 8))::BIGINT % 99999)::VARCHAR, 5, '0')"

_EVENTS_CTE = """
given AS (
  SELECT event_id % (SELECT count(*) FROM documents) AS sample_id,
    arg_min(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END, (ts, event_id)) AS label
  FROM events WHERE event_type IN ('click', 'error') GROUP BY ALL
)"""

_PROGRESS = f"""
WITH {_EVENTS_CTE}
SELECT count(*) FILTER (label IS NULL) AS unlabeled, count(label) AS labeled,
  count(*) FILTER (label = 1) AS positive, count(*) FILTER (label = 0) AS negative
FROM documents LEFT JOIN given ON doc_id = sample_id"""

_TEMPLATES_CTE = """
vecs AS (
  SELECT vec_id AS sample_id, label, embedding::DOUBLE[] AS vec,
    list_transform(range(10), lambda i: CASE WHEN i = label THEN 1 ELSE 0 END)::DOUBLE[] AS y
  FROM embeddings
),
elements AS (
  SELECT label, unnest(range(1, 65)) AS position, unnest(vec) AS x FROM vecs
),
templates AS (
  SELECT label AS template_id, list(x ORDER BY position) AS vec
  FROM (SELECT label, position, avg(x) AS x FROM elements GROUP BY ALL) GROUP BY ALL
),
near AS (
  SELECT v.sample_id, t.template_id, row_number() OVER (PARTITION BY v.sample_id
    ORDER BY list_distance(v.vec, t.vec), t.template_id) AS place
  FROM vecs v, templates t
)"""

_STREAM_P = "round(greatest(0::DOUBLE, least(1::DOUBLE, vec[7])), 6)"


# Two columns of the labeled documents, and the discriminant and first component of them.
_PAIR_CTE = f"""{SHAPE_CTE}, pair AS (
  SELECT s.sample_id, l.quality::DOUBLE AS y, vec[6] AS a, vec[7] AS b
  FROM shapes s JOIN labels l ON l.doc_id = s.sample_id)"""
_LDA = f"""
WITH {_PAIR_CTE},
by_class AS (
  SELECT y, count(*) AS n, avg(a) AS ma, avg(b) AS mb, var_pop(a) * count(*) AS aa,
    var_pop(b) * count(*) AS bb, covar_pop(a, b) * count(*) AS ab
  FROM pair GROUP BY y),
fit AS (
  SELECT sum(aa) / (sum(n) - 2) AS aa, sum(bb) / (sum(n) - 2) AS bb, sum(ab) / (sum(n) - 2) AS ab,
    max(ma) FILTER (y = 1) AS ma1, max(ma) FILTER (y = 0) AS ma0,
    max(mb) FILTER (y = 1) AS mb1, max(mb) FILTER (y = 0) AS mb0
  FROM by_class),
line AS (
  SELECT *, (bb * (ma1 - ma0) - ab * (mb1 - mb0)) / (aa * bb - ab * ab) AS ca,
    (aa * (mb1 - mb0) - ab * (ma1 - ma0)) / (aa * bb - ab * ab) AS cb FROM fit)
SELECT sample_id, round(1 / (1 + exp(-(ca * (a - (ma0 + ma1) / 2) + cb * (b - (mb0 + mb1) / 2)))), 6) AS p_lda
FROM pair, line"""
_PCA = f"""
WITH {_PAIR_CTE},
moments AS (SELECT var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab FROM pair)
SELECT 1 AS component, round(share, 6) AS ratio, round(share, 6) AS cumulative
FROM (SELECT (aa + bb + sqrt((aa - bb) ** 2 + 4 * ab * ab)) / (2 * (aa + bb)) AS share FROM moments)"""
# Newton steps for two weights (penalised) and an intercept; three unknowns by Cramer's rule.
_LR = f"""
WITH RECURSIVE {_PAIR_CTE},
steps AS (
  SELECT 0 AS k, 0::DOUBLE AS u, 0::DOUBLE AS v, 0::DOUBLE AS w
  UNION ALL
  SELECT k + 1, u - d1 / d, v - d2 / d, w - d3 / d FROM (
    SELECT *, g1 * (h22 * h33 - h23 * h23) - h12 * (g2 * h33 - h23 * g3) + h13 * (g2 * h23 - h22 * g3) AS d1,
      h11 * (g2 * h33 - h23 * g3) - g1 * (h12 * h33 - h23 * h13) + h13 * (h12 * g3 - g2 * h13) AS d2,
      h11 * (h22 * g3 - g2 * h23) - h12 * (h12 * g3 - g2 * h13) + g1 * (h12 * h23 - h22 * h13) AS d3,
      h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13) AS d
    FROM (
      SELECT k, u, v, w, u + sum(c * (p - y) * a) AS g1, v + sum(c * (p - y) * b) AS g2, sum(c * (p - y)) AS g3,
        1 + sum(c * p * (1 - p) * a * a) AS h11, 1 + sum(c * p * (1 - p) * b * b) AS h22,
        sum(c * p * (1 - p)) AS h33, sum(c * p * (1 - p) * a * b) AS h12,
        sum(c * p * (1 - p) * a) AS h13, sum(c * p * (1 - p) * b) AS h23
      FROM (
        SELECT s.*, a, b, y, 0.5::DOUBLE AS c, 1 / (1 + exp(-(u * a + v * b + w))) AS p
        FROM steps s, pair WHERE k < 30)
      GROUP BY k, u, v, w)))
SELECT sample_id, round(1 / (1 + exp(-(u * a + v * b + w))), 3) AS p_lr
FROM pair, steps WHERE k = 30"""


def _stumps(steps: int, rate: float, least: int) -> str:
    """Boosting by stumps: of all edges between values of a column the one with most gain."""
    edges = """
edges_{k} AS (
  SELECT c, v, (v + lead(v) OVER w) / 2 AS edge, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(n) OVER w AS nl,
    sum(g) OVER (PARTITION BY c) AS gt, sum(h) OVER (PARTITION BY c) AS ht, sum(n) OVER (PARTITION BY c) AS nt
  FROM (
    SELECT c, v, sum(p - y) AS g, sum(p * (1 - p)) AS h, count(*) AS n FROM (
      SELECT y, 1 / (1 + exp(-score)) AS p, unnest([0, 1]) AS c, unnest([a, b]) AS v FROM scored_{k})
    GROUP BY c, v)
  WINDOW w AS (PARTITION BY c ORDER BY v)),
best_{k} AS (
  SELECT *, -{rate} * gl / hl AS below, -{rate} * (gt - gl) / (ht - hl) AS above FROM edges_{k}
  WHERE edge IS NOT NULL AND nl >= {least} AND nt - nl >= {least}
  ORDER BY gl * gl / hl + (gt - gl) ** 2 / (ht - hl) - gt * gt / ht DESC, c, edge LIMIT 1),
scored_{j} AS (
  SELECT sample_id, a, b, y, score + CASE WHEN (CASE WHEN c = 0 THEN a ELSE b END) <= edge THEN below ELSE above END AS score
  FROM scored_{k}, best_{k})"""
    grown = ",".join(edges.format(k=k, j=k + 1, rate=rate, least=least) for k in range(steps))
    return f"""
WITH {_PAIR_CTE},
scored_0 AS (
  SELECT sample_id, round(a, 1) AS a, round(b, 2) AS b, y, ln(avg(y) OVER () / (1 - avg(y) OVER ())) AS score FROM pair),
{grown.lstrip()}
SELECT sample_id, round(1 / (1 + exp(-score)), 6) AS p_gbt FROM scored_{steps}"""


def oracle_sql() -> dict[str, str]:
    """SQL per query key; keys without an entry have no equivalent SQL."""
    known = {
        "doc_letter_features": f"""
WITH {LETTER_CTE}
SELECT sample_id, unnest(range(27))::INT AS position, round(unnest(vec), 6) AS value FROM letters""",
        "doc_shape_features": f"""
WITH {SHAPE_CTE}
SELECT sample_id, unnest(range(8))::INT AS position, round(unnest(vec), 6) AS value FROM shapes""",
        "sample_ids": f"""
WITH ids AS (
  SELECT page_id, split_part(regexp_extract(url, '([^/]+)$', 1), '.', 1) AS sample_id,
    string_split(url, '.')[-1] AS extension FROM pages
)
SELECT *, sample_id || '_' || {_SUFFIX.format(id='sample_id')} AS dest_id FROM ids""",
        "id_collisions": """
SELECT split_part(regexp_extract(url, '([^/]+)$', 1), '.', 1) AS sample_id, count(*) AS n_items
FROM pages GROUP BY ALL HAVING count(*) > 1""",
        "feature_store_pending": """
SELECT doc_id AS sample_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "feature_store_collect": f"""
WITH {SHAPE_CTE}
SELECT sample_id, unnest(range(8))::INT AS position,
  round(unnest(list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec)))), 6) AS value
FROM shapes""",
        "concat_two_models": f"""
WITH {_HALVES_CTE}
SELECT sample_id, unnest(range(64))::INT AS position, round(unnest(vec), 6) AS value FROM both_halves""",
        "alignment_check": """
SELECT doc_id AS sample_id, 1::BIGINT AS n_models FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
        "width_check": """
SELECT min(len(embedding))::INT AS min_width, max(len(embedding))::INT AS max_width,
  count(*) AS n_items, count(*) FILTER (embedding IS NULL) AS n_null FROM embeddings""",
        "near_dup_drop": f"WITH {LETTER_CTE}"
        + _DROPPED.format(later=_BY_ID, group="", threshold=_TEXT),
        "near_dup_keep_best": f"""WITH {LETTER_CTE}, dropped AS (
{_DROPPED.format(later=_BY_SIZE, group="", threshold=_TEXT)})
SELECT sample_id, n_chars FROM letters WHERE sample_id NOT IN (SELECT sample_id FROM dropped)""",
        "near_dup_report": f"""WITH {LETTER_CTE}, dropped AS (
{_DROPPED.format(later=_BY_SIZE, group="", threshold=_TEXT)})
SELECT total, removed, round(100.0::DOUBLE * removed / total, 1) AS removed_percent
FROM (SELECT (SELECT count(*) FROM letters) AS total, (SELECT count(*) FROM dropped) AS removed)""",
        "near_dup_by_group": f"WITH {LETTER_CTE}, dropped AS ("
        + _DROPPED.format(later=_BY_SIZE, group="AND a.lang = b.lang", threshold="0.999")
        + ") SELECT lang, sample_id FROM letters JOIN dropped USING (sample_id)",
        "near_dup_embeddings": """
WITH raw AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS v FROM embeddings),
letters AS (
  SELECT sample_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS vec FROM raw
)"""
        + _DROPPED.format(later=_BY_ID, group="", threshold="0.4"),
        "near_dup_two_models": f"WITH {_HALVES_CTE}, letters AS (SELECT * FROM both_halves)"
        + _DROPPED.format(later=_BY_ID, group="", threshold="0.8"),
        "near_dup_routed": f"""
WITH {TOY_CTE}, {LETTER_CTE},
routed AS ({_ROUTED.format(negative="0.6", positive="0.7")}),
full_rows AS (SELECT sample_id, p, route, vec FROM routed JOIN letters USING (sample_id))
SELECT sample_id, route FROM full_rows a
WHERE NOT EXISTS (SELECT 1 FROM full_rows b WHERE a.route = b.route
  AND (b.p, b.sample_id) > (a.p, a.sample_id)
  AND list_dot_product(a.vec, b.vec)::FLOAT > {_TEXT}::FLOAT)""",
        "near_dup_across_routes": f"""
WITH {TOY_CTE}, {LETTER_CTE},
routed AS ({_ROUTED.format(negative="0.6", positive="0.7")}),
full_rows AS (SELECT sample_id, abs(p - 0.5::DOUBLE) AS clear, route, vec FROM routed JOIN letters USING (sample_id))
SELECT sample_id, route FROM full_rows a
WHERE NOT EXISTS (SELECT 1 FROM full_rows b WHERE a.route <> b.route
  AND (b.clear, b.sample_id) > (a.clear, a.sample_id)
  AND list_dot_product(a.vec, b.vec)::FLOAT > {_TEXT}::FLOAT)""",
        "labeled_set": """
SELECT doc_id AS sample_id, n_chars, quality::DOUBLE AS label FROM documents JOIN labels USING (doc_id)""",
        "accuracy_rmse": f"""
WITH {JUDGED_CTE}
SELECT round({_HIT}, 6) AS accuracy, round(sqrt(avg((p - label) * (p - label))), 6) AS rmse FROM judged""",
        "auc_exact": f"""
WITH {JUDGED_CTE}, scored AS (SELECT 0 AS g, p, label FROM judged)
SELECT round(auc, 6) AS auc FROM ({_area('scored', 'g')})""",
        "threshold_sweep": f"""
WITH {_ALL}
SELECT k, round(t, 6) AS t, round(tp, 6) AS tp, round(fp, 6) AS fp, round(fn, 6) AS fn,
  round(tn, 6) AS tn FROM sweep""",
        "ratio_curves": f"""
WITH {_ALL}
SELECT k, round(positives_ratio, 6) AS positives_ratio, round(negatives_ratio, 6) AS negatives_ratio
FROM curves""",
        "ratio_peaks": f"""
WITH {_ALL}, {_peaks('g')}
SELECT round(positive_threshold, 6) AS positive_threshold,
  round(negative_threshold, 6) AS negative_threshold FROM margins""",
        "safe_margins": f"""
WITH {_ALL}, {_peaks('g')}
SELECT round(positive_margin, 6) AS positive_margin, round(negative_margin, 6) AS negative_margin
FROM margins""",
        "score_histogram": f"""
WITH {JUDGED_CTE}
SELECT label, bin, round(bin::DOUBLE / 99, 6) AS left_edge, coalesce(n, 0) AS n FROM
  (SELECT DISTINCT label, b::INT AS bin FROM judged, range(99) r(b))
  LEFT JOIN (SELECT label, {_bin('p', 100)} AS bin, count(*) AS n FROM judged GROUP BY ALL)
  USING (label, bin)""",
        "adaptive_histogram": f"""
WITH {JUDGED_CTE},
unlabeled AS (SELECT * FROM toy WHERE sample_id NOT IN (SELECT sample_id FROM known))
{_adaptive('validation', 'judged', 'label', _sized(_N_JUDGED, [(200, 10), (1000, 25), (None, 100)]))}
UNION ALL
{_adaptive('prediction', 'unlabeled', '(-1)::DOUBLE', _sized(_N_POOL, [(150, 12), (1000, 25), (None, 100)]))}
UNION ALL
{_adaptive('session', 'judged', 'label', _sized(_N_JUDGED, [(None, 12)]))}""",
        "tail_fractions": f"""
WITH {TOY_CTE},
shares AS (
  SELECT avg(CASE WHEN p >= 0.85::DOUBLE THEN 1.0 ELSE 0.0 END) AS hi,
    avg(CASE WHEN p <= 0.25::DOUBLE THEN 1.0 ELSE 0.0 END) AS lo FROM toy
)
SELECT round(hi, 6) AS share_high, round(lo, 6) AS share_low,
  round(100 * hi, 1) AS percent_high, round(100 * lo, 1) AS percent_low FROM shares""",
        "score_pairs": f"WITH {JUDGED_CTE} SELECT sample_id, label, p_knn, p_lr FROM judged",
        "sort_by_score": f"""
WITH {TOY_CTE} SELECT sample_id, round(p, 6) AS p FROM toy ORDER BY toy.p, sample_id""",
        "route_items": f"""
WITH {TOY_CTE}
SELECT sample_id, round(p, 6) AS p, route FROM ({_ROUTED.format(negative="0.7", positive="0.6")})""",
        "route_residual": f"""
WITH {TOY_CTE}
SELECT sample_id, round(p, 6) AS p FROM toy WHERE p > 0.6::DOUBLE AND p < 0.8::DOUBLE""",
        "route_features": f"""
WITH {TOY_CTE}
SELECT sample_id || '_' || {_SUFFIX.format(id='sample_id')} AS dest_id, route,
  round(vec[6], 6) AS log_length
FROM ({_ROUTED.format(negative="0.6", positive="0.8")}) JOIN shapes USING (sample_id)""",
        "routed_sink": f"""
WITH {TOY_CTE}, routed AS ({_ROUTED.format(negative="0.6", positive="0.8")}),
runs AS (
  SELECT '1' AS run, route, sample_id, sample_id || '_' || {_SUFFIX.format(id='sample_id')} AS dest_id
  FROM routed WHERE sample_id % 2 = 0
  UNION ALL
  SELECT '2', route, sample_id, sample_id || '_' || {_SUFFIX.replace("'0:'", "'again/:'").format(id='sample_id')}
  FROM routed WHERE sample_id % 2 = 1)
SELECT run, route, dest_id, dest_id || '.txt' AS dest_name FROM runs""",
        "cold_start": "SELECT doc_id AS sample_id, 0.1::DOUBLE AS p FROM documents",
        "model_name": """
SELECT 'taste_num_samples_' || count(*) || '_num_features_35_2024-01-31' AS name FROM labels""",
        "stratified_folds": f"WITH {LABELS_CTE} {_FOLDS.format(repeats=2)}",
        "shuffle_split": """
SELECT doc_id AS sample_id, CASE WHEN row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id)
  <= (SELECT floor(0.7::DOUBLE * count(*)) FROM labels) THEN 'train' ELSE 'valid' END AS subset
FROM labels""",
        "fold_summary": f"""
WITH {JUDGED_CTE}, folds AS ({_FOLDS.format(repeats=1)}),
stacked AS (
  SELECT fold, 'kNN' AS classifier, p_knn AS p, judged.label FROM judged JOIN folds USING (sample_id)
  UNION ALL SELECT fold, 'LR', p_lr, judged.label FROM judged JOIN folds USING (sample_id)
  UNION ALL SELECT fold, 'GBT', p_gbt, judged.label FROM judged JOIN folds USING (sample_id)
  UNION ALL SELECT fold, 'ensemble', p, judged.label FROM judged JOIN folds USING (sample_id)
),
keyed AS (SELECT fold || ':' || classifier AS g, classifier, p, label FROM stacked),
areas AS ({_area('keyed', 'g')})
SELECT split_part(g, ':', 2) AS classifier, round(avg(auc), 6) AS mean_auc,
  round(stddev_pop(auc), 6) AS std_auc FROM areas GROUP BY ALL""",
        "weight_grid_search": _searched(_GRID_WEIGHTS, ""),
        "weight_search": _searched(
            _RANDOM_WEIGHTS, "ORDER BY round(scores.score, 9) DESC, weight_id LIMIT 1"
        ),
        "uncertainty_sample": f"""
WITH {TOY_CTE},
weighted AS (
  SELECT sample_id, p, CASE WHEN p < 0.35::DOUBLE OR p > 0.65::DOUBLE THEN 0.01::DOUBLE
    ELSE 1::DOUBLE END AS weight
  FROM toy WHERE sample_id NOT IN (SELECT doc_id FROM labels)
)
SELECT sample_id, round(p, 6) AS p, weight FROM weighted
ORDER BY -ln({_uniform("'7:' || sample_id")}) / weight, sample_id LIMIT 50""",
        "label_progress": _PROGRESS,
        "session_eval": f"""
WITH {TOY_CTE}, {_EVENTS_CTE},
seen AS (SELECT 0 AS g, toy.p, given.label FROM given JOIN toy USING (sample_id)),
area AS ({_area('seen', 'g')})
SELECT coalesce(max(round(accuracy, 6)), 0) AS accuracy, coalesce(max(round(auc, 6)), 0) AS auc,
  coalesce(max(n), 0) AS n
FROM (SELECT 0 AS g, {_HIT} AS accuracy, count(*) AS n FROM seen) JOIN area USING (g)
WHERE auc IS NOT NULL""",
        "template_knn": f"""
WITH {_TEMPLATES_CTE}
SELECT sample_id, c::INT AS position,
  round(count(*) FILTER (template_id = c) / 3.0::DOUBLE, 6) AS share
FROM near, range(10) r(c) WHERE place <= 3 GROUP BY ALL""",
        "multiclass_accuracy": f"""
WITH {_TEMPLATES_CTE},
hits AS (
  SELECT CASE WHEN template_id = label THEN 1.0 ELSE 0.0 END AS hit
  FROM near JOIN vecs USING (sample_id) WHERE place = 1
)
SELECT round(avg(hit), 6) AS accuracy, round(sqrt(avg(1 - hit) * 2 / 10), 6) AS rmse FROM hits""",
        "stream_score": f"""
WITH {SHAPE_CTE}, scored AS (SELECT sample_id, {_STREAM_P} AS p FROM shapes)
SELECT sample_id, p, CASE WHEN p <= 0.6::DOUBLE THEN 'negative' WHEN p >= 0.8::DOUBLE
  THEN 'positive' ELSE 'none' END AS route FROM scored""",
        "stream_label_progress": _PROGRESS,
    }
    known["gbt_two_stumps"] = _stumps(2, 0.5, 10)
    known |= {"lda_two_columns": _LDA, "pca_two_columns": _PCA, "lr_two_columns": _LR}
    # Other ways to the same rows.
    known["near_dup_cells"] = known["near_dup_drop"]
    known["template_knn_blocks"] = known["template_knn"]
    known["stream_session_eval"] = known["session_eval"]
    return known
