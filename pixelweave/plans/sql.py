"""DuckDB SQL for the registered queries, written on its own over the same tables."""

from __future__ import annotations

PX = """px AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 23940 AS INT) AS frame_idx, CAST(l_partkey % 128 AS INT) AS x, CAST(l_suppkey % 96 AS INT) AS y,
  CAST(max(floor(l_extendedprice / 2)) AS INT) AS intensity FROM lineitem GROUP BY ALL)"""
LP = PX + """, lp AS (SELECT frame_idx, CAST((y // 8) * 16 + x // 8 + 1 AS INT) AS blob_id, x, y, intensity FROM px WHERE intensity > 30000)"""
ST = LP + """, st AS (SELECT frame_idx, blob_id, count(*) AS size, CAST(sum(intensity) // count(*) AS INT) AS mean_intensity, list_sort(list(intensity))[count(*) // 2 + 1] AS median_intensity,
  max(intensity) AS max_intensity, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM lp GROUP BY ALL)"""
AROUND = "(VALUES (0,-1),(-1,0),(1,0),(0,1),(-1,-1),(1,-1),(-1,1),(1,1)) o(dx, dy)"
D = """d AS (SELECT CAST(date_diff('day', DATE '2020-01-01', CAST(ts AS DATE)) AS INT) AS frame_idx, event_id AS group_id, CASE WHEN event_type IN ('purchase', 'error') THEN 'userSelected' END AS reason_kind,
  CASE WHEN event_type IN ('purchase', 'error') THEN value END AS reason_value, CASE event_type WHEN 'purchase' THEN true WHEN 'error' THEN false END AS will_paint FROM events)"""
DC = D + ", dc AS (SELECT frame_idx, count(*) FILTER (will_paint) AS n_positive, count(*) FILTER (NOT will_paint) AS n_negative, count(*) FILTER (will_paint IS NULL) AS n_undecided FROM d GROUP BY ALL)"
TR = """t AS (SELECT doc_id AS id, quality = 1 AS label, CAST(length(text) AS DOUBLE) AS f0, CAST(length(regexp_replace(text, '[^A-Z]', '', 'g')) AS DOUBLE) AS f1,
  CAST(length(regexp_replace(text, '[A-Za-z]', '', 'g')) AS DOUBLE) AS f2 FROM labels JOIN documents USING (doc_id))"""
CS = TR + """, m AS (UNPIVOT t ON f0, f1, f2 INTO NAME feature VALUE v), cs AS (SELECT label, feature, min(v) AS low, max(v) AS high, avg(v) AS mean, list_sort(list(v))[count(*) // 2 + 1] AS median FROM m GROUP BY ALL)"""


def near(scan: int, small: str = "true", other: str = "true") -> str:
    return f"""(SELECT DISTINCT a.frame_idx, a.blob_id, p.blob_id AS other_id FROM st a JOIN lp p ON p.frame_idx = a.frame_idx AND p.blob_id <> a.blob_id
      AND p.x BETWEEN a.min_x - {scan} AND a.max_x + {scan} AND p.y BETWEEN a.min_y - {scan} AND a.max_y + {scan} WHERE {small})"""


def beside(expression: str, table: str) -> str:
    return f"(SELECT count(*) FROM (SELECT DISTINCT frame_idx FROM lp) f WHERE abs(f.frame_idx - {table}.frame_idx) = 1)"


_KERNEL = """(SELECT a.i - 6 AS dx, b.i - 6 AS dy, CASE WHEN sqrt((a.i - 7) ** 2 + (b.i - 7) ** 2) <= 2 THEN CAST(1 AS DOUBLE) ELSE (6 - sqrt((a.i - 7) ** 2 + (b.i - 7) ** 2)) / 4 END AS w
  FROM range(15) a(i), range(15) b(i) WHERE sqrt((a.i - 7) ** 2 + (b.i - 7) ** 2) < 6)"""
ALPHA = f"""al AS (SELECT frame_idx, CAST(x + dx AS INT) AS x, CAST(y + dy AS INT) AS y, round(max(w), 9) AS alpha FROM px, {_KERNEL} k
  WHERE intensity > 48000 AND x + dx BETWEEN 0 AND 127 AND y + dy BETWEEN 0 AND 95 GROUP BY ALL)"""
_ANGLES = "(SELECT t, CAST(round(cos(radians(t)) * 1000000) AS BIGINT) AS c, CAST(round(sin(radians(t)) * 1000000) AS BIGINT) AS s FROM range(180) r(t))"
VOTES = f"""px AS (SELECT vec_id // 64 AS frame_idx, i AS x, vec_id % 64 AS y FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings) WHERE floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 100000) > 30000),
  v AS (SELECT CAST(frame_idx AS INT) AS frame_idx, CAST(t AS INT) AS theta, CAST(floor((x * c + y * s) / 1000000) AS INT) AS rho, count(*) AS votes FROM px, {_ANGLES} a GROUP BY ALL HAVING count(*) > 3)"""
THETA = VOTES + ", b AS (SELECT frame_idx, theta // 10 AS band, CAST(sum(votes) AS BIGINT) AS votes FROM v GROUP BY ALL), h AS (SELECT *, round(votes / sum(votes) OVER (PARTITION BY frame_idx), 9) AS share FROM b)"
BL = ST + f""", gv AS (SELECT frame_idx, blob_id, t, c, s, CAST(floor((x * c + y * s + 500000) / 1000000) AS INT) AS rho, count(*) AS votes FROM lp, {_ANGLES} a GROUP BY ALL),
  gk AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, blob_id ORDER BY votes DESC, t, rho) AS place FROM gv QUALIFY place <= 10),
  gd AS (SELECT k.frame_idx, k.blob_id, place, t, rho, c, s, votes, count(*) AS n, list_sort(list(abs(x * c + y * s - rho * CAST(1000000 AS BIGINT))), 'DESC')[count(*) // 2 + 1] AS med FROM gk k JOIN lp p ON p.frame_idx = k.frame_idx AND p.blob_id = k.blob_id GROUP BY ALL),
  bl AS (SELECT frame_idx, blob_id, CAST(t AS INT) AS theta, rho, c AS cosine, s AS sine, votes FROM gd WHERE n >= 3 QUALIFY row_number() OVER (PARTITION BY frame_idx, blob_id ORDER BY med, place) = 1)"""
FIT = BL + """, pd AS (SELECT lp.*, bl.* EXCLUDE (frame_idx, blob_id), abs(x * cosine + y * sine - rho * CAST(1000000 AS BIGINT)) AS d FROM lp JOIN bl USING (frame_idx, blob_id)),
  ft AS (SELECT frame_idx, blob_id, sum(d) / count(*) / 1000000 AS mean, list_sort(list(d), 'DESC')[count(*) // 2 + 1] AS middle, max(d) AS most, any_value(votes) / count(*) AS per_pixel,
    sqrt(CAST((max(x) FILTER (d < 4000000) - min(x) FILTER (d < 4000000)) ** 2 + (max(y) FILTER (d < 4000000) - min(y) FILTER (d < 4000000)) ** 2 AS DOUBLE)) AS length FROM pd GROUP BY ALL)"""
_N8 = f"(SELECT count(*) FROM lp q, {AROUND} WHERE q.frame_idx = p.frame_idx AND q.blob_id = p.blob_id AND q.x = p.x + dx AND q.y = p.y + dy)"
_Y, _X = "(rho * CAST(1000000 AS DOUBLE) - {0} * cosine) / nullif(sine, 0)", "(rho * CAST(1000000 AS DOUBLE) - {0} * sine) / nullif(cosine, 0)"


def _met(sides: list[tuple[str, str]], low: str = "") -> str:
    """Where a line, given as its x or y at a side, meets the sides of a box."""
    on_x = [f"CASE WHEN {y} > {low}min_y AND {y} <= {low}max_y THEN {{'x': CAST({x} AS DOUBLE), 'y': {y}}} END" for x, y in sides[:2]]
    on_y = [f"CASE WHEN {x} > {low}min_x AND {x} <= {low}max_x THEN {{'x': {x}, 'y': CAST({y} AS DOUBLE)}} END" for x, y in sides[2:]]
    return f"list_filter([{', '.join(on_x + on_y)}], lambda p: p IS NOT NULL)"


_MET = _met([("min_x", _Y.format("min_x")), ("max_x", _Y.format("max_x")), (_X.format("min_y"), "min_y"), (_X.format("max_y"), "max_y")])
FILL = BL + f""", lm AS (SELECT frame_idx, blob_id, rho, cosine, sine, {_MET} AS met, abs(sine) > abs(cosine) AS level FROM st JOIN bl USING (frame_idx, blob_id)),
  le AS (SELECT *, CASE WHEN level THEN met[1].x ELSE met[1].y END AS e1, CASE WHEN level THEN met[2].x ELSE met[2].y END AS e2 FROM lm WHERE len(met) > 1),
  lt AS (SELECT *, unnest(range(CAST(trunc(least(e1, e2)) AS BIGINT), CAST(trunc(greatest(e1, e2)) AS BIGINT) + 1)) AS t FROM le),
  lu AS (SELECT *, CAST(trunc(CASE WHEN level THEN {_Y.format('t')} ELSE {_X.format('t')} END) AS BIGINT) AS u FROM lt),
  lv AS (SELECT frame_idx, blob_id, CASE WHEN level THEN t ELSE u + k END AS x, CASE WHEN level THEN u + k ELSE t END AS y FROM lu, (VALUES (-1), (0), (1)) o(k) WHERE t >= 0 AND u >= 0 AND u + k >= 0),
  lf AS (SELECT v.frame_idx, v.blob_id, count(q.x) / count(*) AS share FROM lv v LEFT JOIN lp q ON q.frame_idx = v.frame_idx AND q.blob_id = v.blob_id AND q.x = v.x AND q.y = v.y GROUP BY ALL)"""
_BOXES = f"""SELECT n.frame_idx, n.blob_id, n.other_id, {", ".join(f"{t}.{c} AS {t}_{c}" for t in "pq" for c in ("min_x", "min_y", "max_x", "max_y"))}, p.min_x + (p.max_x - p.min_x + 1) / 2 AS x1, p.min_y + (p.max_y - p.min_y + 1) / 2 AS y1,
  q.min_x + (q.max_x - q.min_x + 1) / 2 AS x2, q.min_y + (q.max_y - q.min_y + 1) / 2 AS y2 FROM {near(4)} n JOIN st p ON p.frame_idx = n.frame_idx AND p.blob_id = n.blob_id JOIN st q ON q.frame_idx = n.frame_idx AND q.blob_id = n.other_id WHERE n.blob_id < n.other_id"""
_CY, _CX = "((x2 * y1 - x1 * y2) - (y1 - y2) * {0}) / nullif(x2 - x1, 0)", "((x2 * y1 - x1 * y2) - (x2 - x1) * {0}) / nullif(y1 - y2, 0)"


def _of_centres(t: str) -> str:
    return _met([(f"{t}_min_x", _CY.format(f"{t}_min_x")), (f"{t}_max_x", _CY.format(f"{t}_max_x")), (_CX.format(f"{t}_min_y"), f"{t}_min_y"), (_CX.format(f"{t}_max_y"), f"{t}_max_y")], f"{t}_")


_DIAGONAL = _met([("p_min_x", "CAST(p_min_x AS DOUBLE)"), ("p_max_x", "CAST(p_max_x AS DOUBLE)"), ("CAST(p_min_y AS DOUBLE)", "p_min_y"), ("CAST(p_max_y AS DOUBLE)", "p_max_y")], "p_")
BOXES = ST + f""", bx AS ({_BOXES}), bd AS (SELECT *, sqrt((x1 - x2) ** 2 + (y1 - y2) ** 2) AS apart, (p_max_x - p_min_x + 1) * (p_max_y - p_min_y + 1) AS ps, (q_max_x - q_min_x + 1) * (q_max_y - q_min_y + 1) AS qs,
    {_of_centres("p")} AS pm, {_of_centres("q")} AS qm, len({_DIAGONAL}) AS n_met FROM bx),
  be AS (SELECT *, list_filter(pm, lambda s: trunc(sqrt((s.x - x2) ** 2 + (s.y - y2) ** 2)) <= trunc(apart + 3))[-1] AS mine, list_filter(qm, lambda s: trunc(sqrt((s.x - x1) ** 2 + (s.y - y1) ** 2)) <= trunc(apart + 3))[-1] AS theirs FROM bd),
  bf AS (SELECT *, sqrt((mine.x - theirs.x) ** 2 + (mine.y - theirs.y) ** 2) AS between_, sqrt((mine.x - x1) ** 2 + (mine.y - y1) ** 2) + sqrt((theirs.x - x2) ** 2 + (theirs.y - y2) ** 2) AS reach FROM be)"""
CLOUDS = """e AS (SELECT frame_idx, blob_id AS a, other_id AS b FROM np UNION SELECT frame_idx, other_id, blob_id FROM np),
  r AS (SELECT frame_idx, blob_id, blob_id AS via FROM gs UNION SELECT r.frame_idx, r.blob_id, e.b FROM r JOIN e ON e.frame_idx = r.frame_idx AND e.a = r.via),
  c AS (SELECT frame_idx, blob_id, CAST(min(via) AS INT) AS cloud_id, CAST(count(*) AS INT) AS cloud_size FROM r GROUP BY ALL)"""
_INSIDE = "SELECT p.frame_idx, p.blob_id, p.x, p.y, count(q.x) AS n FROM lp p CROSS JOIN {0} LEFT JOIN lp q ON q.frame_idx = p.frame_idx AND q.blob_id = p.blob_id AND q.x = p.x + dx AND q.y = p.y + dy GROUP BY ALL"
CARDINAL, CORNERS = "(VALUES (0,-1),(-1,0),(1,0),(0,1)) o(dx, dy)", "(VALUES (-1,-1),(1,-1),(-1,1),(1,1)) o(dx, dy)"

ORACLES: dict[str, str] = {
    "px_dense": "SELECT CAST(vec_id // 64 AS INT) AS frame_idx, CAST(i AS INT) AS x, CAST(vec_id % 64 AS INT) AS y, CAST(floor(abs(CAST(embedding[i + 1] AS DOUBLE)) * 100000) AS INT) AS intensity FROM (SELECT *, unnest(range(len(embedding))) AS i FROM embeddings)",
    "px_sparse": f"WITH {PX} SELECT * FROM px",
    "subtract": f"""WITH {PX}, c AS (SELECT frame_idx, x, y, intensity + intensity // 2 + intensity // 4 AS s, (x + y) % 7 = 0 AS dim FROM px)
      SELECT p.frame_idx, p.x, p.y, CAST(CASE WHEN q.dim THEN 0 ELSE greatest(p.s - q.s, 0) // 3 END AS INT) AS intensity FROM c p JOIN c q ON q.frame_idx = p.frame_idx + 1 AND q.x = p.x AND q.y = p.y""",
    "admit": f"WITH {PX} SELECT *, intensity > 30000 AS seedable FROM px WHERE y < 86 AND (intensity > 30000 OR abs(intensity - 30000) / CAST(greatest(intensity, 30000) AS DOUBLE) * 100 < 50)",
    "contrast_edges": f"WITH {PX} SELECT p.frame_idx, p.x, p.y, count(*) AS n_like FROM px p, {AROUND}, px q WHERE q.frame_idx = p.frame_idx AND q.x = p.x + dx AND q.y = p.y + dy AND coalesce(abs(p.intensity - q.intensity) / CAST(nullif(greatest(p.intensity, q.intensity), 0) AS DOUBLE) * 100, 0) < 20 GROUP BY ALL",
    "seed_candidates": f"WITH {PX} SELECT * FROM px p WHERE intensity > 30000 AND NOT EXISTS (SELECT 1 FROM px q WHERE q.frame_idx = p.frame_idx AND q.x BETWEEN p.x - 1 AND p.x + 1 AND q.y BETWEEN p.y - 1 AND p.y + 1 AND q.intensity > p.intensity)",
    "border_brightness": f"""WITH {LP}, o AS (SELECT p.frame_idx, p.blob_id, p.intensity AS i, p.x + dx AS x, p.y + dy AS y FROM lp p, {AROUND}),
      n AS (SELECT o.frame_idx, o.blob_id, count(*) FILTER (q.intensity > i) AS n_brighter, count(*) FILTER (q.intensity <= i) AS n_darker FROM o JOIN px q USING (frame_idx, x, y) WHERE NOT EXISTS (SELECT 1 FROM lp s WHERE s.frame_idx = o.frame_idx AND s.blob_id = o.blob_id AND s.x = o.x AND s.y = o.y) GROUP BY ALL)
      SELECT *, round(n_brighter / nullif(n_darker, 0), 9) AS ratio FROM n""",
    "alpha_plane": f"WITH {PX}, {ALPHA} SELECT * FROM al",
    "blend": f"""WITH {PX}, {ALPHA} SELECT p.frame_idx, p.x, p.y, CAST(CASE WHEN alpha IS NULL OR q.intensity IS NULL THEN p.intensity WHEN alpha >= 1 THEN q.intensity ELSE CAST(trunc(p.intensity * (1 - alpha)) AS INT) + CAST(trunc(q.intensity * alpha) AS INT) END AS INT) AS intensity
      FROM px p LEFT JOIN px q ON q.frame_idx = p.frame_idx + 1 AND q.x = p.x AND q.y = p.y LEFT JOIN al ON al.frame_idx = p.frame_idx AND al.x = p.x AND al.y = p.y""",
    "dilate_validation": f"WITH {LP} SELECT DISTINCT frame_idx, x + dx AS x, y + dy AS y FROM lp, (SELECT * FROM {AROUND} UNION ALL SELECT 0, 0) o WHERE x + dx BETWEEN 0 AND 127 AND y + dy BETWEEN 0 AND 95",
    "blob_stats": f"WITH {ST} SELECT * FROM st",
    "qualify_blobs": f"WITH {ST} SELECT * FROM st WHERE size > 2 AND median_intensity >= 32000 AND NOT (size < 5 AND median_intensity < 36000)",
    "near_pairs": f"WITH {ST} SELECT * FROM {near(4)}",
    "isolated_filter": f"""WITH {ST} SELECT frame_idx, blob_id, size FROM st WHERE size > 24 OR (frame_idx, blob_id) IN
      (SELECT (n.frame_idx, n.blob_id) FROM {near(6)} n JOIN st o ON o.frame_idx = n.frame_idx AND o.blob_id = n.other_id AND o.size > 1 GROUP BY n.frame_idx, n.blob_id HAVING count(*) >= 3)""",
    "dim_isolated_filter": f"""WITH {ST}, l AS (SELECT frame_idx, list_sort(list(median_intensity))[count(*) // 2 + 1] AS half, list_sort(list(median_intensity))[count(*) // 4 + 1] AS quarter FROM st GROUP BY ALL),
      n AS (SELECT n.frame_idx, n.blob_id FROM {near(6)} n JOIN st o ON o.frame_idx = n.frame_idx AND o.blob_id = n.other_id JOIN l ON l.frame_idx = n.frame_idx WHERE o.median_intensity > quarter GROUP BY ALL HAVING count(*) >= 4)
      SELECT st.frame_idx, st.blob_id, size FROM st JOIN l USING (frame_idx) LEFT JOIN n ON n.frame_idx = st.frame_idx AND n.blob_id = st.blob_id WHERE size > 24 OR median_intensity > half OR n.blob_id IS NOT NULL""",
    "bbox_overlap_pairs": f"""WITH {ST} SELECT p.frame_idx, p.blob_id AS a, q.blob_id AS b, (least(p.max_x, q.max_x) - greatest(p.min_x, q.min_x) + 1) * (least(p.max_y, q.max_y) - greatest(p.min_y, q.min_y) + 1) AS overlap
      FROM st p JOIN st q ON q.frame_idx = p.frame_idx + 1 AND p.min_x < q.max_x AND q.min_x < p.max_x AND p.min_y < q.max_y AND q.min_y < p.max_y""",
    "feature_shape": f"""WITH {ST}, s AS (SELECT *, CAST(max_x - min_x + 1 AS DOUBLE) AS w, CAST(max_y - min_y + 1 AS DOUBLE) AS h FROM st)
      SELECT frame_idx, blob_id, round(size / 12288, 9) AS f_size, round(w / 128, 9) AS f_width, round(h / 96, 9) AS f_height, round(floor(min_x + w / 2) / 128, 9) AS f_center_x, round(floor(min_y + h / 2) / 96, 9) AS f_center_y,
      round(min_x / 128, 9) AS f_min_x, round(min_y / 96, 9) AS f_min_y, round(max_x / 128, 9) AS f_max_x, round(max_y / 96, 9) AS f_max_y, round(sqrt(w * w + h * h) / 12288, 9) AS f_hypotenuse, round(w / h, 9) AS f_aspect_ratio, round(size / (w * h), 9) AS f_fill_amount,
      CAST(mean_intensity AS DOUBLE) AS f_average_brightness, CAST(median_intensity AS DOUBLE) AS f_median_brightness, CAST(max_intensity AS DOUBLE) AS f_max_brightness FROM s""",
    "surface_ratio": f"WITH {LP}, i AS ({_INSIDE.format(CARDINAL)}) SELECT frame_idx, blob_id, round(avg(CASE WHEN n < 4 THEN 1.0 ELSE 0.0 END), 9) AS f_surface_ratio FROM i GROUP BY ALL",
    "diag_border": f"WITH {LP}, i AS ({_INSIDE.format(CORNERS)}) SELECT frame_idx, blob_id, round(avg(n), 9) AS f_pixel_border FROM i GROUP BY ALL",
    "nearby_count": f"""WITH {ST}, c AS (SELECT frame_idx, blob_id, floor(min_x + (max_x - min_x + 1) / 2) AS cx, floor(min_y + (max_y - min_y + 1) / 2) AS cy FROM st),
      n AS (SELECT n.frame_idx, n.blob_id, count(*) AS k FROM {near(20)} n JOIN c a ON a.frame_idx = n.frame_idx AND a.blob_id = n.blob_id JOIN c b ON b.frame_idx = n.frame_idx AND b.blob_id = n.other_id WHERE sqrt((a.cx - b.cx) ** 2 + (a.cy - b.cy) ** 2) < 16 GROUP BY ALL)
      SELECT c.frame_idx, c.blob_id, coalesce(k, 0) AS f_nearby FROM c LEFT JOIN n ON n.frame_idx = c.frame_idx AND n.blob_id = c.blob_id""",
    "direct_overlap": f"""WITH {LP}, g AS (SELECT frame_idx, blob_id, count(*) AS n FROM lp GROUP BY ALL), h AS (SELECT p.frame_idx, p.blob_id, count(*) AS k FROM lp p JOIN lp q ON abs(q.frame_idx - p.frame_idx) = 1 AND q.x = p.x AND q.y = p.y GROUP BY ALL)
      SELECT g.frame_idx, g.blob_id, round(coalesce(coalesce(k, 0) / nullif(n * {beside("", "g")}, 0), 0), 9) AS f_direct_overlap FROM g LEFT JOIN h ON h.frame_idx = g.frame_idx AND h.blob_id = g.blob_id""",
    "bbox_overlap_score": f"""WITH {ST}, h AS (SELECT s.frame_idx, s.blob_id, count(*) AS k FROM st s JOIN lp q ON abs(q.frame_idx - s.frame_idx) = 1 AND q.x BETWEEN min_x AND max_x AND q.y BETWEEN min_y AND max_y WHERE max_y - min_y + 1 >= 3 GROUP BY ALL)
      SELECT st.frame_idx, st.blob_id, round(coalesce(coalesce(k, 0) / nullif((max_x - min_x + 1) * (max_y - min_y + 1) * {beside("", "st")}, 0), 0), 9) AS f_bounds_overlap FROM st LEFT JOIN h ON h.frame_idx = st.frame_idx AND h.blob_id = st.blob_id""",
    "razor": f"WITH {LP}, n AS (SELECT frame_idx, max(blob_id) + 1 AS new_id FROM lp GROUP BY ALL) SELECT lp.frame_idx, CASE WHEN x BETWEEN 10 AND 40 AND y BETWEEN 10 AND 30 THEN new_id ELSE blob_id END AS blob_id, x, y, intensity FROM lp JOIN n USING (frame_idx)",
    "overlapping_groups": f"WITH {LP} SELECT DISTINCT p.frame_idx, p.blob_id, q.blob_id AS other_id FROM lp p JOIN lp q ON q.frame_idx = p.frame_idx + 1 AND q.x = p.x AND q.y = p.y",
    "frame_links": f"WITH {PX}, f AS (SELECT DISTINCT frame_idx FROM px) SELECT f.frame_idx, b.frame_idx AS previous, a.frame_idx AS next, coalesce(a.frame_idx, b.frame_idx) AS compared_with FROM f LEFT JOIN f b ON b.frame_idx = f.frame_idx - 1 LEFT JOIN f a ON a.frame_idx = f.frame_idx + 1",
    "incremental_plan": f"WITH {PX}, f AS (SELECT DISTINCT frame_idx FROM px) SELECT frame_idx FROM f WHERE EXISTS (SELECT 1 FROM f m WHERE m.frame_idx % 11 = 5 AND abs(m.frame_idx - f.frame_idx) <= 2)",
    "hough_topk": f"""WITH {VOTES}, m AS (SELECT * FROM v WHERE NOT EXISTS (SELECT 1 FROM v o WHERE o.frame_idx = v.frame_idx AND abs(o.theta - v.theta) <= 5 AND abs(o.rho - v.rho) <= 5 AND o.votes > v.votes)),
      r AS (SELECT *, CAST(row_number() OVER (PARTITION BY frame_idx ORDER BY votes DESC, theta, rho) AS INT) AS place FROM m) SELECT * FROM r WHERE place <= 10""",
    "theta_hist": f"WITH {THETA} SELECT * FROM h",
    "decision_counts": f"WITH {DC} SELECT * FROM dc",
    "apply_undecided": f"WITH {D}, s AS (SELECT *, (group_id % 21 - 10) / 10.0 AS score FROM d) SELECT frame_idx, group_id, CASE WHEN will_paint IS NULL THEN 'fromClassifier' ELSE reason_kind END AS reason_kind, round(CASE WHEN will_paint IS NULL THEN CAST(score AS DOUBLE) ELSE reason_value END, 6) AS reason_value, coalesce(will_paint, score > 0) AS will_paint FROM s",
    "validation_override": f"WITH {LP} SELECT frame_idx, blob_id, bool_or(intensity > 49000) AS will_paint FROM lp GROUP BY ALL",
    "select_in_box": f"WITH {ST}, {DC} SELECT st.frame_idx, blob_id, CASE WHEN st.frame_idx BETWEEN 10 AND 60 AND min_x >= 0 AND min_y >= 0 AND max_x <= 63 AND max_y <= 63 THEN true ELSE n_positive > 1 END AS will_paint FROM st LEFT JOIN dc ON dc.frame_idx = st.frame_idx",
    "delete_in_box": f"WITH {ST} SELECT frame_idx, blob_id FROM st WHERE NOT (frame_idx BETWEEN 10 AND 60 AND max_x <= 63 AND max_y <= 63)",
    "next_positive_frame": f"WITH {DC} SELECT frame_idx, coalesce((SELECT min(n.frame_idx) FROM dc n WHERE n.frame_idx > dc.frame_idx AND n.n_positive > 0), (SELECT max(frame_idx) FROM dc)) AS advance_to FROM dc",
    "fold_split": f"WITH {TR} SELECT id, label, CAST((row_number() OVER (PARTITION BY label ORDER BY id) - 1) % 8 AS INT) AS fold FROM t",
    "chunk_split": f"WITH {TR} SELECT id, label, CAST(least((row_number() OVER (PARTITION BY label ORDER BY id) - 1) // greatest(count(*) OVER (PARTITION BY label) // 6, 1), 5) AS INT) AS chunk FROM t",
    "train_test_split": f"WITH {TR} SELECT id, label, row_number() OVER (ORDER BY label DESC, id) % 10 = 0 AS is_test FROM t",
    "class_stats": f"WITH {CS} SELECT label, feature, low, high, round(mean, 6) AS mean, median FROM cs",
    "split_scores": f"""WITH {CS}, c AS (SELECT p.feature, CASE WHEN p.high < n.low THEN (p.high + n.low) / 2 WHEN n.high < p.low THEN (n.high + p.low) / 2 ELSE (p.median + n.median) / 2 END AS threshold, p.high < n.low OR n.high < p.low AS clean,
        CASE WHEN p.high < n.low THEN n.low - p.high WHEN n.high < p.low THEN p.low - n.high END / nullif(abs(p.median - n.median), 0) AS gap FROM cs p JOIN cs n ON n.feature = p.feature WHERE p.label AND NOT n.label),
      k AS (SELECT m.feature, threshold, clean, gap, count(*) FILTER (v < threshold) AS nl, count(*) FILTER (v < threshold AND label) AS pl, count(*) AS n, count(*) FILTER (label) AS p FROM m JOIN c USING (feature) GROUP BY ALL),
      s AS (SELECT feature, threshold, round(CASE WHEN clean THEN gap ELSE greatest(coalesce(pl / nullif(nl, 0), 0), coalesce((p - pl) / nullif(n - nl, 0), 0)) - p / n END, 9) AS score FROM k) SELECT * FROM s WHERE score > 0""",
    "clouds": f"WITH RECURSIVE {ST}, gs AS (SELECT frame_idx, blob_id FROM st), np AS {near(1)}, {CLOUDS} SELECT * FROM c",
    "best_line": f"WITH {BL} SELECT * FROM bl",
    "line_fit": f"""WITH {FIT} SELECT st.frame_idx, st.blob_id, round(coalesce(mean, 4294967295.0), 9) AS f_average_line, round(coalesce(middle / 1000000, 4294967295.0), 9) AS f_median_line, round(coalesce(most / 1000000, 0), 9) AS max_line,
      round(coalesce(mean, 420420420.0), 9) AS ideal_distance, round(coalesce(length, 0), 9) AS f_line_length, round(coalesce(per_pixel, 0), 9) AS f_max_hough FROM st LEFT JOIN ft ON ft.frame_idx = st.frame_idx AND ft.blob_id = st.blob_id""",
    "line_fill": f"WITH {FILL} SELECT st.frame_idx, st.blob_id, round(coalesce(share, 0), 9) AS f_line_fill FROM st LEFT JOIN lf ON lf.frame_idx = st.frame_idx AND lf.blob_id = st.blob_id",
    "line_trim": f"WITH {FIT} SELECT lp.* FROM lp LEFT JOIN pd ON pd.frame_idx = lp.frame_idx AND pd.blob_id = lp.blob_id AND pd.x = lp.x AND pd.y = lp.y LEFT JOIN ft ON ft.frame_idx = lp.frame_idx AND ft.blob_id = lp.blob_id WHERE d IS NULL OR 2 * d <= middle + most",
    "stray_trim": f"WITH {FIT} SELECT p.* FROM lp p LEFT JOIN pd ON pd.frame_idx = p.frame_idx AND pd.blob_id = p.blob_id AND pd.x = p.x AND pd.y = p.y LEFT JOIN ft ON ft.frame_idx = p.frame_idx AND ft.blob_id = p.blob_id WHERE d IS NULL OR d < 2000000 OR {_N8} > CASE WHEN d < middle THEN 2 ELSE 1 END",
    "neighbour_trim": f"WITH {LP} SELECT * FROM lp p WHERE {_N8} > 2",
    "line_geometry": f"""WITH {BL}, u AS (SELECT *, radians(theta) AS t FROM bl) SELECT frame_idx, blob_id, round(rho, 4) + 0.0 AS rho, round(cos(t), 4) + 0.0 AS cosine, round(CASE WHEN theta <> 0 THEN (rho - 10 * cos(t)) / sin(t) END, 4) + 0.0 AS y_at_10,
      round(CASE WHEN theta <> 135 THEN rho / (cos(t) + sin(t)) END, 4) + 0.0 AS met_x, true AS same FROM u""",
    "box_relations": f"""WITH {BOXES} SELECT frame_idx, blob_id, other_id, round(CASE WHEN p_min_x < q_max_x AND q_min_x < p_max_x AND p_min_y < q_max_y AND q_min_y < p_max_y
        THEN (least(p_max_x, q_max_x) - greatest(p_min_x, q_min_x) + 1) * (least(p_max_y, q_max_y) - greatest(p_min_y, q_min_y) + 1) / ((ps + qs) // 2) ELSE 0 END, 6) + 0.0 AS overlap,
      round(CASE WHEN y1 = y2 THEN 0 WHEN x1 = x2 THEN 90 WHEN (x1 < x2) = (y1 < y2) THEN 90 + degrees(atan(abs(y1 - y2) / abs(x1 - x2))) ELSE degrees(atan(abs(x1 - x2) / abs(y1 - y2))) END, 6) + 0.0 AS theta,
      round(CASE WHEN p_min_x <= q_min_x AND p_min_y <= q_min_y AND q_max_x <= p_max_x AND q_max_y <= p_max_y THEN -qs WHEN q_min_x <= p_min_x AND q_min_y <= p_min_y AND p_max_x <= q_max_x AND p_max_y <= q_max_y THEN -ps
        WHEN mine IS NOT NULL AND theirs IS NOT NULL THEN CASE WHEN reach < apart THEN between_ ELSE -between_ END WHEN mine IS NOT NULL THEN sqrt((mine.x - x2) ** 2 + (mine.y - y2) ** 2)
        WHEN theirs IS NOT NULL THEN sqrt((theirs.x - x1) ** 2 + (theirs.y - y1) ** 2) ELSE apart END, 6) + 0.0 AS edge_distance, CAST(n_met AS INT) AS n_met FROM bf""",
    "pixel_overlap": f"""WITH {ST}, o AS (SELECT lp.*, size FROM lp JOIN st USING (frame_idx, blob_id) WHERE NOT (lp.x = min_x AND lp.y = min_y))
      SELECT p.frame_idx, p.blob_id AS a, q.blob_id AS b, round(count(*) / ((any_value(p.size) + any_value(q.size)) / 2), 9) AS f_pixel_overlap FROM o p JOIN o q ON q.frame_idx = p.frame_idx + 1 AND q.x = p.x AND q.y = p.y GROUP BY ALL""",
    "theta_match": f"""WITH {THETA}, m AS (SELECT h.frame_idx, max(least(h.share, coalesce(n.share, 0))) AS score FROM h LEFT JOIN h n ON n.frame_idx = h.frame_idx + 1 AND n.band = h.band GROUP BY ALL),
      a AS (SELECT frame_idx, band FROM h QUALIFY row_number() OVER (PARTITION BY frame_idx ORDER BY share DESC, band) = 1)
      SELECT m.frame_idx, CASE WHEN m.frame_idx + 1 IN (SELECT frame_idx FROM h) THEN score END AS score, CAST(band * 10 AS INT) AS max_theta FROM m JOIN a USING (frame_idx)""",
    "mean_pixels": f"WITH {PX} SELECT x, y, CAST(sum(intensity) // count(*) AS INT) AS r, CAST(sum(intensity // 2) // count(*) AS INT) AS g, CAST(sum(intensity // 4) // count(*) AS INT) AS b FROM px GROUP BY ALL",
    "channel_difference": f"""WITH {PX}, d AS (SELECT p.frame_idx, p.x, p.y, p.intensity - q.intensity AS r, p.intensity // 2 - q.intensity // 2 AS g, p.intensity // 4 - q.intensity // 4 AS b FROM px p JOIN px q ON q.frame_idx = p.frame_idx + 1 AND q.x = p.x AND q.y = p.y)
      SELECT frame_idx, x, y, CAST(greatest(trunc(r + g + b / 3), r, g, b) AS INT) AS difference FROM d""",
    "packed_pixels": f"""WITH {PX}, c AS (SELECT frame_idx, x, y, intensity AS r, intensity // 2 AS g, intensity // 4 AS b, CASE WHEN (x + y) % 7 = 0 THEN 65534 ELSE 65535 END AS a FROM px)
      SELECT *, r + g * 65536 + b * 4294967296 + CAST(a - 65536 AS BIGINT) * 281474976710656 AS packed FROM c""",
    "blend_channels": f"""WITH {PX}, {ALPHA}, c AS (SELECT frame_idx, x, y, intensity AS r, intensity // 2 AS g, intensity // 4 AS b, CASE WHEN (x + y) % 7 = 0 THEN 65534 ELSE 65535 END AS a FROM px)
      SELECT p.frame_idx, p.x, p.y, {", ".join(f"CAST(CASE WHEN alpha IS NULL OR q.a IS NULL OR q.a <> 65535 THEN p.{c} WHEN alpha >= 1 THEN q.{c} ELSE trunc(p.{c} * (1 - alpha)) + trunc(q.{c} * alpha) END AS INT) AS {c}" for c in "rgb")}, p.a
      FROM c p LEFT JOIN c q ON q.frame_idx = p.frame_idx + 1 AND q.x = p.x AND q.y = p.y LEFT JOIN al ON al.frame_idx = p.frame_idx AND al.x = p.x AND al.y = p.y""",
    "paint_mask": f"WITH {PX}, {ALPHA} SELECT frame_idx, x, y, CAST(least(trunc(alpha * 255), 255) AS INT) AS mask FROM al",
    "within_disc": f"""WITH {PX} SELECT frame_idx, CAST(x + a.i - 3 AS INT) AS x, CAST(y + b.i - 3 AS INT) AS y, round(min(sqrt((a.i - 3) ** 2 + (b.i - 3) ** 2)), 9) AS distance FROM px, range(7) a(i), range(7) b(i)
      WHERE intensity > 49000 AND (a.i - 3) ** 2 + (b.i - 3) ** 2 <= 9 AND x + a.i - 3 >= 0 AND y + b.i - 3 >= 0 GROUP BY ALL""",
    "apply_unselected": f"WITH {D}, s AS (SELECT *, (group_id % 21 - 10) / 10.0 AS score FROM d) SELECT frame_idx, group_id, coalesce(reason_kind, 'fromClassifier') AS reason_kind, round(CASE WHEN reason_kind IS NULL THEN CAST(score AS DOUBLE) ELSE reason_value END, 6) AS reason_value, coalesce(will_paint, score > 0) AS will_paint FROM s",
    "select_undecided": f"WITH {D} SELECT frame_idx, group_id, 'userSelected' AS reason_kind, CASE WHEN will_paint IS NULL THEN 1.0 ELSE reason_value END AS reason_value, coalesce(will_paint, true) AS will_paint FROM d",
    "scope_actions": f"""WITH {D}, e AS (SELECT d.*, event_id % 96 BETWEEN 10 AND 60 AND user_id % 128 BETWEEN 10 AND 60 AS hit, user_id % 128 = 127 AS edge FROM d JOIN events ON event_id = group_id),
      f AS (SELECT *, CASE WHEN frame_idx >= 300 AND hit THEN true WHEN frame_idx <= 20 THEN false WHEN frame_idx BETWEEN 190 AND 200 AND will_paint IS NULL THEN true END AS chosen FROM e WHERE NOT (frame_idx BETWEEN 100 AND 110 AND hit) AND NOT edge)
      SELECT frame_idx, group_id, CASE WHEN chosen IS NULL THEN reason_kind ELSE 'userSelected' END AS reason_kind, CASE WHEN chosen IS NULL THEN reason_value ELSE CAST(chosen AS DOUBLE) END AS reason_value, coalesce(chosen, will_paint) AS will_paint FROM f""",
    "select_overlapping": f"""WITH {ST}, c AS (SELECT DISTINCT x, y FROM lp WHERE frame_idx = 10 AND blob_id = (SELECT min(blob_id) FROM lp WHERE frame_idx = 10)), o AS (SELECT DISTINCT frame_idx, blob_id FROM lp JOIN c USING (x, y))
      SELECT st.frame_idx, st.blob_id, CASE WHEN o.blob_id IS NOT NULL THEN 'userSelected' END AS reason_kind, CASE WHEN o.blob_id IS NOT NULL THEN true END AS will_paint FROM st LEFT JOIN o ON o.frame_idx = st.frame_idx AND o.blob_id = st.blob_id WHERE st.frame_idx BETWEEN 5 AND 15""",
    "previous_undecided_frame": f"WITH {DC} SELECT frame_idx, coalesce((SELECT max(n.frame_idx) FROM dc n WHERE n.frame_idx < dc.frame_idx AND n.n_undecided > n.n_positive + n.n_negative), (SELECT min(frame_idx) FROM dc)) AS advance_to FROM dc",
    "next_frame_of_any": f"WITH {DC} SELECT frame_idx, coalesce((SELECT min(n.frame_idx) FROM dc n WHERE n.frame_idx > dc.frame_idx), (SELECT max(frame_idx) FROM dc)) AS advance_to FROM dc",
    "group_table": f"WITH {ST}, w AS (SELECT frame_idx, blob_id, round((max_x - min_x + 1) / 128, 9) AS w, CAST(mean_intensity AS DOUBLE) AS m FROM st) SELECT frame_idx, blob_id, {', '.join(f'round(round({c} / 10.0 ** (floor(log10({c})) - 4)) * 10.0 ** (floor(log10({c})) - 4), 9) AS {n}' for c, n in (('w', 'f_width'), ('m', 'f_average_brightness')))} FROM w",
    "linear_leaves": f"WITH {TR} SELECT id, round((f0 - (SELECT min(f0) FROM t)) / ((SELECT max(f0) FROM t) - (SELECT min(f0) FROM t)) * 2 - 1, 9) AS score FROM t",
}

#: All features side by side, from the statements above, in the order of feature files.
_PARTS = ("feature_shape", "surface_ratio", "diag_border", "nearby_count", "direct_overlap", "bbox_overlap_score", "line_fit", "line_fill")
_FEATURES = {
    "size": "f_size", "width": "f_width", "height": "f_height", "centerX": "f_center_x", "centerY": "f_center_y", "minX": "f_min_x", "minY": "f_min_y", "maxX": "f_max_x", "maxY": "f_max_y", "hypotenuse": "f_hypotenuse",
    "aspectRatio": "f_aspect_ratio", "fillAmount": "f_fill_amount", "surfaceAreaRatio": "f_surface_ratio", "averagebrightness": "f_average_brightness", "medianBrightness": "f_median_brightness", "maxBrightness": "f_max_brightness",
    "numberOfNearbyOutliersInSameFrame": "f_nearby", "maxHoughTransformCount": "f_max_hough", "pixelBorderAmount": "f_pixel_border", "averageLineVariance": "f_average_line", "medianLineVariance": "f_median_line",
    "lineLength": "f_line_length", "nearbyDirectOverlapScore": "f_direct_overlap", "boundingBoxOverlapScore": "f_bounds_overlap", "lineFillAmount": "f_line_fill",
}
ORACLES["feature_vector"] = f"SELECT frame_idx, blob_id, {', '.join(f'CAST({c} AS DOUBLE) AS {n}' for n, c in _FEATURES.items())} FROM ({ORACLES[_PARTS[0]]})" + "".join(f" JOIN ({ORACLES[p]}) USING (frame_idx, blob_id)" for p in _PARTS[1:])

_DRAWN = """sl AS (SELECT frame_idx, ord, abs(frame_idx) * 7 * ord % 90 AS min_x, abs(frame_idx) * 5 * ord % 60 AS min_y, abs(frame_idx) * 7 * ord % 90 + 20 + ord AS max_x, abs(frame_idx) * 5 * ord % 60 + 15 AS max_y
  FROM (SELECT DISTINCT frame_idx FROM lp), range(1, 5) r(ord)), sc AS (SELECT lp.frame_idx, x, y, ord FROM lp JOIN sl ON sl.frame_idx = lp.frame_idx AND x BETWEEN min_x AND max_x AND y BETWEEN min_y AND max_y)"""
_MID = "min_{0} + (max_{0} - min_{0} + 1) / 2"
ORACLES |= {
    "razor_in_order": f"""WITH {LP}, {_DRAWN}, n AS (SELECT frame_idx, ord, row_number() OVER (PARTITION BY frame_idx ORDER BY ord) AS n FROM (SELECT DISTINCT frame_idx, ord FROM sc)), m AS (SELECT frame_idx, max(blob_id) AS last_id FROM lp GROUP BY ALL),
      w AS (SELECT frame_idx, x, y, max(ord) AS ord FROM sc GROUP BY ALL) SELECT lp.frame_idx, CAST(coalesce(last_id + n, blob_id) AS INT) AS blob_id, lp.x, lp.y, intensity
      FROM lp JOIN m ON m.frame_idx = lp.frame_idx LEFT JOIN w ON w.frame_idx = lp.frame_idx AND w.x = lp.x AND w.y = lp.y LEFT JOIN n ON n.frame_idx = w.frame_idx AND n.ord = w.ord""",
    "recorded_slices": f"""WITH {LP}, {_DRAWN}, made AS (SELECT * FROM sl SEMI JOIN sc USING (frame_idx, ord)) SELECT frame_idx, CAST(ord AS INT) AS ord, CAST(min_x AS INT) AS min_x, CAST(min_y AS INT) AS min_y, CAST(max_x AS INT) AS max_x, CAST(max_y AS INT) AS max_y
      FROM made p WHERE NOT EXISTS (SELECT 1 FROM made q WHERE q.frame_idx = p.frame_idx AND q.ord > p.ord AND q.min_x < p.max_x AND p.min_x < q.max_x AND q.min_y < p.max_y AND p.min_y < q.max_y)""",
    "decide_by_image": f"""WITH {LP}, g AS (SELECT frame_idx, blob_id, bool_or(intensity > 49000) AS hit, CASE WHEN blob_id % 5 > 0 THEN CAST((blob_id % 21 - 10) / 10 AS DOUBLE) END AS score, frame_idx % 3 = 0 AS image FROM lp GROUP BY ALL)
      SELECT frame_idx, blob_id, CASE WHEN image THEN 'userSelected' WHEN score IS NOT NULL THEN 'fromClassifier' END AS reason_kind, CASE WHEN image THEN CAST(hit AS DOUBLE) ELSE score END AS reason_value, CASE WHEN image THEN hit ELSE score > 0 END AS will_paint FROM g""",
    "nearest_group": f"""WITH {ST}, p AS (SELECT frame_idx, blob_id, CAST(floor({_MID.format('x')}) AS INT) AS x, CAST(floor({_MID.format('y')}) AS INT) AS y FROM st)
      SELECT p.frame_idx, p.blob_id, q.blob_id AS other_id, CAST((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) AS BIGINT) AS distance_sq FROM p LEFT JOIN lp q ON q.frame_idx = p.frame_idx AND q.blob_id <> p.blob_id
      QUALIFY row_number() OVER (PARTITION BY p.frame_idx, p.blob_id ORDER BY distance_sq, other_id) = 1""",
    "nearest_pixels": f"""WITH {BL}, c AS (SELECT frame_idx, blob_id, abs(sine) > abs(cosine) AS level, rho, cosine, sine, {_MID.format('x')} AS mx, {_MID.format('y')} AS my FROM st LEFT JOIN bl USING (frame_idx, blob_id))
      SELECT frame_idx, blob_id, round(min(abs(x * cosine + y * sine - rho * CAST(1000000 AS BIGINT))) / 1000000, 6) + 0.0 AS to_line, round(sqrt(min((x - 64) * (x - 64) + (y - 48) * (y - 48))), 6) + 0.0 AS to_point,
      round(CASE WHEN level THEN mx ELSE {_X.format('my')} END, 6) + 0.0 AS centre_x, round(CASE WHEN level THEN {_Y.format('mx')} WHEN NOT level THEN my END, 6) + 0.0 AS centre_y FROM lp JOIN c USING (frame_idx, blob_id) GROUP BY ALL""",
    "shifted_lines": f"WITH {BL} SELECT frame_idx, blob_id, cosine AS a, sine AS b, -rho * CAST(1000000 AS BIGINT) - cosine * min_x - sine * min_y AS c FROM st JOIN bl USING (frame_idx, blob_id)",
    "walk_until": f"""WITH {BL}, ws AS (SELECT frame_idx, blob_id, rho, cosine, sine, abs(sine) > abs(cosine) AS level, CAST(trunc(CASE WHEN abs(sine) > abs(cosine) THEN {_MID.format('x')} ELSE {_MID.format('y')} END) AS INT) AS start FROM st JOIN bl USING (frame_idx, blob_id)),
      wt AS (SELECT *, unnest(range(0, CASE WHEN level THEN 128 ELSE 96 END)) AS t FROM ws), wu AS (SELECT *, CAST(trunc(CASE WHEN level THEN {_Y.format('t')} ELSE {_X.format('t')} END) AS BIGINT) AS u FROM wt),
      wh AS (SELECT wu.frame_idx, wu.blob_id, start, t FROM wu JOIN lp q ON q.frame_idx = wu.frame_idx AND q.x = CASE WHEN level THEN t ELSE u END AND q.y = CASE WHEN level THEN u ELSE t END WHERE u >= 0),
      ww AS (SELECT *, unnest(CASE WHEN t = start THEN [1, -1] WHEN t > start THEN [1] ELSE [-1] END) AS way, abs(t - start) AS step FROM wh),
      wm AS (SELECT *, step - coalesce(lag(step) OVER (PARTITION BY frame_idx, blob_id, way ORDER BY step), -1) > 3 AS missed FROM ww), wk AS (SELECT * FROM wm QUALIFY count(*) FILTER (missed) OVER (PARTITION BY frame_idx, blob_id, way ORDER BY step) = 0)
      SELECT frame_idx, blob_id, CAST(min(t) AS INT) AS first, CAST(max(t) AS INT) AS last, count(DISTINCT t) AS hits FROM wk GROUP BY ALL""",
}
