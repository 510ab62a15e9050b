"""Queries of the general data problems (places, nesting, orphans) and the SQL they can be held against."""

from __future__ import annotations

from ..operators import nesting, orphans, places

QUERIES = {
    "p1_found": places.p1_found,
    "p2_found": nesting.p2_found,
    "p2_elements": nesting.p2_elements,
    "p2_measurements": nesting.p2_measurements,
    "p2_damages": nesting.p2_damages,
    "p2_levels": nesting.p2_levels,
    "p5_found": orphans.p5_found,
    "p5_report": orphans.p5_report,
}

_REFS = """
refs AS (
  SELECT 'ecotones' AS ref_table, 'id_a' AS ref_column, ecotone_no AS ref_no, id_a AS id, computed_at AS t FROM ecotones
  UNION ALL SELECT 'ecotones', 'id_b', ecotone_no, id_b, computed_at FROM ecotones
  UNION ALL SELECT 'weather_eraldis', 'id', weather_no, id, as_of FROM weather_eraldis),
known AS (SELECT id, min(arrived_at) AS earliest FROM eraldis WHERE id IS NOT NULL GROUP BY id),
unmet AS (
  SELECT r.ref_table, r.ref_column, r.ref_no, r.id, strftime(r.t, '%Y-%m') AS ref_month,
    CASE WHEN k.id IS NULL THEN 'missing' WHEN k.earliest > r.t THEN 'late' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN known k ON k.id = r.id
  WHERE r.id IS NOT NULL AND NOT EXISTS (
    SELECT 1 FROM eraldis p WHERE p.id = r.id AND p.arrived_at <= r.t AND (p.removed_at IS NULL OR p.removed_at > r.t)))
"""

_SPECIES = "nullif(regexp_replace(lower(regexp_replace(species, '^\\s+|\\s+$', '', 'g')), '[-\\s]', '_', 'g'), '')"
_RING = r"\(?\s*\([^()]+\)"


def _corners(table: str, key: str) -> str:
    """Corners of all rings or lines of a table's WKT: key, ring, outer, n, x, y."""
    return f"""SELECT {key}, ring, outer_, n, CAST(regexp_extract(p, '(\\S+)', 1) AS DOUBLE) AS x, CAST(regexp_extract(trim(p), '^\\S+\\s+(\\S+)', 1) AS DOUBLE) AS y FROM (
      SELECT {key}, ring, regexp_matches(text, '^\\(\\s*\\(') AS outer_, unnest(ps) AS p, generate_subscripts(ps, 1) AS n FROM (
        SELECT {key}, ring, text, string_split(regexp_replace(text, '[()]', '', 'g'), ',') AS ps FROM (
          SELECT {key}, unnest(rs) AS text, generate_subscripts(rs, 1) AS ring FROM (
            SELECT {key}, regexp_extract_all(regexp_replace(upper(trim(geometry)), '^SRID=[0-9]+;', ''), '{_RING}') AS rs FROM {table} WHERE geometry IS NOT NULL))))"""


# Centroids by the shoelace formula relative to the first corner; holes count against their shell, shapes without area by their corners' mean.
_PLACES = f"""
corners AS ({_corners('scout_candidates', 'candidate_id')}),
turned AS (SELECT c.*, first_value(x) OVER f AS ox, first_value(y) OVER f AS oy, lead(x) OVER r AS xn, lead(y) OVER r AS yn FROM corners c
  WINDOW f AS (PARTITION BY candidate_id ORDER BY ring, n), r AS (PARTITION BY candidate_id, ring ORDER BY n)),
crossed AS (SELECT *, (x - ox) * (yn - oy) - (xn - ox) * (y - oy) AS k FROM turned),
ringed AS (SELECT candidate_id, ring, any_value(outer_) AS outer_, any_value(ox) AS ox, any_value(oy) AS oy, sum(k) AS w, sum((x + xn - 2 * ox) * k) AS sx, sum((y + yn - 2 * oy) * k) AS sy,
  count(*) AS n, sum(x - ox) AS mx, sum(y - oy) AS my FROM crossed GROUP BY candidate_id, ring),
summed AS (SELECT candidate_id, any_value(ox) AS ox, any_value(oy) AS oy, sum(g * w) AS w, sum(g * sx) AS sx, sum(g * sy) AS sy, sum(n) AS n, sum(mx) AS mx, sum(my) AS my
  FROM (SELECT *, CASE WHEN (w >= 0) = outer_ THEN 1 ELSE -1 END AS g FROM ringed) GROUP BY candidate_id),
centred AS (SELECT s.candidate_id, CASE WHEN contains(upper(c.geometry), 'POLYGON') AND abs(w) > 1e-9 THEN ox + sx / (3 * w) ELSE ox + mx / n END AS a,
  CASE WHEN contains(upper(c.geometry), 'POLYGON') AND abs(w) > 1e-9 THEN oy + sy / (3 * w) ELSE oy + my / n END AS b FROM summed s JOIN scout_candidates c USING (candidate_id)),
places AS (SELECT c.candidate_id AS pid, run_id, {_SPECIES} AS sp, macrocluster_id, suppressed_by_id, suppression_distance_m AS recorded, id_a, id_b, least(a, b) AS x, greatest(a, b) AS y
  FROM centred JOIN scout_candidates c USING (candidate_id)),
near AS (SELECT p.pid AS a, q.pid AS b FROM places p JOIN places q ON p.run_id = q.run_id AND p.sp = q.sp AND p.pid < q.pid AND abs(p.x - q.x) < 400 AND abs(p.y - q.y) < 400
  WHERE (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < 160000),
named AS (SELECT p.pid, any_value(p.recorded) AS recorded, min(q.pid) AS by_pid, arg_min(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2), q.pid) AS d FROM places p
  JOIN places q ON p.run_id = q.run_id AND p.sp = q.sp AND p.suppressed_by_id = q.id_a || '_' || q.id_b AND p.pid <> q.pid
  WHERE (p.x - q.x) ** 2 + (p.y - q.y) ** 2 < 160000 GROUP BY p.pid),
shells AS ({_corners('macroclusters', 'macrocluster_id')}),
edges AS (SELECT * FROM (SELECT macrocluster_id AS holder, x, y, lead(x) OVER r AS xn, lead(y) OVER r AS yn FROM shells WINDOW r AS (PARTITION BY macrocluster_id, ring ORDER BY n)) WHERE xn IS NOT NULL),
held AS (SELECT pid, min(holder) AS holder FROM (SELECT p.pid, e.holder FROM places p JOIN edges e ON (e.y <= p.y) <> (e.yn <= p.y)
    AND e.x + (p.y - e.y) * (e.xn - e.x) / (e.yn - e.y) > p.x GROUP BY p.pid, e.holder HAVING count(*) % 2 = 1) GROUP BY pid),
lines AS ({_corners('roads', 'road_id')}),
segs AS (SELECT * FROM (SELECT l.road_id, x, y, lead(x) OVER r - x AS dx, lead(y) OVER r - y AS dy FROM lines l JOIN roads k ON k.road_id = l.road_id AND k.car_class IN ('HIGH_CONFIDENCE', 'NORMAL', 'CONDITIONAL')
  WINDOW r AS (PARTITION BY l.road_id, ring ORDER BY n)) WHERE dx IS NOT NULL),
gaps AS (SELECT s.fid, s.nearest_car_road_m AS recorded, g.road_id, s.x - g.x AS px, s.y - g.y AS py, g.dx, g.dy FROM eraldis s CROSS JOIN segs g WHERE s.x IS NOT NULL AND s.y IS NOT NULL),
near_road AS (SELECT fid, any_value(recorded) AS recorded, min(d) AS d, arg_min(road_id, (round(d, 3), road_id)) AS road_id FROM (
  SELECT *, sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) AS d FROM (SELECT *, greatest(0, least(1, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM gaps)) GROUP BY fid)
"""

_WRONG = "recorded IS NULL OR isnan(recorded) OR abs(recorded - d) > 1"

# Every JSON value with its place: elements are members of lists named elemendid that are in no other, else the outermost objects.
_NESTED = """
texts AS (SELECT fid, CASE WHEN json_valid(t) THEN CASE WHEN json_type(t) = 'VARCHAR' THEN json_extract_string(t, '$') ELSE t END END AS t FROM (
  SELECT fid, CASE WHEN json_valid(composition) THEN CASE WHEN json_type(composition) = 'VARCHAR' THEN json_extract_string(composition, '$') ELSE composition END END AS t FROM eraldis)),
tree AS (SELECT x.fid, j.id, j.parent, j.key, j.type, j.value, j.fullkey FROM (SELECT fid, t FROM texts WHERE json_valid(t)) x, json_tree(x.t) j),
listed AS (SELECT DISTINCT fid FROM tree WHERE key = 'elemendid'),
elements AS (SELECT fid, id, value, around, row_number() OVER (PARTITION BY fid ORDER BY id) AS element_no FROM (
  SELECT t.fid, t.id, t.value, a.value AS around FROM tree t JOIN tree l ON l.fid = t.fid AND l.key = 'elemendid' AND ((l.type = 'ARRAY' AND t.parent = l.id) OR (l.type = 'OBJECT' AND t.id = l.id))
    LEFT JOIN tree a ON a.fid = l.fid AND a.id = l.parent WHERE t.type = 'OBJECT' AND len(string_split(l.fullkey, 'elemendid')) = 2
  UNION ALL SELECT t.fid, t.id, t.value, NULL FROM tree t LEFT JOIN tree p ON p.fid = t.fid AND p.id = t.parent
    WHERE t.type = 'OBJECT' AND (t.parent IS NULL OR (p.parent IS NULL AND p.type = 'ARRAY')) AND t.fid NOT IN (SELECT fid FROM listed))),
measures AS (SELECT fid, id, element_no, value, row_number() OVER (PARTITION BY fid, element_no ORDER BY id) AS measure_no FROM (
  SELECT t.fid, t.id, t.value, e.element_no FROM elements e JOIN tree l ON l.fid = e.fid AND l.parent = e.id AND l.key = 'mootmised'
    JOIN tree t ON t.fid = l.fid AND ((l.type = 'ARRAY' AND t.parent = l.id) OR (l.type = 'OBJECT' AND t.id = l.id)) WHERE t.type = 'OBJECT')),
damages AS (SELECT fid, element_no, measure_no, value, row_number() OVER (PARTITION BY fid, element_no, measure_no ORDER BY id) AS damage_no FROM (
  SELECT t.fid, t.id, t.value, e.element_no, e.measure_no FROM measures e JOIN tree l ON l.fid = e.fid AND l.parent = e.id AND l.key = 'kahjustused'
    JOIN tree t ON t.fid = l.fid AND ((l.type = 'ARRAY' AND t.parent = l.id) OR (l.type = 'OBJECT' AND t.id = l.id)) WHERE t.type = 'OBJECT'))
"""


def _leaf(name: str, kind: str, around: str = "") -> str:
    """A member's value as flat tables give it: numbers also from text, with comma or point; else null."""
    own, outer = (f"nullif(json_extract({of}, '$.{name}'), 'null')" for of in ("value", around or "value"))
    v = f"coalesce({own}, {outer})"
    text, type_ = f"json_extract_string({v}, '$')", f"json_type({v})"
    if kind == "double":
        return f"CASE WHEN {type_} NOT IN ('BOOLEAN', 'OBJECT', 'ARRAY') THEN TRY_CAST(replace(trim({text}), ',', '.') AS DOUBLE) END AS \"{name}\""
    if kind == "boolean":
        return f"CASE lower(trim({text})) WHEN 'true' THEN true WHEN 'false' THEN false END AS \"{name}\""
    return f"CASE WHEN {type_} NOT IN ('OBJECT', 'ARRAY') THEN {text} END AS \"{name}\""


def _leaves(level: nesting.Repeated, around: str = "") -> str:
    return ", ".join(_leaf(n, k, around) for n, k in level.leaves)


ORACLE = {
    "p1_found": f"""WITH {_PLACES}
        SELECT 'near' AS relation, CAST(a AS BIGINT) AS key_a, CAST(b AS BIGINT) AS key_b FROM near
        UNION ALL SELECT 'suppressed', pid, by_pid FROM named WHERE {_WRONG}
        UNION ALL SELECT 'region', p.pid, h.holder FROM held h JOIN places p ON p.pid = h.pid WHERE p.macrocluster_id IS DISTINCT FROM h.holder
        UNION ALL SELECT 'road', fid, road_id FROM near_road WHERE {_WRONG}""",
    "p2_found": f"""WITH {_NESTED} SELECT fid, CAST(element_no AS INTEGER) AS element_no, 0 AS measure_no, 0 AS damage_no FROM elements
        UNION ALL SELECT fid, CAST(element_no AS INTEGER), CAST(measure_no AS INTEGER), 0 FROM measures
        UNION ALL SELECT fid, CAST(element_no AS INTEGER), CAST(measure_no AS INTEGER), CAST(damage_no AS INTEGER) FROM damages""",
    "p2_elements": f"WITH {_NESTED} SELECT fid, CAST(element_no AS INTEGER) AS element_no, {_leaves(nesting.ELEMENT, 'around')} FROM elements",
    "p2_measurements": f"WITH {_NESTED} SELECT fid, CAST(element_no AS INTEGER) AS element_no, CAST(measure_no AS INTEGER) AS measurement_no, {_leaves(nesting.MEASUREMENT)} FROM measures",
    "p2_damages": f"""WITH {_NESTED} SELECT fid, CAST(element_no AS INTEGER) AS element_no, CAST(measure_no AS INTEGER) AS measurement_no, CAST(damage_no AS INTEGER) AS damage_no, {_leaves(nesting.DAMAGE)}
        FROM damages""",
    "p5_found": f"WITH {_REFS} SELECT ref_table, ref_column, ref_no, ref_month, reason FROM unmet",
    "p5_report": f"""WITH {_REFS} SELECT ref_table, ref_column, ref_month, reason, count(*) AS refs, count(DISTINCT id) AS ids
        FROM unmet GROUP BY ALL""",
}
