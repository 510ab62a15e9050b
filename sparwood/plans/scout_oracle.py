"""SQL for the queries of ``scout``, written independently of the operators, over the same views."""

from __future__ import annotations

from ..functions import priors as P
from ..functions.crs import ESTONIA
from ..functions.scoring import season_prior
from .views import FLAGSHIP_SLOTS, NOW, SEASON_DAY, SLOTS, VIEWS, case, cte

_N = f"TIMESTAMP '{NOW}'"
_CAR = ", ".join(f"'{c}'" for c in P.CAR_CLASSES)
_C = P.CATEGORIES


def _host(s: str) -> str:
    one = [f"{a} * least(1.0, {t} / {sat})" for t, (a, sat) in P.HOSTS[s].items()]
    return f"CASE WHEN pine IS NOT NULL THEN greatest({', '.join(one)}, 0.0) END"


def _site(s: str, of: str = "site") -> str:
    i = P.SPECIES.index(s)
    return case(of, {c: v[i] for codes, v in P.SITES.values() for c in codes})


def _each(f, sep: str = ", ") -> str:
    return sep.join(f(s) for s in P.SPECIES)


_GROUP = {c: g for g, (codes, _) in P.SITES.items() for c in codes}
_MOIST = {c: m for codes, _ in P.SITES.values() for c, m in codes.items()}
_FR = {
    "fractions": f"""SELECT s.*, {', '.join(f"CASE WHEN t > 0 THEN {c}_s / t WHEN t IS NOT NULL THEN 0.0 END AS {c}" for c in _C)}
      FROM stand s LEFT JOIN (SELECT id, {', '.join(f"coalesce(sum(osakaal) FILTER (puuliik_kood = '{k}'), 0) AS {c}_s" for c, k in P.TREES.items())},
        coalesce(sum(osakaal) FILTER (puuliik_kood NOT IN ({', '.join(f"'{k}'" for k in P.TREES.values())})), 0) AS other_s, sum(osakaal) AS t
        FROM element GROUP BY id) e ON e.id = s.id""",
    "habitat": f"SELECT *, {_each(lambda s: f'CASE WHEN pine + spruce + birch + aspen + other > 0 THEN ({_host(s)}) END * (0.5 + 0.5 * ({_site(s)})) AS habitat_{s}')} FROM fractions",
    "contrasts": f"""SELECT e.*, {' + '.join(f'abs(a.{c} - b.{c})' for c in _C)} AS cc2, a.site <> b.site AS site_type_changed,
      ({case('a.site', _GROUP)}) <> ({case('b.site', _GROUP)}) AS group_changed,
      abs(({case('a.site', _MOIST)}) - ({case('b.site', _MOIST)})) / 4.0 AS moisture_contrast,
      abs(({case('a.age', P.AGE_RANKS)}) - ({case('b.age', P.AGE_RANKS)})) / 6.0 AS age_contrast, a.drained <> b.drained AS drainage_changed,
      {_each(lambda s: f'a.habitat_{s} AS ha_{s}, b.habitat_{s} AS hb_{s}')}
      FROM edge e LEFT JOIN habitat a ON a.id = e.id_a LEFT JOIN habitat b ON b.id = e.id_b""",
    "evidence": """SELECT *, cc2 / 2 AS composition_contrast, coalesce(moisture_contrast, CAST(group_changed AS DOUBLE)) AS sd,
      CAST(drainage_changed AS DOUBLE) AS dc, least(1.0, length / 200.0) AS lt FROM contrasts""",
    "signals": """SELECT *, coalesce(composition_contrast * 0.35, 0) + coalesce(sd * 0.25, 0) + coalesce(age_contrast * 0.2, 0) + coalesce(dc * 0.1, 0) + coalesce(lt * 0.1, 0) AS signal,
      (composition_contrast IS NOT NULL)::INT * 0.35 + (sd IS NOT NULL)::INT * 0.25 + (age_contrast IS NOT NULL)::INT * 0.2 + (dc IS NOT NULL)::INT * 0.1
        + (lt IS NOT NULL)::INT * 0.1 AS coverage FROM evidence""",
    "scored": f"""SELECT *, 0.3 * signal AS bonus, {_each(lambda s: f'''CASE WHEN ha_{s} IS NOT NULL AND hb_{s} IS NOT NULL THEN
      (0.7 * greatest(ha_{s}, hb_{s}) + 0.3 * least(ha_{s}, hb_{s})) * (1 + 0.3 * signal) END AS ecotone_{s}''')} FROM signals""",
    "car": f"""SELECT id, rid, d FROM (SELECT s.id, r.rid, sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2) AS d,
      row_number() OVER (PARTITION BY s.id ORDER BY round(sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2), 3), r.rid) AS n
      FROM stand s, road r WHERE r.car_class IN ({_CAR})) WHERE n = 1""",
    "access": """SELECT s.id, c.d AS nearest_car_road_m, coalesce(greatest(0.0, 1 - c.d / 1500), 0.0) AS access_score, r.car_class AS access_confidence,
      CASE WHEN c.d IS NULL THEN 'no car-accessible road within 1500m' ELSE CAST(CAST(round_even(c.d, 0) AS BIGINT) AS VARCHAR) || 'm from ' || r.car_class || '-class road' END AS access_reason
      FROM stand s LEFT JOIN car c ON c.id = s.id LEFT JOIN road r ON r.rid = c.rid""",
    "reach": """SELECT e.*, greatest(coalesce(a.access_score, 0), coalesce(b.access_score, 0)) AS access_modifier,
      CASE WHEN coalesce(a.access_score, 0) >= coalesce(b.access_score, 0) THEN a.access_confidence ELSE b.access_confidence END AS access_confidence,
      CASE WHEN coalesce(a.access_score, 0) >= coalesce(b.access_score, 0) THEN a.nearest_car_road_m ELSE b.nearest_car_road_m END AS nearest_car_road_m
      FROM edge e LEFT JOIN access a ON a.id = e.id_a LEFT JOIN access b ON b.id = e.id_b""",
    "win": f"SELECT px, ts, rate, coalesce(rate, 0) * 0.25 AS mm FROM slot WHERE ts >= {_N} - INTERVAL 14 DAY AND ts < {_N}",
    "wets": """SELECT *, sum(new) OVER (PARTITION BY px ORDER BY ts) AS event_no FROM (SELECT px, ts, rate,
      CASE WHEN lag(ts) OVER (PARTITION BY px ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY px ORDER BY ts) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new
      FROM win WHERE rate > 0)""",
    "rained": "SELECT px, CAST(event_no AS INTEGER) AS event_no, min(ts) AS began, max(ts) AS ended, count(*) AS slots, sum(rate) * 0.25 AS event_mm FROM wets GROUP BY px, event_no",
    "lasts": f"""SELECT px, (epoch_us({_N}) - epoch_us(max(ended) FILTER (event_mm >= 5))) / 3.6e9 AS hours_since_significant_rain,
      coalesce(arg_max(event_mm, ended) FILTER (event_mm >= 5), 0.0) AS last_significant_mm,
      (epoch_us({_N}) - epoch_us(max(ended) FILTER (event_mm >= 10))) / 3.6e9 AS hours_since_strong_rain,
      coalesce(arg_max(event_mm, ended) FILTER (event_mm >= 10), 0.0) AS last_strong_mm FROM rained GROUP BY px""",
    "met72": f"SELECT count(DISTINCT hour) / 72.0 AS met_coverage, (epoch_us({_N}) - epoch_us(max(hour))) / 3.6e9 AS met_age_hours FROM met WHERE hour >= {_N} - INTERVAL 72 HOUR",
    "airs": """SELECT cell, avg(temp) AS temp_mean, avg(temp) FILTER (h >= 21 OR h < 6) AS temp_night, avg(rh) AS rh_mean, avg(rh) FILTER (h >= 21 OR h < 6) AS rh_night
      FROM (SELECT *, extract(hour FROM hour + INTERVAL 2 HOUR) AS h FROM met) GROUP BY cell""",
}


def _sums(name: str, slots: dict[int, int]) -> dict[str, str]:
    cols = ", ".join(
        f"coalesce(sum(mm) FILTER (ts >= {_N} - INTERVAL {d} DAY), 0) AS rain_{d}d_mm, least(1.0, count(rate) FILTER (ts >= {_N} - INTERVAL {d} DAY) / {n}.0) AS coverage_{d}d"
        for d, n in slots.items()
    )
    return {
        f"sums{name}": f"""SELECT px, {cols}, count(*) FILTER (rate > 0 AND ts >= {_N} - INTERVAL 3 DAY) * 0.25 AS wet_hours_72h, max(ts) FILTER (rate > 0) AS last_wet,
          (epoch_us({_N}) - epoch_us(max(ts) FILTER (rate > 0))) / 3.6e9 AS hours_since_any_rain FROM win GROUP BY px""",
        f"bins{name}": f"""SELECT *, CASE WHEN coverage_3d >= 0.7 THEN rain_3d_mm END AS rain_0_3d_mm,
          greatest(0.0, CASE WHEN coverage_3d >= 0.7 AND coverage_7d >= 0.7 THEN rain_7d_mm - rain_3d_mm END) AS g1,
          CASE WHEN coverage_3d >= 0.7 AND coverage_7d >= 0.7 THEN greatest(0.0, rain_7d_mm - rain_3d_mm) END AS rain_3_7d_mm,
          CASE WHEN coverage_7d >= 0.7 AND coverage_14d >= 0.7 THEN greatest(0.0, rain_14d_mm - rain_7d_mm) END AS rain_7_14d_mm FROM sums{name}""",
    }


_WET = [*(f"rain_{d}d_mm" for d in (3, 7, 14)), *(f"coverage_{d}d" for d in (3, 7, 14)), "wet_hours_72h", "hours_since_any_rain"]
_HELD = [*_WET, "hours_since_significant_rain"]
_GATED = [("r0", "rain_3d_mm", 3), ("r7", "rain_7d_mm", 7), ("r14", "rain_14d_mm", 14), ("wet", "wet_hours_72h", 3), ("rained", "hours_since_any_rain", 14), ("hsr", "hours_since_significant_rain", 14)]
_AIR = [("tm", "temp_mean"), ("tn", "temp_night"), ("rm", "rh_mean"), ("rn", "rh_night")]
_QUALITY = """CASE WHEN q = '' THEN 'complete' ELSE q END"""
_FLAGS = """concat_ws(';', CASE WHEN coalesce(coverage_3d, 0) < 0.7 THEN 'partial_radar_gap_3d' END, CASE WHEN coalesce(coverage_7d, 0) < 0.7 THEN 'partial_radar_gap_7d' END,
  CASE WHEN coalesce(coverage_14d, 0) < 0.7 THEN 'partial_radar_gap_14d' END,
  CASE WHEN met_age_hours IS NULL OR met_age_hours > 6 THEN 'stale_meps' WHEN met_coverage < 0.7 THEN 'partial_meps_gap' END) AS q"""

_FR |= _sums("", SLOTS) | _sums("f", FLAGSHIP_SLOTS)
_FR |= {
    # Weather by place: pixels in the stand's box, else the nearest within 3000 m; air of the nearest cell.
    "pixelled": f"SELECT p.px, p.x, p.y, {', '.join(f'u.{c}' for c in _WET)}, l.hours_since_significant_rain FROM pixel p LEFT JOIN sumsf u ON u.px = p.px LEFT JOIN lasts l ON l.px = p.px",
    "held": f"""SELECT id, {', '.join(f'CASE WHEN n > 0 THEN m_{c} ELSE v.{c} END AS {c}' for c in _HELD)} FROM (
      SELECT s.id, count(*) FILTER (box) AS n, {', '.join(f'avg({c}) FILTER (box) AS m_{c}' for c in _HELD)},
        arg_min(struct_pack({', '.join(f'{c} := {c}' for c in _HELD)}), (far, px)) FILTER (far <= 3000) AS v
      FROM stand s LEFT JOIN (SELECT s.id, p.* EXCLUDE (x, y), p.x BETWEEN s.x - 700 AND s.x + 700 AND p.y BETWEEN s.y - 300 AND s.y + 300 AS box,
          sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) AS far
        FROM stand s JOIN pixelled p ON p.x BETWEEN s.x - 3000 AND s.x + 3000 AND p.y BETWEEN s.y - 3000 AND s.y + 3000) q ON q.id = s.id GROUP BY s.id)""",
    "aired": """SELECT id, cell FROM (SELECT s.id, c.cell, row_number() OVER (PARTITION BY s.id ORDER BY round(sqrt((s.x - c.x) ** 2 + (s.y - c.y) ** 2), 3), c.cell) AS n
      FROM stand s CROSS JOIN met_cell c) WHERE n = 1""",
    "weather": f"""SELECT {_QUALITY} AS quality, * FROM (SELECT h.*, a.* EXCLUDE (cell), m.*, {_FLAGS}
      FROM (SELECT * REPLACE ({', '.join(f'coalesce(round(coverage_{d}d, 12), 0.0) AS coverage_{d}d' for d in (3, 7, 14))}) FROM held) h
      JOIN aired n ON n.id = h.id LEFT JOIN airs a ON a.cell = n.cell CROSS JOIN met72 m)""",
    "parts": f"""SELECT id, quality, coverage_14d AS coverage, {', '.join(f"CASE WHEN coverage_{d}d >= 0.7 THEN {c} END AS {a}" for a, c, d in _GATED)},
      CASE WHEN coverage_3d >= 0.7 AND coverage_7d >= 0.7 THEN greatest(0.0, rain_7d_mm - rain_3d_mm) END AS r1,
      CASE WHEN coverage_7d >= 0.7 AND coverage_14d >= 0.7 THEN greatest(0.0, rain_14d_mm - rain_7d_mm) END AS r2,
      {', '.join(f"CASE WHEN met_age_hours <= 6 AND met_coverage >= 0.7 THEN {c} END AS {a}" for a, c in _AIR)} FROM weather""",
    "modifiers": f"""SELECT *, CASE WHEN tm IS NULL OR tn IS NULL THEN NULL ELSE
        (CASE WHEN tm < 2 OR tm > 26 THEN 0.4 WHEN tm < 8 THEN 0.4 + (tm - 2) / 6 * 0.6 WHEN tm <= 18 THEN 1.0 ELSE 1 - (tm - 18) / 8 * 0.6 END)
        * (CASE WHEN tn >= 2 THEN 1.0 WHEN tn <= -2 THEN 0.6 ELSE 1 - (2 - tn) / 4 * 0.4 END) END AS temperature,
      CASE WHEN rn IS NULL OR wet IS NULL THEN NULL ELSE 0.6 + 0.4 * (0.5 * greatest(0.0, least(1.0, (rn - 65) / 25)) + 0.2 * (1 - exp(-wet / 6))
        + 0.3 * coalesce(exp(-ln(2) * hsr / 72), 0)) END AS persistence,
      {_each(lambda s: ' + '.join(f'{w} * (1 - exp(-r{i} / {k}))' for i, (w, k) in enumerate(zip(P.RAIN_WEIGHTS[s], P.RAIN_SCALES))) + f' AS moisture_{s}')} FROM parts""",
    "fruits": f"SELECT *, {_each(lambda s: f'{season_prior(s, SEASON_DAY)!r} * moisture_{s} * temperature * persistence AS fruiting_{s}')} FROM modifiers",
    "means": f"""SELECT e.id_a, e.id_b, {_each(lambda s: f'(a.fruiting_{s} + b.fruiting_{s}) / 2 AS fruiting_{s}')},
      CASE WHEN a.quality = b.quality THEN a.quality WHEN a.quality = 'complete' THEN b.quality WHEN b.quality = 'complete' THEN a.quality
        WHEN a.quality < b.quality THEN a.quality WHEN b.quality < a.quality THEN b.quality END AS weather_quality,
      CASE WHEN a.coverage <= b.coverage THEN a.coverage WHEN b.coverage < a.coverage THEN b.coverage END AS weather_coverage
      FROM edge e LEFT JOIN fruits a ON a.id = e.id_a LEFT JOIN fruits b ON b.id = e.id_b""",
    "long": " UNION ALL ".join(
        f"""SELECT '{s}' AS species, e.id_a, e.id_b, g.region, g.region <> h.region AS crosses, (sa.x + sb.x) / 2 AS x, (sa.y + sb.y) / 2 AS y, e.ecotone_{s} AS ecotone, m.fruiting_{s} AS fruiting,
        coalesce(r.nearest_car_road_m <= 1500, false) AS eligible,
        round(CASE WHEN r.nearest_car_road_m <= 1500 THEN e.ecotone_{s} * r.access_modifier * m.fruiting_{s} END, 6) AS score
        FROM scored e JOIN reach r ON r.id_a = e.id_a AND r.id_b = e.id_b JOIN means m ON m.id_a = e.id_a AND m.id_b = e.id_b
        JOIN region_of g ON g.id = e.id_a JOIN region_of h ON h.id = e.id_b JOIN stand sa ON sa.id = e.id_a JOIN stand sb ON sb.id = e.id_b"""
        for s in P.SPECIES
    ),
    "covered": """SELECT region, species, CAST(count(*) FILTER (ecotone IS NOT NULL AND eligible) AS BIGINT) AS pool,
      count(*) FILTER (ecotone IS NOT NULL AND eligible AND fruiting IS NOT NULL) / nullif(count(*) FILTER (ecotone IS NOT NULL AND eligible), 0) AS ratio, count(*) FILTER (crosses) AS crossing FROM long GROUP BY region, species""",
    "open": """SELECT l.*, row_number() OVER (PARTITION BY l.region, l.species ORDER BY score DESC, id_a, id_b) AS pos FROM long l
      JOIN covered c ON c.region = l.region AND c.species = l.species AND coalesce(c.ratio, 1) >= 0.9 WHERE score IS NOT NULL""",
    # One step per place: the row is tried against the list of retained rows of its bucket.
    "walk": """SELECT region, species, pos, id_a, id_b, score, x, y, CAST(NULL AS BIGINT) AS by_pos, CAST(NULL AS DOUBLE) AS by_m,
        [{'p': pos, 'x': x, 'y': y}] AS kept FROM open WHERE pos = 1
      UNION ALL SELECT region, species, pos, id_a, id_b, score, x, y, CASE WHEN near.d < 400 THEN near.p END, CASE WHEN near.d < 400 THEN near.d END,
        CASE WHEN near.d < 400 THEN kept ELSE list_append(kept, {'p': pos, 'x': x, 'y': y}) END
      FROM (SELECT o.*, w.kept, list_min([{'d': sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2), 'p': k.p} for k in w.kept]) AS near
        FROM walk w JOIN open o ON o.region = w.region AND o.species = w.species AND o.pos = w.pos + 1)""",
    "settled": """SELECT w.*, k.id_a || '_' || k.id_b AS suppressed_by FROM walk w LEFT JOIN open k ON k.region = w.region AND k.species = w.species AND k.pos = w.by_pos""",
    "chosen": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY region, species ORDER BY pos) AS rank FROM settled WHERE by_pos IS NULL) WHERE rank <= 10""",
    "behind": "SELECT region, species, by_pos AS pos, count(*) AS n, max(score) AS best FROM settled WHERE by_pos IS NOT NULL GROUP BY region, species, by_pos",
    "examples": """SELECT * FROM (SELECT s.*, row_number() OVER (PARTITION BY s.region, s.species, s.by_pos ORDER BY s.pos) AS nth FROM settled s
      JOIN chosen c ON c.region = s.region AND c.species = s.species AND c.pos = s.by_pos) WHERE nth <= 3""",
    "members": """SELECT id, min(id) OVER (PARTITION BY c, island) AS root FROM (SELECT o.o_custkey AS c, o.o_orderkey AS id, sum(CASE WHEN e.id_b IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS island FROM orders o LEFT JOIN edge e ON e.id_b = o.o_orderkey)""",
    "far": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY species ORDER BY ecotone DESC, id_a, id_b) AS rank,
      CASE WHEN NOT eligible THEN 'REMOTE_BY_V1_ACCESS_PROXY' ELSE 'MISSING_FRUITING_DATA' END AS exclusion_reason FROM long WHERE ecotone IS NOT NULL AND score IS NULL) WHERE rank <= 10""",
}

_ALL = {**VIEWS, **_FR}


def _needs(sql: str) -> list[str]:
    """Steps that a text names, with what these name, in order of their definition."""
    import re

    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for n in _ALL:
            if n not in found and re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", text):
                found.add(n)
                todo.append(_ALL[n])
    return [n for n in _ALL if n in found]


def sql(select: str) -> str:
    names = _needs(select)
    parts = [cte(n) if n in VIEWS else f"{n} AS ({_FR[n]})" for n in names]
    return f"WITH {'RECURSIVE ' if 'walk' in names else ''}{', '.join(parts)} {select}" if parts else select


def _r(c: str, n: int = 8, name: str | None = None) -> str:
    return f"round(CAST({c} AS DOUBLE) + 3e-11, {n}) + 0.0 AS {name or c}"


_SEASON = ", ".join(f"('{s}', {int(k[:2])}, {int(k[3:])}, {v})" for s in P.SPECIES for k, v in P.SEASONS[s].items())


def _projection() -> str:
    """Degrees by the series in the conformal latitude and one step that sharpens it, then metres by the forward formulas."""
    n, af, rho0 = ESTONIA.constants()
    e2 = ESTONIA.e**2
    chi = f"(pi() / 2 - 2 * atan(pow(sqrt((x - 500000) ** 2 + ({rho0!r} - (y - 6375000)) ** 2) / {af!r}, 1 / {n!r})))"
    a, b, c = e2 / 2 + 5 * e2**2 / 24 + e2**3 / 12 + 13 * e2**4 / 360, 7 * e2**2 / 48 + 29 * e2**3 / 240 + 811 * e2**4 / 11520, 7 * e2**3 / 120 + 81 * e2**4 / 1120
    d = 4279 * e2**4 / 161280
    lat = f"(chi + {a!r} * sin(2 * chi) + {b!r} * sin(4 * chi) + {c!r} * sin(6 * chi) + {d!r} * sin(8 * chi))"
    t = f"(tan(pi() / 4 - phi / 2) / pow((1 - {ESTONIA.e!r} * sin(phi)) / (1 + {ESTONIA.e!r} * sin(phi)), {ESTONIA.e / 2!r}))"
    return f"""SELECT id, round(degrees(lam) + 24 + 3e-11, 7) + 0.0 AS lon, round(degrees(phi) + 3e-11, 7) + 0.0 AS lat,
      round(500000 + {af!r} * pow({t}, {n!r}) * sin({n!r} * lam) + 3e-11, 3) + 0.0 AS x, round(6375000 + {rho0!r} - {af!r} * pow({t}, {n!r}) * cos({n!r} * lam) + 3e-11, 3) + 0.0 AS y
      FROM (SELECT id, lam, pi() / 2 - 2 * atan(tan(pi() / 4 - chi / 2) * pow((1 - {ESTONIA.e!r} * sin(phi0)) / (1 + {ESTONIA.e!r} * sin(phi0)), {ESTONIA.e / 2!r})) AS phi
        FROM (SELECT id, chi, {lat} AS phi0, atan2(x - 500000, {rho0!r} - (y - 6375000)) / {n!r} AS lam FROM (SELECT id, x, y, {chi} AS chi FROM stand)))"""


ORACLE = {
    "stand_composition_list": "SELECT id, count(*) AS n, arg_min(puuliik_kood, (puuliik_kood, osakaal)) AS first_code, arg_max(osakaal, (puuliik_kood, osakaal)) AS last_share FROM element GROUP BY id",
    "stand_species_shares": f"""SELECT id, {', '.join(_r(f"coalesce(sum(osakaal) FILTER (puuliik_kood = '{k}'), 0)", 8, f"{t}_share") for t, k in P.TREES.items())}, {_r('sum(osakaal)', 8, 'total_share')}
      FROM element GROUP BY id""",
    "stand_fractions": f"SELECT id, {', '.join(_r(c) for c in _C)} FROM fractions",
    "stand_diversity": f"SELECT id, {_r(' + '.join(f'CASE WHEN {c} IS NULL THEN 0.0 WHEN {c} > 0 THEN -{c} * ln({c}) ELSE 0.0 END' for c in _C), 8, 'diversity')} FROM fractions",
    "stand_dominant": f"SELECT id, CASE greatest({', '.join(_C)}) {' '.join(f'''WHEN {c} THEN '{c}' ''' for c in _C)} END AS dominant, {_r(f'greatest({chr(44).join(_C)})', 8, 'share')} FROM fractions",
    "host_score": f"SELECT id, {_each(lambda s: _r(_host(s), 8, s))} FROM fractions",
    "site_score": f"SELECT id, {case('site', _GROUP)} AS site_group, CAST({case('site', _MOIST)} AS INTEGER) AS moisture, {_each(lambda s: _r(_site(s), 8, s))} FROM stand",
    "stand_habitat": f"SELECT id, {_each(lambda s: _r(f'habitat_{s}'))} FROM habitat",
    "ecotone_contrasts": f"SELECT id_a, id_b, {_r('composition_contrast')}, site_type_changed, group_changed, {_r('moisture_contrast')}, {_r('age_contrast')}, drainage_changed FROM evidence",
    "exploration_bonus": f"SELECT id_a, id_b, {_r('bonus')}, {_r('signal')}, {_r('coverage')} FROM scored",
    "ecotone_score": f"SELECT id_a, id_b, {_each(lambda s: _r(f'ecotone_{s}'))} FROM scored",
    "nearest_road": f"SELECT id, rid, {_r('d', 8, 'distance')} FROM car",
    "nearest_by_class": f"""SELECT s.id, {_r("min(sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2)) FILTER (r.car_class = 'HIGH_CONFIDENCE')", 8, 'high_m')},
      {_r("min(sqrt((s.x - r.x) ** 2 + (s.y - r.y) ** 2)) FILTER (r.car_class = 'WALK_ONLY')", 8, 'walk_m')} FROM stand s CROSS JOIN road r GROUP BY s.id""",
    "access_score_reason": f"SELECT id, {_r('nearest_car_road_m', 8)}, {_r('access_score', 8)}, access_confidence, access_reason FROM access",
    "car_class": f"""SELECT road_id, made AS car_class, made IS NULL AS unknown, made IS NOT DISTINCT FROM recorded AS as_recorded FROM (
      SELECT road_id, car_class AS recorded, CASE WHEN tyyp_tekst IN ({', '.join(f"'{k}'" for k in P.ROAD_CLASSES['HIGH_CONFIDENCE'])}) THEN 'HIGH_CONFIDENCE'
        WHEN tyyp_tekst IN ('Kergliiklustee', 'Rada') THEN 'WALK_ONLY' WHEN tyyp_tekst = 'Muu tee' AND teekate_tekst = 'Pinnas' THEN 'CONDITIONAL'
        WHEN tyyp_tekst = 'Muu tee' AND teekate_tekst IN ('Püsikate', 'Kruuskate', 'Kivikate') THEN 'NORMAL' END AS made FROM roads)""",
    "best_of_two_access": f"SELECT id_a, id_b, {_r('access_modifier', 8)}, access_confidence, {_r('nearest_car_road_m', 8)}, coalesce(nearest_car_road_m <= 1500, false) AS scout_eligible FROM reach",
    "annulus_filter": "SELECT id FROM stand WHERE sqrt((x - 510000) ** 2 + (y - 6510000) ** 2) <= 8000 AND sqrt((x - 510000) ** 2 + (y - 6510000) ** 2) > 3000",
    "range_pairs": f"""SELECT a.id AS id_a, b.id AS id_b, {_r('sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)', 8, 'distance')} FROM stand a JOIN stand b
      ON a.id < b.id AND a.x BETWEEN b.x - 100 AND b.x + 100 AND (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 10000""",
    "barrier_anti_join": f"SELECT id FROM stand s WHERE NOT EXISTS (SELECT 1 FROM barrier b WHERE b.toke_tekst = '{P.CLOSED}' AND (s.x - b.x) ** 2 + (s.y - b.y) ** 2 <= 40000)",
    "zonal_mean_fallback": f"""SELECT id, {_r('CASE WHEN n > 0 THEN m ELSE v END', 8, 'rain_14d_mm')} FROM (
      SELECT s.id, count(p.px) FILTER (p.x BETWEEN s.x - 700 AND s.x + 700 AND p.y BETWEEN s.y - 300 AND s.y + 300) AS n,
        avg(u.rain_14d_mm) FILTER (p.x BETWEEN s.x - 700 AND s.x + 700 AND p.y BETWEEN s.y - 300 AND s.y + 300) AS m,
        arg_min(struct_pack(v := u.rain_14d_mm), (sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2), p.px)) FILTER (sqrt((s.x - p.x) ** 2 + (s.y - p.y) ** 2) <= 1500).v AS v
      FROM stand s CROSS JOIN pixel p LEFT JOIN sums u ON u.px = p.px GROUP BY s.id)""",
    "rain_sums": f"""SELECT px, {', '.join(f"{_r(f'rain_{d}d_mm', 8)}, {_r(f'coverage_{d}d', 8)}" for d in (3, 7, 14))}, {_r('wet_hours_72h', 8)}, last_wet, {_r('hours_since_any_rain', 8)} FROM sums""",
    "rain_events": f"SELECT px, event_no, began, ended, slots, {_r('event_mm', 8)} FROM rained",
    "significant_strong": f"SELECT px, {_r('hours_since_significant_rain', 8)}, {_r('last_significant_mm', 8)}, {_r('hours_since_strong_rain', 8)}, {_r('last_strong_mm', 8)} FROM lasts",
    "rain_max_24h": f"""SELECT px, {_r('max(s)', 8, 'max_24h_rain_14d')} FROM (SELECT px, sum(mm) OVER (PARTITION BY px ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) AS s FROM win)
      GROUP BY px""",
    "rain_bins": f"SELECT px, {_r('rain_0_3d_mm', 8)}, {_r('rain_3_7d_mm', 8)}, {_r('rain_7_14d_mm', 8)} FROM bins",
    "met_means": f"SELECT cell, {_r('temp_mean', 8)}, {_r('temp_night', 8)}, {_r('rh_mean', 8)}, {_r('rh_night', 8)} FROM airs",
    "met_hours": f"SELECT {_r('met_coverage', 8)}, {_r('met_age_hours', 8)} FROM met72",
    "weather_quality": f"""SELECT px, {_QUALITY} AS quality, {_r('CASE WHEN coverage_3d >= 0.7 THEN wet_hours_72h END', 8, 'wet_hours_72h')},
      {_r('CASE WHEN coverage_14d >= 0.7 THEN h0 END', 8, 'hours_since_significant_rain')} FROM (SELECT u.*, l.hours_since_significant_rain AS h0, {_FLAGS}
      FROM sums u LEFT JOIN lasts l ON l.px = u.px CROSS JOIN met72)""",
    "fruiting_components": f"SELECT id, {_r('temperature', 8)}, {_r('persistence', 8)}, {_each(lambda s: _r(f'moisture_{s}', 8))} FROM modifiers",
    "fruiting_score": f"SELECT id, quality, {_r('coverage', 8)}, {_each(lambda s: _r(f'fruiting_{s}', 8))} FROM fruits",
    "projection_3301": _projection(),
    "season_priors": f"""WITH knots(species, m, k, v) AS (VALUES {_SEASON}), k AS (SELECT species, make_date(2000, m, k) AS day, CAST(v AS DOUBLE) AS v FROM knots),
      days AS (SELECT CAST(day AS DATE) AS day FROM range(DATE '2000-01-01', DATE '2001-01-01', INTERVAL 1 DAY) a(day)),
      spans AS (SELECT species, day AS d0, v AS v0, lead(day) OVER w AS d1, lead(v) OVER w AS v1, row_number() OVER w AS n FROM k WINDOW w AS (PARTITION BY species ORDER BY day))
      SELECT strftime(d.day, '%m-%d') AS month_day, s.species, round(max(CASE WHEN d.day <= d0 AND n = 1 THEN v0 WHEN d.day >= d0 AND d1 IS NULL THEN v0
        WHEN d.day > d0 AND d.day <= d1 THEN v0 + (v1 - v0) * (d.day - d0) / (d1 - d0) END), 6) AS prior FROM days d CROSS JOIN spans s GROUP BY d.day, s.species""",
    "fruiting_join_strict": f"SELECT id_a, id_b, {_each(lambda s: _r(f'fruiting_{s}', 8))}, weather_quality, {_r('weather_coverage', 8)} FROM means",
    "worst_quality": """SELECT weather_no, CASE WHEN a = b THEN a WHEN a = 'complete' THEN b WHEN b = 'complete' THEN a WHEN a < b THEN a WHEN b < a THEN b END AS worst FROM (
      SELECT weather_no, weather_data_quality AS a, o.q AS b
      FROM weather_eraldis LEFT JOIN (SELECT weather_no - 1 AS no, weather_data_quality AS q FROM weather_eraldis) o ON o.no = weather_no)""",
    # Edges only link a customer's consecutive orders, so components are islands.
    "forest_blocks": """SELECT row_number() OVER (ORDER BY root) - 1 AS block_id, root, n_stands FROM (
      SELECT min(id) AS root, count(*) AS n_stands FROM (SELECT o.o_custkey AS c, o.o_orderkey AS id, sum(CASE WHEN e.id_b IS NULL THEN 1 ELSE 0 END)
        OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderkey) AS island FROM orders o LEFT JOIN edge e ON e.id_b = o.o_orderkey) GROUP BY c, island)""",
    "block_rollup": f"""SELECT row_number() OVER (ORDER BY root) - 1 AS block_id, n_stands, {_r('m', 8, 'extent_m')}, m > 25000 AS oversized FROM (
      SELECT a.root, count(DISTINCT a.id) AS n_stands, max(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS m FROM members a JOIN members b ON b.root = a.root
        JOIN stand p ON p.id = a.id JOIN stand q ON q.id = b.id GROUP BY a.root)""",
    "block_extent": f"""SELECT block_id, {_r('m', 8, 'extent_m')}, m > 25000 AS oversized FROM (SELECT a.o_custkey AS block_id, max(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS m
      FROM orders a JOIN orders b ON b.o_custkey = a.o_custkey JOIN stand p ON p.id = a.o_orderkey JOIN stand q ON q.id = b.o_orderkey GROUP BY a.o_custkey)""",
    "block_proximity": f"""SELECT a.rid AS id_a, b.rid AS id_b, {_r('3 * sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)', 8, 'distance_m')} FROM road a JOIN road b
      ON a.rid < b.rid AND 9 * ((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 64000000""",
    # Boundaries of squares: the gaps along both axes.
    "block_boundary_proximity": f"""SELECT id_a, id_b, {_r('d', 8, 'distance_m')} FROM (SELECT a.rid AS id_a, b.rid AS id_b,
      sqrt(greatest(0.0, 3 * abs(a.x - b.x) - 1000) ** 2 + greatest(0.0, 3 * abs(a.y - b.y) - 1000) ** 2) AS d FROM road a JOIN road b ON a.rid < b.rid) WHERE d <= 8000""",
    "macrocluster_rollup": f"""WITH {cte('road')}, b AS (SELECT rid, (x - 500000) * 3 + 400000 AS x, (y - 6500000) * 3 + 6400000 AS y FROM road),
      c AS (SELECT *, CAST(floor(x / 12000) * 100000 + floor(y / 12000) AS BIGINT) AS cluster_id FROM b),
      far AS (SELECT p.cluster_id, max(sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2)) AS m, max(sqrt((abs(p.x - q.x) + 1000) ** 2 + (abs(p.y - q.y) + 1000) ** 2)) AS g
        FROM c p JOIN c q ON q.cluster_id = p.cluster_id GROUP BY p.cluster_id)
      SELECT c.cluster_id, CAST(count(*) AS INTEGER) AS block_count, CAST(sum(rid) AS BIGINT) AS stand_count, {_r('any_value(m)', 3, 'centroid_extent_m')}, {_r('any_value(g)', 3, 'geometry_extent_m')},
        any_value(g) > 35000 AS oversized, any_value(g) <= 25000 AS within_target_extent, count(*) BETWEEN 5 AND 15 AS within_target_block_count
      FROM c JOIN far ON far.cluster_id = c.cluster_id GROUP BY c.cluster_id""",
    "parcel_adjacency": f"""SELECT id_a, id_b, CASE WHEN gap = 0 THEN 'touching' ELSE 'near_gap' END AS adjacency_type, {_r('CASE WHEN gap = 0 THEN side END', 8, 'length_m')}, {_r('gap', 8, 'gap_m')}
      FROM (SELECT a.id AS id_a, b.id AS id_b, greatest(a.x0, b.x0) - least(a.x1, b.x1) AS gap, least(a.y1, b.y1) - greatest(a.y0, b.y0) AS side FROM parcel a JOIN parcel b ON a.id < b.id)
      WHERE side >= 20 AND gap BETWEEN 0 AND 10""",
    "block_outlines": f"""SELECT p.block, {_r('p.n * 10000', 3, 'area_m2')}, {_r('p.n * 400 - 2 * coalesce(c.shared, 0)', 3, 'perimeter_m')} FROM (SELECT block, count(*) AS n FROM parcel GROUP BY block) p
      LEFT JOIN (SELECT a.block, sum(least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS shared FROM parcel a JOIN parcel b ON a.block = b.block AND a.id < b.id
        AND greatest(a.x0, b.x0) = least(a.x1, b.x1) AND least(a.y1, b.y1) > greatest(a.y0, b.y0) GROUP BY a.block) c ON c.block = p.block""",
    "composition_attach": f"SELECT s.id, count(e.id) AS n, {_r('coalesce(sum(e.osakaal), 0)', 8, 'total')} FROM stand s LEFT JOIN element e ON e.id = s.id GROUP BY s.id",
    "stand_weather": f"""SELECT id, quality, {_r('coverage')}, {_N} AS as_of, {', '.join(_r(a, 8, c) for a, c, _ in _GATED)}, {', '.join(_r(a, 8, c) for a, c in _AIR)},
      {_r('r0', 8, 'rain_0_3d_mm')}, {_r('r1', 8, 'rain_3_7d_mm')}, {_r('r2', 8, 'rain_7_14d_mm')} FROM parts""",
    "air_hours": f"""SELECT h.hour, m.hour IS NOT NULL AS there FROM (SELECT unnest(range({_N} - INTERVAL 71 HOUR, {_N} + INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS hour) h
      LEFT JOIN (SELECT DISTINCT hour FROM met) m ON m.hour = h.hour""",
    "road_anti_join": f"""WITH {cte('barrier')}, lines AS (SELECT road_id, unnest(regexp_extract_all(geometry, '\\(([^()]+)\\)', 1)) AS line FROM roads),
      points AS (SELECT road_id, line_no, i, CAST(split_part(trim(p), ' ', 1) AS DOUBLE) AS x, CAST(split_part(trim(p), ' ', 2) AS DOUBLE) AS y FROM (
        SELECT road_id, line_no, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT road_id, row_number() OVER () AS line_no, string_split(line, ',') AS ps FROM lines))),
      segs AS (SELECT a.road_id, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM points a JOIN points b ON b.line_no = a.line_no AND b.i = a.i + 1),
      near AS (SELECT road_id, b.x - x1 AS px, b.y - y1 AS py, x2 - x1 AS dx, y2 - y1 AS dy FROM segs JOIN barrier b ON b.toke_tekst = '{P.CLOSED}'
          AND b.x BETWEEN least(x1, x2) - 50 AND greatest(x1, x2) + 50 AND b.y BETWEEN least(y1, y2) - 50 AND greatest(y1, y2) + 50),
      hit AS (SELECT road_id FROM (SELECT *, greatest(0, least(1, coalesce((px * dx + py * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM near)
        WHERE sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) <= 50)
      SELECT DISTINCT road_id FROM segs WHERE road_id NOT IN (SELECT road_id FROM hit)""",
    "scout_shortlist": f"""SELECT c.species, c.region, c.id_a, c.id_b, CAST(c.rank AS INTEGER) AS rank, CAST(c.pos AS INTEGER) AS rank_before, {_r('c.score', 8, 'scout_score')},
      coalesce(b.n, 0) AS nearby_suppressed_count, {_r('b.best', 8, 'best_suppressed_score')} FROM chosen c
      LEFT JOIN behind b ON b.region = c.region AND b.species = c.species AND b.pos = c.pos""",
    "suppressed_examples": f"SELECT species, region, id_a, id_b, suppressed_by, {_r('by_m', 8, 'suppressed_m')}, CAST(nth AS INTEGER) AS nth FROM examples",
    "remote_high_value": f"SELECT species, id_a, id_b, CAST(rank AS INTEGER) AS rank, {_r('ecotone', 8)}, exclusion_reason FROM far",
    "coverage_gate": f"SELECT region, species, pool, {_r('ratio', 8, 'weather_coverage_ratio')} FROM covered",
    "tier_union": """SELECT tier, species, count(*) AS n, CAST(sum(rank) AS BIGINT) AS ranks, count(why) AS reasons FROM (
      SELECT 'ranked' AS tier, species, rank, NULL AS why FROM chosen UNION ALL SELECT 'suppressed', species, NULL, NULL FROM examples
      UNION ALL SELECT 'remote', f.species, f.rank, f.exclusion_reason FROM far f WHERE f.species IN (SELECT species FROM long GROUP BY species
        HAVING coalesce(count(*) FILTER (ecotone IS NOT NULL AND eligible AND fruiting IS NOT NULL) / nullif(count(*) FILTER (ecotone IS NOT NULL AND eligible), 0), 1) >= 0.9)) GROUP BY tier, species""",
    "daily_state_rollup": f"""SELECT n.n_nationkey AS region, {_N} AS as_of, coalesce(max(z.crossing), 0) AS cross_count, {_each(lambda s: f'''coalesce(max(n_{s}), 0) AS {s}_ranked_count, {_r(f'max(t_{s})', 8, f'{s}_top_score')}, {_r(f'max(m_{s})', 8, f'{s}_top3_mean')},
        max(g_{s}) AS {s}_top_target, {_r(f'max(w_{s})', 8, f'{s}_weather_coverage_ratio')},
        CASE WHEN max(w_{s}) >= 0.9 THEN 'ok' WHEN max(w_{s}) IS NOT NULL THEN 'insufficient_coverage' END AS {s}_status''')}
      FROM nation n LEFT JOIN (SELECT c.region, c.crossing, {_each(lambda s: f"CASE WHEN c.species = '{s}' THEN k.n END AS n_{s}, CASE WHEN c.species = '{s}' THEN k.t END AS t_{s}, CASE WHEN c.species = '{s}' THEN k.m END AS m_{s}, CASE WHEN c.species = '{s}' THEN k.g END AS g_{s}, CASE WHEN c.species = '{s}' THEN c.ratio END AS w_{s}")}
        FROM covered c LEFT JOIN (SELECT region, species, count(*) AS n, max(score) AS t, avg(score) FILTER (rank <= 3) AS m, max(id_a || '_' || id_b) FILTER (rank = 1) AS g
          FROM chosen GROUP BY region, species) k ON k.region = c.region AND k.species = c.species) z ON z.region = n.n_nationkey GROUP BY n.n_nationkey""",
    "cross_cluster_count": "SELECT id_a % 7 AS region, CAST(sum(CASE WHEN id_a % 7 <> id_b % 7 THEN 1 ELSE 0 END) AS BIGINT) AS cross_count, count(*) AS edges FROM edge GROUP BY id_a % 7",
    "nms_suppression": f"""WITH RECURSIVE {cte('nms_input')}, o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, id) AS pos FROM nms_input),
      w AS (SELECT id, bucket, pos, CAST(NULL AS BIGINT) AS by_id, CAST(NULL AS DOUBLE) AS by_m, [{{'p': pos, 'i': id, 'x': x, 'y': y}}] AS kept FROM o WHERE pos = 1
        UNION ALL SELECT id, bucket, pos, CASE WHEN near.d < 400 THEN near.i END, CASE WHEN near.d < 400 THEN near.d END,
          CASE WHEN near.d < 400 THEN kept ELSE list_append(kept, {{'p': pos, 'i': id, 'x': x, 'y': y}}) END
        FROM (SELECT o.*, w.kept, list_min([{{'d': sqrt((k.x - o.x) ** 2 + (k.y - o.y) ** 2), 'p': k.p, 'i': k.i}} for k in w.kept]) AS near
          FROM w JOIN o ON o.bucket = w.bucket AND o.pos = w.pos + 1))
      SELECT id, bucket, CAST(pos AS INTEGER) AS rank_before, by_id AS suppressed_by, {_r('by_m', 8, 'suppressed_m')} FROM w""",
}
ORACLE = {k: q if q.lstrip().startswith("WITH") else sql(q) for k, q in ORACLE.items()}
