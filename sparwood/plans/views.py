"""Derived stand, edge, rain and road views over the general tables: one text, valid for Spark and for the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import priors as P

#: Time at which the rain windows end, expected slots of the thin test series, month and day for the season.
NOW = "2024-01-31 00:00:00"
SLOTS = {3: 3, 7: 8, 14: 16}
FLAGSHIP_SLOTS = {3: 1, 7: 6, 14: 16}
SEASON_DAY = "08-20"

_CODES = [c for codes, _ in P.SITES.values() for c in codes]


def case(of: str, values: dict, default: str = "NULL") -> str:
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {of} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in values.items()) + f" ELSE {default} END"


_XY = "CAST({x0} + ({k} * {fx}) % {mx} AS DOUBLE) AS x, CAST({y0} + ({k} * {fy}) % {my} AS DOUBLE) AS y"


def _xy(k: str, fx: int, fy: int, x0: int = 500000, y0: int = 6500000, mx: int = 20011, my: int = 20021) -> str:
    return _XY.format(k=k, fx=fx, fy=fy, x0=x0, y0=y0, mx=mx, my=my)


VIEWS = {
    "stand": f"""SELECT o_orderkey AS id, {_xy('o_orderkey', 7919, 104729)},
        {case('o_orderkey % 30', {**dict(enumerate(_CODES)), 28: 'XX', 29: 'YY'})} AS site,
        {case('o_custkey % 8', {**dict(enumerate(P.AGE_RANKS)), 7: 'Z'})} AS age,
        CASE o_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS drained FROM {{orders}}""",
    "element": """SELECT l.l_orderkey AS id, CASE p.p_type WHEN 'STANDARD' THEN 'MA' WHEN 'ECONOMY' THEN 'KU' WHEN 'PROMO' THEN 'KS' WHEN 'SMALL' THEN 'HB'
        ELSE 'LM' END AS puuliik_kood, l.l_quantity AS osakaal FROM {lineitem} l JOIN {part} p ON p.p_partkey = l.l_partkey""",
    "edge": """SELECT id_a, id_b, 20 + (id_a + id_b) % 300 AS length FROM (
        SELECT o_orderkey AS id_b, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id_a, o_orderdate AS d,
          lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pd FROM {orders}) q
        WHERE id_a IS NOT NULL AND d <= pd + INTERVAL 365 DAY AND pd <= d + INTERVAL 365 DAY""",
    "region_of": "SELECT o.o_orderkey AS id, c.c_nationkey AS region FROM {orders} o JOIN {customer} c ON c.c_custkey = o.o_custkey",
    "slot": """SELECT user_id AS px, ts, CASE event_type WHEN 'error' THEN CAST(NULL AS DOUBLE) WHEN 'view' THEN CAST(0.0 AS DOUBLE)
        ELSE CAST(value / 10 AS DOUBLE) END AS rate FROM {events}""",
    "pixel": f"SELECT px, x, y FROM (SELECT DISTINCT user_id AS px, {_xy('user_id', 15106, 11409)} FROM {{events}}) q",
    "met": """SELECT user_id % 25 AS cell, date_trunc('hour', ts) AS hour, CAST(value / 10 AS DOUBLE) AS temp,
        CAST(40 + event_id % 60 AS DOUBLE) AS rh FROM {events}""",
    "met_cell": """SELECT cell, CAST(502000 + (cell % 5) * 4000 AS DOUBLE) AS x, CAST(6502000 + (cell - cell % 5) * 800 AS DOUBLE) AS y
        FROM (SELECT DISTINCT user_id % 25 AS cell FROM {events}) q""",
    "road": f"""SELECT s_suppkey AS rid, {_xy('s_suppkey', 6151, 3571)},
        {case('s_nationkey % 4', {0: 'HIGH_CONFIDENCE', 1: 'NORMAL', 2: 'CONDITIONAL', 3: 'WALK_ONLY'})} AS car_class FROM {{supplier}}""",
    "barrier": f"""SELECT c_custkey AS oid, {_xy('c_custkey', 4801, 9973)}, {case('c_nationkey % 3', {0: P.CLOSED, 1: 'Avatav'})} AS toke_tekst
        FROM {{customer}}""",
    "parcel": """SELECT id, block, x0, x0 + 100 AS x1, y0, y0 + 100 AS y1 FROM (SELECT c_custkey AS id, c_custkey % 50 - c_custkey % 50 % 6 + (c_custkey - c_custkey % 50) AS block,
        CAST(c_custkey % 50 * 104 - c_custkey % 50 % 2 * 4 + (c_custkey % 50 - c_custkey % 50 % 6) * 5 AS DOUBLE) AS x0,
        CAST((c_custkey - c_custkey % 50) / 50 * 130 + c_custkey % 50 % 3 * 30 AS DOUBLE) AS y0 FROM {customer}) q""",
    "nms_input": f"SELECT c_custkey AS id, c_nationkey AS bucket, c_acctbal AS score, {_xy('c_custkey', 7919, 104729, 0, 0, 6007, 6011)} FROM {{customer}}",
}

TABLES = ("orders", "lineitem", "part", "customer", "supplier", "events")


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    used = {t: spark.read.parquet(f"{folder}/{t}.parquet") for t in TABLES if f"{{{t}}}" in VIEWS[name]}
    return spark.sql(VIEWS[name], **used)


def cte(name: str) -> str:
    return f"{name} AS ({VIEWS[name].format(**{t: t for t in TABLES})})"
