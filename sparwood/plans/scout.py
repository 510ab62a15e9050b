"""Queries of the scouting operators over the derived views, each with the SQL it is held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import priors as P
from ..functions import scoring as S
from ..operators import components as G
from ..operators import composition as C
from ..operators import partition, rain, shapes, spatial
from ..operators import shortlist as L
from ..operators import suppression as N
from ..operators.ordering import numbered_rows
from ..session import drop_stored, stored
from .stages import AIR, BUCKET, RAIN, Stages, met, nearest_roads
from .views import NOW, SLOTS, view

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
HAIR = 3e-11


def query(f: Q) -> Q:
    QUERIES[f.__name__] = f
    return f


def r(c: str | Column, digits: int = 8) -> Column:
    """Rounded for comparison, moved by a hair first so that exact halves round alike everywhere; -0.0 comes out as 0.0."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double") + HAIR, digits) + 0.0


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    return df.select(*[r(n, digits).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])


# Composition and habitat


@query
def stand_composition_list(spark, d):
    n = C.nested(view(spark, d, "element"), "id", ["puuliik_kood", "osakaal"])
    return n.select("id", F.size("composition").cast("bigint").alias("n"), F.col("composition")[0]["puuliik_kood"].alias("first_code"), F.element_at("composition", -1)["osakaal"].alias("last_share"))


@query
def stand_species_shares(spark, d):
    return rounded(C.shares(view(spark, d, "element")))


@query
def composition_attach(spark, d):
    """Stands with their compositions, those without elements with an empty list."""
    a = C.attached(view(spark, d, "stand").select("id"), view(spark, d, "element"), "id", ["puuliik_kood", "osakaal"])
    share = F.aggregate("composition", F.lit(0.0), lambda t, e: t + e["osakaal"])
    return a.select("id", F.size("composition").cast("bigint").alias("n"), r(share).alias("total"))


def _stands(spark, d) -> DataFrame:
    return C.fractions(view(spark, d, "stand"), view(spark, d, "element"))


@query
def stand_fractions(spark, d):
    return rounded(_stands(spark, d).select("id", *P.CATEGORIES))


@query
def stand_diversity(spark, d):
    return _stands(spark, d).select("id", r(S.diversity(C.frac())).alias("diversity"))


@query
def stand_dominant(spark, d):
    name, share = S.dominant(C.frac())
    return _stands(spark, d).select("id", name.alias("dominant"), r(share).alias("share"))


@query
def host_score(spark, d):
    return _stands(spark, d).select("id", *[r(S.host_score(s, {c: F.col(c) for c in P.CATEGORIES})).alias(s) for s in P.SPECIES])


@query
def site_score(spark, d):
    v = view(spark, d, "stand")
    return v.select("id", S.site_group(F.col("site")).alias("site_group"), S.site_moisture(F.col("site")).alias("moisture"), *[r(S.site_score(s, F.col("site"))).alias(s) for s in P.SPECIES])


@query
def stand_habitat(spark, d):
    return rounded(C.stand_scores(_stands(spark, d)).select("id", *[f"habitat_{s}" for s in P.SPECIES]))


# Ecotones


def _ecotones(spark, d) -> DataFrame:
    return C.ecotones(view(spark, d, "edge"), Stages(spark, d)["stands"])


@query
def ecotone_contrasts(spark, d):
    return rounded(_ecotones(spark, d).select("id_a", "id_b", "composition_contrast", "site_type_changed", "group_changed", "moisture_contrast", "age_contrast", "drainage_changed"))


@query
def exploration_bonus(spark, d):
    return rounded(_ecotones(spark, d).select("id_a", "id_b", "bonus", "signal", "coverage"))


@query
def ecotone_score(spark, d):
    return rounded(_ecotones(spark, d).select("id_a", "id_b", *[f"ecotone_{s}" for s in P.SPECIES]))


# Roads and access


def _nearest(spark, d, classes) -> DataFrame:
    return nearest_roads(Stages(spark, d), classes)


@query
def nearest_road(spark, d):
    return _nearest(spark, d, P.CAR_CLASSES).select(F.col("pid").alias("id"), "rid", r("distance", 8).alias("distance"))


@query
def nearest_by_class(spark, d):
    parts = {"high_m": ("HIGH_CONFIDENCE",), "walk_m": ("WALK_ONLY",)}
    one = [_nearest(spark, d, c).select(F.col("pid").alias("id"), r("distance", 8).alias(n)) for n, c in parts.items()]
    return reduce(lambda a, b: a.join(b, "id"), one)


@query
def access_score_reason(spark, d):
    return rounded(Stages(spark, d).plan("access"))


@query
def car_class(spark, d):
    """Class of every road by type and surface, compared with the recorded one; null (where the strict function raises) for unknown ones."""
    t = spark.read.parquet(f"{d}/roads.parquet")
    made = S.known_car_class(F.col("tyyp_tekst"), F.col("teekate_tekst"))
    return t.select("road_id", made.alias("car_class"), made.isNull().alias("unknown"), made.eqNullSafe(F.col("car_class")).alias("as_recorded"))


@query
def best_of_two_access(spark, d):
    e = L.best_access(view(spark, d, "edge"), Stages(spark, d)["access"])
    return e.select("id_a", "id_b", r("access_modifier", 8).alias("access_modifier"), "access_confidence", r("nearest_car_road_m", 8).alias("nearest_car_road_m"), "scout_eligible")


@query
def annulus_filter(spark, d):
    return view(spark, d, "stand").where(crs.annulus(F.col("x"), F.col("y"), 510000.0, 6510000.0, 8000.0, 3000.0)).select("id")


@query
def range_pairs(spark, d):
    p = view(spark, d, "stand").select(F.col("id").alias("pid"), "x", "y")
    return spatial.near_pairs(p, 100.0, [], inclusive=True).select(F.col("pid_a").alias("id_a"), F.col("pid_b").alias("id_b"), r("distance", 8).alias("distance"))


@query
def barrier_anti_join(spark, d):
    p = view(spark, d, "stand").select(F.col("id").alias("pid"), "x", "y")
    closed = view(spark, d, "barrier").where(F.col("toke_tekst") == P.CLOSED)
    return spatial.anti_within(p, closed, 200.0).select(F.col("pid").alias("id"))


@query
def road_anti_join(spark, d):
    """Roads of the tables, as whole lines, that no closed barrier comes near."""
    lines = spatial.segments_of(spark.read.parquet(f"{d}/roads.parquet"), "road_id", "geometry")
    closed = view(spark, d, "barrier").where(F.col("toke_tekst") == P.CLOSED)
    return spatial.lines_apart(lines, "road_id", closed, 50.0)


@query
def zonal_mean_fallback(spark, d):
    z = view(spark, d, "stand").select(F.col("id").alias("zid"), "x", "y", (F.col("x") - 700).alias("xmin"), (F.col("x") + 700).alias("xmax"), (F.col("y") - 300).alias("ymin"), (F.col("y") + 300).alias("ymax"))
    px = view(spark, d, "pixel").join(rain.sums(view(spark, d, "slot"), NOW, SLOTS).select("px", "rain_14d_mm"), "px", "left")
    return spatial.zonal_mean(z, px, "rain_14d_mm").select(F.col("zid").alias("id"), r("rain_14d_mm", 8).alias("rain_14d_mm"))


@query
def projection_3301(spark, d):
    """Degrees of a stand from its metres and back."""
    lon, lat = crs.inverse(F.col("x"), F.col("y"))
    v = view(spark, d, "stand").select("id", lon.alias("lon"), lat.alias("lat"))
    x, y = crs.forward(F.col("lon"), F.col("lat"))
    return v.select("id", r("lon", 7).alias("lon"), r("lat", 7).alias("lat"), r(x, 3).alias("x"), r(y, 3).alias("y"))


# Rain and air


@query
def rain_sums(spark, d):
    return rounded(rain.sums(view(spark, d, "slot"), NOW, SLOTS))


@query
def rain_events(spark, d):
    return rounded(rain.events(view(spark, d, "slot"), NOW))


@query
def significant_strong(spark, d):
    s = view(spark, d, "slot")
    return rounded(rain.last_event(s, NOW, "significant", P.SIGNIFICANT_MM).join(rain.last_event(s, NOW, "strong", P.STRONG_MM), "px"))


@query
def rain_max_24h(spark, d):
    return rounded(rain.max_24h(view(spark, d, "slot"), NOW))


@query
def rain_bins(spark, d):
    return rounded(rain.bins(rain.sums(view(spark, d, "slot"), NOW, SLOTS)).select("px", "rain_0_3d_mm", "rain_3_7d_mm", "rain_7_14d_mm"))


@query
def met_means(spark, d):
    return rounded(rain.air(view(spark, d, "met"), 2))


@query
def met_hours(spark, d):
    return rounded(rain.hour_coverage(view(spark, d, "met").where(F.col("hour") >= F.expr(f"timestamp_ntz'{NOW}' - INTERVAL 72 HOUR")), NOW))


@query
def weather_quality(spark, d):
    """Quality of every pixel's weather."""
    f = rain.features(view(spark, d, "slot"), NOW, SLOTS).crossJoin(F.broadcast(met(Stages(spark, d))))
    cov = {n: F.col(f"coverage_{n}d") for n in (3, 7, 14)}
    q = S.data_quality(cov, F.col("met_age_hours"), F.col("met_coverage"))
    wet, since = S.if_covered(F.col("wet_hours_72h"), cov[3]), S.if_covered(F.col("hours_since_significant_rain"), cov[14])
    return f.select("px", q.alias("quality"), r(wet).alias("wet_hours_72h"), r(since).alias("hours_since_significant_rain"))


@query
def stand_weather(spark, d):
    """Weather of every stand by place."""
    w = Stages(spark, d).plan("weather")
    return rounded(w.select("id", "quality", "coverage", "as_of", *[c for c in (*RAIN, *AIR) if not c.startswith("coverage")], "rain_0_3d_mm", "rain_3_7d_mm", "rain_7_14d_mm"))


@query
def air_hours(spark, d):
    """The 72 hours that the air model should have, and whether it has them."""
    hours = rain.hour_series(spark, NOW)
    have = view(spark, d, "met").select("hour").distinct().withColumn("there", F.lit(True))
    return hours.join(have, "hour", "left").select("hour", F.coalesce("there", F.lit(False)).alias("there"))


@query
def fruiting_components(spark, d):
    return rounded(Stages(spark, d).plan("fruiting").select("id", "temperature", "persistence", *[f"moisture_{s}" for s in P.SPECIES]))


@query
def fruiting_score(spark, d):
    return rounded(Stages(spark, d).plan("fruiting").select("id", "quality", "coverage", *[f"fruiting_{s}" for s in P.SPECIES]))


@query
def season_priors(spark, d):
    """Every species' prior on every day of the year."""
    days = [str(k)[5:] for k in np.arange("2000-01-01", "2001-01-01", dtype="datetime64[D]")]
    return spark.createDataFrame([(k, s, round(S.season_prior(s, k), 6)) for k in days for s in P.SPECIES], "month_day string, species string, prior double")


@query
def fruiting_join_strict(spark, d):
    e = L.mean_fruiting(view(spark, d, "edge"), Stages(spark, d)["fruiting"])
    return rounded(e.select("id_a", "id_b", *[f"fruiting_{s}" for s in P.SPECIES], "weather_quality", "weather_coverage"))


@query
def worst_quality(spark, d):
    """Every weather row with the row of the next number."""
    w = spark.read.parquet(f"{d}/weather_eraldis.parquet").select("weather_no", "weather_data_quality")
    nxt = w.select((F.col("weather_no") - 1).alias("weather_no"), F.col("weather_data_quality").alias("other"))
    return w.join(nxt, "weather_no", "left").select("weather_no", S.worst_quality(F.col("weather_data_quality"), F.col("other")).alias("worst"))


# Blocks and clusters


@query
def forest_blocks(spark, d):
    return Stages(spark, d).plan("blocks").groupBy("block_id", "root").agg(F.count("*").alias("n_stands"))


@query
def block_rollup(spark, d):
    """Stands, extent and flag of every block of linked stands; those of one stand, which are most, need no grouping."""
    stands = view(spark, d, "stand").select("id", "x", "y").where("id IS NOT NULL").dropDuplicates(["id"])
    placed = G.rooted(stands, view(spark, d, "edge"))
    groups = stored(shapes.group_extent(placed.where("root IS NOT NULL"), "root", "n_stands"), "groups")
    lone = placed.where("root IS NULL").select(F.col("id").alias("root"), F.lit(0.0).alias("extent_m"), F.lit(1).cast("bigint").alias("n_stands"))
    e = numbered_rows(groups.union(lone), [F.col("root")], "block_id")
    drop_stored(placed, groups)
    return e.select((F.col("block_id") - 1).alias("block_id"), "n_stands", r("extent_m").alias("extent_m"), (F.col("extent_m") > P.BLOCK_EXTENT_M).alias("oversized"))


def _blocks(spark, d) -> DataFrame:
    """Customers as blocks of their orders' stands (as many as the tables have, of bounded size)."""
    s = view(spark, d, "stand").select("id", "x", "y").join(spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("block_id")), "id")
    return s


@query
def block_extent(spark, d):
    return shapes.group_extent(_blocks(spark, d), "block_id").select("block_id", r("extent_m", 8).alias("extent_m"), (F.col("extent_m") > P.BLOCK_EXTENT_M).alias("oversized"))


def _centres(spark, d) -> DataFrame:
    """Suppliers' places, all of them, as compact blocks in a wider country."""
    s = view(spark, d, "road")
    return s.select(F.col("rid").alias("block_id"), ((F.col("x") - 500000) * 3 + 400000).alias("x"), ((F.col("y") - 6500000) * 3 + 6400000).alias("y"), F.col("rid").alias("stand_count"))


def _squares(blocks: DataFrame) -> DataFrame:
    """The blocks with their corners, of a square kilometre each."""
    corners = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((-500, -500), (500, -500), (500, 500), (-500, 500))])
    return blocks.withColumn("corners", corners)


@query
def block_boundary_proximity(spark, d):
    """Blocks whose boundaries are near, of all blocks (JN-4)."""
    links = shapes.near_shapes(_squares(_centres(spark, d)).select(F.col("block_id").alias("id"), F.col("corners").alias("ring")), P.BLOCK_PROXIMITY_M)
    return links.select("id_a", "id_b", r("distance_m", 8).alias("distance_m"))


@query
def block_proximity(spark, d):
    """Centre points of the blocks; block_boundary_proximity is the join of their boundaries."""
    p = _centres(spark, d).withColumnRenamed("block_id", "pid")
    return spatial.near_pairs(p, P.BLOCK_PROXIMITY_M, [], inclusive=True).select(F.col("pid_a").alias("id_a"), F.col("pid_b").alias("id_b"), r("distance", 8).alias("distance_m"))


@query
def macrocluster_partition(spark, d):
    """Clusters with their counts, extents and flags."""
    blocks = _squares(_centres(spark, d))
    roots = partition.clusters(blocks, block_boundary_proximity(spark, d))
    return rounded(partition.rollup(G.numbered(roots, name="cluster_id").join(blocks, "block_id")), 3)


@query
def macrocluster_rollup(spark, d):
    """Counts, extents and flags of given clusters: suppliers' blocks by place, in squares of 12 km."""
    blocks = _squares(_centres(spark, d))
    given = (F.floor(F.col("x") / 12000) * 100000 + F.floor(F.col("y") / 12000)).cast("long")
    return rounded(partition.rollup(blocks.withColumn("cluster_id", given)), 3)


# Polygons


def _parcels(spark, d) -> DataFrame:
    """Customers as squares of 100 m in rows: every other pair of columns touches, the others are 8 m apart, every six columns a block."""
    p = view(spark, d, "parcel")
    corners = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
    return p.select("id", "block", F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in corners]).alias("ring"))


@query
def parcel_adjacency(spark, d):
    """Contacts of parcels (JN-1 to JN-3); lengths of those that touch."""
    a = shapes.adjacency(_parcels(spark, d))
    return a.select("id_a", "id_b", "adjacency_type", r(F.when(F.col("adjacency_type") == "touching", F.col("length_m"))).alias("length_m"), r("gap_m").alias("gap_m"))


@query
def block_outlines(spark, d):
    """Area, length of the outline and parts of each block's parcels dissolved into one shape."""
    o = shapes.dissolve(_parcels(spark, d), "block")
    return o.select("block", r("area_m2", 3).alias("area_m2"), r("perimeter_m", 3).alias("perimeter_m"))


# Shortlist


@query
def nms_suppression(spark, d):
    n = N.suppress(view(spark, d, "nms_input"), ["bucket"], "score", ["id"], "id")
    return n.select("id", "bucket", "rank_before", "suppressed_by", r("suppressed_m", 8).alias("suppressed_m"))


@query
def scout_shortlist(spark, d):
    ranked = Stages(spark, d).plan("ranked")
    return ranked.select("species", "region", "id_a", "id_b", "rank", F.col("rank_before"), r("scout_score", 8).alias("scout_score"), "nearby_suppressed_count", r("best_suppressed_score", 8).alias("best_suppressed_score"))


@query
def suppressed_examples(spark, d):
    return Stages(spark, d).plan("examples").select("species", "region", "id_a", "id_b", "suppressed_by", r("suppressed_m", 8).alias("suppressed_m"), "nth")


@query
def remote_high_value(spark, d):
    return Stages(spark, d).plan("remote").select("species", "id_a", "id_b", "rank", r("ecotone", 8).alias("ecotone"), "exclusion_reason")


@query
def coverage_gate(spark, d):
    return rounded(L.coverage(Stages(spark, d).plan("candidates"), BUCKET))


@query
def tier_union(spark, d):
    s = Stages(spark, d)
    ok = L.gated(s["candidates"], ["species"])
    t = L.tiers({"ranked": s.plan("ranked"), "suppressed": s.plan("examples"), "remote": L.remote(ok)}, ["tier", "species", "region", "id_a", "id_b", "rank", "exclusion_reason"])
    return t.groupBy("tier", "species").agg(F.count("*").alias("n"), F.sum("rank").cast("bigint").alias("ranks"), F.count("exclusion_reason").alias("reasons"))


@query
def daily_state_rollup(spark, d):
    return rounded(Stages(spark, d).plan("state"))


@query
def cross_cluster_count(spark, d):
    e = L.with_region(view(spark, d, "edge"), view(spark, d, "region_of").withColumn("region", (F.col("id") % 7).cast("bigint")))
    return e.groupBy("region").agg(F.sum(F.col("is_cross").cast("int")).cast("bigint").alias("cross_count"), F.count("*").alias("edges"))
