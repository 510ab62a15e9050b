"""Checks of recorded places: near candidates, suppression distances, holding regions and nearest roads (problem 1)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import wkt
from ..functions.scoring import species_key
from ..session import stored, table
from . import spatial

#: Separation of candidates, tolerance of recorded distances, classes of roads that carry cars.
SEPARATION_M = 400.0
TOLERANCE_M = 1.0
CAR_CLASSES = ("HIGH_CONFIDENCE", "NORMAL", "CONDITIONAL")


def candidate_places(candidates: DataFrame) -> DataFrame:
    """Candidates with a place, stored once for the three checks that read them."""
    c = candidates.select(
        F.col("candidate_id").alias("pid"), "run_id", species_key(F.col("species")).alias("sp"), "macrocluster_id", "suppressed_by_id",
        "suppression_distance_m", "id_a", "id_b", wkt.place("geometry").alias("p"),
    )
    c = c.select("*", "p.x", "p.y").drop("p").where(F.col("x").isNotNull() & ~F.isnan("x"))
    return stored(c, "places")


def wrong(recorded: Column, true: Column) -> Column:
    """Whether a recorded distance is null, NaN or more than the tolerance off."""
    return recorded.isNull() | F.isnan(recorded) | (F.abs(recorded - true) > TOLERANCE_M)


def near(places: DataFrame) -> DataFrame:
    return spatial.near_pairs(places, SEPARATION_M, ["run_id", "sp"]).select("pid_a", "pid_b")


def suppressed(places: DataFrame) -> DataFrame:
    """Candidates whose recorded suppressor is near, with a wrong distance; a row isn't its own suppressor.

    The namesake rows are reached by an equi-join on run, species and the two ids; copies of a hot name are reduced to
    the one row per place of smallest id first.
    """
    named = places.where(F.col("suppressed_by_id").isNotNull()).select(
        "run_id", "sp", F.col("suppressed_by_id").alias("name"), "pid", "x", "y", "suppression_distance_m"
    )
    own = F.concat_ws("_", F.col("id_a").cast("string"), F.col("id_b").cast("string"))
    # A place's two smallest ids are enough: the smallest, and the next for the row that is the smallest itself.
    by = places.where(F.col("id_a").isNotNull() & F.col("id_b").isNotNull()).groupBy("run_id", "sp", own.alias("name"), F.col("x").alias("xs"), F.col("y").alias("ys"))
    first = by.agg(F.min("pid").alias("first"), F.count("*").alias("n"))
    copies = first.where("n > 1").select("run_id", "sp", "name", "xs", "ys", "first")
    rows = places.select("run_id", "sp", own.alias("name"), F.col("x").alias("xs"), F.col("y").alias("ys"), "pid")
    second = rows.join(copies, ["run_id", "sp", "name", "xs", "ys"]).where("pid > first").groupBy("run_id", "sp", "name", "xs", "ys").agg(F.min("pid").alias("by"))
    targets = first.select("run_id", "sp", "name", "xs", "ys", F.col("first").alias("by")).unionByName(second)
    d = F.hypot(F.col("x") - F.col("xs"), F.col("y") - F.col("ys"))
    met = named.join(targets, ["run_id", "sp", "name"]).where((F.col("pid") != F.col("by")) & (d < SEPARATION_M))
    best = met.groupBy("pid").agg(F.first("suppression_distance_m").alias("recorded"), F.min(F.struct(F.col("by"), d.alias("d"))).alias("b"))
    return best.where(wrong(F.col("recorded"), F.col("b.d"))).select("pid", F.col("b.by").alias("by"))


def misplaced(places: DataFrame, regions: DataFrame) -> DataFrame:
    edges = spatial.edges_of(regions.where(F.col("macrocluster_id").isNotNull()).select(F.col("macrocluster_id").alias("holder"), "geometry"), "holder", "geometry")
    held = spatial.containing(places, edges, "holder")
    return places.select("pid", "macrocluster_id").join(held, "pid").where(~F.col("macrocluster_id").eqNullSafe(F.col("holder"))).select("pid", "holder")


def misjudged_roads(stands: DataFrame, roads: DataFrame) -> DataFrame:
    lines = spatial.segments_of(roads.where(F.col("car_class").isin(*CAR_CLASSES)), "road_id", "geometry")
    points = stands.select(F.col("fid").alias("pid"), "x", "y", "nearest_car_road_m")
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    found = spatial.nearest(points, lines, "road_id")
    return points.select("pid", "nearest_car_road_m").join(found, "pid").where(F.col("road_id").isNotNull() & wrong(F.col("nearest_car_road_m"), F.col("distance"))).select("pid", "road_id")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """relation, key_a, key_b: what TESTDATA.md defines; rows without place form no case."""
    places = candidate_places(table(spark, folder, "scout_candidates"))
    parts = {
        "near": near(places),
        "suppressed": suppressed(places),
        "region": misplaced(places, table(spark, folder, "macroclusters")),
        "road": misjudged_roads(table(spark, folder, "eraldis"), table(spark, folder, "roads")),
    }
    return reduce(DataFrame.unionAll, [d.select(F.lit(k).alias("relation"), *[d[c].cast("long").alias(n) for c, n in zip(d.columns, ("key_a", "key_b"))]) for k, d in parts.items()])
