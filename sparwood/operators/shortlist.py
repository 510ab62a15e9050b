"""From pairs of stands to ranked, spaced candidates and a daily state per region."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import priors as P
from ..functions import scoring as S
from ..session import stored
from .composition import sides
from .suppression import suppress


def best_access(edges: DataFrame, access: DataFrame) -> DataFrame:
    """Adds the better side's access: a null score counts as 0, ties go to side a; eligible only within the cap.

    access: id, access_score, access_confidence, access_reason, nearest_car_road_m.
    """
    return reached(sides(edges, access.select("id", "access_score", *_ACCESS))).drop("_a", "_b")


_ACCESS = ["access_confidence", "access_reason", "nearest_car_road_m"]


def reached(e: DataFrame) -> DataFrame:
    """:func:`best_access` of edges that have their sides."""
    sa, sb = (F.coalesce(F.col(f"_{k}.access_score"), F.lit(0.0)) for k in "ab")
    e = e.withColumns({"access_modifier": F.greatest(sa, sb), **{c: F.when(sa >= sb, F.col(f"_a.{c}")).otherwise(F.col(f"_b.{c}")) for c in _ACCESS}})
    d = F.col("nearest_car_road_m")
    return e.withColumn("scout_eligible", d.isNotNull() & (d <= P.ACCESS_CAP_M))


def mean_fruiting(edges: DataFrame, weather: DataFrame) -> DataFrame:
    """Adds fruiting_{species} as the mean of both stands, worst quality, least coverage and earliest time; strict on both.

    Columns that weather lacks come out null, whatever edges had before.
    """
    return fruited(sides(edges, weather), set(weather.columns)).drop("_a", "_b")


def fruited(e: DataFrame, have: set[str]) -> DataFrame:
    """:func:`mean_fruiting` of edges that have their sides with the columns ``have``."""
    wanted = [f"fruiting_{s}" for s in P.SPECIES]
    whole = {"quality", "coverage", "as_of"} <= have

    def strict(c: str, f: Callable[[Column, Column], Column], kind: str, known: bool) -> Column:
        a, b = (F.col(f"_{k}.{c}") if known else F.lit(None) for k in "ab")
        return (F.when(a.isNotNull() & b.isNotNull(), f(a, b)) if known else F.lit(None)).cast(kind)

    out = {c: strict(c, lambda x, y: (x + y) / 2, "double", c in have) for c in wanted}
    out |= {"weather_quality": strict("quality", S.worst_quality, "string", whole), "weather_coverage": strict("coverage", F.least, "double", whole)}
    return e.withColumns(out | {"weather_as_of": strict("as_of", F.least, "timestamp_ntz", whole)})


def by_species(edges: DataFrame) -> DataFrame:
    """One row per edge and species: species, ecotone, fruiting, and score where eligible and complete."""
    one = F.explode(F.array(*[F.struct(F.lit(s).alias("species"), F.col(f"ecotone_{s}").alias("ecotone"), F.col(f"fruiting_{s}").alias("fruiting")) for s in P.SPECIES]))
    drop = [c for c in edges.columns if c.startswith(("ecotone_", "fruiting_"))]
    long = edges.withColumn("_s", one).drop(*drop).select("*", "_s.*").drop("_s")
    return long.withColumn("scout_score", F.when(F.col("scout_eligible"), F.col("ecotone") * F.col("access_modifier") * F.col("fruiting")))


def coverage(long: DataFrame, by: list[str], *more: Column) -> DataFrame:
    """Part of the eligible pool with weather, per group; null where the pool is empty (gates read that as 1)."""
    pool = F.col("ecotone").isNotNull() & F.col("scout_eligible").eqNullSafe(F.lit(True))
    n = F.sum(pool.cast("int"))
    have = F.sum((pool & F.col("fruiting").isNotNull()).cast("int"))
    return long.groupBy(*by).agg(n.cast("bigint").alias("pool"), F.when(n > 0, have / n).alias("weather_coverage_ratio"), *more)


def gated(long: DataFrame, by: list[str]) -> DataFrame:
    """Rows of groups whose coverage passes the gate; an empty pool passes."""
    ok = coverage(long, by).where(F.coalesce("weather_coverage_ratio", F.lit(1.0)) >= P.GATE).select(*by)
    return long.join(ok, by, "left_semi")


def remote(long: DataFrame, top: int = P.REMOTE_TOP) -> DataFrame:
    """Best ecotones per species that have no score, with the reason: out of reach first, else weather is missing."""
    open_ = long.where(F.col("ecotone").isNotNull() & F.col("scout_score").isNull())
    order = Window.partitionBy("species").orderBy(F.desc("ecotone"), "id_a", "id_b")
    reason = F.when(~F.coalesce("scout_eligible", F.lit(False)), "REMOTE_BY_V1_ACCESS_PROXY").otherwise("MISSING_FRUITING_DATA")
    return open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).withColumn("exclusion_reason", reason)


def settled(long: DataFrame, bucket: list[str]) -> DataFrame:
    """The scored rows with own_id, rank_before and what suppresses them, written once for the tables that read them."""
    return stored(suppress(long.withColumn("own_id", F.concat_ws("_", "id_a", "id_b")), bucket, "scout_score", ["id_a", "id_b"], "own_id"), "settled")


def select(all_: DataFrame, bucket: list[str], top: int = P.TOP) -> tuple[DataFrame, DataFrame]:
    """Ranked candidates (rank within bucket, statistics of what they suppressed) and suppressed examples of the ranked.

    all_: the rows of :func:`settled`. The best `top` retained rows per bucket are ranked; statistics count all rows that a
    ranked one suppressed, examples are the best few of these.
    """
    order = Window.partitionBy(*bucket).orderBy(F.desc("scout_score"), "id_a", "id_b")
    ranked = all_.where("suppressed_by is null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    behind = all_.where("suppressed_by is not null")
    stats = behind.groupBy(*bucket, F.col("suppressed_by").alias("own_id")).agg(F.count("*").alias("nearby_suppressed_count"), F.max("scout_score").alias("best_suppressed_score"))
    full = ranked.join(stats, [*bucket, "own_id"], "left").withColumn("nearby_suppressed_count", F.coalesce("nearby_suppressed_count", F.lit(0).cast("long")))
    kept = behind.join(ranked.select(*bucket, F.col("own_id").alias("suppressed_by")), [*bucket, "suppressed_by"], "left_semi")
    nth = F.row_number().over(Window.partitionBy(*bucket, "suppressed_by").orderBy(F.desc("scout_score"), "id_a", "id_b"))
    return full, kept.withColumn("nth", nth).where(F.col("nth") <= P.EXAMPLES)


def tiers(parts: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    """Union of tiers with differing columns in a fixed layout; what a tier lacks is null."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [d.withColumn("tier", F.lit(k)) for k, d in parts.items()])
    return union.select(*[F.col(c) if c in union.columns else F.lit(None).alias(c) for c in columns])


def daily_state(regions: DataFrame, ranked: DataFrame, long: DataFrame, as_of: Column) -> DataFrame:
    """One row per region: as_of, edges that cross into another region, and of each species count, best score, mean of the best three, best target, coverage and status.

    Regions without candidates or pool come out too, with null (not 0) but for the counts. region is the key of all three;
    long has a row per edge and species.
    """
    order = Window.partitionBy("region", "species").orderBy(F.desc("scout_score"), "id_a", "id_b")
    best = ranked.withColumn("nth", F.row_number().over(order)).groupBy("region", "species").agg(
        F.count("*").alias("ranked_count"), F.max("scout_score").alias("top_score"), F.avg(F.when(F.col("nth") <= 3, F.col("scout_score"))).alias("top3_mean"),
        F.max(F.when(F.col("nth") == 1, F.concat_ws("_", "id_a", "id_b"))).alias("top_target"),
    )
    species = long.sparkSession.createDataFrame([(s,) for s in P.SPECIES], "species string")
    known = regions.select("region").distinct()
    per = coverage(long, ["region", "species"], F.count_if("is_cross").alias("crossing"))
    state = known.crossJoin(F.broadcast(species)).join(best, ["region", "species"], "left").join(per, ["region", "species"], "left")
    status = F.when(F.col("weather_coverage_ratio") >= P.GATE, "ok").when(F.col("weather_coverage_ratio").isNotNull(), "insufficient_coverage")
    state = state.withColumns({"ranked_count": F.coalesce("ranked_count", F.lit(0).cast("long")), "status": status})
    values = ["ranked_count", "top_score", "top3_mean", "top_target", "weather_coverage_ratio", "status"]
    of = lambda s, v: F.max(F.when(F.col("species") == s, F.col(v))).alias(f"{s}_{v}")
    # Every species has a row of every edge, so each of them counts the crossing edges.
    crossing = F.coalesce(F.max("crossing"), F.lit(0)).alias("cross_count")
    return state.groupBy("region").agg(as_of.alias("as_of"), crossing, *[of(s, v) for s in P.SPECIES for v in values])


def with_region(edges: DataFrame, region_of: DataFrame) -> DataFrame:
    """Adds the region of side a and whether side b is in another; a stand without region is an error."""
    return placed(sides(edges, region_of.select("id", "region"))).drop("_a", "_b")


def placed(e: DataFrame) -> DataFrame:
    """:func:`with_region` of edges that have their sides."""
    must = lambda k: F.coalesce(F.col(f"_{k}.region"), F.raise_error(F.lit("stand without region")).cast("long"))
    return e.withColumns({"region": must("a"), "is_cross": must("a") != must("b")})
