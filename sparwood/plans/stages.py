"""The stages from tables to candidates: each is built once from those before it, kept, and read by those after it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import priors as P
from ..functions import scoring as S
from ..operators import components as G
from ..operators import composition as C
from ..operators import rain, spatial
from ..operators import shortlist as L
from ..session import stored
from .views import FLAGSHIP_SLOTS, NOW, SEASON_DAY, view

#: Half the box around a stand's place, in which its rain is measured, and how far the nearest pixel may be: theirs are sparse here.
BOX_M, FALLBACK_M = (700.0, 300.0), 3000.0
#: Pixels' values that stands get by place.
RAIN = ["rain_3d_mm", "rain_7d_mm", "rain_14d_mm", "coverage_3d", "coverage_7d", "coverage_14d", "wet_hours_72h", "hours_since_any_rain", "hours_since_significant_rain"]
AIR = ["temp_mean", "temp_night", "rh_mean", "rh_night"]


class Stages:
    """Tables by stage over one folder; ``keep`` writes a stage and reads it back (by default into the shared folder)."""

    def __init__(self, spark: SparkSession, folder: str, keep: Callable[[DataFrame, str], DataFrame] = stored):
        self.spark, self.folder, self.keep = spark, folder, keep
        self.tables: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        return view(self.spark, self.folder, name)

    def __getitem__(self, name: str) -> DataFrame:
        """A stage as a table, written at its first use."""
        if name not in self.tables:
            self.tables[name] = self.keep(BUILD[name](self), name)
        return self.tables[name]

    def together(self, *names: str) -> None:
        """Write stages that don't need each other at the same time, so that their many small jobs share the cluster."""
        todo = [n for n in names if n not in self.tables]
        with ThreadPoolExecutor(max(1, len(todo))) as pool:
            for done in [pool.submit(inheritable_thread_target(self.spark)(lambda n=n: self[n])) for n in todo]:
                done.result()

    def plan(self, name: str) -> DataFrame:
        """A stage that is read once only, and so needn't be written."""
        return self.tables[name] if name in self.tables else BUILD[name](self)


def stands(s: Stages) -> DataFrame:
    """Fractions and habitat scores of every stand, with its place and codes."""
    return C.stand_scores(C.fractions(s.view("stand"), s.view("element")))


def road_points(s: Stages) -> DataFrame:
    p = s.view("road")
    return p.select("rid", "car_class", F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))


def nearest_roads(s: Stages, classes: tuple[str, ...]) -> DataFrame:
    points = s.view("stand").select(F.col("id").alias("pid"), "x", "y")
    return spatial.nearest(points, road_points(s).where(F.col("car_class").isin(*classes)), "rid")


def access(s: Stages) -> DataFrame:
    near = nearest_roads(s, P.CAR_CLASSES).join(s.view("road").select("rid", "car_class"), "rid", "left")
    d = F.col("distance")
    return near.select(
        F.col("pid").alias("id"), d.alias("nearest_car_road_m"), S.access_score(d).alias("access_score"), F.col("car_class").alias("access_confidence"),
        S.access_reason(d, F.col("car_class")).alias("access_reason"),
    )


def met(s: Stages) -> DataFrame:
    """One row: how many of the last 72 hours the air model has, and the age of the newest."""
    return rain.hour_coverage(s.view("met").where(F.col("hour") >= F.expr(f"timestamp_ntz'{NOW}' - INTERVAL 72 HOUR")), NOW)


def weather(s: Stages) -> DataFrame:
    """Weather of every stand by place: rain of the pixels in its box, or else of the nearest; air of the nearest grid cell.

    Values of windows that are covered too little are null, air's too if the model is stale; a stand without pixels has
    coverage 0; a coverage outside 0 to 1 is an error.
    """
    x, y = F.col("x"), F.col("y")
    zones = s.view("stand").select(F.col("id").alias("zid"), "x", "y", (x - BOX_M[0]).alias("xmin"), (x + BOX_M[0]).alias("xmax"), (y - BOX_M[1]).alias("ymin"), (y + BOX_M[1]).alias("ymax"))
    pixels = s.view("pixel").join(rain.features(s.view("slot"), NOW, FLAGSHIP_SLOTS), "px", "left")
    wet = spatial.zonal_means(zones, pixels, RAIN, FALLBACK_M, 1000.0).withColumnRenamed("zid", "id")
    # Means of fractions hang on the order of their sums in the last bits, which a gate must not.
    wet = wet.withColumns({c: S.coverage(F.round(c, 12)) for c in RAIN if c.startswith("coverage")})
    grid = s.view("met_cell").select("cell", *[F.col(a).alias(f"{a}{n}") for n in (1, 2) for a in "xy"])
    place = spatial.nearest(s.view("stand").select(F.col("id").alias("pid"), "x", "y"), grid, "cell").select(F.col("pid").alias("id"), "cell")
    air = place.join(rain.air(s.view("met"), 2), "cell", "left").drop("cell")
    cov = {n: F.col(f"coverage_{n}d") for n in (3, 7, 14)}
    w = rain.bins(wet.join(air, "id", "left").crossJoin(F.broadcast(met(s))))
    fresh = F.coalesce((F.col("met_age_hours") <= P.STALE_HOURS) & (F.col("met_coverage") >= P.MIN_COVERAGE), F.lit(False))
    gates = {"wet_hours_72h": 3, "rain_3d_mm": 3, "rain_7d_mm": 7, "rain_14d_mm": 14, "hours_since_any_rain": 14, "hours_since_significant_rain": 14}
    w = w.withColumns({c: S.if_covered(F.col(c), cov[n]) for c, n in gates.items()} | {c: F.when(fresh, F.col(c)) for c in AIR})
    quality = S.data_quality(cov, F.col("met_age_hours"), F.col("met_coverage"))
    return w.withColumns({"quality": quality, "coverage": cov[14], "as_of": F.expr(f"timestamp_ntz'{NOW}'")}).drop("met_age_hours", "met_coverage")


def fruiting(s: Stages) -> DataFrame:
    w = s.plan("weather")
    bins = [F.col(c) for c in ("rain_0_3d_mm", "rain_3_7d_mm", "rain_7_14d_mm")]
    w = w.withColumns({"temperature": S.temperature_modifier(F.col("temp_mean"), F.col("temp_night")), "persistence": S.persistence_modifier(F.col("rh_night"), F.col("wet_hours_72h"), F.col("hours_since_significant_rain"))})
    w = w.withColumns({f"moisture_{k}": S.moisture_trigger(k, bins) for k in P.SPECIES})
    w = w.withColumns({f"fruiting_{k}": S.season_prior(k, SEASON_DAY) * F.col(f"moisture_{k}") * F.col("temperature") * F.col("persistence") for k in P.SPECIES})
    return w.select("id", "quality", "coverage", "as_of", "temperature", "persistence", *[f"{n}_{k}" for n in ("moisture", "fruiting") for k in P.SPECIES])


def facts(s: Stages) -> DataFrame:
    """All that pairs need to know of a stand, one row each."""
    s.together("stands", "access", "fruiting")
    f = s.plan("fruiting").drop("temperature", "persistence", *[f"moisture_{k}" for k in P.SPECIES])
    base = s.plan("stands").drop(*[f"{t}_share" for t in (*P.TREES, "total")])
    return base.join(s.plan("access"), "id", "left").join(f, "id", "left").join(s.view("region_of"), "id", "left")


def ecotones(s: Stages) -> DataFrame:
    """Pairs of stands with contrasts, scores, access, weather, region and place: one join per side."""
    known = s["facts"]
    e = L.placed(L.fruited(L.reached(C.contrasted(C.sides(s.view("edge"), known))), set(known.columns)))
    return e.withColumns({v: (F.col(f"_a.{v}") + F.col(f"_b.{v}")) / 2 for v in "xy"}).drop("_a", "_b")


def candidates(s: Stages) -> DataFrame:
    """A row per pair and species."""
    keep = ["id_a", "id_b", "region", "is_cross", "x", "y", "access_modifier", "scout_eligible"]
    long = L.by_species(s.plan("ecotones").select(*keep, *[f"ecotone_{k}" for k in P.SPECIES], *[f"fruiting_{k}" for k in P.SPECIES]))
    # Scores are compared and ranked at a fixed precision, so that ties don't hang on the last bits.
    return long.withColumn("scout_score", F.round("scout_score", 6))


def blocks(s: Stages) -> DataFrame:
    return G.numbered(G.components(s.view("stand"), s.view("edge")))


BUCKET = ["region", "species"]


def settled(s: Stages) -> DataFrame:
    return L.settled(L.gated(s["candidates"], BUCKET), BUCKET)


def ranked(s: Stages) -> DataFrame:
    return L.select(s["settled"], BUCKET)[0]


def examples(s: Stages) -> DataFrame:
    return L.select(s["settled"], BUCKET)[1]


def remote(s: Stages) -> DataFrame:
    return L.remote(s["candidates"])


def state(s: Stages) -> DataFrame:
    regions = s.spark.read.parquet(f"{s.folder}/nation.parquet").select(F.col("n_nationkey").alias("region"))
    return L.daily_state(regions, s.plan("ranked"), s["candidates"], F.expr(f"timestamp_ntz'{NOW}'"))


#: Stages in an order in which each only needs those before it.
BUILD: dict[str, Callable[[Stages], DataFrame]] = {
    f.__name__: f for f in (stands, access, weather, fruiting, facts, blocks, ecotones, candidates, settled, ranked, examples, remote, state)
}
