"""Rain and air over time, per pixel and grid cell: sums, coverage, events, rolling maxima, means.

Slots are rows (px, ts, rate); a null rate is an invalid slot, 0 a dry one. Everything of a pixel comes from one shuffle
on px; aggregates are conditional sums, events and rolling sums are window functions over the same partitioning.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import priors as P
from ..functions import scoring as S

MICROS = 1_000_000


def decode(raw: Column, gain: Column, offset: Column, nodata: Column, undetect: Column) -> Column:
    """Raster value: undetect is dry (0.0) and valid, nodata is null."""
    return F.when(raw == undetect, 0.0).when(raw == nodata, None).otherwise(raw * gain + offset)


def pixel_points(rasters: DataFrame) -> DataFrame:
    """Centres of all pixels of a georeference row (x0, y0, xscale, yscale, rows, cols), with their row and column."""
    r = rasters.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)))
    return r.withColumns({"x": F.col("x0") + (F.col("col") + 0.5) * F.col("xscale"), "y": F.col("y0") - (F.col("row") + 0.5) * F.col("yscale")})


def micros(c: str) -> Column:
    """Microseconds of a timestamp without zone, independent of the session."""
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {c})")


def at(text: str) -> Column:
    return F.expr(f"timestamp_ntz'{text}'")


def hours_before(now: str, c: str) -> Column:
    return (F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', timestamp_ntz'{now}')") - micros(c)) / (3600.0 * MICROS)


def window(slots: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Slots in [now - days, now)."""
    return slots.where((F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {days} DAY")) & (F.col("ts") < at(now)))


def sums(slots: DataFrame, now: str, expected: dict[int, int] | None = None) -> DataFrame:
    """Per pixel: rain and coverage of 3, 7 and 14 days, wet hours of 72 h, hours since any rain (null: never)."""
    expected = expected or P.SLOTS
    mm = F.coalesce(F.col("rate"), F.lit(0.0)) * P.SLOT_HOURS
    since = lambda d: F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {d} DAY")
    wet = F.coalesce(F.col("rate") > 0, F.lit(False))
    out = []
    for d, n in expected.items():
        out.append(F.sum(F.when(since(d), mm).otherwise(0.0)).alias(f"rain_{d}d_mm"))
        out.append(F.least(F.lit(1.0), F.sum(F.when(since(d) & F.col("rate").isNotNull(), 1).otherwise(0)) / n).alias(f"coverage_{d}d"))
    out.append((F.sum(F.when(since(3) & wet, 1).otherwise(0)) * P.SLOT_HOURS).alias("wet_hours_72h"))
    out.append(F.max(F.when(wet, F.col("ts"))).alias("last_wet"))
    return window(slots, now).groupBy("px").agg(*out).withColumn("hours_since_any_rain", hours_before(now, "last_wet"))


def events(slots: DataFrame, now: str) -> DataFrame:
    """Rain events per pixel: a wet slot more than the dry gap after the last wet one begins a new event."""
    wet = window(slots, now).where("rate > 0").withColumn("us", micros("ts"))
    by = Window.partitionBy("px").orderBy("us")
    gap = F.col("us") - F.lag("us").over(by)
    new = (gap.isNull() | (gap > P.DRY_GAP_HOURS * 3600 * MICROS)).cast("int")
    numbered = wet.withColumn("new", new).withColumn("event_no", F.sum("new").over(by.rangeBetween(Window.unboundedPreceding, Window.currentRow)).cast("int"))
    return numbered.groupBy("px", "event_no").agg(
        F.min("ts").alias("began"), F.max("ts").alias("ended"), F.count("*").alias("slots"), (F.sum("rate") * P.SLOT_HOURS).alias("event_mm")
    )


def last_event(slots: DataFrame, now: str, name: str, at_least: float) -> DataFrame:
    """Per wet pixel the end and rain of its last event of at least so many mm; hours null and mm 0.0 if there was none."""
    big = F.col("event_mm") >= at_least
    e = events(slots, now).groupBy("px").agg(F.max(F.when(big, F.col("ended"))).alias("ended"), F.max_by("event_mm", F.when(big, micros("ended"))).alias("mm"))
    return e.select("px", hours_before(now, "ended").alias(f"hours_since_{name}_rain"), F.coalesce("mm", F.lit(0.0)).alias(f"last_{name}_mm"))


def max_24h(slots: DataFrame, now: str) -> DataFrame:
    """Per pixel the largest sum of 24 h, both ends included, at any slot; 0 at least."""
    by = Window.partitionBy("px").orderBy("us").rangeBetween(-24 * 3600 * MICROS, 0)
    mm = F.coalesce(F.col("rate"), F.lit(0.0)) * P.SLOT_HOURS
    rolled = window(slots, now).withColumn("us", micros("ts")).withColumn("day_mm", F.sum(mm).over(by))
    return rolled.groupBy("px").agg(F.greatest(F.max("day_mm"), F.lit(0.0)).alias("max_24h_rain_14d"))


def features(slots: DataFrame, now: str, expected: dict[int, int] | None = None) -> DataFrame:
    out = sums(slots, now, expected)
    for part in (last_event(slots, now, "significant", P.SIGNIFICANT_MM), last_event(slots, now, "strong", P.STRONG_MM), max_24h(slots, now)):
        out = out.join(part, "px", "left")
    return out.withColumns({f"last_{n}_mm": F.coalesce(f"last_{n}_mm", F.lit(0.0)) for n in ("significant", "strong")})


def bins(f: DataFrame) -> DataFrame:
    """Rain by age without overlap, from windows that are covered well enough; else null."""
    r = {d: S.if_covered(F.col(f"rain_{d}d_mm"), F.col(f"coverage_{d}d")) for d in (3, 7, 14)}
    return f.withColumns({"rain_0_3d_mm": r[3], "rain_3_7d_mm": S.rain_bin(r[7], r[3]), "rain_7_14d_mm": S.rain_bin(r[14], r[7])})


def air(hours: DataFrame, local_shift_hours: int | None = None, zone: str = "Europe/Tallinn") -> DataFrame:
    """Per cell the means of temperature and humidity over all hours and over the nights (21 to 6 local time).

    hours: cell, hour (UTC), temp, rh. local_shift_hours replaces the zone by a fixed shift.
    """
    if local_shift_hours is None:
        local = F.hour(F.from_utc_timestamp(F.col("hour").cast("timestamp"), zone))
    else:
        local = F.hour(F.expr(f"hour + INTERVAL {local_shift_hours} HOUR"))
    night = (local >= 21) | (local < 6)
    return hours.groupBy("cell").agg(
        F.avg("temp").alias("temp_mean"), F.avg(F.when(night, F.col("temp"))).alias("temp_night"),
        F.avg("rh").alias("rh_mean"), F.avg(F.when(night, F.col("rh"))).alias("rh_night"),
    )


def hour_series(spark: SparkSession, now: str, hours: int = P.MET_HOURS) -> DataFrame:
    """hour: the last so many full hours up to now, that of now included."""
    return spark.range(hours).select(F.expr(f"timestampadd(HOUR, cast(-id as int), date_trunc('hour', timestamp_ntz'{now}'))").cast("timestamp_ntz").alias("hour"))


def hour_coverage(hours: DataFrame, now: str, expected: int = P.MET_HOURS) -> DataFrame:
    """One row: hours fetched as a part of those expected, and the age of the newest."""
    return hours.agg((F.countDistinct("hour") / expected).alias("met_coverage"), F.max("hour").alias("newest")).select("met_coverage", hours_before(now, "newest").alias("met_age_hours"))


