"""Rain rasters on a file system: names, listings, windows and decoding.

Files are named by time (``20240131T101500Z_RATE.h5``). The pixel values land as rows of a parquet table (row, col, ts,
raw, gain, offset, nodata, undetect), since no HDF5 library is at hand; a reader of another format plugs in there.
"""

from __future__ import annotations

import os
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs
from ..functions import scoring as S
from ..operators.rain import at, decode
from .features import fetch

_KEY = r"@(\d{8}T\d{4})@0@RATE\.h5$"
_NAME = r"(\d{8}T\d{6})Z_RATE\.h5$"
_HDF5 = "894844460D0A1A0A"


def key_time(key: Column) -> Column:
    """Time in an object's key; a key of another form is an error."""
    text = F.regexp_extract(key, _KEY, 1)
    return F.when(text != "", F.to_timestamp_ntz(text, F.lit("yyyyMMdd'T'HHmm"))).otherwise(F.raise_error(F.concat(F.lit("not a raster key: "), key)).cast("timestamp_ntz"))


def file_name(ts: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd'T'HHmmss"), F.lit("Z_RATE.h5"))


def name_time(path: Column) -> Column:
    """Time in a file's name; null for other names."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(path, _NAME, 1), F.lit("")), F.lit("yyyyMMdd'T'HHmmss")).cast("timestamp_ntz")


def listed(spark: SparkSession, path: str) -> DataFrame:
    """key, ts of the rain rasters in bucket listings (XML); other keys are passed over, an empty listing is no error."""
    keys = F.explode(F.regexp_extract_all("value", F.lit(r"<Key>([^<]+)</Key>"), F.lit(1)))
    k = spark.read.text(path, wholetext=True).select(keys.alias("key")).where(F.col("key").rlike(_KEY))
    return k.withColumn("ts", key_time(F.col("key")))


#: Days that the rolling bucket serves; older ones are in the archive.
RECENT_HOURS = 24
BUCKETS = ("recent", "archive")


def days_due(spark: SparkSession, since: str, now: str) -> DataFrame:
    """day, bucket: the days of [since, now] and the bucket that serves each."""
    days = F.explode(F.sequence(F.to_date(at(since)), F.to_date(at(now))))
    d = spark.range(1).select(days.alias("day"))
    recent = F.col("day") >= F.to_date(F.expr(f"timestamp_ntz'{now}' - INTERVAL {RECENT_HOURS} HOUR"))
    return d.withColumn("bucket", F.when(recent, BUCKETS[0]).otherwise(BUCKETS[1]))


def objects_due(days: DataFrame, list_url: str, since: str, now: str, attempts: int = 3) -> DataFrame:
    """bucket, key, ts of the rain rasters of [since, now], both included, by the listings of each day; a day without objects is no error.

    list_url: text with {bucket} and {prefix}, which is year/month/day. Each day is one request of the task that holds it.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [fetch(list_url.format(bucket=b, prefix=f"{d:%Y/%m/%d}"), attempts).decode() for d, b in zip(rows["day"], rows["bucket"])]
            yield pd.DataFrame({"bucket": rows["bucket"], "value": texts})

    keys = F.explode(F.regexp_extract_all("value", F.lit(r"<Key>([^<]+)</Key>"), F.lit(1)))
    k = days.select("day", "bucket").repartition("day").mapInPandas(run, "bucket string, value string").select("bucket", keys.alias("key")).where(F.col("key").rlike(_KEY))
    return k.withColumn("ts", key_time(F.col("key"))).where((F.col("ts") >= at(since)) & (F.col("ts") <= at(now)))


def download(objects: DataFrame, base_url: str, folder: str, attempts: int = 3) -> DataFrame:
    """path, fetched of every object's file in the folder, which all tasks share: those that are there already aren't fetched again.

    A body without the HDF5 signature is an error. A file is written beside its name and then renamed, so that none is ever
    seen in part, whatever task is lost or runs twice.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for rows in batches:
            out = []
            for bucket, key, name in rows.itertuples(index=False):
                path = os.path.join(folder, name)
                if there := os.path.exists(path):
                    out.append((path, False))
                    continue
                body = fetch(f"{base_url}{bucket}/{key}", attempts)
                if body[:8].hex().upper() != _HDF5:
                    raise ValueError(f"not an HDF5 file: {key}, {len(body)} bytes")
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(body)
                os.replace(part, path)
                out.append((path, not there))
            yield pd.DataFrame(out, columns=["path", "fetched"])

    return objects.select("bucket", "key", file_name(F.col("ts")).alias("name")).dropDuplicates(["name"]).mapInPandas(run, "path string, fetched boolean")


def expire(spark: SparkSession, folder: str, cutoff: str) -> DataFrame:
    """path of the files older than the cutoff, which are deleted by the tasks that hold them when this is run; other files stay. A file already gone is none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            gone = []
            for p in rows["path"]:
                try:
                    os.remove(p.removeprefix("file:"))
                    gone.append(p)
                except FileNotFoundError:
                    pass
            yield pd.DataFrame({"path": gone})

    return files(spark, folder).where(F.col("ts") < at(cutoff)).select("path").mapInPandas(run, "path string")


def files(spark: SparkSession, folder: str) -> DataFrame:
    """path, ts of the rain rasters in a folder; no file is opened, others aren't seen."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*_RATE.h5").load(folder)
    return f.select("path", name_time(F.col("path")).alias("ts")).where(F.col("ts").isNotNull())


def cached(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """path, ts of the files in [start, end), by time."""
    return files(spark, folder).where((F.col("ts") >= at(start)) & (F.col("ts") < at(end))).orderBy("ts")


def checked(df: DataFrame) -> DataFrame:
    """Adds valid: the HDF5 signature is there. Eight bytes of each file are read."""

    def valid(path: str) -> bool:
        with open(path.removeprefix("file:"), "rb") as f:
            return f.read(8).hex().upper() == _HDF5

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(valid=[valid(p) for p in rows["path"]])

    return df.mapInPandas(run, ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", valid boolean")


def file_coverage(df: DataFrame, now: str, expected: dict[int, int]) -> DataFrame:
    """One row: of each window of days (before now) the files (ts) there are as a part of those expected; more than all is an error."""
    n = {d: F.count_if((F.col("ts") >= F.expr(f"timestamp_ntz'{now}' - INTERVAL {d} DAY")) & (F.col("ts") < at(now))) for d in expected}
    return df.agg(*[S.coverage(c / expected[d]).alias(f"coverage_{d}d") for d, c in n.items()])


def georefs(spark: SparkSession, path: str) -> DataFrame:
    """Georeferences landed as JSON (projdef, xsize, ysize, xscale, yscale, ul_lon, ul_lat)."""
    return spark.read.schema("projdef string, xsize int, ysize int, xscale double, yscale double, ul_lon double, ul_lat double").json(path)


def area_slice(georef: dict, spark: SparkSession, bounds: tuple[float, float, float, float], buffer: int = 5) -> tuple[int, int, int, int]:
    """First and last row and column (last excluded) of the pixels around an area in degrees (west, south, east, north), within the raster.

    The corners are projected into the raster's plane and the range is widened by some pixels; it becomes a filter of :func:`slots`.
    """
    plane = crs.parse(georef["projdef"])
    west, south, east, north = bounds
    corners = [(georef["ul_lon"], georef["ul_lat"]), (west, south), (east, south), (west, north), (east, north)]
    at_ = [F.struct(*[c.alias(n) for c, n in zip(crs.forward(F.lit(lon), F.lit(lat), plane), "xy")]) for lon, lat in corners]
    (x0, y0), *rest = [tuple(p) for p in spark.range(1).select(F.array(*at_).alias("p")).first().p]
    cols, rows = [(x - x0) / georef["xscale"] for x, _ in rest], [(y0 - y) / georef["yscale"] for _, y in rest]
    lo, hi = (lambda v: max(0, int(min(v)) - buffer)), (lambda v, n: min(n, int(max(v)) + buffer + 1))
    return lo(rows), hi(rows, georef["ysize"]), lo(cols), hi(cols, georef["xsize"])


def pixel_places(pixels: DataFrame, georef: dict) -> DataFrame:
    """Adds x, y (national grid) of the centres of pixels with row and col."""
    plane = crs.parse(georef["projdef"])
    x0, y0 = crs.forward(F.lit(georef["ul_lon"]), F.lit(georef["ul_lat"]), plane)
    x, y = x0 + (F.col("col") + 0.5) * georef["xscale"], y0 - (F.col("row") + 0.5) * georef["yscale"]
    east, north = crs.reproject(x, y, plane)
    return pixels.withColumns({"x": east, "y": north})


def quality(raw: Column, gain: Column, offset: Column) -> Column:
    """A quality layer's value; null, not 0, for a file without one."""
    return raw * F.coalesce(gain, F.lit(1.0)) + F.coalesce(offset, F.lit(0.0))


def mean_quality(landed: DataFrame) -> DataFrame:
    """px, quality_mean over the files that bear quality (column quality); null where none does."""
    return landed.groupBy("px").agg(F.avg(F.when(~F.isnan("quality"), F.col("quality"))).alias("quality_mean"))


def newest(files: DataFrame) -> DataFrame:
    return files.agg(F.max("ts").alias("ts"))


def slots(landed: DataFrame, min_row: int, max_row: int, min_col: int, max_col: int) -> DataFrame:
    """px, ts, rate of the pixels in an area; the range filter reaches the files."""
    a = landed.where(F.col("row").between(min_row, max_row) & F.col("col").between(min_col, max_col))
    rate = decode(F.col("raw"), F.col("gain"), F.col("offset"), F.col("nodata"), F.col("undetect"))
    return a.select((F.col("row").cast("long") * (1 << 20) + F.col("col")).alias("px"), "ts", rate.alias("rate"))


def hour_url(hour: Column, template: str) -> Column:
    """Address of an hour's file: {year}, {month}, {day} and {hour} of a template, padded with zeros."""
    parts = {"{year}": "yyyy", "{month}": "MM", "{day}": "dd", "{hour}": "HH"}
    url = F.lit(template)
    for name, form in parts.items():
        url = F.replace(url, F.lit(name), F.date_format(hour, form))
    return url


def hourly(hours: DataFrame, archive: DataFrame, latest: DataFrame) -> DataFrame:
    """Grid rows of the wanted hours: those of the archive, else of the latest analysis, but only if it is of that very hour.

    hours: hour; archive and latest: hour and the grid's columns. Hours that neither has are left out.
    """
    filed = archive.join(hours.select("hour").distinct(), "hour", "left_semi")
    missing = hours.select("hour").distinct().join(filed.select("hour").distinct(), "hour", "left_anti")
    return filed.unionByName(latest.join(missing, "hour", "left_semi"))


def air_points(grid: DataFrame, plane: crs.Projection = crs.NORDIC) -> DataFrame:
    """Kelvin as degrees, fractions as per cent; x and y, if there, from the model's plane to the national grid."""
    out = grid.withColumns({"temp": F.col("air_temperature_2m") - 273.15, "rh": F.col("relative_humidity_2m") * 100})
    if {"x", "y"} <= set(grid.columns):
        x, y = crs.reproject(F.col("x"), F.col("y"), plane)
        out = out.withColumns({"x": x, "y": y})
    return out


def home(path: str) -> tuple[float, float]:
    """Latitude and longitude of a configuration file; a missing one is an error that says what to write."""
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"{p}: write it with home_lat and home_lon")
    c = tomllib.loads(p.read_text())
    return float(c["home_lat"]), float(c["home_lon"])
