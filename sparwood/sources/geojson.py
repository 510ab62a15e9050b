"""GeoJSON files: reading feature collections and newline-delimited features, writing one feature a line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import ESTONIA, Projection, inverse

#: Any geometry: its kind, and its coordinates as text, which differ in depth.
_GEOMETRY = "struct<type: string, coordinates: string>"


def read_geojson(spark: SparkSession, path: str, properties: str, lines: bool = False) -> DataFrame:
    """Properties (a DDL of the wanted ones only), geometry_type and coordinates (JSON text) of every feature.

    A collection is one document per file; with lines every line is a feature, which Spark can split.
    """
    feature = f"struct<properties: struct<{properties}>, geometry: {_GEOMETRY}>"
    if lines:
        df = spark.read.schema(f"properties struct<{properties}>, geometry {_GEOMETRY}").json(path)
        f = df.select(F.struct("properties", "geometry").alias("f"))
    else:
        f = spark.read.schema(f"features array<{feature}>").json(path, multiLine=True).select(F.explode("features").alias("f"))
    return f.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def point(coordinates: Column) -> tuple[Column, Column]:
    c = F.from_json(coordinates, "array<double>")
    return F.get(c, F.lit(0)), F.get(c, F.lit(1))


def polygons(kind: Column, coordinates: Column) -> Column:
    """array<array<array<struct<x, y>>>> of an area's parts, each its rings, the shell first; null for other kinds."""
    one = F.array(F.from_json(coordinates, "array<array<array<double>>>"))
    many = F.from_json(coordinates, "array<array<array<array<double>>>>")
    point_ = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))
    parts = F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many)
    return F.transform(parts, lambda rings: F.transform(rings, lambda r: F.transform(r, point_)))


def shells(kind: Column, coordinates: Column) -> Column:
    """array<array<struct<x, y>>>: the shell of every part of an area; null for other kinds."""
    return F.transform(polygons(kind, coordinates), lambda rings: F.get(rings, F.lit(0)))


def geometry_json(wkt: Column) -> Column:
    """GeoJSON of WKT (points, lines, areas and their MULTI forms, an SRID prefix, two coordinates of each position); null for empty or null."""
    text = F.regexp_replace(F.upper(F.trim(wkt)), r"^SRID=\d+;\s*", "")
    names = ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon")
    word = F.regexp_extract(text, r"^([A-Z]+)", 1)
    kind = F.coalesce(*[F.when(word == n.upper(), F.lit(n)) for n in names])
    positions = F.regexp_replace(F.regexp_extract(text, r"(?s)\(.*\)", 0), r"([-+0-9.eE]+)\s+([-+0-9.eE]+)(?:\s+[-+0-9.eE]+)*", "[$1,$2]")
    nested = F.translate(F.regexp_replace(positions, r"\s+", ""), "()", "[]")
    # A point's brackets are its position's own; a multipoint's members may have brackets of their own or none.
    flat = F.when(kind == "Point", F.regexp_replace(nested, r"^\[(.*)\]$", "$1")).when(kind == "MultiPoint", F.regexp_replace(nested, r"\[(\[[^\[\]]+\])\](?=[,\]])", "$1")).otherwise(nested)
    single = F.when((kind == "MultiPoint") & ~flat.startswith("[["), F.concat(F.lit("["), flat, F.lit("]"))).otherwise(flat)
    return F.when(kind.isNotNull() & positions.contains("["), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), single, F.lit("}")))


def write_shapes(df: DataFrame, path: str, wkt: str) -> None:
    """Shapes (WKT in degrees) as one feature a line; all other columns are its properties, nulls included."""
    props = F.to_json(F.struct(*[c for c in df.columns if c != wkt]), {"ignoreNullFields": "false"})
    line = F.concat(F.lit('{"type":"Feature","properties":'), props, F.lit(',"geometry":'), F.coalesce(geometry_json(F.col(wkt)), F.lit("null")), F.lit("}"))
    df.select(line.alias("value")).write.mode("error").text(path)


def write_metric(df: DataFrame, path: str, x: str, y: str, crs: Projection = ESTONIA) -> None:
    """Points in metres of a projection, written in degrees as GeoJSON wants them."""
    lon, lat = inverse(F.col(x), F.col(y), crs)
    write_geojson(df.withColumns({x: lon, y: lat}), path, x, y)


def write_geojson(df: DataFrame, path: str, x: str, y: str) -> None:
    """Points in degrees as one feature a line; all other columns are its properties, nulls included."""
    props = [c for c in df.columns if c not in (x, y)]
    geometry = F.when(
        F.col(x).isNotNull() & F.col(y).isNotNull(), F.struct(F.lit("Point").alias("type"), F.array(F.col(x).cast("double"), F.col(y).cast("double")).alias("coordinates"))
    )
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(*props).alias("properties"), geometry.alias("geometry"))
    df.select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("value")).write.mode("error").text(path)
