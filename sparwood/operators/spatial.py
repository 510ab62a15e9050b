"""Joins of points with points, lines and regions on metric coordinates.

All joins are equi-joins on grid cells or strips with an exact test behind them, so that Spark partitions them by key,
splits hot cells (AQE) and never pairs a side with the whole other one. A side is broadcast only when its stored size
is known to be below ``BROADCAST_BYTES``.
"""

from __future__ import annotations

from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegralType

from ..functions import wkt
from ..session import BROADCAST_BYTES, drop_stored, stored, stored_bytes


def small(df: DataFrame) -> DataFrame:
    """Hint a stored table for broadcast if its files are provably small, else leave the join to a shuffle."""
    return F.broadcast(df) if stored_bytes(df) <= BROADCAST_BYTES else df


def cell(v: Column, size: float) -> Column:
    return F.floor(v / F.lit(float(size))).cast("long")


def _clean(df: DataFrame) -> DataFrame:
    return df.where(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull() & ~F.isnan("y"))


def near_pairs(points: DataFrame, radius: float, by: list[str], inclusive: bool = False) -> DataFrame:
    """Pairs of points of equal ``by`` columns less than ``radius`` apart (``inclusive``: or exactly so).

    points has pid (unique), x, y and the columns of by; result: pid_a < pid_b, distance. Null keys or positions pair
    with nothing. Of each pair the point lower in y probes the cells of the upper half of its neighbourhood, so that a
    pair comes out once and nothing has to be made distinct.
    """
    size = 4.0 * radius
    p = _clean(points).select(*by, "pid", "x", "y").dropna(subset=by) if by else _clean(points).select("pid", "x", "y")
    right = p.select(*by, F.col("pid").alias("pid_r"), F.col("x").alias("xr"), F.col("y").alias("yr"), cell(F.col("x"), size).alias("cx"), cell(F.col("y"), size).alias("cy"))
    span = lambda lo, hi: F.sequence(cell(lo, size), cell(hi, size))
    left = p.withColumn("cx", F.explode(span(F.col("x") - radius, F.col("x") + radius))).withColumn("cy", F.explode(span(F.col("y"), F.col("y") + radius)))
    d2 = (F.col("x") - F.col("xr")) ** 2 + (F.col("y") - F.col("yr")) ** 2
    upper = (F.col("yr") > F.col("y")) | ((F.col("yr") == F.col("y")) & (F.col("pid_r") > F.col("pid")))
    close = d2 <= radius * radius if inclusive else d2 < radius * radius
    return left.join(right, [*by, "cx", "cy"]).where(upper & close).select(
        F.least("pid", "pid_r").alias("pid_a"), F.greatest("pid", "pid_r").alias("pid_b"), F.sqrt(d2).alias("distance"), *by
    )


def segments_of(lines: DataFrame, key: str, geometry: str, keep: list[str] | None = None) -> DataFrame:
    """One row per segment of each WKT line: key, x1, y1, x2, y2 and the columns to keep."""
    return lines.select(F.col(key), *(keep or []), F.explode(wkt.segments(F.col(geometry))).alias("s")).select(key, *(keep or []), "s.*")


def segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    long2 = dx * dx + dy * dy
    t = F.when(long2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - x1) * dx + (py - y1) * dy) / long2))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))


def nearest(points: DataFrame, segments: DataFrame, key: str, cell_size: float | None = None) -> DataFrame:
    """Nearest segment of every point, however far: pid, key, distance (the least of all).

    Ties to the millimetre go to the smaller key. Points (given as segments of length 0) work alike. First the 3 x 3 cells
    around a point are searched, which settles it if its distance is within a cell. The few others go down a pyramid of
    occupied cells, each level four times as fine as the one above: a cell stays if what it holds can be as near as what some other
    cell holds for sure, so that a far point meets only the segments of the few cells that can hold its nearest, never all.
    Points without position, and all points if there are no segments, come out with null key and distance. Extra columns of
    either side are ignored.
    """
    kind = segments.schema[key].dataType
    s = segments.select(key, "x1", "y1", "x2", "y2").where(F.col(key).isNotNull())
    s = stored(reduce(lambda d, c: d.where(F.col(c).isNotNull() & ~F.isnan(c)), ("x1", "y1", "x2", "y2"), s).distinct(), "segments")
    box = s.agg(
        F.count("*").alias("n"), F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"),
        F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1"),
    ).first()
    unknown = [F.lit(None).cast(kind).alias(key), F.lit(None).cast("double").alias("distance")]
    if not box["n"]:
        drop_stored(s)
        return points.select("pid", *unknown)
    width, height = box["x1"] - box["x0"], box["y1"] - box["y0"]
    size = cell_size or max((max(width, 1.0) * max(height, 1.0) / box["n"]) ** 0.5, max(width, height) / (1 << 24), 1.0)
    pieces = stored(_pieces(s, key, size), "pieces")
    near = [F.explode(F.sequence(F.col(f"c{v}") - 1, F.col(f"c{v}") + 1)).alias(f"c{v}") for v in "xy"]
    cells = pieces.select(key, "x1", "y1", "x2", "y2", near[0], "cy").select(key, "x1", "y1", "x2", "y2", "cx", near[1]).distinct()
    cells = stored(cells, "segment_cells")
    p = _clean(points).select("pid", "x", "y").withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    first = stored(_least(p.join(small(cells), ["cx", "cy"], "left"), key, kind), "nearest")
    drop_stored(cells, s)
    settled = F.coalesce(F.col("distance") + 0.001 <= size, F.lit(False))
    found = first.where(settled).select("pid", key, "distance")
    rest = first.where(~settled).select("pid", "x", "y", F.coalesce("distance", F.lit(float("inf"))).alias("bound"))
    if not rest.isEmpty():
        found = found.unionByName(_descent(rest, pieces, key, kind).select("pid", key, "distance"))
    none = points.select("pid", "x", "y").where(F.col("x").isNull() | F.isnan("x") | F.col("y").isNull() | F.isnan("y"))
    return found.unionByName(none.select("pid", *unknown))


def _pieces(s: DataFrame, key: str, size: float) -> DataFrame:
    """Segments with the cells that they, cut into pieces no longer than a cell, touch, and the box of what is there: key, x1 to y2, cx, cy, xa to yb."""
    count = F.greatest(F.lit(1), F.ceil(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) / size)).cast("int")
    cut = s.withColumn("n", count).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    at = lambda v, i: F.col(f"{v}1") + (F.col(f"{v}2") - F.col(f"{v}1")) * i / F.col("n")
    for v in "xy":
        lo, hi = at(v, F.col("i")), at(v, F.col("i") + 1)
        cut = cut.withColumns({f"{v}a": F.least(lo, hi), f"{v}b": F.greatest(lo, hi)})
    for v in "xy":
        cut = cut.withColumn(f"c{v}", F.explode(F.sequence(cell(F.col(f"{v}a"), size), cell(F.col(f"{v}b"), size))))
    return cut.select(key, "x1", "y1", "x2", "y2", "cx", "cy", "xa", "ya", "xb", "yb")


def _least(tried: DataFrame, key: str, kind: DataType) -> DataFrame:
    """pid, x, y, key, distance: of each point the segment of least millimetres, then of least key."""
    d = segment_distance(*[F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")])
    mm = F.round(d * 1000)
    by = tried.groupBy("pid", "x", "y")
    if not isinstance(kind, IntegralType):
        return by.agg(F.min(F.struct(mm.alias("mm"), F.col(key))).alias("b"), F.min(d).alias("distance")).select("pid", "x", "y", F.col(f"b.{key}").alias(key), "distance")
    # Millimetres and key in one number, so that the minimum is a hash aggregate on plain values instead of a sort of structs.
    base, shift = F.lit(Decimal(1 << 64)).cast("decimal(20,0)"), F.lit(Decimal(1 << 63)).cast("decimal(20,0)")
    packed = mm.cast("decimal(17,0)") * base + (F.col(key).cast("decimal(20,0)") + shift)
    best = by.agg(F.min(packed.cast("decimal(38,0)")).alias("best"), F.min(d).alias("distance"))
    return best.select("pid", "x", "y", (F.col("best") % base - shift).cast(kind).alias(key), "distance")


def _descent(points: DataFrame, pieces: DataFrame, key: str, kind: DataType) -> DataFrame:
    """:func:`_least` of far points (pid, x, y, bound: a distance within which there is a segment), by a pyramid of cells."""
    reach = pieces.agg(*[f(f"c{v}").alias(f"{n}{v}") for v in "xy" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    top = 0
    while any((reach[f"hi{v}"] >> 2 * top) - (reach[f"lo{v}"] >> 2 * top) > 1 for v in "xy"):
        top += 1
    up = F.col("level") * 2
    levels = pieces.select("cx", "cy", "xa", "ya", "xb", "yb").groupBy("cx", "cy").agg(*[F.min(f"{v}a").alias(f"{v}a") for v in "xy"], *[F.max(f"{v}b").alias(f"{v}b") for v in "xy"])
    levels = levels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    levels = levels.groupBy("level", *[F.call_function("shiftright", f"c{v}", up).alias(f"c{v}") for v in "xy"]).agg(
        *[F.min(f"{v}a").alias(f"{v}a") for v in "xy"], *[F.max(f"{v}b").alias(f"{v}b") for v in "xy"]
    )
    levels = stored(levels, "pyramid")
    # Four cells of the uppermost level, at most, hold everything.
    first = F.array(*[F.struct(F.lit(r["cx"]).alias("px"), F.lit(r["cy"]).alias("py")) for r in levels.where(F.col("level") == top).select("cx", "cy").collect()])
    open_ = points.withColumn("c", F.explode(first)).select("pid", "x", "y", "bound", "c.px", "c.py")
    every = Window.partitionBy("pid")
    for level in range(top, -1, -1):
        to = 0 if level == top else 2
        fine = levels.where(F.col("level") == level).select(*[F.shiftright(f"c{v}", to).alias(f"p{v}") for v in "xy"], "cx", "cy", "xa", "ya", "xb", "yb")
        met = open_.join(F.broadcast(fine) if small(levels) is not levels else fine, ["px", "py"])
        gap = {v: F.greatest(F.lit(0.0), F.col(f"{v}a") - F.col(v), F.col(v) - F.col(f"{v}b")) for v in "xy"}
        side = {v: (F.abs(F.col(v) - F.col(f"{v}a")), F.abs(F.col(v) - F.col(f"{v}b"))) for v in "xy"}
        # Every side of a box is touched by something: there is a segment no farther than the far end of the nearer side.
        sure = F.least(F.hypot(F.least(*side["x"]), F.greatest(*side["y"])), F.hypot(F.greatest(*side["x"]), F.least(*side["y"])))
        met = met.withColumns({"least": F.hypot(gap["x"], gap["y"]), "bound": F.least(F.col("bound"), F.min(sure).over(every))})
        open_ = met.where(F.col("least") <= F.col("bound") * (1 + 1e-9) + 0.002).select("pid", "x", "y", "bound", F.col("cx").alias("px"), F.col("cy").alias("py"))
    at = pieces.select(key, "x1", "y1", "x2", "y2", F.col("cx").alias("px"), F.col("cy").alias("py"))
    return _least(open_.join(F.broadcast(at) if small(pieces) is not pieces else at, ["px", "py"]), key, kind)


def edges_of(regions: DataFrame, key: str, geometry: str) -> DataFrame:
    """Edges of each region's rings (shells and holes alike, which parity treats alike)."""
    return segments_of(regions, key, geometry).where((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))


def containing(points: DataFrame, edges: DataFrame, key: str, strip: float = 1000.0, column: float = 8000.0) -> DataFrame:
    """The region that holds each point, by parity of the edges that a ray eastwards crosses: pid, key.

    Edges are binned into latitude strips, and within these into the columns that their region's bounding box touches:
    a point meets the edges of the few regions around it only, and its whole ray's. An edge counts from its lower end
    (included) to its upper end (excluded), so a corner counts once and a level edge never; a point on an edge or corner
    belongs to the region. Of several regions the smallest key counts. Points in no region give no row.
    """
    box = edges.groupBy(key).agg(F.min(F.least("x1", "x2")).alias("bx0"), F.max(F.greatest("x1", "x2")).alias("bx1"))
    binned = (
        edges.join(box, key)
        .withColumn("strip", F.explode(F.sequence(cell(F.least("y1", "y2"), strip), cell(F.greatest("y1", "y2"), strip))))
        .withColumn("col", F.explode(F.sequence(cell(F.col("bx0"), column), cell(F.col("bx1"), column))))
    )
    binned = stored(binned.select(key, "x1", "y1", "x2", "y2", "strip", "col"), "strips")
    px, py, x1, y1, x2, y2 = (F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2"))
    side = (x2 - x1) * (py - y1) - (y2 - y1) * (px - x1)
    on = (side == 0) & px.between(F.least(x1, x2), F.greatest(x1, x2)) & py.between(F.least(y1, y2), F.greatest(y1, y2))
    straddles = (y1 <= py) != (y2 <= py)
    east = F.when(y2 > y1, side < 0).otherwise(side > 0)
    p = _clean(points).select("pid", "x", "y").withColumns({"strip": cell(py, strip), "col": cell(px, column)})
    hits = p.join(small(binned), ["strip", "col"]).withColumns({"on": on, "cross": straddles & ~east}).where(F.col("on") | F.col("cross"))
    inside = hits.groupBy("pid", key).agg(F.max("on").alias("on"), F.sum(F.col("cross").cast("int")).alias("n")).where(F.col("on") | (F.col("n") % 2 == 1))
    return inside.groupBy("pid").agg(F.min(key).alias(key))


def within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Pairs of a point (pid) and another relation's point (oid) at most ``radius`` apart: pid, oid, distance."""
    size = 2.0 * radius
    o = _clean(others).select("oid", F.col("x").alias("xo"), F.col("y").alias("yo"))
    o = o.withColumn("cx", F.explode(F.sequence(cell(F.col("xo") - radius, size), cell(F.col("xo") + radius, size))))
    o = o.withColumn("cy", F.explode(F.sequence(cell(F.col("yo") - radius, size), cell(F.col("yo") + radius, size))))
    p = _clean(points).select("pid", "x", "y").withColumns({"cx": cell(F.col("x"), size), "cy": cell(F.col("y"), size)})
    d2 = (F.col("x") - F.col("xo")) ** 2 + (F.col("y") - F.col("yo")) ** 2
    return p.join(o, ["cx", "cy"]).where(d2 <= radius * radius).select("pid", "oid", F.sqrt(d2).alias("distance"))


def anti_within(points: DataFrame, others: DataFrame, radius: float) -> DataFrame:
    """Points with no other within ``radius`` (inclusive); without others nothing is dropped, nor are points without position."""
    return points.join(within(points, others, radius).select("pid").distinct(), "pid", "left_anti")


def lines_apart(segments: DataFrame, key: str, others: DataFrame, radius: float) -> DataFrame:
    """Keys of lines none of whose segments (key, x1 to y2) comes within ``radius`` (inclusive) of a point (oid, x, y).

    Segments are cut into pieces no longer than a cell, grown by the radius and met with the points of the cells they touch.
    Without points no line is dropped; lines without segments aren't in the table to begin with.
    """
    size = max(4.0 * radius, 1.0)
    o = _clean(others).select(F.col("x").alias("xo"), F.col("y").alias("yo"))
    o = o.withColumns({"cx": cell(F.col("xo"), size), "cy": cell(F.col("yo"), size)}).distinct()
    p = _pieces(segments.select(key, "x1", "y1", "x2", "y2"), key, size).drop("cx", "cy").distinct()
    for v in "xy":
        p = p.withColumn(f"c{v}", F.explode(F.sequence(cell(F.col(f"{v}a") - radius, size), cell(F.col(f"{v}b") + radius, size))))
    d = segment_distance(*[F.col(c) for c in ("xo", "yo", "x1", "y1", "x2", "y2")])
    hit = p.join(o, ["cx", "cy"]).where(d <= radius).select(key).distinct()
    return segments.select(key).distinct().join(hit, key, "left_anti")


def zonal_means(zones: DataFrame, pixels: DataFrame, values: list[str], fallback: float = 1500.0, size: float | None = None) -> DataFrame:
    """Means of the pixels inside each zone's box (bounds included), else the nearest pixel's values within ``fallback`` of its centre.

    zones: zid (unique), xmin, ymin, xmax, ymax, x, y (centre). The fallback is taken only if the box holds no pixel; null values
    are skipped by the means but count as pixels. Of equally near pixels the smaller px counts. pixels: px, x, y, values.
    Zones that meet nothing come out with nulls. size: width of the cells that boxes are met in.
    """
    size = size or fallback
    q = stored(_clean(pixels).select("px", F.col("x").alias("xp"), F.col("y").alias("yp"), *[F.col(c).alias(f"v_{c}") for c in values]), "pixels")

    def meet(z: DataFrame, size: float, reach: dict[str, tuple[Column, Column]]) -> DataFrame:
        for v, (lo, hi) in reach.items():
            z = z.withColumn(f"c{v}", F.explode(F.sequence(cell(lo, size), cell(hi, size))))
        at = q.withColumns({"cx": cell(F.col("xp"), size), "cy": cell(F.col("yp"), size)})
        return z.join(F.broadcast(at) if small(q) is not q else at, ["cx", "cy"])

    boxes = meet(zones.select("zid", "xmin", "xmax", "ymin", "ymax"), size, {v: (F.col(f"{v}min"), F.col(f"{v}max")) for v in "xy"})
    held = boxes.where(F.col("xp").between(F.col("xmin"), F.col("xmax")) & F.col("yp").between(F.col("ymin"), F.col("ymax")))
    means = stored(held.groupBy("zid").agg(*[F.avg(f"v_{c}").alias(c) for c in values]), "means")
    left = _clean(zones).select("zid", "x", "y").join(means.select("zid"), "zid", "left_anti")
    d = F.hypot(F.col("x") - F.col("xp"), F.col("y") - F.col("yp"))
    near = meet(left, fallback, {v: (F.col(v) - fallback, F.col(v) + fallback) for v in "xy"}).withColumn("d", d).where(F.col("d") <= fallback)
    first = near.groupBy("zid").agg(F.min(F.struct("d", "px")).alias("b")).select("zid", F.col("b.px").alias("px"))
    found = means.unionByName(first.join(q, "px").select("zid", *[F.col(f"v_{c}").alias(c) for c in values]))
    return zones.select("zid").join(found, "zid", "left")


def zonal_mean(zones: DataFrame, pixels: DataFrame, value: str, fallback: float = 1500.0) -> DataFrame:
    """:func:`zonal_means` of one value."""
    return zonal_means(zones, pixels, [value], fallback)
