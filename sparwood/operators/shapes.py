"""Geometry in numpy for Arrow functions: hulls, extents, distances, buffers, contacts of polygons; and their operators."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import priors as P

QUADRANT = 16


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise (monotone chain)."""
    p = np.asarray(points, float).reshape(-1, 2)
    p = p[np.lexsort((p[:, 1], p[:, 0]))]
    p = p[np.r_[True, (p[1:] != p[:-1]).any(1)]] if len(p) else p
    if len(p) < 3:
        return p

    def half(seq) -> list:
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def extent(points: np.ndarray) -> float:
    """Largest distance between two points: of hull corners, by rotating over them; as the root of the sum of squares, like SQL's."""
    h = hull(points)
    return math.sqrt(max((float(((h - q) ** 2).sum(1).max()) for q in h), default=0.0))


def segments(ring: np.ndarray) -> np.ndarray:
    """x1, y1, x2, y2 of a closed ring's edges."""
    r = np.asarray(ring, float)
    r = r if (r[0] == r[-1]).all() else np.vstack([r, r[:1]])
    return np.hstack([r[:-1], r[1:]])


def _point_to_segments(p: np.ndarray, s: np.ndarray) -> np.ndarray:
    d = s[:, 2:] - s[:, :2]
    t = np.clip(((p - s[:, :2]) * d).sum(1) / np.maximum((d * d).sum(1), 1e-300), 0, 1)
    return np.hypot(*(p - s[:, :2] - t[:, None] * d).T)


def inside(p: np.ndarray, ring: np.ndarray) -> bool:
    s = segments(ring)
    cross = (s[:, 1] <= p[1]) != (s[:, 3] <= p[1])
    s = s[cross]
    x = s[:, 0] + (p[1] - s[:, 1]) * (s[:, 2] - s[:, 0]) / (s[:, 3] - s[:, 1])
    return bool((x > p[0]).sum() % 2)


def _crossing(a: np.ndarray, b: np.ndarray) -> bool:
    o = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    a1, a2, b1, b2 = a[:, None, :2], a[:, None, 2:], b[None, :, :2], b[None, :, 2:]
    return bool(((o(a1, a2, b1) * o(a1, a2, b2) < 0) & (o(b1, b2, a1) * o(b1, b2, a2) < 0)).any())


def distance(a: np.ndarray, b: np.ndarray) -> float:
    """Between two polygons (outer rings): 0 if they touch or overlap."""
    if len(a) == 1 and len(b) == 1:
        return float(np.hypot(*(a[0] - b[0])))
    sa, sb = segments(a), segments(b)
    if _crossing(sa, sb) or (len(b) > 2 and inside(a[0], b)) or (len(a) > 2 and inside(b[0], a)):
        return 0.0
    return float(min(min(_point_to_segments(p, sb).min() for p in a), min(_point_to_segments(p, sa).min() for p in b)))


def shared_boundary(a: np.ndarray, b: np.ndarray, eps: float = 1e-9) -> float:
    """Length along which the boundaries run together."""
    total = 0.0
    for x1, y1, x2, y2 in segments(a):
        d = np.array([x2 - x1, y2 - y1])
        length = math.hypot(*d)
        if length < eps:
            continue
        d /= length
        spans = []
        for u1, v1, u2, v2 in segments(b):
            q = np.array([[u1 - x1, v1 - y1], [u2 - x1, v2 - y1]])
            if np.abs(q[:, 0] * d[1] - q[:, 1] * d[0]).max() <= 1e-6:
                lo, hi = sorted(q @ d)
                if min(hi, length) > max(lo, 0.0):
                    spans.append((max(lo, 0.0), min(hi, length)))
        end = 0.0
        for lo, hi in sorted(spans):
            total, end = total + max(0.0, hi - max(lo, end)), max(end, hi)
    return total


def area(ring: np.ndarray) -> float:
    r = np.asarray(ring, float) - ring[0]
    return abs(float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1]))) / 2


def buffer_convex(ring: np.ndarray, radius: float, quadrant: int = QUADRANT) -> np.ndarray:
    """Buffer of a convex ring, arcs as ``quadrant`` segments per quarter circle: hull of circles put on its corners.

    Arc points are counted from the direction of the edge that leads into a corner, as is usual for polygonal buffers.
    """
    h = hull(ring)
    out = []
    n = len(h)
    for i in range(n):
        before, here, after = h[i - 1], h[i], h[(i + 1) % n]
        a0 = math.atan2(*(here - before)[::-1]) - math.pi / 2
        a1 = math.atan2(*(after - here)[::-1]) - math.pi / 2
        sweep = (a1 - a0) % (2 * math.pi)
        steps = max(1, math.ceil(sweep / (math.pi / 2 / quadrant) - 1e-9))
        angles = a0 + sweep * np.arange(steps + 1) / steps
        out.append(here + radius * np.stack([np.cos(angles), np.sin(angles)], 1))
    return np.vstack(out)


def clip_convex(subject: np.ndarray, window: np.ndarray) -> np.ndarray:
    """Part of a ring inside a convex counter-clockwise window (Sutherland-Hodgman)."""
    out = [tuple(p) for p in subject]
    for x1, y1, x2, y2 in segments(window):
        side = lambda p: (x2 - x1) * (p[1] - y1) - (y2 - y1) * (p[0] - x1)  # noqa: B023, E731
        kept = []
        for p, q in zip(out, out[1:] + out[:1]):
            sp, sq = side(p), side(q)
            if sp >= 0:
                kept.append(p)
            if (sp > 0) != (sq > 0) and sp != sq:
                t = sp / (sp - sq)
                kept.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
        out = kept
        if not out:
            break
    return np.array(out).reshape(-1, 2)


#: Metres to which corners of unions are rounded, and at which the two sides of an edge are looked at.
_SNAP, _BESIDE = 1e-6, 1e-4


def _within_any(points: np.ndarray, s: np.ndarray, shape: np.ndarray, n: int) -> np.ndarray:
    """Which points are inside any of n shapes (even-odd), given by the segments of their rings."""
    out = np.zeros(len(points), bool)
    step = max(1, (1 << 21) // max(1, len(s)))
    rise = np.where(s[:, 3] == s[:, 1], 1.0, s[:, 3] - s[:, 1])
    for k in range(0, len(points), step):
        p = points[k : k + step]
        cross = (s[None, :, 1] <= p[:, None, 1]) != (s[None, :, 3] <= p[:, None, 1])
        row, seg = np.nonzero(cross)
        x = s[seg, 0] + (p[row, 1] - s[seg, 1]) * (s[seg, 2] - s[seg, 0]) / rise[seg]
        east = x > p[row, 0]
        code, count = np.unique(row[east] * n + shape[seg[east]], return_counts=True)
        out[k + np.unique(code[count % 2 == 1] // n)] = True
    return out


def _cuts(s: np.ndarray) -> list[np.ndarray]:
    """Of each segment the places (0 to 1) at which others cross it, end on it or run along it."""
    d = s[:, 2:] - s[:, :2]
    long2 = np.maximum((d * d).sum(1), 1e-300)
    out = [[np.array([0.0, 1.0])] for _ in s]
    lo, hi = np.minimum(s[:, :2], s[:, 2:]) - _BESIDE, np.maximum(s[:, :2], s[:, 2:]) + _BESIDE
    step = max(1, (1 << 21) // max(1, len(s)))
    for k in range(0, len(s), step):
        a, b = np.nonzero(((lo[k : k + step, None] <= hi[None]) & (lo[None] <= hi[k : k + step, None])).all(2))
        a = a + k
        a, b = a[a != b], b[a != b]
        w = s[b, :2] - s[a, :2]
        turn = d[a, 0] * d[b, 1] - d[a, 1] * d[b, 0]
        flat = np.abs(turn) <= 1e-12 * np.sqrt(long2[a] * long2[b])
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(flat, np.nan, (w[:, 0] * d[b, 1] - w[:, 1] * d[b, 0]) / turn)
            u = np.where(flat, np.nan, (w[:, 0] * d[a, 1] - w[:, 1] * d[a, 0]) / turn)
        meets = (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
        for i, v in zip(a[meets].tolist(), t[meets].tolist()):
            out[i].append(np.array([v]))
        for end in (s[b, :2], s[b, 2:]):
            at = ((end - s[a, :2]) * d[a]).sum(1) / long2[a]
            off = np.hypot(*(end - s[a, :2] - at[:, None] * d[a]).T)
            on = (off <= 10 * _SNAP) & (at > 0) & (at < 1)
            for i, v in zip(a[on].tolist(), at[on].tolist()):
                out[i].append(np.array([v]))
    return [np.unique(np.concatenate(c)) for c in out]


def union(shapes: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Outline of the union of shapes (each its rings, even-odd): shells counter-clockwise, holes clockwise; without any, none.

    All edges are cut where they meet; of the pieces those remain that have the union on one side only, which is looked up
    beside their middles, and these are linked to rings. Corners are rounded to a micrometre.
    """
    snap = lambda p: np.round(np.asarray(p, float) / _SNAP) * _SNAP
    own = [(k, segments(snap(r))) for k, rings in enumerate(shapes) for r in rings if len(r) > 2]
    if not own:
        return []
    s = np.vstack([x for _, x in own])
    shape = np.repeat([k for k, _ in own], [len(x) for _, x in own])
    some = (s[:, :2] != s[:, 2:]).any(1)
    s, shape = s[some], shape[some]
    ends = []
    for (x1, y1, x2, y2), t in zip(s, _cuts(s)):
        p = snap(np.stack([x1 + t * (x2 - x1), y1 + t * (y2 - y1)], 1))
        p[0], p[-1] = (x1, y1), (x2, y2)
        ends.append(np.hstack([p[:-1], p[1:]]))
    e = np.vstack(ends)
    back = (e[:, 0] > e[:, 2]) | ((e[:, 0] == e[:, 2]) & (e[:, 1] > e[:, 3]))
    e[back] = e[back][:, [2, 3, 0, 1]]
    e = np.unique(e[(e[:, :2] != e[:, 2:]).any(1)], axis=0)
    d = e[:, 2:] - e[:, :2]
    side = _BESIDE * np.stack([-d[:, 1], d[:, 0]], 1) / np.hypot(*d.T)[:, None]
    middle = (e[:, :2] + e[:, 2:]) / 2
    left, right = (_within_any(middle + f * side, s, shape, len(shapes)) for f in (1, -1))
    e = np.vstack([e[left & ~right], e[right & ~left][:, [2, 3, 0, 1]]])
    return _linked(e)


def _linked(e: np.ndarray) -> list[np.ndarray]:
    """Rings of directed edges that have the inside on their left; where several go on, the one that turns back to the left most."""
    start: dict[tuple[float, float], list[int]] = {}
    for i, p in enumerate(map(tuple, e[:, :2].tolist())):
        start.setdefault(p, []).append(i)
    free, rings = np.ones(len(e), bool), []
    angle = np.arctan2(e[:, 3] - e[:, 1], e[:, 2] - e[:, 0])
    for i in range(len(e)):
        ring, at = [], i
        while free[at]:
            free[at] = False
            ring.append(e[at, :2])
            on = [k for k in start.get(tuple(e[at, 2:].tolist()), ()) if free[k]]
            if not on:
                break
            at = max(on, key=lambda k: (angle[k] - angle[at] + math.pi) % (2 * math.pi)) if len(on) > 1 else on[0]  # noqa: B023
        if len(ring) > 2:
            rings.append(_straight(np.array(ring)))
    return rings


def _straight(ring: np.ndarray) -> np.ndarray:
    """A ring without the corners at which it goes straight on."""
    d, f = ring - np.roll(ring, 1, 0), np.roll(ring, -1, 0) - ring
    turn = np.abs(d[:, 0] * f[:, 1] - d[:, 1] * f[:, 0]) > 10 * _SNAP * np.minimum(np.hypot(*d.T), np.hypot(*f.T))
    return ring[turn] if turn.sum() > 2 else ring


def signed_area(ring: np.ndarray) -> float:
    r = np.asarray(ring, float) - ring[0]
    return float(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - np.roll(r[:, 0], -1) * r[:, 1])) / 2


def perimeter(ring: np.ndarray) -> float:
    return float(np.hypot(*(np.roll(ring, -1, 0) - ring).T).sum())


def buffer(shape: list[np.ndarray], radius: float, closed: bool = True) -> list[np.ndarray]:
    """Outline of all points at most radius from a polygon (its rings) or, not closed, from lines; arcs as in :func:`buffer_convex`."""
    parts: list[list[np.ndarray]] = [shape] if closed else []
    for r in shape:
        r = np.asarray(r, float)
        if len(r) == 1 or (r == r[0]).all():
            a = np.arange(4 * QUADRANT) * math.pi / 2 / QUADRANT
            parts.append([r[0] + radius * np.stack([np.cos(a), np.sin(a)], 1)])
            continue
        s = segments(r) if closed else np.hstack([r[:-1], r[1:]])
        parts += [[buffer_convex(np.array([[x1, y1], [x2, y2]]), radius)] for x1, y1, x2, y2 in s if (x1, y1) != (x2, y2)]
    return union(parts)


def _convex(ring: np.ndarray) -> bool:
    return area(hull(ring)) - area(ring) < 1e-6 * max(1.0, area(ring))


def buffered_overlap(a: list[np.ndarray], b: list[np.ndarray], radius: float) -> float:
    """Area shared by the buffers of two polygons, given by their parts' shells."""
    if len(a) == len(b) == 1 and _convex(a[0]) and _convex(b[0]):
        return area(c) if len(c := clip_convex(buffer_convex(a[0], radius), buffer_convex(b[0], radius))) > 2 else 0.0
    grown = [union([[r] for r in p] + [buffer([r], radius) for r in p]) for p in (a, b)]
    total = lambda rings: sum(map(signed_area, rings))
    return max(0.0, total(grown[0]) + total(grown[1]) - total(union(grown)))


def classify(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[str, float, float] | None:
    """Kind, length and gap of the contact of two stands (their parts' shells): touching along at least CONTACT_M, or near over a gap; else None.

    Contacts of all parts add up, the smallest gap counts.
    """
    shared = sum(shared_boundary(p, q) for p in a for q in b)
    if shared >= P.CONTACT_M:
        return "touching", shared, 0.0
    gap = min(distance(p, q) for p in a for q in b)
    if not 0 < gap <= P.GAP_M:
        return None
    length = buffered_overlap(a, b, P.GAP_M) / P.GAP_M
    return ("near_gap", length, gap) if length >= P.CONTACT_M else None


def adjacency(stands: DataFrame, size: float = 500.0) -> DataFrame:
    """id_a < id_b, adjacency_type, length_m, gap_m of stands in contact.

    stands: id (unique), and ring (array of x, y structs) or parts (array of such rings); parts of fewer than three corners,
    and stands without others, touch nothing. Candidate pairs come from an equi-join on the grid cells of the boxes, grown by half
    the gap and a metre against rounding, and a box test; a pair counts in the cell of its boxes' common lower left corner
    only. Shapes are classified in Arrow batches.
    """
    parts = F.filter(F.col("parts") if "parts" in stands.columns else F.array("ring"), lambda r: F.size(r) > 2)
    all_ = lambda v: F.transform(F.flatten("parts"), lambda p: p[v])
    grow = P.GAP_M / 2 + 1
    box = stands.select("id", parts.alias("parts")).where(F.size("parts") > 0)
    box = box.select("id", "parts", *[e.alias(f"{v}{k}") for v in "xy" for k, e in ((0, F.array_min(all_(v)) - grow), (1, F.array_max(all_(v)) + grow))])
    at = lambda c: F.floor(F.col(c) / size)
    cells = box.withColumn("cx", F.explode(F.sequence(at("x0"), at("x1")))).withColumn("cy", F.explode(F.sequence(at("y0"), at("y1"))))
    a, b = cells.alias("a"), cells.alias("b")
    own = (F.col("a.cx") == F.floor(F.greatest("a.x0", "b.x0") / size)) & (F.col("a.cy") == F.floor(F.greatest("a.y0", "b.y0") / size))
    meet = (F.col("a.x0") <= F.col("b.x1")) & (F.col("b.x0") <= F.col("a.x1")) & (F.col("a.y0") <= F.col("b.y1")) & (F.col("b.y0") <= F.col("a.y1"))
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    pairs = a.join(b, same & (F.col("a.id") < F.col("b.id")) & meet & own).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), F.col("a.parts").alias("pa"), F.col("b.parts").alias("pb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(i, j, *c) for i, j, pa, pb in rows.itertuples(index=False) if (c := classify(_rings(pa), _rings(pb)))]
            yield pd.DataFrame(out, columns=["id_a", "id_b", "adjacency_type", "length_m", "gap_m"])

    kind = dict(stands.dtypes)["id"]
    return pairs.mapInPandas(run, f"id_a {kind}, id_b {kind}, adjacency_type string, length_m double, gap_m double")


def _rings(parts) -> list[np.ndarray]:
    return [np.array([[p["x"], p["y"]] for p in r], float) for r in parts]


def text(rings: list[np.ndarray]) -> str:
    """Outlines as WKT: every shell with the holes that lie in it."""
    shells = [r for r in rings if signed_area(r) > 0]
    holes: list[list[np.ndarray]] = [[] for _ in shells]
    for h in (r for r in rings if signed_area(r) <= 0):
        inner = (h[0] + h[1]) / 2 + _BESIDE * np.array([h[1][1] - h[0][1], h[0][0] - h[1][0]]) / np.hypot(*(h[1] - h[0]))
        holder = [k for k, r in enumerate(shells) if inside(inner, r)]
        if holder:
            holes[min(holder, key=lambda k: signed_area(shells[k]))].append(h)
    one = lambda r: "(" + ", ".join(f"{x:.6f} {y:.6f}" for x, y in [*r, r[0]]) + ")"
    return "MULTIPOLYGON (" + ", ".join("(" + ", ".join(map(one, [r, *h])) + ")" for r, h in zip(shells, holes)) + ")" if shells else "MULTIPOLYGON EMPTY"


def dissolve(stands: DataFrame, key: str, size: float = 5000.0) -> DataFrame:
    """key, area_m2, perimeter_m, outline (WKT) of the union of each group's polygons; stands: key and ring (array of x, y structs).

    Polygons of a group are dissolved in each cell of a grid (by their lower left corners) first, then the cells' outlines, so a
    task never holds all the polygons of a large group. Rings of fewer than three corners have no area; a group without
    others gives no row.
    """
    kind = dict(stands.dtypes)[key]
    low = lambda v: F.floor(F.array_min(F.transform("ring", lambda p: p[v])) / size).alias(f"c{v}")
    cells = stands.where((F.size("ring") > 2) & F.col(key).isNotNull()).select(key, "ring", low("x"), low("y"))

    def first(g: pd.DataFrame) -> pd.DataFrame:
        out = union([[r] for r in _rings(g["ring"])])
        return pd.DataFrame({key: [g[key].iloc[0]], "xs": [[r[:, 0].tolist() for r in out]], "ys": [[r[:, 1].tolist() for r in out]]})

    def last(g: pd.DataFrame) -> pd.DataFrame:
        out = union([[np.stack([x, y], 1) for x, y in zip(*r)] for r in zip(g["xs"], g["ys"])])
        return pd.DataFrame({key: [g[key].iloc[0]], "area_m2": [sum(map(signed_area, out))], "perimeter_m": [sum(map(perimeter, out))], "outline": [text(out)]})

    partial = cells.groupBy(key, "cx", "cy").applyInPandas(first, f"`{key}` {kind}, xs array<array<double>>, ys array<array<double>>")
    return partial.groupBy(key).applyInPandas(last, f"`{key}` {kind}, area_m2 double, perimeter_m double, outline string")


def buffered_lines(lines: DataFrame, key: str, radius: float = P.ECOTONE_BUFFER_M) -> DataFrame:
    """key, area_m2, outline (WKT) of what lies at most radius from each line; lines: key and line (array of x, y structs). Empty and null lines give no row."""
    kind = dict(lines.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = [(k, buffer(_rings([r]), radius, closed=False)) for k, r in rows.itertuples(index=False)]
            yield pd.DataFrame([(k, sum(map(signed_area, o)), text(o)) for k, o in out], columns=[key, "area_m2", "outline"])

    return lines.where(F.size("line") > 0).select(key, "line").mapInPandas(run, f"`{key}` {kind}, area_m2 double, outline string")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`distance` of many pairs of polygons with equally many corners each: a of shape (pairs, n, 2), b (pairs, m, 2)."""
    a2, b2 = np.roll(a, -1, 1), np.roll(b, -1, 1)
    o = lambda p, q, r: np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))
    p1, p2, q1, q2 = a[:, :, None], a2[:, :, None], b[:, None], b2[:, None]
    meet = ((o(p1, p2, q1) * o(p1, p2, q2) < 0) & (o(q1, q2, p1) * o(q1, q2, p2) < 0)).any((1, 2))

    def holds(ring: np.ndarray, nxt: np.ndarray, p: np.ndarray) -> np.ndarray:
        if ring.shape[1] < 3:
            return np.zeros(len(ring), bool)
        x, y = p[:, None, 0], p[:, None, 1]
        cross = (ring[..., 1] <= y) != (nxt[..., 1] <= y)
        rise = np.where(cross, nxt[..., 1] - ring[..., 1], 1.0)
        return ((ring[..., 0] + (y - ring[..., 1]) * (nxt[..., 0] - ring[..., 0]) / rise > x) & cross).sum(1) % 2 == 1

    def gap(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        p, s, d = p[:, :, None], s[:, None], (e - s)[:, None]
        t = np.clip(((p - s) * d).sum(-1) / np.maximum((d * d).sum(-1), 1e-300), 0, 1)
        off = p - s - t[..., None] * d
        return np.hypot(off[..., 0], off[..., 1]).min((1, 2))

    apart = np.minimum(gap(a, b, b2), gap(b, a, a2))
    return np.where(meet | holds(b, b2, a[:, 0]) | holds(a, a2, b[:, 0]), 0.0, apart)


def _upright(xs: Column, ys: Column) -> Column:
    """Whether a shape is its own box: a point, a line along an axis, or a rectangle along the axes, closed or not."""
    x, y = (lambda k: F.get(xs, F.lit(k))), (lambda k: F.get(ys, F.lit(k)))
    flat = lambda u, v: (u(0) == u(1)) & (v(1) == v(2)) & (u(2) == u(3)) & (v(3) == v(0))
    n, four = F.size(xs), flat(x, y) | flat(y, x)
    return F.coalesce((n == 1) | ((n == 2) & ((x(0) == x(1)) | (y(0) == y(1)))) | ((n == 4) & four) | ((n == 5) & four & (x(4) == x(0)) & (y(4) == y(0))), F.lit(False))


def _box_pairs(a: DataFrame, b: DataFrame, radius: float, size: float, slack: float = 0.0) -> DataFrame:
    """Rows of a (columns a.*) and b (b.*) whose boxes (x0, x1, y0, y1) are at most radius and slack apart, with this distance as gap.

    An equi-join on grid cells of the boxes of a, and of those of b grown by the radius; a pair counts in the cell of the
    lower left corner that they have in common. Cells are spread over many tasks, as few rows may make many pairs.
    """
    grow = radius + 1  # against rounding
    tasks = 8 * a.sparkSession.sparkContext.defaultParallelism

    def cells(df: DataFrame, name: str, by: float) -> DataFrame:
        at = lambda c, s: F.floor((F.col(c) + s * by) / size)
        df = df.withColumns({"lx": at("x0", -1), "ly": at("y0", -1), "cx": F.explode(F.sequence(at("x0", -1), at("x1", 1)))})
        return df.withColumn("cy", F.explode(F.sequence("ly", at("y1", 1)))).repartition(tasks, "cx", "cy").alias(name)

    off = lambda v: F.greatest(F.col(f"a.{v}0") - F.col(f"b.{v}1"), F.col(f"b.{v}0") - F.col(f"a.{v}1"), F.lit(0.0))
    gap = F.sqrt(off("x") * off("x") + off("y") * off("y"))
    same = (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    own = (F.col("a.cx") == F.greatest("a.lx", "b.lx")) & (F.col("a.cy") == F.greatest("a.ly", "b.ly"))
    return cells(a, "a", 0).join(cells(b, "b", grow), same & (off("x") <= radius + slack) & (off("y") <= radius + slack) & (gap <= radius + slack) & own).withColumn("gap", gap)


def near_shapes(shapes: DataFrame, radius: float) -> DataFrame:
    """id_a < id_b, distance_m of polygons whose boundaries are at most radius apart (0 if they touch or overlap).

    shapes: id (unique), ring (array of x, y structs; one corner is a point, two a line; without any it pairs with nothing).
    Candidate pairs come from a join of their boxes. Of two shapes that are their own boxes the boxes' distance is that of the
    shapes; all others are measured exactly, in Arrow batches.
    """
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    box = shapes.where(F.size("ring") > 0).select("id", xs.alias("xs"), ys.alias("ys"), *[f(c).alias(f"{v}{k}") for v, c in (("x", xs), ("y", ys)) for k, f in ((0, F.array_min), (1, F.array_max))])
    box = box.withColumn("upright", _upright(F.col("xs"), F.col("ys")))
    slim = box.where("upright").select("id", "x0", "x1", "y0", "y1")
    ids = F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b")
    simple = _box_pairs(slim, slim, radius, radius).where("a.id < b.id").select(*ids, F.col("gap").alias("distance_m"))

    odd = box.where("NOT upright")
    pairs = _box_pairs(odd, box, radius, 2 * radius, 1.0).where("a.id < b.id OR (b.upright AND a.id > b.id)")
    pairs = pairs.select(F.least("a.id", "b.id").alias("id_a"), F.greatest("a.id", "b.id").alias("id_b"), F.col("a.xs").alias("xa"), F.col("a.ys").alias("ya"), F.col("b.xs").alias("xb"), F.col("b.ys").alias("yb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            xa, ya, xb, yb = (rows.column(k) for k in range(2, 6))
            na, nb = (np.diff(c.offsets.to_numpy()) for c in (xa, xb))
            flat = [c.values.to_numpy(zero_copy_only=False).astype(float) for c in (xa, ya, xb, yb)]
            begin = [c.offsets.to_numpy()[:-1] for c in (xa, ya, xb, yb)]
            gap = np.full(rows.num_rows, np.inf)
            kinds, which = np.unique(np.stack([na, nb], 1), axis=0, return_inverse=True)
            for k, (n, m) in enumerate(kinds.tolist()):
                of = np.flatnonzero(which.reshape(-1) == k)
                step = max(1, (1 << 20) // (n * m))
                for part in (of[i : i + step] for i in range(0, len(of), step)):
                    x, y, u, v = (f[s[part][:, None] + np.arange(c)] for f, s, c in zip(flat, begin, (n, n, m, m)))
                    gap[part] = distances(np.stack([x, y], -1), np.stack([u, v], -1))
            keep = np.flatnonzero(gap <= radius)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(keep)), rows.column(1).take(pa.array(keep)), pa.array(gap[keep], pa.float64())], ["id_a", "id_b", "distance_m"])

    kind = dict(shapes.dtypes)["id"]
    return simple.union(pairs.mapInArrow(run, f"id_a {kind}, id_b {kind}, distance_m double"))


#: Points up to which all pairs of a group are compared and none is dropped before the shuffle; rows that a task holds at once.
_FEW, _HELD = 256, 200_000


def _outer(points: np.ndarray) -> np.ndarray:
    """Hull corners; points inside the polygon of the farthest ones along eight directions are dropped before."""
    a = np.arange(8) * math.pi / 4
    e = points[np.argmax(points @ np.stack([np.cos(a), np.sin(a)]), 0)]
    far = np.ones(len(points), bool)
    if len(ring := hull(e)) > 2:
        # A hair of the shape's size against rounding: a point that stays costs time only.
        slack = 1e-12 * float(np.abs(ring).max()) * float(np.ptp(ring, 0).max())
        turn = [(x2 - x1) * (points[:, 1] - y1) - (y2 - y1) * (points[:, 0] - x1) for x1, y1, x2, y2 in segments(ring)]
        far = np.min(turn, 0) <= slack
    return hull(points[far])


def extents(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
    """:func:`extent` of many groups, whose points lie one after the other: of few points pairwise, all groups of one size at once."""
    out, start = np.zeros(len(size)), np.cumsum(size) - size
    for n in np.unique(size[size > 1]).tolist():
        of = np.flatnonzero(size == n)
        if n > _FEW:
            for k in of:
                out[k] = extent(_outer(np.stack([x[start[k] : start[k] + n], y[start[k] : start[k] + n]], 1)))
            continue
        step = max(1, (1 << 18) // n)
        for part in (of[i : i + step] for i in range(0, len(of), step)):
            at = start[part] + np.arange(n)[:, None]
            u, v, best = x[at], y[at], np.zeros(len(part))
            for k in range(1, n // 2 + 1):  # points set against themselves turned by k places: every pair once at least
                np.maximum(best, ((u - np.roll(u, k, 0)) ** 2 + (v - np.roll(v, k, 0)) ** 2).max(0), out=best)
            out[part] = np.sqrt(best)
    return out


def group_extent(points: DataFrame, key: str, counted: str | None = None) -> DataFrame:
    """key, extent_m: largest distance between two points of a group; with ``counted`` the number of its points under that name too.

    Before the shuffle a task puts hull corners in the place of many points of a group; after it rows come sorted by group,
    so a task holds some rows and the corners of one group. Groups of few points are handled by the array, not one by one.
    """
    kind = dict(points.dtypes)[key]
    names = [key, "x", "y", *(["n"] if counted else [])]

    def grouped(held: list[pa.RecordBatch]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        """Keys in the order in which they come, the columns of their points one after the other, and how many each has."""
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = rows.column(0).combine_chunks().dictionary_encode()
        code = keys.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        return keys.dictionary, [c.to_numpy()[order] for c in rows.columns[1:]], np.bincount(code, minlength=len(keys.dictionary))

    def thinned(keys: pa.Array, columns: list[np.ndarray], size: np.ndarray) -> pa.RecordBatch:
        many, start = np.flatnonzero(size > _FEW), np.cumsum(size) - size
        keep, size = np.repeat(size <= _FEW, size), size.copy()
        parts = [[c[keep] for c in columns]]
        for k in many:
            x, y, *n = (c[start[k] : start[k] + size[k]] for c in columns)
            h = _outer(np.stack([x, y], 1))
            # The first corner stands for all points that are left out.
            parts.append([h[:, 0], h[:, 1], *[np.r_[c.sum(), np.zeros(len(h) - 1, c.dtype)] for c in n]])
            size[k] = len(h)
        order = np.concatenate([np.setdiff1d(np.arange(len(size)), many), many]).astype(int)
        codes = pa.array(np.repeat(order, size[order]))
        return pa.RecordBatch.from_arrays([keys.take(codes), *[pa.array(np.concatenate(c)) for c in zip(*parts)]], names)

    def corners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for rows in batches:
            held.append(rows)
            if sum(b.num_rows for b in held) > _HELD:
                held = [thinned(*grouped(held))]
                if held[0].num_rows > _HELD // 2:
                    yield held.pop()
        if held:
            yield thinned(*grouped(held))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done(keys: pa.Array, columns: list[np.ndarray], size: np.ndarray) -> pa.RecordBatch:
            x, y, *n = columns
            number = [pa.array(np.add.reduceat(c, np.cumsum(size) - size) if len(c) else c) for c in n]
            return pa.RecordBatch.from_arrays([keys, pa.array(extents(x, y, size)), *number], [key, "extent_m", *([counted] if counted else [])])

        for rows in batches:
            held.append(rows)
            if sum(b.num_rows for b in held) > _HELD:
                keys, columns, size = grouped(held)
                last = size[-1]  # the last group may go on in the next batch
                if len(size) > 1:
                    yield done(keys[:-1], [c[:-last] for c in columns], size[:-1])
                held = [thinned(keys[-1:], [c[-last:] for c in columns], size[-1:])]
        if held:
            yield done(*grouped(held))

    p = points.select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna()
    p = p.withColumn("n", F.lit(1).cast("bigint")) if counted else p
    p = p.mapInArrow(corners, f"`{key}` {kind}, x double, y double" + ", n bigint" * bool(counted)).repartition(key).sortWithinPartitions(key)
    return p.mapInArrow(merged, f"`{key}` {kind}, extent_m double" + f", `{counted}` bigint" * bool(counted))
