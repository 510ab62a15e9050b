"""Blocks into clusters of bounded extent: complete linkage on centroids, then extent and connectivity."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import priors as P
from ..session import stored
from .components import components
from .shapes import extent, group_extent, hull
from .spatial import small


# Directions in which clusters' reaches are held: the farthest points of two clusters lie within 22.5 degrees of one of them.
_ANGLES = np.arange(4) * np.pi / 4
_AXES = np.stack([np.cos(_ANGLES), np.sin(_ANGLES)])
_SURE = float(np.cos(np.pi / 8))


def _farthest(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1]).max())


class _Grid:
    """Points at the given places of an array, in cells of two on the average."""

    def __init__(self, points: np.ndarray, at: np.ndarray):
        p = points[at]
        self.low, span = p.min(0), np.ptp(p, 0)
        self.cell = float(max(np.sqrt(2 * span.prod() / len(at)), 2 * span.max() / len(at))) or 1.0
        self.shape = (span // self.cell).astype(int) + 1
        x, y = ((p - self.low) // self.cell).astype(int).T
        code = y * self.shape[0] + x
        order = np.argsort(code, kind="stable")
        self.at, self.start = at[order], np.concatenate([[0], np.cumsum(np.bincount(code, minlength=self.shape.prod()))]).tolist()

    def around(self, point: np.ndarray, width: int) -> tuple[np.ndarray, bool]:
        """Places of the points in the cells up to width from the point's cell, all those nearer than width cells among them; whether these are all."""
        cx, cy = ((point - self.low) // self.cell).astype(int).tolist()
        nx, ny = self.shape.tolist()
        x0, x1, y0, y1 = max(cx - width, 0), min(cx + width, nx - 1), max(cy - width, 0), min(cy + width, ny - 1)
        if x1 - x0 == nx - 1 and y1 - y0 == ny - 1:
            return self.at, True
        return np.concatenate([self.at[self.start[y * nx + x0] : self.start[y * nx + x1 + 1]] for y in range(y0, y1 + 1)]), False


def complete_linkage(points: np.ndarray, threshold: float) -> np.ndarray:
    """Label of each point: clusters whose largest inner distance is at most threshold, by nearest-neighbour chains.

    Clusters are held as hull corners and their reaches along fixed directions, never as a matrix: memory grows with the
    points. A sum of reaches is at least _SURE of the distance between two clusters and at most all of it, so the hulls of
    the few clusters that may be nearest are compared only. They are looked for in a grid of the clusters' smallest points:
    two clusters are at least as far apart as these.
    """
    n = len(points)
    points = np.asarray(points, float)
    label = np.arange(n)
    corners = [points[i : i + 1] for i in range(n)]
    high = points @ _AXES
    low = high.copy()
    live = np.ones(n, bool)
    left, first = n, 0
    grid = _Grid(points, label)
    chain: list[int] = []

    while left > 1:
        if left < 0.75 * len(grid.at):
            grid = _Grid(points, np.flatnonzero(live))
        if not chain:
            while not live[first]:
                first += 1
            chain = [first]
        top = chain[-1]
        h, w, width = high[top], low[top], 2
        while True:
            some, whole = grid.around(points[top], width)
            some = some[live[some]]
            some = some[some != top]
            bound = np.maximum(high[some] - w, h - low[some]).max(1)
            least = min(float(bound.min()) / _SURE if len(bound) else np.inf, threshold)
            within = least * (1 + 1e-9) + 1e-6
            if whole or within < width * grid.cell:
                break
            width = int(min(within // grid.cell + 2, 2 * width if not len(bound) else np.inf))
        near, best = -1, np.inf
        for k in np.sort(some[bound <= within]).tolist():
            d = _farthest(corners[top], corners[k])
            if d < best or (d == best and len(chain) > 1 and k == chain[-2]):
                near, best = k, d
        if best > threshold:
            # Nothing near enough: in complete linkage it comes closer to nothing later.
            live[top], left = False, left - 1
            chain.pop()
            continue
        if len(chain) < 2 or near != chain[-2]:
            chain.append(near)
            continue
        chain = chain[:-2]
        keep, gone = min(top, near), max(top, near)
        label[gone] = keep
        corners[keep] = hull(np.vstack([corners[keep], corners[gone]]))
        corners[gone] = points[:0]
        high[keep] = np.maximum(high[keep], high[gone])
        low[keep] = np.minimum(low[keep], low[gone])
        live[gone], left = False, left - 1
    # A label is always that of a smaller point, so one look from below finds each cluster's smallest.
    for i in range(n):
        label[i] = label[label[i]]
    return label


def _reachable(members: list[int], links: dict[int, set[int]]) -> list[list[int]]:
    """Members in parts that links connect inside the group, each sorted."""
    left, parts = set(members), []
    while left:
        part, edge = set(), [min(left)]
        while edge:
            k = edge.pop()
            if k in left:
                left.discard(k), part.add(k)
                edge += links.get(k, set()) & left
        parts.append(sorted(part))
    return parts


def parts(ids: list[int], centroid: dict[int, np.ndarray], corners: dict[int, np.ndarray], cap: float) -> list[list[int]]:
    """Groups of one component: cut by linkage at a threshold that shrinks until the group's extent is within cap."""
    todo, done = [(sorted(ids), 0)], []
    while todo:
        group, depth = todo.pop()
        if len(group) == 1:
            done.append(group)
        elif depth >= P.MAX_DEPTH:
            done.append(group)
        else:
            labels = complete_linkage(np.array([centroid[i] for i in group]), cap * P.SHRINK**depth)
            for one in np.unique(labels):
                part = [i for i, k in zip(group, labels) if k == one]
                if len(part) > 1 and extent(np.vstack([corners[i] for i in part])) > cap:
                    todo.append((part, depth + 1))
                else:
                    done.append(part)
    return done


def split(ids: list[int], centroid: dict[int, np.ndarray], corners: dict[int, np.ndarray], links: dict[int, set[int]], cap: float) -> list[list[int]]:
    """The parts of one component, each in the pieces that links connect inside it."""
    return [piece for part in parts(ids, centroid, corners, cap) for piece in _reachable(part, links)]


def clusters(blocks: DataFrame, edges: DataFrame, cap: float = P.CLUSTER_EXTENT_M) -> DataFrame:
    """block_id, root (smallest block of its cluster). blocks: block_id, x, y (centroid), corners (array of x, y structs).

    Components of the proximity graph are cut each in one Arrow group, of centroids and corners only: linkage needs all of a
    component's blocks, in memory that grows with their number. Links stay outside: what they connect within each part is
    found by the components of the edges inside it.
    """
    comp = components(blocks, edges, "block_id").withColumnRenamed("id", "block_id")
    rows = blocks.join(comp, "block_id").select("root", "block_id", "x", "y", "corners")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ids = g["block_id"].astype(int).tolist()
        centroid = dict(zip(ids, g[["x", "y"]].to_numpy(float)))
        corners = {i: np.array([[p["x"], p["y"]] for p in c], float) for i, c in zip(ids, g["corners"])}
        out = [(i, min(part)) for part in parts(ids, centroid, corners, cap) for i in part]
        return pd.DataFrame(out, columns=["block_id", "part"])

    part = stored(rows.groupBy("root").applyInPandas(run, "block_id bigint, part bigint"), "parts")
    side = lambda k: small(part).select(F.col("block_id").alias(f"id_{k}"), F.col("part").alias(f"part_{k}"))
    inner = edges.select("id_a", "id_b").join(side("a"), "id_a").join(side("b"), "id_b").where("part_a = part_b")
    return components(part, inner, "block_id").withColumnRenamed("id", "block_id")


def rollup(blocks: DataFrame) -> DataFrame:
    """Counts, extents and flags per cluster of blocks: cluster_id, x, y (centroid), corners (array of x, y structs), stand_count.

    Extents are those of the centroids and of all corners: a cluster sends its hulls' corners only. A block without corners
    counts, but has no part in the geometry's extent.
    """
    counts = blocks.groupBy("cluster_id").agg(F.count("*").cast("int").alias("block_count"), F.sum("stand_count").cast("long").alias("stand_count"))
    spread = blocks.select("cluster_id", F.explode("corners").alias("c")).select("cluster_id", "c.x", "c.y")
    for name, points in {"centroid_extent_m": blocks, "geometry_extent_m": spread}.items():
        counts = counts.join(group_extent(points.select("cluster_id", "x", "y"), "cluster_id").withColumnRenamed("extent_m", name), "cluster_id", "left")
    wide = F.col("geometry_extent_m")
    flags = {"oversized": wide > P.CLUSTER_EXTENT_M, "within_target_extent": wide <= P.TARGET_EXTENT_M, "within_target_block_count": F.col("block_count").between(*P.TARGET_BLOCKS)}
    return counts.withColumns(flags)
