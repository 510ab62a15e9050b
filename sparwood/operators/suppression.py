"""Greedy suppression of candidates near a better one, per bucket, in tiles."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import priors as P
from ..session import stored
from .ordering import numbered_rows
from .spatial import cell

OPEN, RETAINED, SUPPRESSED = 0, 1, 2
#: Radii around a tile that are looked at with it: what a point hangs on, and that in turn on, mostly lies within.
MARGIN = 6


def decider(group: list[str], radius: float) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Decides points (rank_before, x, y, status, inner) that come in order of group and rank; only the own ones are given back.

    A point within the radius of a retained better one is suppressed; else it stays open if an open better one is within the
    radius, and is retained if none is. Points that aren't inner keep their status: what is around them isn't known here.
    Points that count lie in a grid of cells as wide as the radius, so a point looks at nine cells; only they, and only those
    of the present group, are held.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, cells = None, {}
        for rows in batches:
            x, y = rows["x"].to_numpy(), rows["y"].to_numpy()
            cx, cy = np.floor(x / radius).astype(np.int64).tolist(), np.floor(y / radius).astype(np.int64).tolist()
            state, inner, of = rows["status"].tolist(), rows["inner"].tolist(), list(zip(*(rows[c].tolist() for c in group)))
            for i, (u, v) in enumerate(zip(x.tolist(), y.tolist())):
                if of[i] != now:
                    now, cells = of[i], {}
                if state[i] == OPEN and inner[i]:
                    state[i] = RETAINED
                    for a, b, k in (c for gx in (cx[i] - 1, cx[i], cx[i] + 1) for gy in (cy[i] - 1, cy[i], cy[i] + 1) for c in cells.get((gx, gy), ())):
                        if ((a - u) ** 2 + (b - v) ** 2) ** 0.5 < radius:
                            state[i] = SUPPRESSED if k == RETAINED else OPEN
                            if k == RETAINED:
                                break
                if state[i] != SUPPRESSED:
                    cells.setdefault((cx[i], cy[i]), []).append((u, v, state[i]))
            rows["status"] = np.array(state, np.int32)
            yield rows[rows["own"]].drop(columns=["own", "inner"])

    return run


def suppress(candidates: DataFrame, bucket: list[str], score: str, ties: list[str], label: str, radius: float = P.SEPARATION_M, tile: float | None = None) -> DataFrame:
    """Adds rank_before, suppressed_by (label of the suppressor, null: retained) and suppressed_m within each bucket.

    Order: score descending, then ties, which make it total. A retained point suppresses all worse ones nearer than the
    radius; of several the nearest is named, of equally near ones the better. Rows without score, position or bucket are left
    out.

    A round decides, in each tile of a bucket, what follows from the tile and a margin around it; what hangs on points beyond
    waits for the next round, which looks at the retained and open points only. The best open point of a bucket is always
    decided, so rounds end; they number as many as tiles that a chain of dependent points crosses. A task goes through its
    tiles in order and holds the points of one tile that may suppress others, never a bucket. Suppressors are named by a join
    with the retained points, of which few fit within the radius.
    """
    side, margin = tile or 64.0 * radius, MARGIN * radius
    have = candidates.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).dropna(subset=["x", "y", *bucket])
    ranked = stored(numbered_rows(have, [F.col(score).desc(), *map(F.col, ties)], "rank_before", bucket), "ranked")
    state = ranked.select(*bucket, "rank_before", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.lit(OPEN).alias("status"))
    group = [*bucket, "_tx", "_ty"]
    gone: list[DataFrame] = []
    while True:
        spread = state
        for v in "xy":
            spread = spread.withColumn(f"_t{v}", F.explode(F.sequence(cell(F.col(v) - margin, side), cell(F.col(v) + margin, side))))
        at = lambda v, more: F.col(v).between(F.col(f"_t{v}") * side - more, (F.col(f"_t{v}") + 1) * side + more)  # noqa: B023, E731
        spread = spread.withColumns({"own": (F.col("_tx") == cell(F.col("x"), side)) & (F.col("_ty") == cell(F.col("y"), side)), "inner": at("x", margin - radius) & at("y", margin - radius)})
        spread = spread.repartition(*group).sortWithinPartitions(*group, "rank_before")
        schema = spread.drop("own", "inner").schema
        after = stored(spread.mapInPandas(decider(group, radius), schema).drop("_tx", "_ty"), "tiles")
        gone.append(after.where(F.col("status") == SUPPRESSED))
        state = after.where(F.col("status") != SUPPRESSED)
        if state.where(F.col("status") == OPEN).isEmpty():
            break
    near = lambda v: F.explode(F.array(*[cell(F.col(v), radius) + k for k in (-1, 0, 1)])).alias(f"c{v}")
    named = ranked.select(*bucket, "rank_before", F.col(label).alias("_label"))
    kept = state.join(named, [*bucket, "rank_before"]).select(*bucket, F.col("rank_before").alias("_better"), "_label", F.col("x").alias("_x"), F.col("y").alias("_y"), near("x"))
    kept = kept.select(*bucket, "_better", "_label", "_x", "_y", "cx", F.explode(F.array(*[cell(F.col("_y"), radius) + k for k in (-1, 0, 1)])).alias("cy"))
    lost = gone[0]
    for more in gone[1:]:
        lost = lost.unionByName(more)
    lost = lost.withColumns({"cx": cell(F.col("x"), radius), "cy": cell(F.col("y"), radius)})
    d = F.sqrt((F.col("x") - F.col("_x")) ** 2 + (F.col("y") - F.col("_y")) ** 2)
    met = lost.join(kept, [*bucket, "cx", "cy"]).where((d < radius) & (F.col("_better") < F.col("rank_before")))
    by = met.groupBy(*bucket, "rank_before").agg(F.min(F.struct(d.alias("d"), F.col("_better"), F.col("_label"))).alias("b"))
    by = by.select(*bucket, "rank_before", F.col("b._label").alias("suppressed_by"), F.col("b.d").alias("suppressed_m"))
    out = ranked.join(by, [*bucket, "rank_before"], "left")
    return out.select(*candidates.columns, F.col("rank_before").cast("int").alias("rank_before"), "suppressed_by", "suppressed_m")
