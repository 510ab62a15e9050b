"""The N best rows of every group by bounded heaps that are built before the shuffle and merged after it (problem 3).

Every task keeps at most N rows of a group while it reads its partition: rows arrive in Arrow batches, a row that can't
beat the root of its group's full heap is dropped before the sort (by a hash join with the roots), the others are merged in.
A heap is kept as a sorted run, which is what a merge needs; its root is its last row. When a task holds too many groups it emits its heaps and starts anew, as partial
aggregation does; that is right because merging is associative. So a group of a third of all rows sends N rows per task.
With very many tasks the heaps of a group are merged in salted parts first. The last merge is a window over these rows.

Order: higher score, then the tie columns ascending with nulls last. Rows with null or NaN score or a null group column
take no part. Repeated rows all count. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scoring import species_key

#: Rows that a task holds in heaps before it emits them.
HELD_ROWS = 500_000
#: Rows, at least, that are merged into the heaps at once.
WAITING_ROWS = 1 << 16
#: Partial heaps of one group beyond which they are merged in salted parts first.
FAN_IN = 512


def _bounded(rows: pa.Table, groups: list[str], score: str, ties: list[str], n: int) -> pa.Table:
    """The n first rows of every group, sorted by group and place."""
    order = pc.sort_indices(rows, sort_keys=[*((g, "ascending") for g in groups), (score, "descending"), *((t, "ascending") for t in ties)])
    rows = rows.take(order)
    new = np.zeros(rows.num_rows, bool)
    new[:1] = True
    for g in groups:
        c = rows.column(g).combine_chunks()
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    return rows.filter(pa.array(np.arange(len(new)) - first < n))


def _roots(held: pa.Table, groups: list[str], score: str, n: int) -> pa.Table:
    """The groups whose heap is full, with the score of its root, that is of its last row."""
    size = held.group_by(groups).aggregate([(score, "count"), (score, "min")])
    full = size.filter(pc.equal(size.column(f"{score}_count"), n))
    return full.select([*groups, f"{score}_min"]).rename_columns([*groups, "_root"])


def _promising(rows: pa.Table, roots: pa.Table, groups: list[str], score: str) -> pa.Table:
    """The rows that can get into their group's heap: those of groups not full yet, and those with at least the root's score."""
    met = rows.join(roots, groups, join_type="left outer")
    return met.filter(pc.or_kleene(pc.is_null(met.column("_root")), pc.greater_equal(met.column(score), met.column("_root")))).select(rows.column_names)


def _heaps(groups: list[str], score: str, ties: list[str], n: int, held_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        waiting: list[pa.RecordBatch] = []
        rows = 0

        def merge() -> pa.Table:
            fresh = pa.Table.from_batches(waiting)
            if held is None:
                return _bounded(fresh, groups, score, ties, n)
            return _bounded(pa.concat_tables([held, _promising(fresh, _roots(held, groups, score, n), groups, score)]), groups, score, ties, n)

        for b in batches:
            if not b.num_rows:
                continue
            waiting.append(b)
            rows += b.num_rows
            if rows >= max(WAITING_ROWS, held.num_rows if held is not None else 0):
                held, waiting, rows = merge(), [], 0
                if held.num_rows >= held_rows:
                    yield from held.to_batches(max_chunksize=10_000)
                    held = None
        if waiting:
            held = merge()
        if held is not None:
            yield from held.to_batches(max_chunksize=10_000)

    return run


def top_n(df: DataFrame, groups: list[str], score: str, ties: list[str], n: int, place: str = "place") -> DataFrame:
    """The groups, score and ties columns of the n best rows per group, with their place from 1."""
    c = df.select(*groups, score, *ties).where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).dropna(subset=groups)
    heaps = _heaps(groups, score, ties, n, HELD_ROWS)
    tasks = c.rdd.getNumPartitions() if not c.isStreaming else 1
    if tasks > FAN_IN:
        salts = int(tasks**0.5) + 1
        c = c.mapInArrow(heaps, c.schema).withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        c = c.repartition(*groups, "_salt").drop("_salt")
    partial = c.mapInArrow(heaps, c.schema)
    order = [F.col(score).desc(), *(F.col(t).asc_nulls_last() for t in ties)]
    return partial.withColumn(place, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(place) <= n)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """candidate_id, rank_macrocluster: places 1 to 10 in each run, species and macrocluster."""
    c = spark.read.parquet(f"{folder}/scout_candidates.parquet")
    c = c.select("run_id", species_key(F.col("species")).alias("species"), "macrocluster_id", "scout_score", "id_a", "id_b", "candidate_id")
    best = top_n(c, ["run_id", "species", "macrocluster_id"], "scout_score", ["id_a", "id_b", "candidate_id"], 10)
    return best.select("candidate_id", F.col("place").cast("int").alias("rank_macrocluster"))
