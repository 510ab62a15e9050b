"""Connected components, of each task's edges first and by large-star and small-star steps between them, numbered by their smallest member."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_stored, stored
from .ordering import numbered_rows
from .spatial import small


#: Edges that a task of :func:`forest` holds before it reduces them; if more than half are left, they go out.
_HELD = 2_000_000


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges u, v, sorted, and the smallest node that each hangs together with."""
    coded = pa.array(np.concatenate([u, v])).dictionary_encode()
    nodes = coded.dictionary.to_numpy()
    order = np.argsort(nodes)
    rank = np.empty(len(nodes), int)
    rank[order] = np.arange(len(nodes))
    nodes, (a, b) = nodes[order], rank[coded.indices.to_numpy()].reshape(2, -1)
    low = np.arange(len(nodes))
    while len(a):
        # Roots take the smallest root they are linked to, then all look up to their roots; edges within a tree are dropped.
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (nxt := low[low]).tobytes() != low.tobytes():
            low = nxt
        a, b = low[a], low[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[low]


def forest(edges: DataFrame, roots: bool = False) -> DataFrame:
    """u > v: edges that connect what the edges u, v (bigint, no nulls) connect, at most one for each node a task meets.

    With ``roots`` every node comes at least once: the smallest of a task's component with itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def reduced() -> np.ndarray:
            nodes, low = joined(*np.concatenate(held, 1))
            return np.stack([nodes, low])[:, (nodes != low) | roots]

        def rows(e: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], ["u", "v"])

        for b in batches:
            held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]))
            size += b.num_rows
            if size > _HELD:
                held = [reduced()]
                size = held[0].shape[1]
                if size > _HELD // 2:
                    yield rows(held.pop())
                    size = 0
        if held:
            yield rows(reduced())

    return edges.select("u", "v").mapInArrow(run, "u bigint, v bigint")


def _stars(e: DataFrame) -> DataFrame:
    """id, root of every node that the edges u > v (stored, distinct; deleted here) meet.

    A star step links every node's neighbours to its smallest neighbour (Kiveris et al. 2014). Each step is an aggregate
    and a join on the node, written to the shared folder; the number of steps grows with the logarithm of the size.
    """

    def star(pairs: DataFrame, large: bool) -> DataFrame:
        near = pairs.union(pairs.select(F.col("v"), F.col("u"))) if large else pairs
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        linked = near.join(low, "u")
        if large:
            return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        own = low.where("u != m").select("u", F.col("m").alias("v"))
        return linked.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own).distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(e)
    while True:
        nxt = stored(star(star(e, True), False).where("u != v"), "edges")
        now = mark(nxt)
        drop_stored(e)
        e = nxt
        if now == seen:
            break
        seen = now
    leaves = e.groupBy("u").agg(F.min("v").alias("root"))
    return leaves.select(F.col("u").alias("id"), "root").union(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())


def labels(edges: DataFrame) -> DataFrame:
    """id, root (smallest id of the component) of every node that the edges u > v meet.

    If nodes are whole numbers, each task labels the components of its own edges first. A node that tasks label differently
    links its labels, and only these links are left for star steps: none where components lie within tasks.
    """
    if {kind for _, kind in edges.dtypes} != {"bigint"}:
        return _stars(stored(edges.distinct(), "edges"))
    met = stored(forest(edges, True), "forest")
    low = stored(met.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high")), "labels")
    apart = low.where("low != high")
    links = None
    if not apart.isEmpty():
        links = stored(met.join(apart, "u").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct(), "edges")
    drop_stored(met)
    if links is None:
        return low.select(F.col("u").alias("id"), F.col("low").alias("root"))
    return low.join(_stars(links).withColumnRenamed("id", "low"), "low", "left").select(F.col("u").alias("id"), F.coalesce("root", "low").alias("root"))


def rooted(vertices: DataFrame, edges: DataFrame, id_: str = "id", a: str = "id_a", b: str = "id_b") -> DataFrame:
    """Rows of vertices (each id once, no nulls) with root, the smallest id of their component; null where no edge to another vertex meets them.

    Edges to unknown vertices don't count. Such vertices show in the join with the labels, after which their edges are
    left out and the others labelled again: so the edges need no joins before, if there are none.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).dropna().where("u != v")

    def met(e: DataFrame) -> DataFrame:
        found = labels(e).withColumnRenamed("id", id_)
        return stored(vertices.withColumn("_known", F.lit(True)).join(found, id_, "full"), "rooted")

    m = met(e)
    if not (unknown := m.where("_known IS NULL").select(id_)).isEmpty():
        unknown = small(stored(unknown, "unknown"))
        for end in ("u", "v"):
            e = e.join(unknown.withColumnRenamed(id_, end), end, "left_anti").select("u", "v")
        m = met(e)
    return m.select(*vertices.columns, "root")


def components(vertices: DataFrame, edges: DataFrame, id_: str = "id", a: str = "id_a", b: str = "id_b") -> DataFrame:
    """id, root (smallest id of the component) of every vertex, isolated ones too; edges to unknown vertices don't count."""
    v = vertices.select(F.col(id_).alias("id")).where(F.col("id").isNotNull()).distinct()
    return rooted(v, edges, "id", a, b).select("id", F.coalesce("root", "id").alias("root"))


def numbered(groups: DataFrame, root: str = "root", name: str = "block_id") -> DataFrame:
    """Groups numbered from 0 (bigint) in the order of their roots."""
    ids = numbered_rows(groups.select(root).distinct(), [F.col(root)], name)
    return groups.join(ids.withColumn(name, F.col(name) - 1), root)


def with_key(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """df with the other columns of values, which has one row per key: columns of these names that df has are replaced, so it can be run again."""
    return df.drop(*[c for c in values.columns if c != key]).join(values, key, "left")
