"""One group identifier for all records that matches chain together (problem 4).

Minimum labels are propagated across edges and the pointers shortened by jumping. A round lets every node of the (by now
contracted) graph point at its smallest neighbour, or at itself if that is smaller; the pointers are jumped until each is
at a root, four times as far with every written step, so that a run of n nodes takes log4(n) steps; then the edges' ends
are replaced by their roots, and edges inside a group vanish. Every step is written to the shared folder. Rounds end when
no edge is left, that is when no label can change. Two rounds at least halve the nodes: a root that nothing points at has
a neighbour that points lower still, so it is no root in the next round; any other root has a node to itself. So rounds
grow with the logarithm of the nodes, whatever the order of the ids. The label of a record is the composition of the
rounds' pointers, from the last round backwards, so that joins are on small tables first.

The smallest neighbour is a hash aggregate with partial aggregation, so that a node with a third of all edges sends one
value per task. Joins on node ids are left to AQE, which splits the partition of such a node; pointers are broadcast
only where their stored size is proven small.

Defined results: pairs with a null side link nothing and name no record; a self-pair names its record; order and
repetition of pairs don't matter; no pairs, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.spatial import small
from ..session import drop_stored, stored

#: Rounds and written jumps of the last call, for tests.
LAST: dict[str, int] = {}


def small_side(side: DataFrame, source: DataFrame) -> DataFrame:
    return F.broadcast(side) if small(source) is not source else side


def _jump(pointers: DataFrame) -> DataFrame:
    """Every pointer (id, to, done) moved to where its target points; done: the target is known to be a root."""

    def once(p: DataFrame, by: DataFrame) -> DataFrame:
        up = by.select(F.col("id").alias("to"), F.col("to").alias("up"), F.col("done").alias("there"))
        return p.select("id", "to").join(small_side(up, pointers), "to").select("id", F.col("up").alias("to"), F.col("there").alias("done"))

    twice = once(pointers, pointers)
    return stored(once(twice, twice), "jump")


def _roots(edges: DataFrame) -> DataFrame:
    """id, to: the root that each node's chain of smallest neighbours ends at."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lowest = both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("to"))
    pointers = stored(lowest.withColumn("done", F.col("id") == F.col("to")), "pointers")
    while True:
        old, pointers = pointers, _jump(pointers)
        LAST["jumps"] += 1
        drop_stored(old)
        if pointers.where("not done").isEmpty():
            return pointers.select("id", "to")


def groups(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """id, group_id of every record that a pair with both sides names; group_id is the smallest id of its group."""
    LAST.update(rounds=0, jumps=0)
    e = pairs.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    links = stored(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    edges = links.where("a != b")
    rounds: list[DataFrame] = []
    while not edges.isEmpty():
        roots = _roots(edges)
        rounds.append(roots)
        side = lambda k: small_side(roots.select(F.col("id").alias(k), F.col("to").alias(f"r{k}")), roots)  # noqa: B023, E731
        one = edges.join(side("a"), "a").join(side("b"), "b").where("ra != rb")
        old, edges = edges, stored(one.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
        LAST["rounds"] += 1
        if len(rounds) > 1:
            drop_stored(old)
    if not rounds:
        return nodes.select("id", F.col("id").alias("group_id"))
    drop_stored(edges)
    final = rounds.pop()
    while rounds:
        # The roots of a round are the nodes of the next, but for those whose group is whole.
        before = rounds.pop()
        up = small_side(final.select(F.col("id").alias("to"), F.col("to").alias("up")), final)
        joined = before.join(up, "to", "left").select("id", F.coalesce("up", "to").alias("to"))
        joined, old = stored(joined, "labels"), final
        drop_stored(old, before)
        final = joined
    # Nodes that only pair with themselves are in no round.
    return nodes.join(small_side(final, final), "id", "left").select("id", F.coalesce("to", "id").alias("group_id"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """id, group_id of every stand id in a pair with both ids."""
    return groups(spark.read.parquet(f"{folder}/ecotones.parquet"), "id_a", "id_b")


def p4_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Number of groups by size."""
    sizes = p4_found(spark, folder).groupBy("group_id").agg(F.count("*").alias("size"))
    return sizes.groupBy("size").agg(F.count("*").alias("n_groups"))
