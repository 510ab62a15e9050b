"""Places of rows in an order, without one task that sees all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored


def numbered_rows(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """Adds the place (bigint, from 1) of each row in the order, within ``by``; the order should be total.

    Rows are cut into ranges of the order, sorted and written; a place is the count of the ranges before, of which there are as
    many as partitions, and the place within the range, by which rows are numbered as they are written. So neither a hot group
    nor the whole table is sorted in one task, and no row is moved again after the cut.
    """
    by = by or []
    keys = [*[F.col(b) for b in by], *order]
    cut = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "ranges")
    cut = cut.withColumn("_part", F.shiftright("_at", 33))
    sizes = cut.groupBy(*by, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = sizes.select(*by, "_part", (F.sum("_n").over(Window.partitionBy(*by).orderBy("_part")) - F.col("_n") - F.col("_first")).alias("_before"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col("r._part") == F.col("b._part")]
    joined = cut.alias("r").join(F.broadcast(before).alias("b") if not by else before.alias("b"), same)
    return joined.select(*[F.col(f"r.`{c}`") for c in df.columns], (F.col("_before") + F.col("_at") + 1).alias(name))
