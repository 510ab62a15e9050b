"""The stages from tables to a shortlist and a daily state, each written to its own folder and read from there by the next."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession

from .stages import BUILD, Stages


def run(spark: SparkSession, folder: str, out: str, skip: tuple[str, ...] = ()) -> dict[str, float]:
    """Write every stage to out/stage, in order; seconds by stage. Unknown names to skip are an error.

    A skipped stage is read from out if an earlier run left it there; else what needs it builds it for itself.
    """
    if unknown := set(skip) - set(BUILD):
        raise ValueError(f"unknown stages: {', '.join(sorted(unknown))}")
    took: dict[str, float] = {}

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(df.schema).parquet(f"{out}/{name}")

    stages = Stages(spark, folder, keep)
    for name in BUILD:
        if name in skip:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}")
            if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
                stages.tables[name] = spark.read.parquet(f"{out}/{name}")
            continue
        began = time.monotonic()
        stages[name]
        took[name] = time.monotonic() - began
    return took
