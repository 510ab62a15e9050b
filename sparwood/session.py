"""Session defaults and the shared folder in which intermediate tables are kept."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A side of a join is broadcast only if its measured bytes stay below this.
BROADCAST_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="sparwood-")
        spark.conf.set("spark.checkpoint.dir", known)
        atexit.register(shutil.rmtree, known, ignore_errors=True)
    return known


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the session was started: by path, on other machines as a zip."""
    sc, home = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = sc.environment.get("PYTHONPATH", "")
    if home in known.split(os.pathsep):
        return
    if home not in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        sc.environment["PYTHONPATH"] = os.pathsep.join(p for p in (home, known) if p)
    if not sc.master.startswith("local") and (folder := shared_dir(spark).removeprefix("file://")).startswith("/"):
        sc.addPyFile(shutil.make_archive(f"{folder}/sparwood-{uuid.uuid4().hex}", "zip", home, "sparwood"))


#: Folders written by this process that nothing has deleted yet, and the sessions that wrote them.
_WRITTEN: dict[str, SparkSession] = {}


def stored(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage by a written table in the shared folder, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparwood/{name}-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_stored(*tables: DataFrame) -> None:
    """Delete tables that :func:`stored` wrote and that nothing reads any more."""
    for df in tables:
        files = [f.split(":", 1)[-1].lstrip("/") for f in df.inputFiles()]
        for path in [p for p in _WRITTEN if any(f.startswith(p.split(":", 1)[-1].lstrip("/") + "/") for f in files)]:
            _delete(_WRITTEN.pop(path), path)


def clean_up() -> None:
    """Delete all stored tables: to be called when no result of this package is read any more; done at exit at the latest."""
    while _WRITTEN:
        path, spark = _WRITTEN.popitem()
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: what is left on a mounted folder can still be deleted
            shutil.rmtree(path.removeprefix("file:"), ignore_errors=True)


atexit.register(clean_up)


def stored_bytes(df: DataFrame) -> int:
    """Size that Catalyst knows of a stored table (the sum of its files)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
