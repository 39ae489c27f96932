"""Tables written part-way through a job, in the folder that the whole cluster shares.

``materialize`` cuts a plan's lineage: the rows are written as Parquet below
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read and never a
recomputation. Only a session that runs in one process may leave that folder unset. Tables that
nothing reads any more are dropped with ``discard``, the rest when the driver's process ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Has Spark delete a statement's shuffle files as soon as the statement ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: list[str] = []
_ended: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a temporary one only where the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="trialframe-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def fresh_path(spark: SparkSession, what: str) -> str:
    """A path below this application's folder, which goes when the driver's process ends."""
    folder = f"{shared_dir(spark)}/trialframe/{spark.sparkContext.applicationId}"
    if folder not in _ended:
        _ended.add(folder)
        atexit.register(_forget, spark, folder)
    return f"{folder}/{what}-{uuid.uuid4().hex}"


def _forget(spark: SparkSession, folder: str) -> None:
    try:
        remove(spark, folder)
    except Exception:  # the JVM went first
        pass


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = fresh_path(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trialframe_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``materialize`` wrote, once no plan that is still to run reads it."""
    for df in tables:
        remove(df.sparkSession, df._trialframe_path)


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """Statements that run in here leave no shuffle files behind; else these stay until the driver happens to collect its garbage.

    A statement that runs twice shuffles twice, so this is for writes of large tables.
    """
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
