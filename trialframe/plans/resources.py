"""What a block's tasks need, as a profile that Spark's stage-level scheduling obeys.

``resources`` of a node may name ``cpus`` and ``gpus`` of a task, ``memory_mb`` and ``cores`` of an executor, and any
resource that the cluster offers by its own name. Executor requests start executors of that kind, which needs dynamic
allocation; task requests do with the ones there are. Masters that schedule no profiles are an error, never silence.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.resource import ExecutorResourceRequests, ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import SparkSession

from trialframe.errors import ResourceError

#: Masters that schedule by profiles (prefixes, fixed values).
MASTERS = ("spark://", "yarn", "k8s://", "local-cluster")
EXECUTOR = ("memory_mb", "cores")


def profile(spark: SparkSession, resources: Mapping[str, float]) -> ResourceProfile | None:
    """The profile of a block's tasks, or none where they need what every task has."""
    wrong = sorted(k for k, v in resources.items() if not v > 0)
    if wrong:
        raise ResourceError(f"resources {wrong} are not above 0")
    own = int(spark.sparkContext.getConf().get("spark.task.cpus", "1"))
    asked = {k: v for k, v in resources.items() if not (k == "cpus" and v <= own)}
    if not asked:
        return None
    master = spark.sparkContext.master
    if not master.startswith(MASTERS):
        raise ResourceError(f"master {master} schedules no resource profiles; the block asks for {asked}")
    builder, task, executor = ResourceProfileBuilder(), TaskResourceRequests(), ExecutorResourceRequests()
    if any(k in EXECUTOR for k in asked):
        if spark.sparkContext.getConf().get("spark.dynamicAllocation.enabled", "false") != "true":
            raise ResourceError(f"executors of a kind {asked} need spark.dynamicAllocation.enabled")
        if "memory_mb" in asked:
            executor = executor.memory(f"{int(asked['memory_mb'])}m")
        if "cores" in asked:
            executor = executor.cores(int(asked["cores"]))
        for k in asked.keys() - {"cpus", *EXECUTOR}:
            executor = executor.resource("gpu" if k == "gpus" else k, max(1, int(asked[k])))
        builder = builder.require(executor)
    for k, v in asked.items():
        if k == "cpus":
            task = task.cpus(int(v))
        elif k not in EXECUTOR:
            task = task.resource("gpu" if k == "gpus" else k, v)
    return builder.require(task).build
