"""Durable runs of several drivers and at once: leases, parallel batches, cancellation, cache per block, resources."""

from __future__ import annotations

import subprocess
import sys
import threading
import time

import pytest
from pyspark.sql import functions as F

from trialframe.context import Context
from trialframe.errors import Cancelled, Paused, ResourceError, RunError, StateConflict
from trialframe.operators.runstore import RunStore
from trialframe.plans.pipeline import Block, Pipeline, python_block
from trialframe.plans.study import DurableRunner
from trialframe.schemas import schema

ITEMS = "items array<bigint>"


def _input(spark, items):
    return spark.createDataFrame([("r0", items)], f"run_id string, {ITEMS}")


def _slow(seconds, bad=None):
    """A block that sleeps for each item on the workers, and fails at once for one of them."""

    def work(frames):
        for frame in frames:
            for items in frame["items"]:
                if bad is not None and items[0] == bad:
                    raise ValueError("bad item")
                time.sleep(seconds)
            yield frame

    return python_block("slow", work, ITEMS, ITEMS)


def _runner(spark, tmp_path, **options):
    return DurableRunner(spark, RunStore(spark, f"file://{tmp_path}/state"), f"file://{tmp_path}/work", **options)


def test_batches_run_at_once_and_in_order(spark, tmp_path):
    p = Pipeline("p").add("slow", _slow(1.0), map_over="items", parallelism=4)
    tracker, seen, over = spark.sparkContext.statusTracker(), [0], threading.Event()

    def watch():
        while not over.wait(0.05):
            seen.append(len(tracker.getActiveJobsIds()))

    threading.Thread(target=watch, daemon=True).start()
    out = _runner(spark, tmp_path).run(p, _input(spark, list(range(8)))).final.first()["items"]
    over.set()
    assert out == list(range(8)) and max(seen) >= 3


def test_a_failing_batch_stops_its_siblings(spark, tmp_path):
    p = Pipeline("p").add("slow", _slow(60.0, bad=3), map_over="items", parallelism=4)
    began = time.monotonic()
    with pytest.raises(RunError, match="bad item"):
        _runner(spark, tmp_path).run(p, _input(spark, [0, 1, 2, 3]))
    assert time.monotonic() - began < 40 and not spark.sparkContext.statusTracker().getActiveJobsIds()


def test_cancelling_stops_running_batches_and_keeps_finished_ones(spark, tmp_path):
    first = {"sleep": 60.0}

    def work(df):
        wait = first["sleep"]
        late = F.udf(lambda x: (time.sleep(wait if x >= 2 else 0), x)[1], "bigint")
        return df.withColumn("items", F.array(late(F.col("items")[0])))

    p = Pipeline("p").add("slow", Block("slow", work, schema(ITEMS), schema(ITEMS), version="1"), map_over="items", parallelism=2)
    context, runner = Context(), _runner(spark, tmp_path)
    threading.Timer(15, context.token.cancel).start()
    began = time.monotonic()
    with pytest.raises(Cancelled):
        runner.run(p, _input(spark, [0, 1, 2, 3]), context)
    assert time.monotonic() - began < 35
    folders = [s.getPath().getName() for s in runner.store._fs.globStatus(runner.store._path(f"{runner.root}/partitions/*/*/_SUCCESS"))]
    assert len(folders) == 2


def test_a_pause_asked_of_the_store_is_heard(spark, tmp_path):
    runner = _runner(spark, tmp_path)
    runner.POLL = 0.3
    p = Pipeline("p").add("slow", _slow(3.0), map_over="items")

    def pause():
        while runner.store.list_runs(kind="pipeline").isEmpty():
            time.sleep(0.3)
        top = runner.store.list_runs(kind="pipeline").first().run_id
        while runner.store.state(top).state != "running":
            time.sleep(0.3)
        runner.store.transition(top, "pausing")

    threading.Thread(target=pause, daemon=True).start()
    with pytest.raises(Paused):
        runner.run(p, _input(spark, [1, 2, 3, 4, 5, 6]))
    states = {r.kind: runner.store.state(r.run_id).state for r in runner.store.list_runs().collect()}
    assert states["pipeline"] == "paused"


def test_one_of_two_drivers_runs_a_pipeline(spark, tmp_path):
    p = Pipeline("p").add("slow", _slow(2.0), map_over="items")
    a, b, patient = (_runner(spark, tmp_path, lease_s=6.0, wait_s=w) for w in (0.0, 0.0, 90.0))
    done = []
    thread = threading.Thread(target=lambda: done.append(a.run(p, _input(spark, [1, 2, 3]))))
    thread.start()
    while b.store.list_runs(kind="block").isEmpty():
        time.sleep(0.2)
    time.sleep(2)
    with pytest.raises(StateConflict, match="another driver"):
        b.run(p, _input(spark, [1, 2, 3]))
    again = patient.run(p, _input(spark, [1, 2, 3]))  # waits, renewals included, then finds the block in the cache
    thread.join()
    assert done[0].final.first()["items"] == [1, 2, 3] and again.hits == ("slow",)
    held = a.store.table("events").where("event_type = 'heartbeat'").count()
    assert held >= 1
    assert b.run(p, _input(spark, [1, 2, 3])).hits == ("slow",)  # given up at the end


def test_a_block_has_its_own_cache_mode(spark, tmp_path):
    def block(name, cache):
        return Block(name, lambda df: df, schema(ITEMS), schema(ITEMS), cache=cache, version=name)

    p = Pipeline("p").then(block("never", "disabled")).then(block("kept", None)).then(block("again", "refresh"))
    runner = _runner(spark, tmp_path)
    assert runner.run(p, _input(spark, [1])).hits == ()
    assert runner.run(p, _input(spark, [1])).hits == ("kept",)
    started = runner.store.table("events").where("state = 'running' AND event_type = 'transition'").groupBy("run_id").count()
    assert sorted(r["count"] for r in started.collect()) == [1, 2, 2, 2]


def test_blocks_have_a_folder_and_report_to_the_store(spark, tmp_path):
    def work(df, context):
        df.write.parquet(f"{context.work_dir}/half")
        context.report_metric("rows", df.count())
        assert context.save_checkpoint({"done": 1}) == 1
        return df.sparkSession.read.parquet(f"{context.work_dir}/half").join(df.select("run_id"), "run_id")

    runner = _runner(spark, tmp_path)
    p = Pipeline("p").then(Block("work", work, schema(ITEMS), schema(ITEMS)))
    assert runner.run(p, _input(spark, [1])).final.first()["items"] == [1]
    run = runner.store.list_runs(kind="block").first().run_id
    assert [m.scalar for m in runner.store.metrics(run).collect()] == [1.0] and runner.store.latest_checkpoint(run) == {"done": 1}
    assert not list((tmp_path / "work/work").iterdir())


def test_resources_are_obeyed_or_refused(spark):
    p = Pipeline("p").add("slow", _slow(0), resources={"cpus": 2})
    with pytest.raises(ResourceError, match="local"):
        p.run(_input(spark, [1]))
    assert Pipeline("p").add("slow", _slow(0), resources={"cpus": 1}).run(_input(spark, [1]))["slow"].count() == 1
    plain = Block("plain", lambda df: df, schema(ITEMS), schema(ITEMS))
    with pytest.raises(ResourceError):
        Pipeline("p").add("plain", plain, resources={"cpus": -1}).run(_input(spark, [1]))


CLUSTER = """
from pyspark.sql import SparkSession
from tests.test_execution import Pipeline, _input, _slow
conf = {"spark.master": "local-cluster[1,2,1024]", "spark.ui.enabled": "false", "spark.executor.memory": "1g"}
spark = SparkSession.builder.config(map=conf).getOrCreate()
out = Pipeline("p").add("slow", _slow(0), resources={"cpus": 2}).run(_input(spark, [4, 5]))["slow"]
print("PLAN", "name: cpus, amount: 2.0" in out._jdf.queryExecution().executedPlan().toString(), out.first()["items"])
"""


def test_a_cluster_runs_a_block_with_its_profile():
    done = subprocess.run([sys.executable, "-c", CLUSTER], capture_output=True, text=True, timeout=180)
    assert "PLAN True [4, 5]" in done.stdout, done.stderr[-2000:]
