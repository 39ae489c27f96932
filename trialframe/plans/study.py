"""Running pipelines durably, and studies: propose, evaluate all trials in one job, decide, refine."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trialframe.context import Context
from trialframe.errors import Cancelled, Paused, RunError, StateConflict
from trialframe.functions.canonical import cache_key_of, fingerprint
from trialframe.operators import designs
from trialframe.operators.runstore import DONE, RunStore
from trialframe.plans.pipeline import Node, Pipeline
from trialframe.plans.space import Space
from trialframe.plugins import Plugins
from trialframe.schemas import strict
from trialframe.scratch import materialize

CACHE_MODES = ("read_write", "read_only", "refresh", "disabled")


@dataclass(frozen=True)
class Retry:
    """How often a block is tried, and for which errors (classes or names)."""

    attempts: int = 1
    initial_s: float = 0.1
    factor: float = 2.0
    most_s: float = 30.0
    jitter: float = 0.1
    on: tuple = ("RetryableError",)

    def covers(self, error: BaseException) -> bool:
        return any(isinstance(error, o) if isinstance(o, type) else o in (c.__name__ for c in type(error).__mro__) for o in self.on)

    def delay(self, attempt: int, chance: random.Random) -> float:
        return min(self.most_s, self.initial_s * self.factor**attempt) * (1 + chance.uniform(-self.jitter, self.jitter))


@dataclass
class Result:
    """Outputs by node; ``hits`` came from the cache, ``resumed`` from an earlier try, ``partitions`` too, by node: (run_id, partition_id)."""

    outputs: dict[str, DataFrame]
    final: DataFrame
    hits: tuple[str, ...] = ()
    resumed: tuple[str, ...] = ()
    partitions: dict[str, DataFrame] = field(default_factory=dict)


class DurableRunner:
    """Writes each block's table, lists it under its cache key last, and starts again behind what is listed.

    A mapped block is run in batches of its items. Each batch is a table of its own, so what was finished before a failure
    is there when the run is resumed. As many batches as the node's ``parallelism`` are Spark jobs at the same time; the first
    one that fails, and a pause or cancellation, stops the others while they run.

    Of several drivers one runs a pipeline (or a block) of one input: it holds a lease on the run, renews it while it
    works, and gives it up at the end. Another one waits up to ``wait_s`` for it, then it is refused. Whoever asked the store
    to pause or cancel the run is heard at the same rate.
    """

    #: Batches of a mapped block's items, at most.
    BATCHES = 16
    #: Seconds between two looks at a run that is being worked on.
    POLL = 2.0

    def __init__(self, spark: SparkSession, store: RunStore, root: str, cache: str = "read_write", retry: Retry = Retry(), lease_s: float = 120.0, wait_s: float = 0.0) -> None:
        if cache not in CACHE_MODES:
            raise ValueError(f"cache mode {cache!r} is none of {CACHE_MODES}")
        self.spark, self.store, self.root, self.cache, self.retry = spark, store, root.rstrip("/"), cache, retry
        self.lease_s, self.wait_s, self.owner = lease_s, wait_s, uuid.uuid4().hex

    @contextmanager
    def _held(self, run_id: str, context: Context) -> Iterator[None]:
        """Hold a run's lease, renewed by a thread that also passes on what the store was asked for."""
        until = time.monotonic() + self.wait_s
        while not self.store.acquire_lease(run_id, self.owner, self.lease_s):
            if time.monotonic() >= until:
                raise StateConflict(f"{run_id} is held by another driver")
            context.token.check()
            time.sleep(min(self.POLL, self.lease_s / 4))
        over, lost = threading.Event(), threading.Event()

        def keep() -> None:
            renew = time.monotonic() + self.lease_s / 3
            while not over.wait(min(self.POLL, self.lease_s / 6)):
                asked = self.store.newest(run_id)
                if asked == "pausing":
                    context.token.pause()
                elif asked == "cancelled":
                    context.token.cancel()
                if time.monotonic() >= renew:
                    renew = time.monotonic() + self.lease_s / 3
                    if not self.store.heartbeat(run_id, self.owner, self.lease_s):
                        lost.set()
                        return context.token.cancel()

        keeper = threading.Thread(target=inheritable_thread_target(self.spark)(keep), daemon=True)
        keeper.start()
        try:
            yield
        except Cancelled:
            if lost.is_set():
                raise StateConflict(f"the lease on {run_id} was lost") from None
            raise
        finally:
            over.set()
            keeper.join()
            self.store.release(run_id, self.owner)

    def _stopped(self, run_id: str, stop: Paused | Cancelled) -> None:
        """Record what ended a run, unless whoever asked for it did."""
        end = "paused" if isinstance(stop, Paused) else "cancelled"
        now = self.store.state(run_id).state
        if now != end and now != "cancelled":
            self.store.transition(run_id, "pausing")
            self.store.transition(run_id, end)

    def _tried(self, work: Callable[[], None], token, run_id: str, seed: int, given_up: Callable[[], bool] = lambda: False) -> None:
        """Run a block and write its table, again after errors that the policy covers; every retry is an event of its run."""
        chance = random.Random(seed)
        for attempt in range(self.retry.attempts):
            token.check()
            try:
                return work()
            except Exception as e:
                if given_up() or attempt + 1 == self.retry.attempts or not self.retry.covers(e):
                    raise
                wait = self.retry.delay(attempt, chance)
                self.store.add_event(run_id, "retry_scheduled", {"attempt": attempt + 1, "delay_s": wait, "error": repr(e)[:500]})
                token.check()
                time.sleep(wait)

    def run(self, pipeline: Pipeline, initial: DataFrame, context: Context | None = None, resume: bool = False, signals: bool = False) -> Result:
        """Run a pipeline. ``resume`` takes what an earlier try of the same input finished, whatever the cache mode; with ``signals`` the first interrupt pauses, the second cancels."""
        context = context or Context()
        restore = context.token.on_signals() if signals else lambda: None
        try:
            return self._run(pipeline, initial, context, resume)
        finally:
            restore()

    def _key(self, node: Node, upstream: list[str], base: str, context: Context) -> str:
        return cache_key_of(
            {
                "block": f"{node.block.name}:{node.block.version}:{node.map_over}", "code": node.block.code, "parameters": fingerprint(context.parameters), "inputs": fingerprint([base, *upstream]),
                "model": None, "serializers": "parquet", "environment": self.spark.version, "seed": str(context.seed), "dependencies": node.block.dependencies,
            }
        )

    def _run(self, pipeline: Pipeline, initial: DataFrame, context: Context, resume: bool) -> Result:
        # the input's content is part of every key, so that other input never returns old output
        digest = initial.select(F.sum(F.xxhash64(*initial.columns).cast("decimal(38,0)")).cast("string"), F.count("*").cast("string")).first()
        base = fingerprint([list(digest), context.seed, context.parameters])
        top = self.store.create_run(f"pipeline:{pipeline.fingerprint()}:{base}", "pipeline")
        with self._held(top, context):
            return self._blocks(pipeline, initial, context, resume, base, top)

    def _blocks(self, pipeline: Pipeline, initial: DataFrame, context: Context, resume: bool, base: str, top: str) -> Result:
        self._to_running(top)
        outputs: dict[str, DataFrame] = {}
        keys: dict[str, str] = {}
        hits, resumed, partitions = [], [], {}
        last = None
        try:
            for node in pipeline.validate():
                last = node.id
                key = keys[node.id] = self._key(node, [keys[d] for d in node.depends_on], base, context)
                path = f"{self.root}/blocks/{key}"
                run_id = self.store.create_run(f"block:{key}", "block", top)
                there = self._there(path)
                if resume and there and self.store.state(run_id).state in DONE:
                    resumed.append(node.id)
                elif there and self._mode(node) in ("read_write", "read_only") and self.store.find_cache(key) is not None:
                    hits.append(node.id)
                else:
                    with self._held(run_id, context):
                        known = self._evaluated(pipeline, node, pipeline.inputs_of(node, outputs, initial), context, key, run_id, resume)
                    if known is not None:
                        partitions[node.id] = known
                    if self._mode(node) in ("read_write", "refresh"):
                        lineage = {d: keys[d] for d in node.depends_on}
                        self.store.register_artifact({"content_hash": key, "media_type": "application/x-parquet", "codec": "parquet", "lineage": lineage, "metadata": {"path": path}, "size": 0}, run_id, key)
                outputs[node.id] = self.spark.read.parquet(path)
        except (Paused, Cancelled) as stop:
            self._stopped(top, stop)
            raise
        except Exception as e:
            self.store.transition(top, "failed", payload={"node": last, "error": str(e)[:500]})
            raise RunError(f"{pipeline.name}, node {last}: {e}") from e
        if self.store.state(top).state == "running":
            self.store.transition(top, "completed")
        return Result(outputs, outputs[last], tuple(hits), tuple(resumed), partitions)

    def _mode(self, node: Node) -> str:
        """How a block uses the cache: as it says itself, else as the runner does."""
        return node.block.cache or self.cache

    def _evaluated(self, pipeline: Pipeline, node: Node, df: DataFrame, context: Context, key: str, run_id: str, resume: bool) -> DataFrame | None:
        """Run one block and write its table; for a mapped one, the partitions that were finished before.

        Its context names the block's run, in this store, and a folder of its own that goes when the block is over.
        """
        self._to_running(run_id)
        known, work = None, f"{self.root}/work/{run_id}"
        context = replace(context, run_id=run_id, store=context.store or self.store, work_dir=work)
        self.store._fs.mkdirs(self.store._path(work))
        try:
            if node.map_over is None:
                self._tried(lambda: pipeline.apply(node, df, context).write.mode("overwrite").parquet(f"{self.root}/blocks/{key}"), context.token, run_id, context.seed)
            else:
                known = self._mapped(pipeline, node, df, context, key, run_id, resume)
        except (Paused, Cancelled) as stop:
            self._stopped(run_id, stop)
            raise
        except Exception as e:
            self.store.transition(run_id, "failed", payload={"error": str(e)[:500]})
            raise
        finally:
            self.store._fs.delete(self.store._path(work), True)
        self.store.transition(run_id, "completed")
        return known

    def _mapped(self, pipeline: Pipeline, node: Node, df: DataFrame, context: Context, key: str, run_id: str, resume: bool) -> DataFrame:
        """Run a mapped block batch by batch; (run_id, partition_id) of what was finished before. The run's lease is held."""
        folder = f"{self.root}/partitions/{key}"
        if not resume:
            self.store._fs.delete(self.store._path(folder), True)
        items = pipeline.items(node, df)
        shape = T.StructType([*(items.schema[c] for c in ("run_id", "partition_id")), *node.block.outputs])
        finished = self._batches(folder, shape)
        known = materialize(finished.select("run_id", "partition_id"), "finished")
        number = F.col("partition_id").cast("long")
        pending = items.join(known, ["run_id", "partition_id"], "left_anti")
        most = pending.agg(F.max(number)).first()[0]
        step = -(-((most or 0) + 1) // max(self.BATCHES, node.parallelism))

        def batch(first: int) -> None:
            own = pending.where(number.between(first, first + step - 1))
            out = pipeline.evaluated(node, own, context)
            strict(out.select("run_id", "partition_id", *node.block.outputs.names), shape).write.parquet(f"{folder}/{uuid.uuid4().hex}")

        firsts = range(0, -1 if most is None else most + 1, step)
        self._at_once([lambda first=first: batch(first) for first in firsts], node.parallelism, context, run_id)
        pipeline.gathered(node, df, self._batches(folder, shape)).write.mode("overwrite").parquet(f"{self.root}/blocks/{key}")
        return known

    def _at_once(self, works: list[Callable[[], None]], parallelism: int, context: Context, run_id: str) -> None:
        """Run batches as jobs of one tag, ``parallelism`` at a time; an error or a stop cancels those that are running."""
        sc, tag, over = self.spark.sparkContext, f"trialframe-{uuid.uuid4().hex}", threading.Event()

        def tagged(work: Callable[[], None]) -> None:
            if over.is_set():
                return
            sc.addJobTag(tag)
            try:
                self._tried(work, context.token, run_id, context.seed, over.is_set)
            finally:
                sc.removeJobTag(tag)

        with ThreadPoolExecutor(parallelism) as pool:
            left = {pool.submit(inheritable_thread_target(self.spark)(tagged), work) for work in works}
            try:
                while left:
                    done, left = wait(left, 0.2, FIRST_EXCEPTION)
                    for each in done:
                        each.result()
                    context.token.check()
            except BaseException:
                over.set()
                for each in left:
                    each.cancel()
                while left:  # a thread may have been about to start its job
                    sc.cancelJobsWithTag(tag)
                    _, left = wait(left, 0.2)
                raise

    def _batches(self, folder: str, shape: T.StructType) -> DataFrame:
        """The rows of the batches that were written to their end."""
        at = self.store._path(folder)
        found = [s.getPath().getName() for s in self.store._fs.listStatus(at)] if self.store._fs.exists(at) else []
        whole = [f"{folder}/{name}" for name in found if self._there(f"{folder}/{name}")]
        return self.spark.read.schema(shape).parquet(*whole) if whole else self.spark.createDataFrame([], shape)

    def _there(self, path: str) -> bool:
        p = self.store._path(f"{path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _to_running(self, run_id: str) -> None:
        state = self.store.state(run_id).state
        if state in DONE:
            self.store.transition(run_id, "stale")
            state = "stale"
        if state in ("planned", "failed", "paused", "stale", "orphaned", "retry_wait"):
            self.store.transition(run_id, "queued")
        if self.store.state(run_id).state == "queued":
            self.store.transition(run_id, "running")


@dataclass
class Study:
    """``evaluate`` maps the trials to (trial_id, name, value, seq) metrics, all trials at once.

    ``decide`` takes trials joined with their last metrics (null where a trial failed or reported
    nothing) and returns the selected ones in rank order; ``refine`` makes the next round's space of
    them. A trial whose evaluation yields no row is recorded as failed, and the others go on.
    """

    space: Space
    evaluate: Callable[[DataFrame], DataFrame]
    decide: Callable[[DataFrame], DataFrame]
    metrics: tuple[str, ...]
    planner: str | Callable[..., DataFrame] = "random"
    refine: Callable[[Space, DataFrame], Space] | None = None
    history: list[DataFrame] = field(default_factory=list)
    spaces: list[Space] = field(default_factory=list)

    @classmethod
    def by_names(cls, plugins: Plugins, space: Space, evaluate: Callable[[DataFrame], DataFrame], metrics: tuple[str, ...], planner: str = "random", policy: tuple[str, dict] = ("top_k", {}), refinement: tuple[str, dict] | None = None) -> Study:
        """A study of planners, policies and refinements that the library or an extension has, with their options."""
        decide, refine = plugins.resolve("policies", policy[0]), plugins.resolve("refinements", refinement[0]) if refinement else None
        return cls(space, evaluate, lambda h: decide(h, **policy[1]), metrics, plugins.resolve("planners", planner), (lambda s, selected: refine(s, selected, **refinement[1])) if refine else None)

    def run(self, spark: SparkSession, request: designs.Request, rounds: int = 1, root: str | None = None, store: RunStore | None = None) -> DataFrame:
        """The last round's selection; ``history`` has every round's trials, ``spaces`` the spaces used.

        Below ``root`` every round's trials and selection are kept, and taken from there by a study that is run again;
        ``store`` gets the decisions.
        """
        from trialframe.operators.decisions import pivot_metrics

        def kept(what: str, k: int, make: Callable[[], DataFrame]) -> DataFrame:
            if root is None:
                return materialize(make(), what)
            path = f"{root.rstrip('/')}/{what}-{k}"
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
            if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
                make().write.mode("overwrite").parquet(path)
            return spark.read.parquet(path)

        def scored(k: int, space: Space) -> DataFrame:
            plans = kept("plans", k, lambda: designs.propose(spark, space, replace(request, seed=request.seed + k), self.planner))
            wide = pivot_metrics(self.evaluate(plans), {m: m for m in self.metrics})
            rows = plans.join(wide, "trial_id", "left").withColumn("ordinal", F.col("row_index") * F.lit(request.replicates) + F.col("replicate_index")).withColumn("round", F.lit(k))
            missing = reduce(lambda a, b: a & b, (F.col(m).isNull() for m in self.metrics))
            return rows.withColumn("state", F.when(missing, "failed").otherwise("completed"))

        space, selected = self.space, None
        for k in range(rounds):
            self.spaces.append(space)
            self.history.append(kept("trials", k, lambda k=k, space=space: scored(k, space)))
            selected = kept("selection", k, lambda: self.decide(self.history[-1]).withColumn("rank", F.monotonically_increasing_id()))
            if store is not None:
                store.record_decision(f"round-{k}", getattr(self.decide, "__name__", "policy"), [r.trial_id for r in selected.orderBy("rank").select("trial_id").collect()])
            if self.refine and k + 1 < rounds:
                space = self.refine(space, selected)
        return selected.orderBy("rank").drop("rank")
