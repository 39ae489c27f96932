"""Runs, events, leases, metrics, artifacts and checkpoints as append-only tables.

Tables are ``segments.KeyedTable``s: single rows are small files until they are compacted, and the rows of one run are
read from a few files. Nothing is updated in place: a transition is an event with the next version of its run, and the
current state is the event of the highest version. The event of a run's version is a file that only one
writer can create, so of two that saw the same state exactly one moves it on; ``compact_events`` moves such
files into the table. Bulk changes append to the table at once; where a single writer took the same version,
that one counts. Reads are aggregations with map-side combine.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from trialframe import schemas
from trialframe.errors import CheckpointMismatch, StateConflict
from trialframe.operators.decisions import latest
from trialframe.operators.segments import TIME, KeyedTable, bucket_of
from trialframe.scratch import materialize
from trialframe.sources.files import create_once, names, read_text

#: Which states may follow a state (fixed values).
FOLLOWS = {
    "planned": ("queued", "cancelled", "skipped"),
    "queued": ("running", "cancelled", "orphaned"),
    "running": ("completed", "failed", "pausing", "cancelled", "pruned", "retry_wait", "stale", "cached"),
    "pausing": ("paused", "cancelled", "failed"),
    "paused": ("queued", "cancelled"),
    "failed": ("queued", "cancelled"),
    "retry_wait": ("queued", "cancelled"),
    "stale": ("queued", "orphaned", "cancelled"),
    "orphaned": ("queued", "cancelled"),
    "completed": ("stale",),
    "cached": ("stale",),
    "cancelled": (),
    "pruned": (),
    "skipped": (),
}
DONE = ("completed", "cached")


def edges(spark: SparkSession) -> DataFrame:
    """(state, next): the allowed transitions, some thirty rows."""
    return spark.createDataFrame([(a, b) for a, bs in FOLLOWS.items() for b in bs], "state string, next string")


def check_transition(now: str, new: str) -> None:
    if new != now and new not in FOLLOWS[now]:
        raise StateConflict(f"{now} cannot become {new}")


# -- queries over the tables -------------------------------------------------------------------------------


def descendants(runs: DataFrame, root: str, id: str = "run_id", parent: str = "parent_id") -> DataFrame:
    """(run_id, depth) of everything below ``root``, one join a level, of any number and depth; a run that is below itself counts once."""
    rows = runs.select(F.col(id).alias("run_id"), F.col(parent).alias("parent_id"))
    front = rows.where(F.col("parent_id") == root).select("run_id", F.lit(1).alias("depth"))
    found = front = materialize(front.where(F.col("run_id") != root).distinct(), "level")
    depth = 1
    while not front.isEmpty():
        depth += 1
        above = front.select(F.col("run_id").alias("above"))
        below = rows.join(above, F.col("parent_id") == F.col("above")).where(F.col("run_id") != root).select("run_id").distinct()
        front = materialize(below.join(found.select("run_id"), "run_id", "left_anti").withColumn("depth", F.lit(depth)), "level")
        found = found.unionByName(front)
    return found


def artifacts_under(runs: DataFrame, artifacts: DataFrame, root: str) -> DataFrame:
    """Artifacts of ``root`` and everything below it."""
    ids = descendants(runs, root).select("run_id").unionByName(runs.sparkSession.createDataFrame([(root,)], "run_id string"))
    return artifacts.join(ids, "run_id", "left_semi")


def current_states(events: DataFrame) -> DataFrame:
    """(run_id, state, version, attempt): the newest event of every run that carries a state."""
    states = events.where("state is not null")
    return latest(states, ["run_id"], "version", ["state", "version", "attempt"])


def conflicts(events: DataFrame) -> DataFrame:
    """Versions that more than one writer appended."""
    return events.where("state is not null").groupBy("run_id", "version").agg(F.count("*").alias("writers")).where("writers > 1")


def transition_counts(events: DataFrame, run: str = "run_id", state: str = "state", order: str = "version") -> DataFrame:
    w = Window.partitionBy(run).orderBy(order)
    moves = events.withColumn("previous", F.lag(state).over(w)).where("previous is not null")
    return moves.groupBy("previous", F.col(state).alias("next")).agg(F.count("*").alias("n"))


def illegal_transitions(events: DataFrame, run: str = "run_id", state: str = "state", order: str = "version", allowed: DataFrame | None = None) -> DataFrame:
    """Moves that the table of transitions does not have; staying in a state is always legal."""
    w = Window.partitionBy(run).orderBy(order)
    moves = events.select(run, order, F.lag(state).over(w).alias("previous"), F.col(state).alias("next"))
    moves = moves.where("previous is not null and previous <> next")
    table = (allowed if allowed is not None else edges(events.sparkSession)).select(F.col("state").alias("a"), F.col("next").alias("b"))
    return moves.join(F.broadcast(table), (F.col("previous") == F.col("a")) & (F.col("next") == F.col("b")), "left_anti")  # a fixed table


def attempts(events: DataFrame) -> DataFrame:
    """(run_id, attempts): how often each run was started."""
    return events.groupBy("run_id").agg(F.count(F.when(F.col("state") == "running", 1)).alias("attempts"))


def lease_grants(requests: DataFrame, seconds: float, run: str = "run_id", owner: str = "owner", at: str = "at") -> DataFrame:
    """``requests`` in order of time, each with ``granted``: a lease is given if it is free or has run out, and its owner's own stays as it is."""
    none = F.struct(F.lit(None).cast("string").alias("owner"), F.lit(None).cast(requests.schema[at].dataType).alias("expires"), F.array().cast("array<boolean>").alias("granted"))
    length = F.expr(f"INTERVAL {float(seconds):f} SECONDS")
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(owner).cast("string").alias("owner"))))

    def step(state: Column, request: Column) -> Column:
        free = state["expires"].isNull() | (state["expires"] <= request["at"])
        until = request["at"] + length
        granted = F.concat(state["granted"], F.array(free | (state["owner"] == request["owner"])))
        return F.struct(F.when(free, request["owner"]).otherwise(state["owner"]).alias("owner"), F.when(free, until).otherwise(state["expires"]).alias("expires"), granted.alias("granted"))

    folded = requests.groupBy(run).agg(rows.alias("rows")).withColumn("granted", F.aggregate("rows", none, step)["granted"])
    each = F.explode(F.arrays_zip("rows", "granted")).alias("x")
    return folded.select(run, each).select(run, F.col("x.rows.owner").alias(owner), F.col("x.rows.at").alias(at), "x.granted")


def stale_leases(events: DataFrame, now: datetime) -> DataFrame:
    """Running runs whose lease has run out."""
    lease = latest(events.where("owner is not null"), ["run_id"], "version", ["owner", "expires_at"])
    running = current_states(events).where("state = 'running'")
    return running.join(lease, "run_id").where(F.col("expires_at") < F.lit(now)).select("run_id", "owner", "expires_at")


def partition_status(items: DataFrame, artifacts: DataFrame, keys: list[str]) -> DataFrame:
    """``items`` with ``reused``: whether an artifact of the same keys is listed and whole, so that it need not run again."""
    whole = artifacts.where("whole").select(*keys, F.lit(True).alias("reused")).distinct()
    return items.join(whole, keys, "left").withColumn("reused", F.coalesce("reused", F.lit(False)))


def pending(items: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Items that still have to run."""
    return items.join(finished.select(*keys), keys, "left_anti")


def reused(items: DataFrame, finished: DataFrame, keys: list[str]) -> DataFrame:
    """Items whose results can be reused."""
    return items.join(finished.select(*keys).distinct(), keys, "left_semi")


def cache_hits(requests: DataFrame, artifacts: DataFrame, valid: str | None = None) -> DataFrame:
    """Requests with the newest valid artifact of their cache key, null where there is none."""
    known = artifacts.where(valid) if valid else artifacts
    newest = latest(known.where("cache_key is not null"), ["cache_key"], "created_at", ["content_hash"], ["content_hash"])
    return requests.join(newest, "cache_key", "left")


def checkpoint_sequence(checkpoints: DataFrame, run: str, order: str) -> DataFrame:
    return checkpoints.withColumn("sequence", F.row_number().over(Window.partitionBy(run).orderBy(order)))


def latest_checkpoint(checkpoints: DataFrame, run: str = "block_run_id", sequence: str = "sequence", values: tuple[str, ...] = ("payload",)) -> DataFrame:
    return latest(checkpoints, [run], sequence, [sequence, *(v for v in values)]) if sequence not in (run,) else checkpoints


# -- the store ---------------------------------------------------------------------------------------------


class RunStore:
    """Append-only tables at ``root`` and a log of single events. Any number of drivers write and read."""

    TABLES = {"runs": schemas.RUNS, "events": schemas.EVENTS, "metrics": schemas.METRICS, "artifacts": schemas.ARTIFACTS, "checkpoints": schemas.CHECKPOINTS, "decisions": schemas.DECISIONS, "invalid": "cache_key string, created_at timestamp"}
    #: What rows of each table are looked up by.
    KEYS = {"runs": "run_id", "events": "run_id", "metrics": "run_id", "artifacts": "cache_key", "checkpoints": "block_run_id", "decisions": "run_id", "invalid": "cache_key"}
    #: Rows that are added one by one; more are a job.
    FEW = 16
    #: How often a change that names no version is tried again behind another writer's.
    TRIES = 10

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.tables = {name: KeyedTable(spark, f"{self.root}/{name}", shape, self.KEYS[name]) for name, shape in self.TABLES.items()}

    def _exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def table(self, name: str) -> DataFrame:
        rows = self.tables[name].table()
        if name == "runs":  # many runs at once may have been made twice, with one id
            return rows.dropDuplicates(["run_id"])
        return self._with_log(rows, f"{self.root}/log", "*/*/*.json") if name == "events" else rows

    def compact(self) -> list[str]:
        """Compact the tables and the log of events; the tables that had something to compact."""
        self.compact_events()
        return [name for name, table in self.tables.items() if table.compact()]

    def vacuum(self, older_s: float = 3600.0) -> int:
        return sum(table.vacuum(older_s) for table in self.tables.values())

    def _with_log(self, rows: DataFrame, folder: str, files: str) -> DataFrame:
        if not self._exists(folder):
            return rows
        log = self.spark.read.schema(rows.schema).option("timestampFormat", TIME).json(f"{folder}/{files}")
        taken = log.select(F.col("run_id").alias("r"), F.col("version").alias("v"))
        return rows.join(taken, (F.col("run_id") == F.col("r")) & (F.col("version") == F.col("v")), "left_anti").unionByName(log)

    def _log(self, run_id: str) -> str:
        name = hashlib.sha256(run_id.encode()).hexdigest()
        return f"{self.root}/log/{name[:2]}/{name}"

    def events(self, run_id: str) -> DataFrame:
        """All events of a run, in order."""
        return self._own(run_id).orderBy("created_at", "version")

    def _own(self, run_id: str) -> DataFrame:
        return self._with_log(self.tables["events"].rows_of(run_id), self._log(run_id), "*.json")

    def compact_events(self) -> int:
        """Move the log's events into the table; the newest of each run stays, to hold its version. How many were moved."""
        folder = f"{self.root}/log"
        if not self._exists(folder):
            return 0
        shape = schemas.schema(schemas.EVENTS)
        log = materialize(self.spark.read.schema(shape).option("timestampFormat", TIME).json(f"{folder}/*/*/*.json"), "log")
        known = self.tables["events"].table()
        newest = log.groupBy("run_id").agg(F.max("version").alias("last"))
        old = materialize(log.join(newest, "run_id").where("version < last").drop("last"), "old")
        self.append("events", old.join(known.select("run_id", "version"), ["run_id", "version"], "left_anti"))
        moved = 0
        for row in old.select("run_id", "version").toLocalIterator():
            moved += bool(self._fs.delete(self._path(f"{self._log(row.run_id)}/{row.version:012d}.json"), False))
        return moved

    def append(self, name: str, rows: list[tuple] | DataFrame) -> None:
        if isinstance(rows, list) and len(rows) <= self.FEW:
            for row in rows:
                self.tables[name].add(row)
            return
        df = rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schemas.schema(self.TABLES[name]))
        self.tables[name].append(df)

    @staticmethod
    def now() -> datetime:
        return datetime.now(timezone.utc).replace(tzinfo=None)

    # -- runs ------------------------------------------------------------------------------------------------

    def create_run(self, logical_key: str, kind: str, parent_id: str | None = None) -> str:
        """The run of a logical key, made (as planned) if there is none. Its id is a hash of the key, so all writers mean the same one."""
        run_id = hashlib.sha256(logical_key.encode()).hexdigest()
        there = not self._only_log(run_id) and not self._own(run_id).where("version = 0").isEmpty()
        made = there or not self._event(run_id, 0, "created", "planned", 0)
        if not made or self.get_run(run_id) is None:
            self.tables["runs"].add((run_id, logical_key, kind, parent_id, self.now()), run_id)
        return run_id

    def create_runs(self, wanted: DataFrame) -> DataFrame:
        """``create_run`` for a table of (logical_key, kind, parent_id)."""
        fresh = wanted.dropDuplicates(["logical_key"]).join(self.table("runs").select("logical_key"), "logical_key", "left_anti")
        made = fresh.select(F.sha2("logical_key", 256).alias("run_id"), "logical_key", "kind", "parent_id", F.current_timestamp().alias("created_at"))
        made = materialize(made, "runs")
        none = lambda t: F.lit(None).cast(t)
        first = made.join(self.table("events").select("run_id").distinct(), "run_id", "left_anti")
        first = first.select("run_id", F.lit(0).cast("long").alias("version"), F.lit("created").alias("event_type"), F.lit("planned").alias("state"), F.lit(0).cast("long").alias("attempt"), none("string").alias("owner"), none("timestamp").alias("expires_at"), none("string").alias("payload"), F.current_timestamp().alias("created_at"))
        self.append("events", first)
        self.append("runs", made)
        return self.table("runs").join(wanted.select("logical_key").distinct(), "logical_key", "left_semi")

    def get_run(self, run_id: str):
        table = self.tables["runs"]
        if (own := table.few(run_id)) is not None:
            return Row(**(dict.fromkeys(table.shape.names) | own[0])) if own else None
        return table.rows_of(run_id).first()

    def get_by_key(self, logical_key: str):
        return self.get_run(hashlib.sha256(logical_key.encode()).hexdigest())

    def list_runs(self, parent_id: str | None = None, kind: str | None = None) -> DataFrame:
        """Runs of a parent, or of a kind, in the order they were made."""
        rows = self.table("runs")
        for column, value in (("parent_id", parent_id), ("kind", kind)):
            rows = rows if value is None else rows.where(F.col(column) == value)
        return rows.orderBy("created_at", "run_id")

    def artifacts_for_run(self, run_id: str) -> DataFrame:
        return self.table("artifacts").where(F.col("run_id") == run_id).orderBy("created_at", "content_hash")

    def _event(self, run_id: str, version: int | None, kind: str, state: str | None = None, attempt: int | None = None, owner: str | None = None, expires: datetime | None = None, payload: dict | None = None) -> bool:
        """Record an event; False if another writer took the version."""
        row = (run_id, version, kind, state, attempt, owner, expires, json.dumps(payload) if payload else None, self.now())
        if version is None:
            self.append("events", [row])
            return True
        names = schemas.schema(schemas.EVENTS).names
        text = {k: v.isoformat(timespec="microseconds") if isinstance(v, datetime) else v for k, v in zip(names, row, strict=True) if v is not None}
        return create_once(self.spark, f"{self._log(run_id)}/{version:012d}.json", json.dumps(text).encode() + b"\n")

    def add_event(self, run_id: str, kind: str, payload: dict | None = None) -> None:
        self._event(run_id, None, kind, payload=payload)

    def _only_log(self, run_id: str) -> bool:
        """Whether all events with a version that a run can have are in its log."""
        _, folders, segments, _, _ = self.tables["events"]._live(bucket_of(run_id))
        return not folders and not segments

    def _newest(self, run_id: str) -> Iterator[dict]:
        """The events in a run's log, the newest first."""
        for name in sorted(names(self.spark, self._log(run_id), "*.json"), reverse=True):
            yield json.loads(read_text(self.spark, f"{self._log(run_id)}/{name}"))

    def _last(self, run_id: str):
        """The newest state of a run and its newest lease; from a few small files where that is all there is."""
        if self._only_log(run_id):
            now = held = None
            for event in self._newest(run_id):
                now = now or Row(state=event["state"], version=event["version"], attempt=event["attempt"])
                if "owner" in event:
                    held = Row(owner=event["owner"], expires_at=datetime.fromisoformat(event["expires_at"]))
                    break
            if now is None:
                raise StateConflict(f"no run {run_id}")
            return Row(now=now, lease=held)
        own = self._own(run_id).where("state is not null")
        held = F.max_by(F.struct("owner", "expires_at"), F.when(F.col("owner").isNotNull(), F.col("version")))
        row = own.agg(F.max_by(F.struct("state", "version", "attempt"), "version").alias("now"), held.alias("lease")).first()
        if row.now is None:
            raise StateConflict(f"no run {run_id}")
        return row

    def state(self, run_id: str):
        return self._last(run_id).now

    def transition(self, run_id: str, state: str, expected_version: int | None = None, payload: dict | None = None) -> int:
        """Move a run on; returns the new version. With an expected version, only if it is still at that one."""
        for _ in range(self.TRIES):
            now = self.state(run_id)
            if expected_version is not None and now.version != expected_version:
                raise StateConflict(f"{run_id} is at version {now.version}, not {expected_version}")
            check_transition(now.state, state)
            if self._event(run_id, now.version + 1, "transition", state, now.attempt + (state == "running"), payload=payload):
                return now.version + 1
        raise StateConflict(f"others keep changing {run_id}")

    def acquire_lease(self, run_id: str, owner: str, seconds: float) -> bool:
        """Take a free or expired lease; the owner's own is kept as it is. Of two that ask at once one gets it."""
        for _ in range(self.TRIES):
            now, held = self._last(run_id)
            if held is not None and held.expires_at > self.now():
                return held.owner == owner
            if self._event(run_id, now.version + 1, "lease", now.state, now.attempt + 1, owner, self.now() + timedelta(seconds=seconds)):
                return True
        raise StateConflict(f"others keep changing {run_id}")

    def heartbeat(self, run_id: str, owner: str, seconds: float) -> bool:
        for _ in range(self.TRIES):
            now, held = self._last(run_id)
            if held is None or held.owner != owner:
                return False
            if self._event(run_id, now.version + 1, "heartbeat", now.state, now.attempt, owner, self.now() + timedelta(seconds=seconds)):
                return True
        raise StateConflict(f"others keep changing {run_id}")

    def release(self, run_id: str, owner: str) -> bool:
        """Give up a lease before it runs out; False if it is another one's by now."""
        for _ in range(self.TRIES):
            now, held = self._last(run_id)
            if held is None or held.owner != owner:
                return False
            if self._event(run_id, now.version + 1, "release", now.state, now.attempt, owner, self.now()):
                return True
        raise StateConflict(f"others keep changing {run_id}")

    def newest(self, run_id: str) -> str | None:
        """The state in the newest event of a run's log, without a job."""
        return next((e.get("state") for e in self._newest(run_id)), None)

    def _bulk(self, runs: DataFrame, state: str, payload: dict) -> DataFrame:
        """Move ``runs(run_id)`` on with one append; those of them that did move, as their newest events say."""
        now = current_states(self.table("events")).join(runs.select("run_id"), "run_id", "left_semi")
        before = [s for s, after in FOLLOWS.items() if state in after]
        none, mark = F.lit(None), json.dumps(payload)
        moved = now.where(F.col("state").isin(before)).select(
            "run_id", (F.col("version") + 1).alias("version"), F.lit("transition").alias("event_type"), F.lit(state).alias("state"), "attempt",
            none.cast("string").alias("owner"), none.cast("timestamp").alias("expires_at"), F.lit(mark).alias("payload"), F.current_timestamp().alias("created_at"),
        )
        self.append("events", moved)
        return materialize(self.table("events").where((F.col("payload") == mark) & (F.col("state") == state)).select("run_id"), "moved")

    def transition_all(self, runs: DataFrame, state: str) -> DataFrame:
        """Move all of ``runs(run_id)`` on that may go to ``state``, with one append; the ids of those that did."""
        return self._bulk(runs, state, {"batch": uuid.uuid4().hex})

    def reconcile_stale(self, at: datetime | None = None, requeue: bool = False) -> DataFrame:
        """Runs whose workers went silent become stale, all at once; their ids."""
        batch = {"batch": uuid.uuid4().hex}
        gone = self._bulk(stale_leases(self.table("events"), at or self.now()), "stale", batch)
        if requeue:
            self._bulk(gone, "queued", batch)
        return gone

    def report_metric(self, run_id: str, name: str, value: object, partition_id: str | None = None) -> None:
        """Add a metric; its sequence number is the time in nanoseconds, so nothing has to be counted."""
        scalar = float(value) if isinstance(value, int | float) else None
        vector = [float(v) for v in value] if isinstance(value, list | tuple) else None
        artifact = value.get("content_hash") if isinstance(value, dict) else None
        self.append("metrics", [(run_id, name, time.time_ns(), scalar, vector, artifact, partition_id, self.now())])

    def metrics(self, run_id: str | None = None) -> DataFrame:
        table = self.tables["metrics"]
        return (table.table() if run_id is None else table.rows_of(run_id)).orderBy("run_id", "seq")

    def register_artifact(self, ref: dict, run_id: str, cache_key: str | None = None) -> None:
        """List an artifact once per run and cache key, whoever else lists it at the same time."""
        once = hashlib.sha256(json.dumps([ref["content_hash"], run_id, cache_key]).encode()).hexdigest()
        few = self.tables["artifacts"].few(cache_key) if cache_key is not None else None
        merged = few is None and not self._artifacts_of(cache_key).where((F.col("content_hash") == ref["content_hash"]) & (F.col("run_id") == run_id)).isEmpty()
        if not merged:
            self.tables["artifacts"].add((ref["content_hash"], run_id, cache_key, ref["media_type"], ref["codec"], ref["lineage"], ref["metadata"], ref["size"], self.now()), once)

    def _artifacts_of(self, cache_key: str | None) -> DataFrame:
        return self.tables["artifacts"].rows_of(cache_key) if cache_key is not None else self.table("artifacts").where("cache_key is null")

    @staticmethod
    def _valid(rows: DataFrame, invalid: DataFrame) -> DataFrame:
        gone = invalid.groupBy(F.col("cache_key").alias("k")).agg(F.max("created_at").alias("gone_at"))
        return rows.join(gone, (F.col("cache_key") == F.col("k")) & (F.col("created_at") <= F.col("gone_at")), "left_anti")

    def artifacts(self) -> DataFrame:
        """Artifacts whose cache key has not been invalidated since."""
        return self._valid(self.table("artifacts"), self.table("invalid"))

    def _cached(self, key: str) -> DataFrame:
        return self._valid(self._artifacts_of(key), self.tables["invalid"].rows_of(key))

    def find_cache(self, key: str):
        """The newest valid artifact of a key, or None."""
        listed, gone = self.tables["artifacts"].few(key), self.tables["invalid"].few(key)
        if listed is not None and gone is not None:
            until = max((g["created_at"] for g in gone), default="")
            valid = [a for a in listed if a["created_at"] > until]
            best = max(valid, key=lambda a: (a["created_at"], a["content_hash"], a["run_id"]), default=None)
            return best and Row(**{c: best.get(c) for c in ("cache_key", "content_hash", "serializer", "run_id")})
        return latest(self._cached(key), ["cache_key"], "created_at", ["content_hash", "serializer", "run_id"], ["content_hash", "run_id"]).first()

    def invalidate_cache(self, key: str) -> int:
        n = self._cached(key).count()
        self.append("invalid", [(key, self.now())])
        return n

    def save_checkpoint(self, block_run_id: str, payload: object, fingerprint: str = "") -> int:
        """Keep a payload under the next number of its block's run; of two writers each gets a number of its own."""
        table, series = self.tables["checkpoints"], hashlib.sha256(block_run_id.encode()).hexdigest()
        taken = [int(n.rpartition("-")[2]) for n in table.names_of(block_run_id, f"{series}-")]
        n = max(taken) if taken else table.rows_of(block_run_id).agg(F.max("sequence")).first()[0] or 0
        while True:
            n += 1
            if table.add((block_run_id, n, fingerprint, json.dumps(payload), self.now()), f"{series}-{n:012d}"):
                return n

    def latest_checkpoint(self, block_run_id: str, fingerprint: str | None = None):
        """The last payload of a block's run; another fingerprint than the one expected is an error."""
        own = self.tables["checkpoints"].rows_of(block_run_id)
        row = latest(own, ["block_run_id"], "sequence", ["sequence", "fingerprint", "payload"]).first()
        if row is None:
            return None
        if fingerprint is not None and row.fingerprint != fingerprint:
            raise CheckpointMismatch(f"checkpoint {row.sequence} of {block_run_id} was made by other code")
        return json.loads(row.payload)

    def record_decision(self, run_id: str, policy: str, trial_ids: list[str], explanation: str = "") -> None:
        if trial_ids:
            self.append("decisions", [(run_id, policy, t, k, explanation, self.now()) for k, t in enumerate(trial_ids)])
