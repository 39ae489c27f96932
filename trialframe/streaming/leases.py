"""Leases that lapse by themselves: runs' events as a stream, with a timer in event time for each lease.

``lease_watch`` keeps, for each run, its newest state and lease. A lease of a running run that the watermark has passed
is reported as lapsed, without any further event of the run; a renewal, or another state, takes a report back. Runs that
are over are forgotten when ``keep`` has passed since. State is in RocksDB and timers are in it, so a query that is
started again from its checkpoint goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trialframe.operators.decisions import latest
from trialframe.operators.runstore import FOLLOWS

NEEDS = "run_id string, version long, state string, owner string, expires_at timestamp, at timestamp"
REPORT = "run_id string, version long, owner string, expires_at timestamp, lapsed boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _ms(at) -> int | None:
    return None if at is None or pd.isna(at) else int(pd.Timestamp(at).value // 1_000_000)


def _time(ms: int) -> datetime:
    return datetime.fromtimestamp(ms / 1000, timezone.utc).replace(tzinfo=None)


class LeaseWatch(StatefulProcessor):
    def __init__(self, keep_ms: int) -> None:
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "version long, state string, at long")
        self.lease = handle.getValueState("lease", "owner string, expires long, lapsed boolean")

    def _row(self, key: tuple, lease: tuple, lapsed: bool) -> tuple:
        version = self.run.get()[0]
        return (key[0], version, lease[0], _time(lease[1]), lapsed)

    def _out(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "version", "owner", "expires_at", "lapsed"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        news = pd.concat(list(rows)).sort_values("version")
        before = self.run.get() if self.run.exists() else (-1, None, 0)
        lease = self.lease.get() if self.lease.exists() else None
        was_lapsed = bool(lease and lease[2])
        version, state, at = before
        for r in news.itertuples():
            if r.version <= version:  # late or repeated
                continue
            version, state, at = int(r.version), r.state, _ms(r.at)
            if r.owner is not None and not pd.isna(r.owner):
                lease = (r.owner, _ms(r.expires_at), False)
        if version == before[0]:
            return
        self.run.update((version, state, at))
        running = state == "running"
        lapsed = bool(running and lease is not None and lease[1] < now)
        out = []
        if lease is not None:
            lease = (lease[0], lease[1], lapsed)
            self.lease.update(lease)
            if running and not lapsed:
                self.handle.registerTimer(lease[1] + 1)
            if lapsed or was_lapsed:
                out.append(self._row(key, lease, lapsed))
        if not FOLLOWS.get(state, ()):
            self.handle.registerTimer(max(at, now) + self.keep_ms)
        yield from self._out(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = timerValues.getCurrentWatermarkInMs()
        if not self.run.exists():
            return
        _, state, at = self.run.get()
        if not FOLLOWS.get(state, ()):
            if at + self.keep_ms <= now:
                self.run.clear()
                self.lease.clear()
            return
        lease = self.lease.get() if self.lease.exists() else None
        if state == "running" and lease is not None and not lease[2] and lease[1] < now:
            self.lease.update((lease[0], lease[1], True))
            yield from self._out([self._row(key, lease, True)])

    def close(self) -> None:
        pass


def lease_watch(events: DataFrame, late: str = "10 minutes", keep: str = "7 days") -> DataFrame:
    """(run_id, version, owner, expires_at, lapsed) whenever a running run's lease lapses, or is taken up again, on a stream of runs' events.

    A run's events count in the order of their versions; those that come after a newer one are ignored. Rows without a
    run, a version or a time are left out.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)
    rows = events.where("run_id IS NOT NULL AND version IS NOT NULL AND at IS NOT NULL AND state IS NOT NULL")
    rows = rows.select("run_id", "version", "state", "owner", "expires_at", "at").withWatermark("at", late)
    return rows.groupBy("run_id").transformWithStateInPandas(LeaseWatch(keep_ms), REPORT, "append", "eventTime")


def still_lapsed(reports: DataFrame) -> DataFrame:
    """Runs whose last report is that their lease has lapsed, of what ``lease_watch`` wrote."""
    last = latest(reports, ["run_id"], "version", ["owner", "expires_at", "lapsed"], ["lapsed"])
    return last.where("lapsed").drop("lapsed")


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files of runs' events as a stream."""
    return spark.readStream.schema(NEEDS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
