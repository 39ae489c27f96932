"""Metric and event streams (an extension): windows with watermarks, idempotent runs, the run state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.operators.runstore import FOLLOWS


def metric_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(metrics: DataFrame, ts: str, name: str, value: str, size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean and extremes per metric in tumbling (or sliding) windows, on streams and tables alike."""
    rows = metrics.withWatermark(ts, late) if metrics.isStreaming else metrics
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    out = rows.groupBy(w.alias("w"), name).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select(F.col("w.start").alias("start"), name, "n", "mean", "least", "most")


def sessions(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs of events with no gap longer than ``gap``."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def first_runs(requests: DataFrame, ts: str, key: str = "logical_key", late: str = "1 hour") -> DataFrame:
    """The first request of each logical key: run creation that can be repeated."""
    rows = requests.withWatermark(ts, late)
    return rows.dropDuplicatesWithinWatermark([key]) if requests.isStreaming else requests.dropDuplicates([key])


def state_machine(transitions: DataFrame) -> DataFrame:
    """(run_id, version, state, legal) of a stream of (run_id, seq, state): illegal moves are flagged and not taken."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now, version = state.get if state.exists else ("planned", 0)
        rows = pd.concat(list(batches)).sort_values("seq")
        out = []
        for new in rows["state"]:
            legal = new == now or new in FOLLOWS.get(now, ())
            if legal:
                now, version = new, version + 1
            out.append((key[0], version, new, legal))
        state.update((now, version))
        yield pd.DataFrame(out, columns=["run_id", "version", "state", "legal"])

    return transitions.groupBy("run_id").applyInPandasWithState(step, "run_id string, version long, state string, legal boolean", "state string, version long", "append", "NoTimeout")
