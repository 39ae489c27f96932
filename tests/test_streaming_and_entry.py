from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest

import __spark_entry__ as entry
from trialframe import catalogue
from trialframe.streaming import metrics as streams

SCHEMA = "run_id string, seq long, state string, ts timestamp, name string, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream") / "in")
    t0 = datetime(2024, 1, 1)
    rows = [(f"r{i % 3}", i, s, t0 + timedelta(minutes=7 * i), "loss", float(i)) for i, s in enumerate(["queued", "queued", "running", "running", "completed", "running", "completed", "failed", "zz"])]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(path)
    return path


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name).collect()


def test_windows_of_a_stream_equal_those_of_the_table(spark, folder):
    live = streams.windowed(streams.metric_stream(spark, folder, SCHEMA), "ts", "name", "value")
    table = streams.windowed(spark.read.parquet(folder), "ts", "name", "value")
    assert sorted(_drain(live, "w", "complete")) == sorted(table.collect())


def test_run_state_machine_on_a_stream(spark, folder):
    rows = _drain(streams.state_machine(streams.metric_stream(spark, folder, SCHEMA).select("run_id", "seq", "state")), "sm")
    got = {}
    for r in rows:
        got.setdefault(r.run_id, []).append((r.state, r.legal))
    assert got["r0"] == [("queued", True), ("running", True), ("completed", True)]
    assert got["r1"] == [("queued", True), ("completed", False), ("failed", False)]
    assert got["r2"] == [("running", False), ("running", False), ("zz", False)]


def test_repeated_requests_make_one_run(spark, folder):
    live = streams.first_runs(streams.metric_stream(spark, folder, SCHEMA), "ts", "run_id", "1 day")
    assert sorted(r.run_id for r in _drain(live, "fr")) == ["r0", "r1", "r2"]


def test_entry_and_its_catalogue(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"user_id", "quality", "latency", "clicks"}
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(catalogue.ORACLES) > 50


@pytest.mark.parametrize("name", ["metric_pivot", "pareto_fast", "elite_zoom", "ordered_fan_in", "halton_design", "stale_leases"])
def test_some_queries_against_their_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    rows = con.execute(catalogue.ORACLES[name])
    names = [d[0] for d in rows.description]
    want = sorted((tuple(r) for r in rows.fetchall()), key=repr)
    got = sorted((tuple(r) for r in catalogue.QUERIES[name](spark, sf).select(*names).collect()), key=repr)
    assert len(got) == len(want) and all(a == pytest.approx(b) if not any(isinstance(x, list | str | datetime) for x in a) else a == b for a, b in zip(got, want, strict=True))
