"""Database tables through DB-API, and leases that lapse on a stream."""

from __future__ import annotations

import sqlite3
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from trialframe.errors import ConfigError
from trialframe.operators import runstore
from trialframe.sources import database
from trialframe.streaming import leases

SHAPE = "id long, price double, name string, seen timestamp, ok boolean"


def _options(path, **more):
    return {"connect": "trialframe.sources.database:sqlite", "target": str(path), "table": "goods", "key": "id", "partitions": "4"} | more


def _rows(n):
    return [(i, i / 2, None if i % 7 == 0 else f"n{i}", datetime(2024, 1, 1) + timedelta(hours=i), i % 2 == 0) for i in range(n)]


def _tables(path):
    with sqlite3.connect(path) as c:
        return {r[0] for r in c.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}


def test_round_trip_with_ranges_and_predicates(spark, tmp_path):
    path = tmp_path / "db"
    database.register(spark)
    df = spark.createDataFrame(_rows(100), SHAPE).repartition(3)
    df.write.format("database").options(**_options(path, unique="id")).mode("append").save()
    back = spark.read.format("database").options(**_options(path)).schema(SHAPE).load()
    assert back.rdd.getNumPartitions() == 4 and sorted(map(tuple, back.collect())) == _rows(100) and _tables(path) == {"goods"}
    some = back.where("price >= 10 AND name IS NOT NULL AND id IN (30, 31, 35, 5) AND length(name) = 3")
    assert sorted(r.id for r in some.collect()) == [30, 31]
    df.limit(0).write.format("database").options(**_options(path)).mode("overwrite").save()
    assert back.count() == 0


def test_pushed_predicates_are_in_the_statement(tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains

    reader = database.TableReader(database.Place.of(_options(tmp_path / "db")), None)
    kept = list(reader.pushFilters([EqualTo(("name",), "x"), GreaterThan(("price",), 2.5), In(("id",), (1, 2)), StringContains(("name",), "y"), EqualTo(("a", "b"), 1)]))
    assert len(kept) == 2 and reader.where() == (['"name" = ?', '"price" > ?', '"id" IN (?, ?)'], ["x", 2.5, 1, 2])


def test_broken_writes_leave_nothing(spark, tmp_path):
    path = tmp_path / "db"
    database.register(spark)
    df = spark.createDataFrame(_rows(40), SHAPE)
    write = lambda rows, **o: rows.write.format("database").options(**_options(path, **o)).mode("append").save()
    bad = df.repartition(4).withColumn("price", F.when(F.col("id") == 33, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("price")))
    with pytest.raises(Exception, match="broken"):
        write(bad)
    assert _tables(path) == set()
    write(df, unique="id")
    with pytest.raises(Exception, match="UNIQUE"):
        write(df.where("id > 38").unionByName(df.where("id = 39").withColumn("id", F.lit(100).cast("long"))), unique="id")
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*), max(id) FROM goods").fetchone() == (40, 39)
    assert _tables(path) == {"goods"}


def test_a_task_that_waits_for_rows_keeps_no_one_out(tmp_path, monkeypatch):
    from types import SimpleNamespace

    from pyspark.sql import types as T

    path, attempts = tmp_path / "db", iter((7, 8, 9))
    monkeypatch.setattr(database, "ROWS", 10)
    monkeypatch.setattr(database, "BATCH", 20, raising=False)
    monkeypatch.setattr(database, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0, taskAttemptId=lambda: next(attempts))))
    writer = database.TableWriter(database.Place.of(_options(path, unique="id")), T.StructType().add("id", T.LongType()).add("price", T.DoubleType()), False)

    def rows(start):
        for i in range(start, start + 50):
            if i % 50 == 45:  # another task writes meanwhile
                with sqlite3.connect(path, timeout=0.1) as other:
                    other.execute(f"CREATE TABLE IF NOT EXISTS other_{start} (x)")
            yield i, i / 2

    done, lost = writer.write(rows(0)), writer.write(rows(0))  # an attempt that does not count staged the same rows
    also = writer.write(rows(50))
    assert [m.rows for m in (done, lost, also)] == [50, 50, 50]
    writer.commit([done, None, also])
    with sqlite3.connect(path) as c:
        assert c.execute("SELECT count(*), min(id), max(id) FROM goods").fetchone() == (100, 0, 99)
    assert _tables(path) == {"goods", "other_0", "other_50"}


def test_names_and_options_are_checked(spark, tmp_path):
    with pytest.raises(ConfigError):
        database.quoted('x"; DROP TABLE y')
    with pytest.raises(ConfigError, match="table"):
        database.Place.of({"connect": "a:b", "target": "c"})


HOUR = timedelta(hours=1)
T0 = datetime(2024, 5, 1)


def _events():
    """Runs with leases of an hour: renewed, lapsed, lapsed and taken up again, ended in time, ended after a lapse."""
    out = []
    for k in range(20):
        run, kind = f"r{k}", k % 5
        out += [(run, 1, "queued", None, None, T0), (run, 2, "running", None, None, T0 + HOUR / 10), (run, 3, "running", "w", T0 + HOUR, T0 + HOUR / 5)]
        if kind == 0:
            out += [(run, 4 + h, "running", "w", T0 + (h + 2) * HOUR, T0 + (h + 0.8) * HOUR) for h in range(12)]
        if kind == 2:
            out += [(run, 4, "running", "v", T0 + 30 * HOUR, T0 + 6 * HOUR)]
        if kind == 3:
            out += [(run, 4, "completed", None, None, T0 + HOUR / 2)]
        if kind == 4:
            out += [(run, 4, "failed", None, None, T0 + 8 * HOUR)]
    out.append(("clock", 1, "planned", None, None, T0 + 12 * HOUR))
    return sorted(out, key=lambda r: r[5])


def test_leases_lapse_by_themselves_and_after_a_restart(spark, tmp_path):
    rows, parts = _events(), 10
    step = -(-len(rows) // parts)
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")

    def run(last):
        if last:  # the watermark is ten minutes behind the newest event
            spark.createDataFrame([("clock", 2, "planned", None, None, T0 + 12.5 * HOUR)], leases.NEEDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = leases.lease_watch(leases.event_stream(spark, str(tmp_path / "in"))).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination(180)
        assert query.exception() is None

    for k in range(parts):
        spark.createDataFrame(rows[k * step : (k + 1) * step], leases.NEEDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        if k in (4, 9):
            run(k == parts - 1)  # each run starts again from the checkpoint
    reports = spark.read.schema(leases.REPORT).parquet(target)
    events = spark.createDataFrame(rows, leases.NEEDS).withColumn("attempt", F.lit(1))
    want = {tuple(r) for r in runstore.stale_leases(events, T0 + 12 * HOUR).collect()}
    assert want and {tuple(r) for r in leases.still_lapsed(reports).collect()} == want
    lapsed = {int(r.run_id[1:]) % 5 for r in reports.where("lapsed").collect()}
    assert 1 in lapsed and lapsed <= {1, 2, 4}
