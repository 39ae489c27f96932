"""Keyed tables: point reads of few files, numbers and names that one writer gets, and ways to create a file once."""

from __future__ import annotations

import threading

import pytest

from trialframe.errors import ConfigError
from trialframe.operators import segments
from trialframe.operators.runstore import RunStore
from trialframe.operators.segments import KeyedTable
from trialframe.sources import files


def _at_once(works):
    threads = [threading.Thread(target=w) for w in works]
    for t in threads:
        t.start()
    for t in threads:
        t.join()


def test_ten_thousand_reports_are_read_from_few_files(spark, tmp_path):
    s = RunStore(spark, f"file://{tmp_path}/s")
    for k in range(10_000):
        s.report_metric(f"r{k % 3}", "loss", k / 2)
    s.tables["metrics"].compact()
    one = s.tables["metrics"].rows_of("r1")
    assert one.count() == 3333 and len(one.inputFiles()) <= 5
    assert s.metrics().count() == 10_000
    s.report_metric("r1", "loss", -1.0)
    assert s.metrics("r1").count() == 3334


def test_rows_loose_many_and_merged_are_read_once(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v long", "k")
    assert t.table().count() == 0 and t.rows_of("a").count() == 0 and not t.compact()
    t.add(("a", 1))
    t.add((None, 2))
    assert t.few("a") == [{"k": "a", "v": 1}]
    t.append(spark.createDataFrame([("a", 3), ("b", 4)], "k string, v long"))
    for turn in range(6):
        t.add(("b", 10 + turn))
        assert t.compact()
        assert sorted(r.v for r in t.table().collect()) == [1, 2, 3, 4, *range(10, 11 + turn)]
        assert sorted(r.v for r in t.rows_of("a").collect()) == [1, 3] and t.few("a") is None
    assert len(t._manifest()[1]["segments"]) < 6
    assert t.vacuum(older_s=-5) and sorted(r.v for r in t.table().collect()) == [1, 2, 3, 4, *range(10, 16)]


def test_writers_of_one_checkpoint_get_numbers_of_their_own(spark, tmp_path):
    stores, numbers = [RunStore(spark, f"file://{tmp_path}/s") for _ in range(2)], []
    _at_once([lambda s=s: numbers.extend(s.save_checkpoint("b", {"by": k}) for k in range(10)) for s in stores])
    assert sorted(numbers) == list(range(1, 21))
    stores[0].compact()
    stores[0].vacuum(older_s=-5)
    assert stores[1].save_checkpoint("b", {"by": "last"}) == 21 and stores[0].latest_checkpoint("b") == {"by": "last"}


def test_writers_of_one_artifact_list_it_once(spark, tmp_path):
    ref = {"content_hash": "h", "media_type": "m", "codec": "c", "lineage": {"a": "b"}, "metadata": {}, "size": 1}
    stores = [RunStore(spark, f"file://{tmp_path}/s") for _ in range(4)]
    _at_once([lambda s=s: s.register_artifact(ref, "r", "key") for s in stores])
    s = stores[0]
    assert s.table("artifacts").count() == 1 and s.find_cache("key").content_hash == "h"
    s.compact()
    s.vacuum(older_s=-5)
    s.register_artifact(ref, "r", "key")
    assert s.table("artifacts").count() == 1 and s.find_cache("key").run_id == "r"
    assert s.invalidate_cache("key") == 1 and s.find_cache("key") is None and s.artifacts().count() == 0


def test_state_is_the_same_with_and_without_the_log_alone(spark, tmp_path):
    s = RunStore(spark, f"file://{tmp_path}/s")
    run = s.create_run("k", "trial")
    for state in ("queued", "running"):
        s.transition(run, state)
    assert s.acquire_lease(run, "w", 60) and s._only_log(run)
    before = s._last(run)
    s.compact()
    assert not s._only_log(run)
    after = s._last(run)
    assert (before.now.asDict(), before.lease.asDict()) == (after.now.asDict(), after.lease.asDict())
    assert s.create_run("k", "trial") == run and s.state(run).state == "running" and not s.acquire_lease(run, "v", 60)
    assert s.release(run, "w") and s.acquire_lease(run, "v", 60) and not s.release(run, "w")


class _ObjectStore:
    """A store whose rename is a copy and a delete, and which can put on a condition."""

    def __init__(self):
        self.objects, self.lock = {}, threading.Lock()

    def put(self, spark, path, data):
        with self.lock:
            if path in self.objects:
                return False
            self.objects[path] = data
            return True


def test_one_of_many_writers_wins_on_an_object_store(spark, monkeypatch):
    store, won = _ObjectStore(), []
    monkeypatch.setitem(files.COMMITS, "double", store.put)
    _at_once([lambda k=k: won.append(k) if files.create_once(spark, "double://b/1.json", b"%d" % k) else None for k in range(16)])
    assert len(won) == 1 and store.objects == {"double://b/1.json": b"%d" % won[0]}
    assert files.COMMITS["s3a"] is files._conditional_put and files.COMMITS["hdfs"] is files._rename
    with pytest.raises(ConfigError, match="ftp"):
        files.create_once(spark, "ftp://b/1.json", b"")


def test_a_file_system_without_conditions_is_refused(spark, tmp_path):
    # Hadoop's local file system does not know the condition, and says so
    with pytest.raises(ConfigError, match="condition"):
        files._conditional_put(spark, f"file://{tmp_path}/x.json", b"1")


def test_one_of_many_writers_wins_by_rename(spark, tmp_path):
    won = []
    _at_once([lambda k=k: won.append(k) if files._rename(spark, f"file://{tmp_path}/x.json", b"%d" % k) else None for k in range(8)])
    assert won and (tmp_path / "x.json").read_bytes() == b"%d" % won[0] and files.read_text(spark, f"file://{tmp_path}/x.json") == str(won[0])


def test_buckets_agree_with_sparks(spark, tmp_path):
    t = KeyedTable(spark, f"file://{tmp_path}/t", "k string, v long", "k")
    t.append(spark.createDataFrame([(f"é{k}", k) for k in range(200)], "k string, v long"))
    t.compact()
    assert all(t.rows_of(f"é{k}").first().v == k for k in (0, 7, 199)) and len(t._manifest()[1]["segments"][0]["buckets"]) > segments.BUCKETS // 2
