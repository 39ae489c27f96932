from __future__ import annotations

import pytest

from tests.llm import brute
from trialframe.llm.sharding import CommitConflict, Shard, ShardStore, sharded


def _rows(df):
    return sorted((r.doc_id, r.text or "", r.source) for r in df.collect())


def test_arrivals_compact_and_stay_whole(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=40_000, smallest_bytes=1_000, fanout=3, rows_per_shard=40)
    whole = []
    for k in range(5):
        part = brute.documents(spark, [f"text {k} {i} " * 20 for i in range(90)] + [None, "", "same", "same"], first=1000 * k)
        whole += _rows(part)
        store.append(part)
    before = store.manifest()
    assert before.version == 5 and len(before.shards) >= 10 and sum(s.rows for s in before.shards) == len(whole)
    after = store.compact()
    assert after.version > 5 and len(after.shards) < len(before.shards) and store.due(after) is None
    assert _rows(store.read()) == sorted(whole) == _rows(store.read(5))
    assert sum(s.rows for s in after.shards) == len(whole)
    assert store.vacuum() > 0 and _rows(store.read()) == sorted(whole) and store._versions() == [after.version]


def test_commits_are_atomic(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s")
    base = store.manifest()
    first = store.commit(base, [Shard("data/a/x", 1, 1)], None)
    with pytest.raises(CommitConflict):
        store.commit(base, [Shard("data/b/y", 1, 1)], None)
    assert store.manifest() == first and store.manifest(0).shards == ()
    with pytest.raises(ValueError):
        ShardStore(spark, f"file://{tmp_path}/none").read()


def test_empty_and_clashing_columns(spark, tmp_path):
    docs = brute.documents(spark, ["a", None]).withColumnRenamed("fp", "shard")
    got = sharded(docs, f"file://{tmp_path}/a")
    assert _rows(got) == _rows(docs) and {r.shard.endswith(".parquet") for r in got.collect()} == {True}
    assert sharded(docs.where("false"), f"file://{tmp_path}/b").count() == 0
    store = ShardStore(spark, f"file://{tmp_path}/a")
    with pytest.raises(ValueError):
        store.append(docs.select("doc_id"))


def test_two_writers_lose_nothing(spark, tmp_path):
    import threading

    root = f"file://{tmp_path}/s"
    parts = [brute.documents(spark, [f"writer {k} {i}" for i in range(20)], first=100 * k) for k in range(4)]
    errors = []

    def work(k):
        try:
            ShardStore(spark, root, smallest_bytes=100, fanout=2).append(parts[k])
            ShardStore(spark, root, smallest_bytes=100, fanout=2).compact()
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    store = ShardStore(spark, root)
    assert not errors and _rows(store.read()) == sorted(r for p in parts for r in _rows(p))


def test_vacuum_leaves_a_running_append_alone(spark, tmp_path):
    store, other = (ShardStore(spark, f"file://{tmp_path}/s", smallest_bytes=1, fanout=2, target_bytes=10**6) for _ in range(2))
    one, two = brute.documents(spark, ["a"]), brute.documents(spark, ["b"], first=1)
    store.append(one)
    base, written = other.manifest(), other._write(two)  # an append that has not committed yet
    store.append(brute.documents(spark, ["c"], first=2))
    store.compact()
    store.vacuum()
    with pytest.raises(CommitConflict):
        other.commit(base, [*base.shards, *written], base.schema)
    now = other.manifest()
    other.commit(now, [*now.shards, *written], now.schema)
    assert [r[0] for r in _rows(store.read())] == [0, 1, 2]
    assert store.vacuum(orphans_after_s=-1) >= 0 and [r[0] for r in _rows(store.read())] == [0, 1, 2]


def test_a_lost_race_in_compaction_is_tried_again(spark, tmp_path, monkeypatch):
    store = ShardStore(spark, f"file://{tmp_path}/s", smallest_bytes=1, fanout=2, target_bytes=10**6)
    for k in range(2):
        store.append(brute.documents(spark, [f"t{k}"], first=k))
    commit, raced = ShardStore.commit, []

    def race(self, base, shards, schema):
        if not raced:
            raced.append(1)
            ShardStore(spark, self.root).append(brute.documents(spark, ["late"], first=9))
        return commit(self, base, shards, schema)

    monkeypatch.setattr(ShardStore, "commit", race)
    store.compact()
    assert raced and [r[0] for r in _rows(store.read())] == [0, 1, 9]


def test_a_tier_that_cannot_shrink_is_passed_over(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/s", smallest_bytes=1000, fanout=2, target_bytes=100_000)
    shards = [Shard("data/a/x", 10, 1), Shard("data/a/y", 10, 1), Shard("data/b/x", 5000, 1), Shard("data/b/y", 5000, 1)]
    from trialframe.llm.sharding import Manifest

    manifest = Manifest(1, None, tuple(shards))
    assert store.due(manifest) == shards[:2] and store.due(manifest, frozenset(shards[:2])) == shards[2:] and store.due(manifest, frozenset(shards)) is None
