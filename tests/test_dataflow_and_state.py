from __future__ import annotations

import json
import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from trialframe import cli
from trialframe.context import Context, Token
from trialframe.errors import ArtifactCorrupt, ArtifactError, Cancelled, CheckpointMismatch, ConfigError, Paused, PipelineInvalid, PlanError, PortMismatch, RunError, StateConflict
from trialframe.functions import canonical
from trialframe.operators import decisions, designs, reductions, refinement, runstore
from trialframe.operators.runstore import RunStore
from trialframe.plans.pipeline import Block, Pipeline, Stateful, block, mean, scale
from trialframe.plans.space import Float, Space
from trialframe.plans.study import DurableRunner, Retry, Study
from trialframe.plugins import Plugins
from trialframe.schemas import schema
from trialframe.sources import codecs, exchange
from trialframe.sources.artifacts import ArtifactStore
from trialframe.sources.config import Experiment, scan_secrets

NUMBERS = "items array<bigint> not null"


def _double():
    return Block("double", lambda df: df.withColumn("items", F.transform("items", lambda x: x * 2)), schema(NUMBERS), schema("items array<bigint>"))


def _sum():
    return Block("sum", lambda df: df.select("run_id", F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")), schema(NUMBERS), schema("total bigint"))


def _runs(spark, *lists):
    return spark.createDataFrame([(f"r{i}", list(x)) for i, x in enumerate(lists)], "run_id string, items array<bigint>")


def test_sequence_and_mapped_order(spark):
    out = Pipeline("p").then(_double()).then(_sum()).run(_runs(spark, [1, 2, 3], []))
    assert {r.run_id: r.total for r in out["sum"].collect()} == {"r0": 12, "r1": 0}
    mapped = Pipeline("m").add("d", _double(), map_over="items", parallelism=2).run(_runs(spark, [4, 1, 3], []))
    assert {r.run_id: r["items"] for r in mapped["d"].collect()} == {"r0": [8, 2, 6], "r1": []}


def test_graphs_are_validated(spark):
    a, b, c = schema("value bigint"), schema("value bigint not null, note string"), schema("text string not null")
    make = lambda name, i, o: Block(name, lambda df: df, i, o)
    assert [n.id for n in Pipeline("p").then(make("a", a, a)).then(make("b", b, b)).validate()] == ["a", "b"]
    with pytest.raises(PortMismatch):
        Pipeline("p").then(make("a", a, a)).then(make("c", c, c)).validate()
    with pytest.raises(PipelineInvalid, match="cycle"):
        Pipeline("p").add("x", make("x", a, a), ["y"]).add("y", make("y", a, a), ["x"]).validate()
    with pytest.raises(PipelineInvalid):
        Pipeline("p").validate()
    with pytest.raises(PipelineInvalid):
        Pipeline("p").add("x", make("x", a, a), ["nobody"]).validate()
    with pytest.raises(PipelineInvalid, match="trigger"):
        Pipeline("p").then(Block("s", lambda df: df, a, a, pattern="stream")).validate()
    with pytest.raises(PipelineInvalid, match="list"):
        Pipeline("p").add("x", make("x", a, a), map_over="value").validate()
    twice = Pipeline("p").then(make("a", a, a)).then(make("a", a, a))
    assert list(twice.nodes) == ["a", "a_2"] and twice.describe()["nodes"][1]["depends_on"] == ["a"]
    with pytest.raises(PipelineInvalid):
        twice.add("a", make("a", a, a))
    with pytest.raises(PipelineInvalid):
        twice.join("zz")
    fan = Pipeline("p").add("l", make("l", a, schema("u bigint"))).add("r", make("r", a, schema("v bigint"))).join("l", "r").then(make("j", schema("u bigint not null, v bigint not null"), a))
    assert [n.id for n in fan.validate()] == ["l", "r", "j"]


def test_wrong_output_is_refused(spark):
    bad = block("bad", "items array<bigint>", "items array<bigint>")(lambda df: df.select("run_id"))
    with pytest.raises(PortMismatch):
        Pipeline("p").then(bad).run(_runs(spark, [1]))


def test_durable_runs_resume_behind_what_is_done(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/state")
    fail = {"now": True}

    def total(df):
        if fail["now"]:
            raise ValueError("injected")
        return df.select("run_id", F.size("items").cast("long").alias("total"))

    p = Pipeline("p").then(_double()).then(Block("total", total, schema(NUMBERS), schema("total bigint"), version="1"))
    runner = DurableRunner(spark, store, f"file://{tmp_path}/work")
    with pytest.raises(RunError, match="injected"):
        runner.run(p, _runs(spark, [2]))
    fail["now"] = False
    p2 = Pipeline("p").then(p.nodes["double"].block).then(Block("total", lambda df: total(df), schema(NUMBERS), schema("total bigint")))
    second = runner.run(p2, _runs(spark, [2]))
    assert second.hits == ("double",) and second.outputs["double"].first()["items"] == [4]
    assert runner.run(p2, _runs(spark, [2])).hits == ("double", "total")
    assert runner.run(p2, _runs(spark, [5])).hits == ()  # other input, other key
    token = Token()
    token.pause()
    with pytest.raises(Paused):
        runner.run(p2, _runs(spark, [7]), Context(token=token))
    states = {r.state for r in runstore.current_states(store.table("events")).collect()}
    assert "paused" in states and "completed" in states


def test_state_machine_leases_and_stale_runs(spark, tmp_path):
    s = RunStore(spark, f"file://{tmp_path}/s")
    run = s.create_run("trial:one", "trial")
    assert s.create_run("trial:one", "trial") == run
    v = s.transition(run, "queued", 0)
    with pytest.raises(StateConflict):
        s.transition(run, "running", 0)
    with pytest.raises(StateConflict):
        s.transition(run, "completed")
    s.transition(run, "running", v)
    assert s.acquire_lease(run, "w1", 600) and s.acquire_lease(run, "w1", 600) and not s.acquire_lease(run, "w2", 600)
    assert s.heartbeat(run, "w1", 600) and not s.heartbeat(run, "w2", 600)
    assert [r.run_id for r in s.reconcile_stale(s.now() + timedelta(hours=1), requeue=True).collect()] == [run]
    assert s.state(run).state == "queued" and runstore.conflicts(s.table("events")).count() == 0
    assert runstore.illegal_transitions(s.table("events").where("state is not null")).count() == 0
    bulk = s.create_runs(spark.createDataFrame([("k1", "trial", run), ("k1", "trial", run), ("k2", "trial", run)], "logical_key string, kind string, parent_id string"))
    assert bulk.count() == 2 and runstore.descendants(s.table("runs"), run).count() == 2


def test_metrics_artifacts_checkpoints(spark, tmp_path):
    s, a = RunStore(spark, f"file://{tmp_path}/s"), ArtifactStore(spark, f"file://{tmp_path}/a")
    s.add_event("r", "custom", {"x": 1})
    s.report_metric("r", "loss", 0.5)
    s.report_metric("r", "curve", [1, 2])
    assert [(m.name, m.scalar, m.vector) for m in s.metrics("r").collect()] == [("loss", 0.5, None), ("curve", None, [1.0, 2.0])]
    ref = a.put(b"state", "bytes", {"upstream": "abc"})
    assert a.put(b"state", "bytes")["content_hash"] == ref["content_hash"] and a.read(ref) == b"state" and a.verify(ref) and a.lineage(ref) == {"upstream": "abc"}
    s.register_artifact(ref, "r", "cache")
    s.register_artifact(ref, "r", "cache")
    assert s.find_cache("cache").content_hash == ref["content_hash"] and s.invalidate_cache("cache") == 1 and s.find_cache("cache") is None
    assert [s.save_checkpoint("b", {"epoch": k}, "f1") for k in (1, 2)] == [1, 2] and s.latest_checkpoint("b", "f1") == {"epoch": 2} and s.latest_checkpoint("z") is None
    with pytest.raises(CheckpointMismatch):
        s.latest_checkpoint("b", "f2")
    (next((tmp_path / "a/objects").rglob(ref["content_hash"]))).write_bytes(b"bad")
    for crc in (tmp_path / "a/objects").rglob("*.crc"):
        crc.unlink()
    assert a.verify(ref, strict=False) is False
    with pytest.raises(ArtifactCorrupt, match="hash mismatch"):
        a.verify(ref)
    with pytest.raises(ArtifactError):
        a.read({"content_hash": "00", "codec": "bytes"})
    for _ in range(2):
        a.put_table(spark.createDataFrame([("x",), ("y",), ("x",)], "payload string"))
    assert a.manifest().count() == 2 == a.payloads().where("whole").count()
    s.record_decision("r", "top", ["t1", "t2"])
    assert s.table("decisions").count() == 2
    lines = exchange.export_tree(spark.createDataFrame([("c", "r")], "run_id string, parent_id string"), s.table("artifacts").withColumn("run_id", F.lit("c")), "r").collect()
    assert sorted(x.kind for x in lines) == ["artifact", "run"] and {json.loads(x.document)["run_id"] for x in lines} == {"c"}


def test_codecs(spark):
    known = codecs.Codecs()
    for id, value in (("json", {"b": 2, "a": 1}), ("bytes", b"x"), ("text", "текст")):
        assert known.get(id).decode(known.get(id).encode(value)) == value
    assert known.get("json").encode({"b": 2, "a": 1}) == b'{"a":1,"b":2}'
    assert np.array_equal(known.get("numpy").decode(known.get("numpy").encode(np.arange(5))), np.arange(5))
    with pytest.raises(ValueError):
        known.get("json").encode(float("nan"))
    with pytest.raises(ArtifactError):
        known.get("zip")
    df = spark.createDataFrame([([1.0, 2.0],), (None,)], "v array<double>")
    assert [r.w for r in df.select(codecs.from_npy(codecs.npy(F.col("v"))).alias("w")).collect()] == [[1.0, 2.0], None]
    assert df.limit(1).select(codecs.decode_text(codecs.encode_json(F.struct("v"))).alias("j")).first().j == '{"v":[1.0,2.0]}'


def test_fingerprints(spark):
    assert canonical.fingerprint({"a": 1, "b": {2, 1}}) == canonical.fingerprint({"b": {1, 2}, "a": 1}) != canonical.fingerprint({"a": 1})
    df = spark.createDataFrame([(1, "x", {"k": "v", "a": "b"})], "n int, s string, m map<string,string>")
    one, two = df.select(canonical.row_fingerprint(["n", "s"]).alias("a"), canonical.row_fingerprint(["s", "n"]).alias("b")).first()
    assert one == two and len(one) == 64
    assert len(df.select(canonical.map_fingerprint("m")).first()[0]) == 64
    parts = dict.fromkeys(canonical.KEY_PARTS, "ä") | {"seed": "7", "model": None}
    columns = {k: F.lit(v) for k, v in parts.items()}
    assert df.select(canonical.cache_key(columns)).first()[0] == canonical.cache_key_of(parts) != canonical.cache_key_of(parts | {"seed": "8"})
    with pytest.raises(ValueError):
        canonical.cache_key({"seed": F.lit(1)})


def test_canonical_forms():
    import dataclasses
    import datetime
    import pathlib

    @dataclasses.dataclass
    class Point:
        x: int

    values = [None, True, 1, 1.0, "1", b"1", [1], {1}, {"1": 1}, np.arange(2), np.arange(2.0), pathlib.PurePosixPath("1"), datetime.date(2024, 1, 2), Point(1), Point(2)]
    assert len({canonical.fingerprint(v) for v in values}) == len(values)
    assert canonical.fingerprint(np.int64(1)) == canonical.fingerprint(1) and canonical.fingerprint((1, 2)) == canonical.fingerprint([1, 2])
    with pytest.raises(ValueError):
        canonical.fingerprint(float("inf"))
    with pytest.raises(PlanError):
        canonical.fingerprint(object())


def _made(held, n=1):
    def inner(df, k=n):
        return df, held, k

    return inner


def test_code_counts_with_what_it_holds():
    class Held:
        def __init__(self, v):
            self.v = v

    same = canonical.code_fingerprint(_made(Held(1)))
    assert same == canonical.code_fingerprint(_made(Held(1)))  # another object at another address
    others = [_made(Held(2)), _made(Held(1), 2), _made(_made(1)), _made(_made(2)), Held(1).__init__, Held]
    assert len({same, *map(canonical.code_fingerprint, others)}) == 7
    assert canonical.code_fingerprint(_made(1), "1") != canonical.code_fingerprint(_made(1), "2")
    loop = Held(0)
    loop.v = loop
    assert canonical.code_fingerprint(_made(loop))


def test_study_finds_and_refines(spark):
    space = Space((Float("x", low=-1.0, high=1.0),))
    study = Study(
        space,
        evaluate=lambda t: t.where("x < 0.9").select("trial_id", F.lit("score").alias("name"), (-((F.col("x") - 0.25) ** 2)).alias("value"), F.lit(0).alias("seq")),
        decide=lambda h: decisions.top_k(h, "score", 2),
        metrics=("score",),
        refine=lambda s, selected: refinement.neighbourhood(s, selected, "rank", 0.2),
    )
    best = study.run(spark, designs.Request(12, seed=3), rounds=2).collect()
    assert len(best) == 2 and study.spaces[1].parameters[0].high - study.spaces[1].parameters[0].low < 2 and abs(best[0].x - 0.25) < 0.2
    assert {r.state for r in study.history[0].collect()} <= {"completed", "failed"}


def test_context_retry_and_signals():
    c = Context(seed=3)
    assert c.stream("00000001") != c.stream("00000010") and c.stream("a") == Context(seed=3).stream("a")
    c.token.cancel()
    with pytest.raises(Cancelled):
        c.token.check()
    assert Retry(on=("ValueError",)).covers(ValueError()) and not Retry(on=(KeyError,)).covers(ValueError())
    assert Retry(initial_s=1, most_s=3, jitter=0).delay(5, random.Random(1)) == 3
    assert Retry(jitter=0.5).delay(1, random.Random(4)) == Retry(jitter=0.5).delay(1, random.Random(4))


CONFIG = {
    "schema_version": "1", "name": "quick", "seed": 42,
    "pipeline": {"name": "values", "blocks": [{"id": "make", "implementation": "trialframe.constant", "parameters": {"values": [1, 2, 3, 4]}}, {"id": "scale", "implementation": "trialframe.scale", "depends_on": ["make"], "parameters": {"factor": 2.5}}, {"id": "mean", "implementation": "trialframe.mean", "depends_on": ["scale"]}]},
    "parameter_space": {"parameters": [{"kind": "float", "name": "x", "low": 0, "high": 1}, {"kind": "categorical", "name": "c", "values": ["a", "b"], "active_when": {"parameter": "x", "operator": "ge", "value": 0.0}}]},
    "planner": {"kind": "sobol", "n_trials": 3},
}


def test_config_and_command_line(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "e.json"
    path.write_text(json.dumps(CONFIG | {"storage": {"root": "${ENV:TRIAL_ROOT}"}}))
    with pytest.raises(ConfigError, match="TRIAL_ROOT"):
        Experiment.from_json(path)
    monkeypatch.setenv("TRIAL_ROOT", f"file://{tmp_path}/store")
    run = lambda *a: (cli.main(list(a), spark), json.loads(capsys.readouterr().out or "null"))
    assert run("validate", str(path)) == (0, {"valid": True, "order": ["make", "scale", "mean"]})
    code, first = run("run", str(path))
    assert code == 0 and [t["value"] for t in first["trials"]] == [6.25] * 3 and first["hits"] == []
    assert run("run", str(path))[1]["hits"] == ["make", "scale", "mean"]
    assert run("resume", str(path))[1]["resumed"] == ["make", "scale", "mean"]
    assert len(run("plan", str(path))[1]) == 3
    assert "float" in run("schema")[1]["$defs"]
    status = run("status", f"file://{tmp_path}/store")[1]
    assert {(s["kind"], s["state"]) for s in status} == {("block", "completed"), ("pipeline", "completed")}
    assert run("reconcile", f"file://{tmp_path}/store")[1] == {"stale": []}
    assert cli.main(["validate", str(tmp_path / "none.json")], spark) == 2
    for bad in ({"storage": {"password": "x"}}, {"storage": {"api-key": "abc"}}, {"schema_version": "2"}, {"nonsense": 1}):
        with pytest.raises(ConfigError):
            Experiment.from_dict(CONFIG | bad)
    with pytest.raises(ConfigError, match="zz"):
        Experiment.from_dict(CONFIG | {"planner": {"kind": "zz"}}).build_planner()
    with pytest.raises(ConfigError, match="a.0.auth_token, a.1.Private Key.x"):
        scan_secrets({"a": [{"auth_token": 3}, {"Private Key": {"x": "y"}}], "secret_names": ["token"], "ok": {"password": None}})
    assert Experiment.from_dict(CONFIG | {"storage": {"password": "secret://db"}}).name == "quick"


def test_plugins():
    p = Plugins()
    p.register("policies", "mine", object)
    assert p.resolve("policies", "mine") is object and p.names("blocks") == ["trialframe.constant", "trialframe.mean", "trialframe.scale"] and p.discover() == []
    assert set(p.names("planners")) >= {"sobol", "grid"} and "top_k" in p.names("policies") and "elite_zoom" in p.names("refinements")
    for f in (lambda: p.register("policies", "mine", 1), lambda: p.register("zz", "a", 1), lambda: p.resolve("blocks", "zz")):
        with pytest.raises(ConfigError):
            f()


def test_files(spark, tmp_path):
    rows = spark.createDataFrame([("1", "a"), ("2", "b")], "x string, kind string")
    exchange.write_matrix(rows.coalesce(1), f"{tmp_path}/m")
    back = exchange.read_matrix(spark, f"{tmp_path}/m")
    assert [(r.x, r.kind) for r in back.orderBy("row_index").collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(Exception, match="empty"):
        exchange.write_matrix(rows.where("false"), f"{tmp_path}/n")
    with pytest.raises(Exception, match="fewer"):
        designs.design_matrix(back, Space(()), "row_index", 3)
    nested = spark.createDataFrame([("r", (1, ("x",)), 2)], "run_id string, a struct<b: int, c: struct<d: string>>, e int")
    assert exchange.flatten_struct(nested).columns == ["run_id", "a.b", "a.c.d", "e"]
    told = spark.createDataFrame([("r", "loss", 4, 0.5, None, None), ("r", "curve", 5, None, [1.0], None)], "run_id string, name string, seq long, scalar double, vector array<double>, artifact string")
    got = {(x.kind, x.name): (x.value, x.step) for x in exchange.tracking_records(told, nested, 500).collect()}
    assert got == {("param", "a.b"): ("1", None), ("param", "a.c.d"): ("x", None), ("param", "e"): ("2", None), ("metric", "loss"): ("0.5", 4), ("text", "curve"): ('{"vector":[1.0]}', 5)}


def test_array_reductions(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0],), ([10.0, 14.0],)], "v array<double>")
    assert [r.c for r in df.select(reductions.centred(F.col("v")).alias("c")).collect()] == [[-1.0, 0.0, 1.0], [-2.0, 2.0]]
    pts = spark.createDataFrame([([(0.0, 0.0), (2.0, 4.0)],)], "p array<struct<x:double,y:double>>")
    assert [tuple(p) for p in pts.select(reductions.translated(F.col("p")).alias("q")).first().q] == [(1.0, -1.0), (3.0, 3.0)]
    peaks = spark.createDataFrame([([99.0, 0.0, 5.0, 9.0, 8.0, 8.5, 8.7, 6.0, 3.0, 50.0],)], "v array<double>")
    found = peaks.select(reductions.argmax(F.col("v")), reductions.argmax(F.col("v"), 2, 8), reductions.second_argmax(F.col("v"), 2, 8), reductions.second_argmax(F.col("v"), 2, 8, after=1)).first()
    assert tuple(found) == (0, 3, 7, 6)
    bins = reductions.profile(spark.createDataFrame([(1, 2.0), (1, 4.0), (5, 1.0)], "b int, w double"), F.col("b"), "w", 4)
    assert {r.bin: r.profile for r in bins.collect()} == {0: 0.0, 1: 3.0, 2: 0.0, 3: 0.0, 5: 1.0}
    z = reductions.standardize(spark.createDataFrame([(1.0, None), (3.0, None), (5.0, "b")], "x double, k string"), "x", ["k"]).collect()
    assert sorted((r.x, r.z) for r in z if r.k is None) == [(1.0, -1.0), (3.0, 1.0)] and reductions.standardize(df.select(F.col("v")[0].alias("x")), "x", name="q").count() == 2
    m = spark.createDataFrame([({"a": 1, "b": 1}, {"b": 2})], "l map<string,int>, r map<string,int>")
    assert m.select(reductions.merged(F.col("l"), F.col("r"))).first()[0] == {"a": 1, "b": 2}
    empty = spark.createDataFrame([([],)], "values array<double>")
    assert empty.select(reductions.mean_or_zero(F.col("values"))).first()[0] == 0.0
    out = Pipeline("p").then(scale(2.5)).then(mean()).run(spark.createDataFrame([("r", [1.0, 2.0, 3.0, 4.0])], "run_id string, values array<double>"))
    assert out["mean"].first().value == 6.25


def test_finished_partitions_are_not_run_again(spark, tmp_path):
    marker = tmp_path / "tripped"

    def tens(df):
        trip = not marker.exists() and not df.where("items[0] = 12").isEmpty()
        if trip:
            marker.write_text("x")
            raise RuntimeError("tripped")
        return df.withColumn("items", F.transform("items", lambda x: x * 10))

    p = Pipeline("parts").add("tens", Block("tens", tens, schema(NUMBERS), schema("items array<bigint>")), map_over="items")
    for mode in ("read_write", "disabled"):
        marker.unlink(missing_ok=True)
        store = RunStore(spark, f"file://{tmp_path}/{mode}/state")
        runner = DurableRunner(spark, store, f"file://{tmp_path}/{mode}", cache=mode)
        with pytest.raises(RunError, match="tripped"):
            runner.run(p, _runs(spark, [10, 11, 12, 13], [7]))
        again = runner.run(p, _runs(spark, [10, 11, 12, 13], [7]), resume=True)
        assert {r.run_id: r["items"] for r in again.final.collect()} == {"r0": [100, 110, 120, 130], "r1": [70]}
        assert sorted(map(tuple, again.partitions["tens"].collect())) == [("r0", "00000000"), ("r0", "00000001"), ("r1", "00000000")]
        # a finished block is taken as it is, whatever the cache mode
        assert runner.run(p, _runs(spark, [10, 11, 12, 13], [7]), resume=True).resumed == ("tens",)


def test_blocks_are_tried_again(spark, tmp_path):
    fails = [ValueError("once"), ValueError("twice")]

    def shaky(df):
        if fails:
            raise fails.pop()
        return df

    store = RunStore(spark, f"file://{tmp_path}/s")
    p = Pipeline("shaky").then(Block("shaky", shaky, schema(NUMBERS), schema("items array<bigint>")))
    runner = DurableRunner(spark, store, f"file://{tmp_path}/w", retry=Retry(attempts=3, initial_s=0.01, on=("ValueError",)))
    assert runner.run(p, _runs(spark, [4])).final.count() == 1
    assert store.table("events").where("event_type = 'retry_scheduled'").count() == 2
    fails.append(KeyError("never"))
    with pytest.raises(RunError, match="never"):
        runner.run(p, _runs(spark, [5]))


def test_of_two_writers_one_wins(spark, tmp_path):
    import threading

    stores = [RunStore(spark, f"file://{tmp_path}/s") for _ in range(4)]
    runs, won, leases = set(), [], []

    def work(k):
        s = stores[k]
        run = s.create_run("one", "trial")
        runs.add(run)
        try:
            s.transition(run, "queued", 0)
            won.append(k)
        except StateConflict:
            pass
        leases.append(s.acquire_lease(run, f"w{k}", 600))

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s = stores[0]
    (run,) = runs
    assert len(won) == 1 and sum(leases) == 1 and s.table("runs").count() == 1
    events = s.table("events")
    assert runstore.conflicts(events).count() == 0
    before = sorted((r.version, r.state, r.owner) for r in events.collect())
    assert s.compact_events() == len(before) - 1 and sorted((r.version, r.state, r.owner) for r in s.table("events").collect()) == before
    version = s.state(run).version
    assert s.transition(run, "running") == version + 1


def test_lookups(spark, tmp_path):
    s = RunStore(spark, f"file://{tmp_path}/s")
    top = s.create_run("top", "pipeline")
    low = [s.create_run(f"low{k}", "block", top) for k in range(2)]
    assert s.get_run(top).logical_key == "top" and s.get_by_key("low1").run_id == low[1] and s.get_by_key("none") is None
    assert [r.run_id for r in s.list_runs(parent_id=top).collect()] == low and s.list_runs(kind="pipeline").count() == 1
    ref = {"content_hash": "h", "media_type": "m", "codec": "c", "lineage": {}, "metadata": {}, "size": 1}
    s.register_artifact(ref, low[0], "k")
    assert [a.content_hash for a in s.artifacts_for_run(low[0]).collect()] == ["h"] and s.artifacts_for_run(top).count() == 0


def test_descendants_of_any_depth(spark):
    chain = [(f"n{k}", f"n{k - 1}") for k in range(1, 12)] + [("n3", "n9"), ("n0", "n11")]  # and a circle
    got = {r.run_id: r.depth for r in runstore.descendants(spark.createDataFrame(chain, "run_id string, parent_id string"), "n0").collect()}
    assert got == {f"n{k}": k for k in range(1, 12)}


def test_stateful_blocks_and_named_parts(spark):
    class Adder(Stateful):
        def __init__(self, by):
            self.by = by

        def setup(self, context):
            self._table = self.by * 10

        def process(self, df, context):
            return df.withColumn("items", F.transform("items", lambda x: x + self._table))

    adder = Block("add", Adder(2), schema(NUMBERS), schema("items array<bigint>"))
    before = adder.code
    assert Pipeline("p").then(adder).run(_runs(spark, [1]))["add"].first()["items"] == [21]
    assert adder.code == before != Block("add", Adder(3), schema(NUMBERS), schema("items array<bigint>")).code

    def corners(spark, space, request):
        return spark.createDataFrame([(space.parameters[0].low,), (space.parameters[0].high,)], "x double")

    plugins = Plugins()
    plugins.register("planners", "corners", corners)
    study = Study.by_names(plugins, Space((Float("x", low=-1.0, high=3.0),)), lambda t: t.select("trial_id", F.lit("score").alias("name"), F.col("x").alias("value"), F.lit(0).alias("seq")), ("score",), "corners", ("top_k", {"objective": "score", "k": 1}), ("neighbourhood", {"rank": "rank", "radius": 0.25}))
    assert [r.x for r in study.run(spark, designs.Request(2), rounds=2).collect()] == [3.0] and study.spaces[1].parameters[0].low == 2.0


def test_studies_are_kept(spark, tmp_path):
    calls = []

    def evaluate(trials):
        calls.append(1)
        return trials.select("trial_id", F.lit("score").alias("name"), F.col("x").alias("value"), F.lit(0).alias("seq"))

    make = lambda: Study(Space((Float("x"),)), evaluate, lambda h: decisions.top_k(h, "score", 2), ("score",))
    store = RunStore(spark, f"file://{tmp_path}/s")
    first = make().run(spark, designs.Request(5, seed=1), root=f"file://{tmp_path}/study", store=store).collect()
    assert make().run(spark, designs.Request(5, seed=1), root=f"file://{tmp_path}/study").collect() == first and len(calls) == 1
    assert [r.trial_id for r in store.table("decisions").orderBy("rank").collect()] == [r.trial_id for r in first]


def test_image_functions(spark):
    from trialframe.functions import images

    y, x = np.mgrid[:24, :24].astype(float)
    flat, step = np.full((24, 24), 3.0), (x >= 12).astype(float)
    assert np.allclose(images.smooth(flat, 2.0), 3.0) and np.allclose(images.gradient(flat), 0) and np.allclose(images.gradient(2 * x)[:, 1:-1], 16)
    assert abs(images.smooth(step, 1.0).sum() - step.sum()) < 1e-6 and np.abs(images.laplacian(x + y, 1.5)[8:-8, 8:-8]).max() < 0.02
    bowl = images.laplacian((x - 12) ** 2 + (y - 12) ** 2, 1.0)
    assert bowl[12, 12] == pytest.approx(4, abs=0.02)
    found = images.edges(step, quantile=0.9)
    assert found[:, 11:13].all() and not found[:, :9].any() and images.edges(step, "log", 0.9).sum() > 0
    assert images.minimum(lambda v: (v - 1.3) ** 2, 0, 4) == pytest.approx(1.3, abs=1e-6)
    df = spark.createDataFrame([([float(v) for v in flat.ravel()], 24), (None, 1), ([], 1)], "v array<double>, w int")
    got = [r.g for r in df.select(images.per_image(images.gradient, F.col("v"), F.col("w")).alias("g")).collect()]
    assert len(got[0]) == 576 and max(got[0]) == 0 and got[1] is None and got[2] == []
