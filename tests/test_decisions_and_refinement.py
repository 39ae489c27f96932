from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.operators import decisions, designs, refinement
from trialframe.plans.space import Categorical, Float, Integer, Space

SPACE = Space((Float("x", low=0.0, high=10.0), Integer("n", low=1, high=12), Categorical("kind", values=("a", "b", "c"))))


@pytest.fixture(scope="module")
def history(spark):
    rows = [(0, "t0", "completed", 1.0, 2, "a", 0.7, 2.0, 1.0), (1, "t1", "completed", 2.0, 4, "a", 0.9, 4.0, 1.0), (2, "t2", "completed", 7.0, 12, "b", 0.95, 12.0, 0.0), (3, "t3", "failed", 3.0, 3, "c", None, None, None)]
    return spark.createDataFrame(rows, "ordinal int, trial_id string, state string, x double, n int, kind string, quality double, latency double, feasible double")


def _ids(df):
    return [r.trial_id for r in df.collect()]


def test_policies(history):
    assert _ids(decisions.top_k(history, "quality", 2)) == ["t2", "t1"]
    assert _ids(decisions.top_k(history, "latency", 1, "minimize")) == ["t0"]
    assert _ids(decisions.best_feasible(history, "quality", {"feasible": ("ge", 1.0)})) == ["t1"]
    assert len(_ids(decisions.threshold(history, "quality", 0.8))) == 2
    assert len(_ids(decisions.pareto_front(history, {"quality": "maximize", "latency": "minimize"}))) == 3
    with pytest.raises(PlanError):
        decisions.threshold(history, "quality", 0.8, "about")


def test_ties_keep_history_order(spark):
    df = spark.createDataFrame([(i, f"t{i}", "completed", 1.0) for i in range(9, -1, -1)], "ordinal int, trial_id string, state string, q double")
    assert _ids(decisions.top_k(df, "q", 3)) == ["t0", "t1", "t2"] == _ids(decisions.top_k(df, "q", 3, "minimize"))


def test_the_last_scalar_counts(spark):
    rows = [("a", "m", 1, 5.0), ("a", "m", 2, 7.0), ("a", "m", 3, None), ("a", "k", 9, 1.0), ("b", "k", 1, 2.0)]
    m = spark.createDataFrame(rows, "trial_id string, name string, seq int, value double")
    got = {r.trial_id: (r.m, r.k) for r in decisions.pivot_metrics(m, {"m": "m", "k": "k"}).collect()}
    assert got == {"a": (7.0, 1.0), "b": (None, 2.0)}


@pytest.mark.parametrize("n", [1, 2, 3])
def test_fronts_against_all_pairs(spark, n):
    r = random.Random(n)
    rows = [(i, *(float(r.randint(0, 30)) if r.random() > 0.02 else None for _ in range(3))) for i in range(600)]
    df = spark.createDataFrame(rows, "trial_id int, a double, b double, c double")
    aims = dict(list({"a": "maximize", "b": "minimize", "c": "maximize"}.items())[:n])
    sign = [1 if d == "minimize" else -1 for d in aims.values()]
    pts = {i: [s * v for s, v in zip(sign, vs)] for i, *vs in rows if all(v is not None for v in vs[:n])}
    want = {i for i, p in pts.items() if not any(all(x <= y for x, y in zip(q, p)) and q != p for q in pts.values())}
    assert {r.trial_id for r in decisions.pareto_front(df, aims).collect()} == want


@pytest.mark.parametrize("n,block", [(3, 2048), (3, 40), (4, 40)])
def test_large_fronts_are_compared_cell_by_cell(spark, monkeypatch, n, block):
    monkeypatch.setattr(decisions, "BLOCK", block)
    r = random.Random(n)
    rows = []
    for i in range(700):  # costs that trade off against each other: nearly all are on the front
        parts = [r.random() for _ in range(n)]
        total = sum(parts)
        rows.append((i, *(round(p / total + (0.02 if r.random() < 0.2 else 0), 3) for p in parts)))
    names = "abcd"[:n]
    df = spark.createDataFrame(rows, "trial_id int, " + ", ".join(f"{c} double" for c in names))
    want = {i for i, *p in rows if not any(all(x <= y for x, y in zip(q, p, strict=True)) and q != p for _, *q in rows)}
    got = {x.trial_id for x in decisions.pareto_front(df, dict.fromkeys(names, "minimize")).collect()}
    assert got == want and len(want) > 300


def test_refinements(history):
    ranked = decisions.top_k(history, "quality", 3).withColumn("rank", F.monotonically_increasing_id())
    zoomed = refinement.elite_zoom(SPACE, history.where("ordinal < 2"))
    assert zoomed.parameters[0].high < 10 and zoomed.parameters[2].values == ("a",) and zoomed.parent_version == "1" and zoomed.version.startswith("1/zoom@")
    assert SPACE.parameters[2].values == ("a", "b", "c") and zoomed.metadata["trials"] == 2
    near = refinement.neighbourhood(SPACE, history.where("ordinal = 0").withColumn("rank", F.lit(0)), "rank", 0.2)
    assert near.parameters[0].low == 0 and near.parameters[0].high == 3.0 and near.parameters[1].high == 5
    trust = refinement.trust_region(SPACE, ranked, "rank", improved=False)
    assert trust.metadata["radius"] == 0.1 and trust.parameters[0].low == 6.0
    assert refinement.robustness(SPACE, ranked, "rank").parameters[0].high == pytest.approx(7.3)
    again, trials = refinement.replication(SPACE, ranked, replicates=2)
    assert again.parameters == SPACE.parameters and again.metadata["replicates"] == 2
    assert sorted((r.trial_id, r.replicate_index) for r in trials.collect()) == [(f"t{k}", i) for k in range(3) for i in range(2)]
    assert refinement.elite_count(11, 0.2) == 3 and refinement.elite_count(2) == 1
    for f in (lambda d: refinement.elite_zoom(SPACE, d), lambda d: refinement.neighbourhood(SPACE, d, "x"), lambda d: refinement.replication(SPACE, d)):
        with pytest.raises(PlanError):
            f(history.where("false"))


@pytest.mark.parametrize("every", [65_536, 50])
def test_numbers_and_sums_along_an_order(spark, every):
    from trialframe.operators import ordering

    r = random.Random(2)
    rows = [(i, r.choice([None, "a", "é", "b", "zz"]), r.randint(0, 30)) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, s string, n int").repartition(3)
    order = {"s": F.col("s"), "n": F.col("n"), "i": F.col("i")}
    got = ordering.running(ordering.numbered(df, order, "at", every), order, {"sum": F.col("n")}, every).orderBy("at").collect()
    want = sorted(rows, key=lambda x: (x[1] is not None, x[1] or "", x[2], x[0]))
    assert [x.i for x in got] == [x[0] for x in want] and [x.at for x in got] == list(range(1000))
    assert [x.sum for x in got] == [sum(y[2] for y in want[:k]) for k in range(1000)]


def test_fronts_larger_than_a_block(spark, monkeypatch):


    monkeypatch.setattr(decisions, "BLOCK", 16)
    draw = random.Random(2)
    rows = [(i, x, y, -x - y + draw.choice((0.0, 0.0, 0.5))) for i in range(300) for x, y in [(draw.random(), draw.random())]]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    best = {i for i, *p in rows if not any(all(q <= v for q, v in zip(o, p, strict=True)) and o != p for _, *o in rows)}
    got = decisions.pareto_front(df, {"a": "minimize", "b": "minimize", "c": "minimize"})
    assert {r.id for r in got.collect()} == best and len(best) > 100


def test_medians_are_exact(spark):

    import statistics

    draw = random.Random(3)
    data = {"hot": [float(draw.randrange(10**6)) for _ in range(30_001)], "same": [4.0] * 50, "two": [1.0, 2.0], None: [3.0, 9.0, 4.0], "tied": [1.0] * 40 + [5.0] * 40}
    rows = [(k, v) for k, vs in data.items() for v in vs] + [("hot", None), ("none", None)]
    got = {r.k: r.median for r in designs.medians(spark.createDataFrame(rows, "k string, v double"), "k", "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in data.items()}
