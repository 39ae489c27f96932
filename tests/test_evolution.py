"""Non-dominated ranks, crowding, generations and mergeable reducers against plain versions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.operators import designs, evolution, ordering, reductions
from trialframe.plans.space import Constraint, Float, Integer, Space

AIMS = {"a": "minimize", "b": "maximize", "c": "minimize"}


def _fronts(costs):
    """Ranks by taking off one front after the other."""
    left, ranks, front = dict(costs), {}, 0
    while left:
        best = [i for i, x in left.items() if not any(all(p <= q for p, q in zip(y, x, strict=True)) and y != x for y in left.values())]
        for i in best:
            ranks[i] = front
            del left[i]
        front += 1
    return ranks


def _rows(n, seed, steps=12):
    draw = random.Random(seed)
    return [(i, *(float(draw.randrange(steps)) for _ in range(3))) for i in range(n)]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_ranks_of_a_population(spark, block):
    rows = _rows(300, 3)
    df = spark.createDataFrame([*rows, (900, None, 1.0, 1.0), (901, float("nan"), 1.0, 1.0)], "id long, a double, b double, c double")
    want = _fronts({i: (a, -b, c) for i, a, b, c in rows})
    assert {r.id: r["rank"] for r in evolution.nondominated_ranks(df, AIMS, block=block).collect()} == want
    assert evolution.nondominated_ranks(df.limit(0), AIMS).count() == 0
    with pytest.raises(PlanError):
        evolution.nondominated_ranks(df, {"a": "least"})


def _crowding(rows, ranks):
    out = dict.fromkeys(ranks, 0.0)
    for front in set(ranks.values()):
        own = [r for r in rows if ranks[r[0]] == front]
        for k in (1, 2, 3):
            own.sort(key=lambda r: (r[k], r[0]))
            span = own[-1][k] - own[0][k]
            for p, r in enumerate(own):
                edge = p in (0, len(own) - 1)
                out[r[0]] += float("inf") if edge else (own[p + 1][k] - own[p - 1][k]) / span if span else 0.0
    return out


def test_crowding_and_survivors(spark, monkeypatch):
    monkeypatch.setattr(evolution, "neighbours", lambda df, order, values: ordering.neighbours(df, order, values, every=16))
    rows = _rows(200, 4)
    df = spark.createDataFrame(rows, "trial_id long, a double, b double, c double")
    ranks = _fronts({i: (a, -b, c) for i, a, b, c in rows})
    lonely = _crowding(rows, ranks)
    got = {r.trial_id: r.crowding for r in evolution.crowding_distances(evolution.nondominated_ranks(df, AIMS), AIMS).collect()}
    assert got == pytest.approx(lonely)
    best = sorted(ranks, key=lambda i: (ranks[i], -lonely[i], i))[:50]
    chosen = {r.place: r.trial_id for r in evolution.survivors(df, AIMS, 50).collect()}
    assert sorted(chosen) == list(range(50)) and {ranks[i] for i in chosen.values()} == {ranks[i] for i in best}
    assert len(set(chosen.values()) & set(best)) >= 48  # equal distances may differ in the last bit


SPACE = Space((Float("x", low=0.0, high=10.0), Integer("n", low=0, high=20), Float("y", low=-1.0, high=1.0)), (Constraint("x + n < 29"),))


def test_generations_come_nearer_to_the_front(spark):
    def scored(trials):
        return trials.select("trial_id", "x", "n", "y", ((F.col("x") - 2) ** 2 + F.col("n")).alias("f"), ((F.col("x") - 4) ** 2 + F.abs("y")).alias("g"))

    aims = {"f": "minimize", "g": "minimize"}
    history = scored(evolution.next_generation(spark, SPACE, designs.Request(40, seed=1), None, aims))
    first = history.agg(F.avg(F.col("f") + F.col("g"))).first()[0]
    for k in range(3):
        made = evolution.next_generation(spark, SPACE, designs.Request(40, seed=2 + k), history, aims)
        again = evolution.next_generation(spark, SPACE, designs.Request(40, seed=2 + k), history, aims)
        assert made.count() == 40 and sorted(r.trial_id for r in made.collect()) == sorted(r.trial_id for r in again.collect())
        fresh = spark.createDataFrame(scored(made).collect())
        history = spark.createDataFrame(history.unionByName(fresh).collect())
    assert fresh.where("x < 0 or x > 10 or n < 0 or n > 20 or x + n >= 29").count() == 0
    assert fresh.agg(F.avg(F.col("f") + F.col("g"))).first()[0] < first / 2


def test_children_keep_to_their_parents(spark):
    df = spark.range(1).select(F.lit(0.2).alias("a"), F.lit(0.6).alias("b"))
    draws = [df.select(evolution.crossed(F.col("a"), F.col("b"), F.lit(u)), evolution.mutated(F.col("a"), F.lit(u))).first() for u in (0.1, 0.5, 0.9)]
    assert draws[1][0] == pytest.approx(0.2) and draws[1][1] == pytest.approx(0.2)
    assert all(0.1 < d[0] < 0.7 and abs(d[1] - 0.2) < 0.2 for d in draws)


def _longest(values):
    best = run = 0
    last = None
    for v in values:
        run = run + 1 if last is not None and v >= last else 1
        last, best = v, max(best, run)
    return best


@pytest.mark.parametrize("rows,states", [(3, 2), (1024, 64)])
def test_reducers_merge_in_a_tree(spark, rows, states):
    draw = random.Random(8)
    data = [("hot", i, float(draw.randrange(50))) for i in range(900)] + [("one", 0, 3.0), (None, 5, None), (None, 6, 1.0)]
    df = spark.createDataFrame(data, "k string, i long, v double")
    got = {r.k: r.n for r in reductions.tree_reduced(df, ["k"], "i", reductions.longest_run(), "v", "n", rows, states).collect()}
    assert got == {"hot": _longest(v for k, _, v in data if k == "hot"), "one": 1, None: 1}
    text = reductions.Reducer(F.lit(""), lambda s, v: F.concat(s, F.format_string("%.0f,", v)), lambda a, b: F.concat(a, b))
    joined = reductions.tree_reduced(df.where("k = 'hot'"), ["k"], "i", text, "v", "t", rows, states).first().t
    assert joined == "".join(f"{v:.0f}," for k, _, v in data if k == "hot")
    assert reductions.tree_reduced(df.limit(0), ["k"], "i", text, "v", "t").count() == 0


def test_a_tree_over_ranges_needs_no_numbers(spark):
    draw = random.Random(9)
    data = [(draw.choice("ab"), draw.randrange(300), float(draw.randrange(9))) for _ in range(2000)]
    df = spark.createDataFrame(data, "k string, i long, v double")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        out = reductions.tree_reduced(df.repartition(5), ["k"], "i", reductions.longest_run(), "v", "n", 16, 3)
        assert {r.k: r.n for r in out.collect()} == {k: _longest(v for _, _, v in sorted(d for d in data if d[0] == k)) for k in "ab"}
        assert "Window" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("panel,pairs", [(64, 100), (32_768, 65_536)])
def test_ranks_by_panels(spark, monkeypatch, panel, pairs):
    monkeypatch.setattr(evolution, "PANEL", panel)
    monkeypatch.setattr(evolution, "PAIRS", pairs)
    jobs, real = [], evolution.materialize
    monkeypatch.setattr(evolution, "materialize", lambda df, what: (jobs.append(what), real(df, what))[1])
    rows = _rows(300, 5, 40)
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {r.id: r["rank"] for r in evolution.nondominated_ranks(df, AIMS, block=16).collect()}
    assert got == _fronts({i: (a, -b, c) for i, a, b, c in rows})
    assert jobs.count("ranks") == (5 if panel == 64 else 1)  # blocks of 16 took a round each: 19
