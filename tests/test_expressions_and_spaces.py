from __future__ import annotations

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.functions.expressions import compile_expression
from trialframe.operators import designs
from trialframe.plans.space import Boolean, Categorical, Condition, Constraint, Derived, Fixed, Float, Integer, Ordinal, Space, project, resolve, unit_column

CASES = ["a + b * 2", "a / b", "a % b", "-a ** 2", "a % -3", "not a > b", "1 < a <= b", "a in [1, 2.5, 7]", "s in ['x', 'y']", "'x' in s", "a > 1 and b < 3 or s == 'y'", "s not in ('x',)", "+a - -b"]


def test_expressions_mean_what_python_means(spark):
    rows = [(a, b, s) for a in (-7.0, 2.5, 7.0) for b in (-3.0, 2.0) for s in ("x", "zxz", "y")]
    df = spark.createDataFrame(rows, "a double, b double, s string")
    got = df.select("a", "b", "s", *(compile_expression(c, ["a", "b", "s"]).alias(f"c{i}") for i, c in enumerate(CASES))).collect()
    for r in got:
        for i, c in enumerate(CASES):
            want = eval(c, {"__builtins__": {}}, {"a": r.a, "b": r.b, "s": r.s})  # the oracle; the library never evaluates
            assert r[f"c{i}"] == pytest.approx(want) if not isinstance(want, bool) else r[f"c{i}"] is want, c


@pytest.mark.parametrize("text", ["f(a)", "a.b", "a[0]", "a // 2", "a | 1", "a if a else b", "lambda: 1", "zz + 1", "a +", "a is None"])
def test_other_syntax_is_refused(spark, text):
    with pytest.raises(PlanError):
        compile_expression(text, ["a", "b"])


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(low=st.floats(-100, 0), width=st.floats(1e-3, 100), u=st.floats(0, 0.999999))
def test_float_round_trip(spark, low, width, u):
    p = Float("x", low=low, high=low + width)
    row = spark.range(1).select(p.from_unit(F.lit(u)).alias("x")).select("x", p.to_unit(F.col("x")).alias("u")).first()
    assert low <= row.x <= low + width and abs(row.u - u) < 1e-9


def test_unit_values_and_back(spark):
    """Every kind of parameter: values are in range, ascend with the unit value, and come back within their step's width."""
    kinds = [
        Float("a", low=-2.0, high=6.0),
        Float("b", low=0.5, high=32.0, log=True),
        Float("c", low=0.0, high=5.0, step=0.5),
        Integer("d", low=-3, high=12),
        Integer("e", low=2, high=512, log=True),
        Categorical("f", values=("n", "e", "s", "w", "up")),
        Ordinal("g", values=(3, 5, 8, 13)),
        Boolean("h"),
    ]
    width = {"c": 0.11, "d": 0.07, "e": 0.3, "f": 0.26, "g": 0.34, "h": 0.51}
    units = spark.range(41).select((F.col("id") / 40).alias("u"))
    for p in kinds:
        rows = units.select("u", p.from_unit(F.col("u")).alias("v")).select("u", "v", p.to_unit(F.col("v")).alias("back")).orderBy("u").collect()
        place = (lambda v, p=p: p.values.index(v)) if isinstance(p, Categorical | Ordinal) else (lambda v: v)
        values = [place(r.v) for r in rows]
        assert values == sorted(values) and all(abs(r.u - r.back) < width.get(p.name, 1e-9) for r in rows), p.name
        if isinstance(p, Float | Integer):
            assert min(values) >= p.low and max(values) <= p.high
        else:
            assert len(set(values)) == len(getattr(p, "values", (0, 1)))
    for p in (Derived("x", expression="1"), Fixed("y", value=2)):
        with pytest.raises(PlanError):
            p.from_unit(F.lit(0.5))
    with pytest.raises(PlanError):
        Space((Boolean("a"), Fixed("a", value=1)))


def _mixed():
    return Space(
        (
            Categorical("solver", values=("direct", "sweep", "hybrid")),
            Integer("rounds", low=2, high=40),
            Float("damping", low=0.01, high=0.9, log=True, active_when=Condition("solver", "ne", "direct")),
            Ordinal("grid", values=(16, 32, 64)),
            Boolean("warm"),
            Derived("work", expression="rounds * grid", sources=("rounds", "grid")),
        ),
        (Constraint("work <= 1200 and rounds > 2"),),
    )


@pytest.mark.parametrize("planner", ["random", "numpy", "sobol", "halton", "latin"])
def test_designs_repeat_by_seed_and_keep_the_rules(spark, planner):
    draw = lambda seed: designs.propose(spark, _mixed(), designs.Request(9, seed=seed), planner, oversample=6).orderBy("row_index").collect()
    one, again, other = draw(11), draw(11), draw(12)
    assert [r.trial_id for r in one] == [r.trial_id for r in again] != [r.trial_id for r in other]
    for r in one:
        assert r.work == r.rounds * r.grid <= 1200 and r.rounds > 2 and (r.damping is None) == (r.solver == "direct")


def test_numpy_draws_are_numpys(spark):
    import numpy as np

    space = Space((Float("a"), Float("b"), Float("c")))
    rows = designs.numpy_units(spark, space, 1000, 7).orderBy("row_index").select(*(unit_column(p) for p in space.sampled)).toPandas().to_numpy()
    assert np.array_equal(rows, np.random.default_rng(7).random((1000, 3)))


def test_counts_of_rows(spark):
    axes = Space((Ordinal("level", values=(1, 2, 3)), Boolean("on"), Integer("n", low=0, high=9)))
    assert designs.propose(spark, axes, designs.Request(12), "grid", points=2).count() == 12
    for planner in ("grid", "factorial"):
        with pytest.raises(PlanError, match="12 valid rows"):
            designs.propose(spark, axes, designs.Request(13), planner, points=2)
    assert designs.propose(spark, axes, designs.Request(13, allow_fewer=True), "grid", points=2).count() == 12
    assert designs.propose(spark, axes, designs.Request(50, seed=2, replicates=2), "halton").count() == 100
    odd = Space(axes.parameters, (Constraint("level != 2"),))
    assert designs.propose(spark, odd, designs.Request(8), "grid", points=2).count() == 8
    with pytest.raises(PlanError, match="8 valid rows"):
        designs.propose(spark, odd, designs.Request(9), "grid", points=2)
    nothing = Space((Fixed("base", value=5), Derived("next", expression="base - 1", sources=("base",))))
    assert [r.next for r in designs.propose(spark, nothing, designs.Request(4), "random").collect()] == [4] * 4
    with pytest.raises(PlanError, match="unknown planner"):
        designs.propose(spark, axes, designs.Request(1), "spiral")


def test_strata_hold_one_point_each(spark):
    space = Space((Float("x", low=-1.0, high=4.0), Ordinal("k", values=(1, 2, 3, 4, 5)), Float("y", active_when=Condition("k", "gt", 3))))
    rows = designs.propose(spark, space, designs.Request(20, seed=8), "latin").collect()
    assert sorted(int((r.x + 1) / 5 * 20) for r in rows) == list(range(20)) and sorted(r.k for r in rows) == sorted([1, 2, 3, 4, 5] * 4)
    assert all((r.y is not None) == (r.k > 3) for r in rows) and len({r.trial_id for r in rows}) == 20


def test_sobol_points_of_many_dimensions_fill_every_interval(spark):
    space = Space(tuple(Float(f"d{j}") for j in range(30)))
    rows = designs.sobol_units(spark, space, 64).collect()
    for p in space.sampled:  # 64 points: one in each 64th of every dimension
        assert sorted(int(r[unit_column(p)] * 64) for r in rows) == list(range(64))
    with pytest.raises(PlanError, match="repeat"):
        designs.sobol_units(spark, space, 2**30 + 1)


def test_texts_and_lists_in_expressions(spark):
    df = spark.createDataFrame([("ab", [1, 2], 3)], "s string, l array<int>, n int")
    ask = lambda e: df.select(compile_expression(e, ["s", "l", "n"], lists=("l",), texts=("s",)).alias("v")).first().v
    assert (ask("s + '-' + s"), ask("s * 2"), ask("n * 'x'"), ask("l + [n]"), ask("[0] * 2 + l")) == ("ab-ab", "abab", "xxx", [1, 2, 3], [0, 0, 1, 2])
    for bad in ("s + n", "l * s", "s - s", "s / 2", "l + s"):
        with pytest.raises(PlanError):
            ask(bad)
    space = Space((Categorical("a", values=("x", "y")), Derived("b", expression="a + '!'", sources=("a",))))
    assert [r.b for r in designs.propose(spark, space, designs.Request(2), "grid").orderBy("b").collect()] == ["x!", "y!"]


def test_conditions_on_absent_values(spark):
    df = spark.createDataFrame([(None,), (1,)], "x int")
    got = {op: [r.v for r in df.select(Condition("x", op, v).column().alias("v")).collect()] for op, v in (("eq", 1), ("ne", 1), ("in", (1,)), ("not_in", (1,)))}
    assert got == {"eq": [False, True], "ne": [True, False], "in": [False, True], "not_in": [True, False]}
    with pytest.raises(Exception, match="inactive"):
        df.select(Condition("x", "gt", 0).column()).collect()


def test_rejects_keep_their_message(spark):
    space = Space((Integer("n", low=1, high=4),), (Constraint("n >= 3", "too small"),))
    units = designs.grid_units(spark, space, 4)
    assert [r.rejected for r in resolve(units, space, keep_rejects=True).orderBy("row_index").collect()] == ["too small", "too small", None, None]
    assert project(units, space).columns == ["row_index", "n"]
    with pytest.raises(PlanError, match="too small"):
        designs.design_matrix(spark.createDataFrame([(1, 2)], "k int, n int"), space, "k")


def test_suggestions_follow_good_trials(spark):
    space = Space((Float("x", low=-1.0, high=1.0),))
    first = designs.propose(spark, space, designs.Request(40, seed=3))
    told = first.withColumn("score", -((F.col("x") - 0.25) ** 2))
    again = designs.suggest(spark, space, designs.Request(20, seed=5), told)
    off = lambda df: df.agg(F.avg(F.abs(F.col("x") - 0.25))).first()[0]
    assert again.count() == 20 and off(again) < 0.5 * off(first)


def test_suggestions_use_every_past_trial(spark):
    space = Space((Float("x", low=0.0, high=1.0),))
    # 130 good trials: 65 near 0.2, and in the second half of the rows 65 near 0.8; the bad ones are even
    rows = [(0.2 + i * 1e-5 if i < 65 else 0.8 + i * 1e-5, 1.0) for i in range(130)] + [(i / 390, 0.0) for i in range(390)]
    told = spark.createDataFrame(rows, "x double, score double").coalesce(1)
    ask = lambda df: [r.x for r in designs.suggest(spark, space, designs.Request(40, seed=5), df, candidates=4).orderBy("row_index").collect()]
    got = ask(told)
    assert min(sum(x < 0.5 for x in got), sum(x > 0.5 for x in got)) >= 10
    assert got == ask(told.repartition(7).orderBy(F.desc("x")))
