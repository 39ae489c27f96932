"""Sobol points of many dimensions, their scrambling, first rows without a sort, and planners as table functions."""

from __future__ import annotations

import itertools
import statistics

import pytest
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.operators import designs, tables
from trialframe.plans.space import Constraint, Float, Integer, Space, unit_column


def test_published_numbers_are_sound():
    found = designs._polynomials(len(designs.SOBOL))
    assert [x[:2] for x in designs.SOBOL] == list(found)
    assert all(len(m) == s and all(v % 2 and v < 2 << k for k, v in enumerate(m)) for s, _, m in designs.SOBOL)


def test_every_pair_of_64_dimensions_is_stratified():
    rows = [designs._leading(designs.direction_numbers(d)) for d in range(64)]
    defects = [designs._defect(a, b) for a, b in itertools.combinations(rows, 2)]
    later = [designs._defect(rows[i], rows[j]) for i, j in itertools.combinations(range(64), 2) if j > len(designs.SOBOL)]
    assert max(defects) < designs.JUDGED and statistics.mean(later) <= 2.5
    # what a defect says: 256 points fill all boxes of 2**-a by 2**-b with a + b = 8 - defect alike
    for i, j in ((0, 1), (3, 9), (22, 47), (40, 63)):
        t, points = designs._defect(rows[i], rows[j]), []
        vi, vj = designs.direction_numbers(i), designs.direction_numbers(j)
        for n in range(256):
            gray, x, y = n ^ n >> 1, 0, 0
            for k in range(8):
                if gray >> k & 1:
                    x, y = x ^ vi[k], y ^ vj[k]
            points.append((x, y))
        for a in range(9 - t):
            b = 8 - t - a
            cells = {}
            for x, y in points:
                cell = (x >> designs.BITS - a, y >> designs.BITS - b)
                cells[cell] = cells.get(cell, 0) + 1
            assert set(cells.values()) == {2**t} and len(cells) == 2 ** (8 - t)


def test_a_published_file_is_used(spark, tmp_path):
    path = tmp_path / "directions.txt"
    path.write_text("d s a m_i\n2 1 0 1\n3 2 1 1 3\n")
    assert designs.direction_numbers(2, str(path)) == designs.direction_numbers(2)
    with pytest.raises(PlanError, match="3 dimensions"):
        designs.direction_numbers(3, str(path))


def test_scrambled_points_stay_a_net_and_change_with_the_seed(spark):
    space = Space(tuple(Float(f"d{j}") for j in range(3)))
    names = [unit_column(p) for p in space.sampled]
    plain, one, again, other = (designs.sobol_units(spark, space, 256, s).orderBy("row_index").select(*names).collect() for s in (None, 4, 4, 5))
    assert one == again != other
    for rows in (plain, one, other):
        for j in range(3):
            assert sorted(int(r[j] * 256) for r in rows) == list(range(256))
        assert all(len({(int(r[0] * 2**a), int(r[1] * 2 ** (8 - a))) for r in rows}) == 256 for a in range(9))
    assert statistics.mean(r[0] for r in one) == pytest.approx(0.5, abs=0.01)
    with pytest.raises(PlanError):
        designs.sobol_units(spark, space, 4, 1, scramble="none")


def test_first_rows_without_a_sort(spark):
    space = Space((Float("x"), Integer("n", low=0, high=9)), (Constraint("x < 0.5"),))
    for s in (space, Space(space.parameters)):
        made = designs.propose(spark, s, designs.Request(50, seed=2), "random")
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert "GlobalLimit" not in plan and made.count() == 50
    kept = sorted(r.row_index for r in designs.propose(spark, space, designs.Request(50, seed=2), "random").collect())
    units = designs.random_units(spark, space, 500, 2).where(F.col(unit_column(space.sampled[0])) < 0.5)
    assert kept == [r.row_index for r in units.orderBy("row_index").limit(50).collect()]


@pytest.mark.parametrize("planner", tables.PLANNERS)
def test_designs_from_sql(spark, planner):
    tables.register(spark)
    spark.createDataFrame([("a", "x", 0.0, 10.0, 9), ("b", "y", -1.0, 1.0, 4), ("b", "x", 5.0, 5.0, 4)], "space string, name string, low double, high double, n long").createOrReplaceTempView("spaces")
    rows = spark.sql(f"SELECT * FROM planned(TABLE(spaces), planner => '{planner}')").collect()
    own = {s: sorted({r.row_index for r in rows if r.space == s}) for s in "ab"}
    assert own == {"a": list(range(9)), "b": list(range(4))} and all(0 <= r.unit < 1 for r in rows)
    assert {r.value for r in rows if (r.space, r.name) == ("b", "x")} == {5.0}
    lateral = spark.sql("SELECT p.space, count(*) AS n FROM VALUES ('a') AS t(k), LATERAL planned(TABLE(spaces)) AS p WHERE p.space = t.k GROUP BY p.space").collect()
    assert [tuple(r) for r in lateral] == [("a", 9)]
    if planner != "grid":
        units = {"halton": lambda s: designs.halton_units(spark, s, 4), "sobol": lambda s: designs.sobol_units(spark, s, 4)}[planner](Space((Float("x"), Float("y")))).collect()
        assert sorted((r.row_index, r.unit) for r in rows if r.space == "b" and r.name == "y") == sorted((r.row_index, pytest.approx(r[2])) for r in units)


def test_tables_of_spaces_are_checked(spark):
    tables.register(spark)
    spark.createDataFrame([("a", "x", 3.0, 1.0, 9)], "space string, name string, low double, high double, n long").createOrReplaceTempView("turned")
    for sql, why in (("SELECT * FROM planned(TABLE(turned))", "no range"), ("SELECT * FROM planned(TABLE(turned), planner => 'spiral')", "spiral"), ("SELECT * FROM planned(TABLE(SELECT 1 AS space))", "low double")):
        with pytest.raises(Exception, match=why):
            spark.sql(sql).collect()
