"""Planners as table functions: a design for every space of a table, from SQL.

``register`` makes ``planned`` known to a session:

    SELECT * FROM planned(TABLE(spaces), planner => 'halton')

``spaces`` has a row for each parameter of each space: ``space``, ``name``, ``low``, ``high``, and ``n``, the number of trials
of the space. The function deals the table by space itself, so designs are made where their parameters are, one
space after the other, row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from trialframe.errors import PlanError
from trialframe.operators import designs

NEEDS = {"space": T.StringType(), "name": T.StringType(), "low": T.DoubleType(), "high": T.DoubleType(), "n": T.LongType()}


def inverse(index: int, base: int) -> float:
    """The radical inverse of an index."""
    out, power = 0.0, 1
    while index:
        index, digit = divmod(index, base)
        power *= base
        out += digit / power
    return out


def units(planner: str, index: int, n: int, dims: int) -> list[float]:
    """Unit coordinates of one row of a design of ``n``."""
    if planner == "halton":
        return [inverse(index, b) for b in designs.primes(dims)]
    if planner == "sobol":
        gray, out = index ^ (index >> 1), []
        for j in range(dims):
            x = 0
            for k, v in enumerate(designs.direction_numbers(j)):
                x ^= v if gray >> k & 1 else 0
            out.append(x / (1 << designs.BITS))
        return out
    # a grid: the most points of each axis that n rows have room for, the last axis running fastest
    points = 1
    while (points + 1) ** dims <= n:
        points += 1
    digits = []
    for _ in range(dims):
        index, digit = divmod(index, points)
        digits.append((digit + 0.5) / points)
    return digits[::-1]


PLANNERS = ("halton", "sobol", "grid")


class Planned:
    """The function's handler: parameters of a space come in, its design goes out."""

    def __init__(self) -> None:
        self._space, self._axes, self._n, self._planner = None, [], 0, "halton"

    @staticmethod
    def analyze(spaces: AnalyzeArgument, planner: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not spaces.isTable:
            raise PlanError("planned takes a table of spaces first")
        have = {f.name: f.dataType for f in spaces.dataType}
        wrong = sorted(name for name, kind in NEEDS.items() if have.get(name) != kind)
        if wrong:
            raise PlanError(f"a table of spaces has columns {', '.join(f'{n} {t.simpleString()}' for n, t in NEEDS.items())}; {wrong} are not so")
        if planner is not None and planner.value not in PLANNERS:
            raise PlanError(f"planner {planner.value!r} is none of {PLANNERS}")
        shape = T.StructType([T.StructField("space", T.StringType()), T.StructField("row_index", T.LongType()), T.StructField("name", T.StringType()), T.StructField("unit", T.DoubleType()), T.StructField("value", T.DoubleType())])
        return AnalyzeResult(schema=shape, partitionBy=[PartitioningColumn("space")], orderBy=[OrderingColumn("name")])

    def eval(self, spaces: Row, planner: str = "halton") -> None:
        if spaces["low"] is None or spaces["high"] is None or not spaces["low"] <= spaces["high"]:
            raise PlanError(f"{spaces['space']}: {spaces['name']} has no range")
        self._space, self._planner = spaces["space"], planner
        self._axes.append((spaces["name"], spaces["low"], spaces["high"]))
        self._n = max(self._n, spaces["n"] or 0)

    def terminate(self) -> Iterator[tuple]:
        dims = len(self._axes)
        count = self._n if self._planner != "grid" else max((p**dims for p in range(1, self._n + 1) if p**dims <= self._n), default=0)
        for i in range(count if dims else 0):
            for (name, low, high), u in zip(self._axes, units(self._planner, i, self._n, dims), strict=True):
                yield self._space, i, name, u, low + u * (high - low)


def register(spark: SparkSession, name: str = "planned") -> None:
    """Make the function known to a session's SQL."""
    spark.udtf.register(name, udtf(Planned))
