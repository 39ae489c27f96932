"""Selection queries over a long table of metrics: latest values, top-k, feasibility, thresholds, Pareto fronts."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.operators.ordering import numbered
from trialframe.scratch import materialize


def latest(df: DataFrame, keys: list[str], order: str, values: list[str], ties: list[str] = ()) -> DataFrame:
    """The last row of each key by ``order``, then by ``ties``: one partial aggregation, no sort."""
    last = F.max_by(F.struct(*values), F.struct(order, *ties) if ties else F.col(order)).alias("last")
    return df.groupBy(*keys).agg(last).select(*keys, *(f"last.{v}" for v in values))


def pivot_metrics(metrics: DataFrame, names: Mapping[str, str], trial: str = "trial_id", name: str = "name", value: str = "value", seq: str = "seq") -> DataFrame:
    """One row per trial; per entry of ``names`` (column to metric) the last scalar reported, null if none was."""
    shown = [F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq))).alias("v")]
    picked = [F.max_by(F.when(F.col(name) == metric, F.col(value)), F.when((F.col(name) == metric) & F.col(value).isNotNull(), F.col(seq))).alias(column) for column, metric in names.items()]
    return metrics.groupBy(trial).agg(*(picked or shown))


def _holds(value: Column, operator: str, threshold: float) -> Column:
    if operator in ("ge", ">="):
        return value >= threshold
    if operator in ("le", "<="):
        return value <= threshold
    raise PlanError(f"operator {operator!r} is neither ge nor le")


def top_k(df: DataFrame, objective: str, k: int, direction: str = "maximize", ordinal: str = "ordinal", state: str | None = "state") -> DataFrame:
    """The best completed trials, ties in history order. Plans as TakeOrderedAndProject: no full sort."""
    rows = df.where(F.col(objective).isNotNull())
    if state is not None:
        rows = rows.where(F.col(state) == "completed")
    first = F.asc(objective) if direction == "minimize" else F.desc(objective)
    return rows.orderBy(first, F.asc(ordinal)).limit(k)


def best_feasible(df: DataFrame, objective: str, constraints: Mapping[str, tuple[str, float]], k: int = 1, direction: str = "maximize", ordinal: str = "ordinal", state: str | None = "state") -> DataFrame:
    """``top_k`` of the trials that meet every constraint; a missing metric is infeasible."""
    for metric, (operator, threshold) in constraints.items():
        df = df.where(_holds(F.col(metric), operator, threshold))
    return top_k(df, objective, k, direction, ordinal, state)


def threshold(df: DataFrame, metric: str, limit: float, operator: str = "ge") -> DataFrame:
    """Trials on the right side of a limit, whatever their state."""
    return df.where(_holds(F.col(metric), operator, limit))


def pareto_front(df: DataFrame, objectives: Mapping[str, str]) -> DataFrame:
    """Trials that no other dominates; equal ones all stay, trials without every objective do not.

    ``objectives`` maps columns to ``minimize`` or ``maximize``. One objective is a minimum, two are a
    running minimum over distinct values; more are compared within blocks, and then between blocks, so that no
    pair of all rows is formed.
    """
    signs = {c: (1 if d == "minimize" else -1) for c, d in objectives.items()}
    rows = df
    for c in objectives:
        rows = rows.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    costs = [(F.col(c) * s).cast("double").alias(f"__c{i}") for i, (c, s) in enumerate(signs.items())]
    names = [f"__c{i}" for i in range(len(costs))]
    points = rows.select(*costs).distinct()
    if len(names) == 1:
        front = points.agg(F.min("__c0").alias("__c0"))
    elif len(names) == 2:
        front = _staircase(points)
    else:
        front = _skyline(points, names)
    keys = [f"__k{i}" for i in range(len(names))]
    front = front.select(*(F.col(c).alias(k) for c, k in zip(names, keys, strict=True)))
    same = [(F.col(c) * s).cast("double") == F.col(k) for (c, s), k in zip(signs.items(), keys, strict=True)]
    return rows.join(front, same, "left_semi")


def _staircase(points: DataFrame) -> DataFrame:
    """Two costs: per band of the first cost, its own best second cost, then the bands' running minimum.

    Only band minima are ordered in one task; the points of a band are ordered within it.
    """
    cuts = points.agg(F.percentile_approx("__c0", [i / 64 for i in range(1, 64)], 1000).alias("q")).first().q or []
    edges = F.array(*(F.lit(float(c)) for c in sorted(set(cuts)))) if cuts else F.array().cast("array<double>")
    banded = points.groupBy("__c0").agg(F.min("__c1").alias("__c1")).withColumn("__band", F.size(F.filter(edges, lambda c: c < F.col("__c0"))))
    bands = banded.groupBy("__band").agg(F.min("__c1").alias("low"))
    before = Window.partitionBy().orderBy("__band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.select(F.col("__band").alias("b"), F.min("low").over(before).alias("__before"))
    inside = Window.partitionBy("__band").orderBy("__c0").rowsBetween(Window.unboundedPreceding, -1)
    joined = banded.join(F.broadcast(bands), F.col("__band") == F.col("b"))  # 64 rows at most
    best = F.least(F.min("__c1").over(inside), F.col("__before"))
    return joined.withColumn("__best", best).where(F.col("__best").isNull() | (F.col("__c1") < F.col("__best"))).select("__c0", "__c1")


#: Points that a task compares with each other, or with as many.
BLOCK = 2048


def _skyline(points: DataFrame, names: list[str]) -> DataFrame:
    """Three costs or more: fronts of hash blocks, again and again while that leaves at most half of the points.

    What is left is one block in the end, or a front that is larger than a block. That one is put in lexicographic order, where
    nothing is dominated from behind, and cut into blocks; each is compared with those before it whose least corner isn't
    beyond its own largest in any cost, a pair of blocks in each task. Tasks hold two blocks, the driver holds counts.
    """
    import numpy as np
    import pandas as pd

    def dominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), bool)
        for at in range(0, len(by), 256):
            rivals = by[at : at + 256]
            out |= ((rivals[:, None] <= x[None]).all(2) & (rivals[:, None] < x[None]).any(2)).any(0)
        return out

    def front(x: np.ndarray) -> np.ndarray:
        x = x[np.lexsort(x.T[::-1])]
        kept = np.empty((0, x.shape[1]))
        for at in range(0, len(x), 256):
            block = x[at : at + 256]
            kept = np.concatenate([kept, block[~dominated(block, np.concatenate([kept, block]))]])
        return kept

    out = ", ".join(f"{c} double" for c in names)
    thinned = lambda rows: pd.DataFrame(front(rows[names].to_numpy()), columns=names)
    count, turn = points.count(), 0
    while True:
        blocks = max(1, -(-count // BLOCK))
        dealt = points.groupBy(F.pmod(F.xxhash64(*names, F.lit(turn)), F.lit(blocks)).alias("__block"))
        points = materialize(dealt.applyInPandas(lambda _, rows: thinned(rows), out), "points")
        if blocks == 1:
            return points
        before, count, turn = count, points.count(), turn + 1
        if count > BLOCK and 2 * count > before:
            break
    placed = numbered(points, {c: F.col(c) for c in names}, "__at").select(F.floor(F.col("__at") / BLOCK).alias("block"), *names)
    placed = materialize(placed, "points")
    corner = lambda name, f: F.struct(*(f(c).alias(c) for c in names)).alias(name)
    corners = materialize(placed.groupBy("block").agg(corner("least", F.min), corner("most", F.max)), "corners")
    pairs = corners.select(F.col("block").alias("own"), "most", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block"))).alias("rival"))
    near = reduce(lambda a, b: a & b, (F.col(f"least.{c}") <= F.col(f"most.{c}") for c in names))
    duties = pairs.join(corners.select(F.col("block").alias("rival"), "least"), "rival").where(near).select("own", "rival")
    duties = materialize(duties, "duties")
    sides = [duties.join(placed, F.col(side) == F.col("block")).select("own", "rival", F.lit(side == "own").alias("mine"), *names) for side in ("own", "rival")]

    def lost(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.loc[rows["mine"], names]
        return own[dominated(own.to_numpy(), rows.loc[~rows["mine"], names].to_numpy())]

    gone = sides[0].unionByName(sides[1]).groupBy("own", "rival").applyInPandas(lost, out).distinct()
    gone = gone.select(*(F.col(c).alias(f"{c}_gone") for c in names))
    return placed.join(gone, [F.col(c) == F.col(f"{c}_gone") for c in names], "left_anti").select(*names)


#: Policies by the names that extensions and studies use.
POLICIES = {"top_k": top_k, "best_feasible": best_feasible, "threshold": threshold, "pareto_front": pareto_front}


def decision(selected: DataFrame, policy: str, explanation: str, trial: str = "trial_id") -> dict:
    """The record of a small selection: ids in rank order and why."""
    return {"policy": policy, "trial_ids": [r[0] for r in selected.select(trial).collect()], "explanation": explanation}
