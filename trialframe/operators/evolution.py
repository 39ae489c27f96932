"""Population search on several objectives: non-dominated ranks, crowding distances, survivors, and a next generation.

A trial's rank is the number of the front that it is in when fronts are taken off one after the other, which is the
length of the longest chain of trials that dominate each other down to it. So ranks need no loop over fronts: distinct
cost vectors are put in lexicographic order, where every dominating one comes first, and cut into panels of whole blocks.
Panel by panel, a job ends one panel's ranks and raises the lower bounds of all later panels by those of the panel before,
in up to ``TASKS`` tasks. A task holds two panels at a time, and halves both until boxes tell which of their rows dominate.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialframe.errors import PlanError
from trialframe.operators import designs
from trialframe.operators.ordering import neighbours, numbered
from trialframe.plans.space import Space, unit_column
from trialframe.functions.expressions import named
from trialframe.scratch import discard, materialize

#: Distinct cost vectors of a block, and of a panel of blocks, which is ranked in one round (a block at least).
BLOCK, PANEL = 4096, 32_768
#: Tasks of a round at most, so what they report to the driver grows with the rounds only.
TASKS = 64
#: Pairs of cost vectors that are compared at once.
PAIRS = 65_536


def _costs(objectives: Mapping[str, str]) -> dict[str, Column]:
    wrong = {d for d in objectives.values()} - {"minimize", "maximize"}
    if wrong or not objectives:
        raise PlanError(f"objectives are to be minimized or maximized, not {sorted(wrong)}")
    # 0.0 makes -0.0 of a negated zero equal to zero
    return {c: (F.col(c).cast("double") * (1 if d == "minimize" else -1) + F.lit(0.0)) for c, d in objectives.items()}


def _known(df: DataFrame, objectives: Mapping[str, str]) -> DataFrame:
    for c in objectives:
        df = df.where(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")))
    return df


def nondominated_ranks(df: DataFrame, objectives: Mapping[str, str], name: str = "rank", block: int = BLOCK) -> DataFrame:
    """``df`` with the number of the front each row is in, from 0; rows without every objective are left out.

    ``objectives`` maps columns to ``minimize`` or ``maximize``. Equal rows are in one front. No order of rows matters.
    """
    import numpy as np
    import pandas as pd

    rows = _known(df, objectives)
    costs = _costs(objectives)
    keys = [f"__c{i}" for i in range(len(costs))]
    points = rows.select(*(c.alias(k) for k, c in zip(keys, costs.values(), strict=True))).distinct()
    placed = numbered(points, {k: F.col(k) for k in keys}, "__at")
    placed = placed.select(F.floor(F.col("__at") / (block * max(1, PANEL // block))).cast("int").alias("panel"), *keys, F.lit(0).cast("long").alias("rank"))
    left = materialize(placed, "points")
    panels = (left.agg(F.max("panel")).first()[0] or 0) + 1
    shape = ", ".join(["panel int", *(f"{k} double" for k in keys), "rank long"])

    def raised(x: np.ndarray, ranks: np.ndarray, by: np.ndarray, by_ranks: np.ndarray, depth: int = 0) -> np.ndarray:
        """Ranks of ``x``, one above every row of ``by`` that dominates it; ``by`` comes first and is not equal."""
        higher = by_ranks >= ranks.min(initial=np.iinfo(np.int64).max)
        by, by_ranks = by[higher], by_ranks[higher]
        if not len(by) or (by.min(0) > x.max(0)).any():
            return ranks
        undecided = np.flatnonzero(by.max(0) > x.min(0))
        if not len(undecided):
            return np.maximum(ranks, by_ranks.max() + 1)
        if len(x) * len(by) <= PAIRS:
            over = np.logical_and.reduce([by[:, None, k] <= x[None, :, k] for k in undecided])
            return np.maximum(ranks, np.where(over, by_ranks[:, None] + 1, 0).max(0))
        k = undecided[depth % len(undecided)]
        half = max(len(x), len(by)) // 2
        if len(x) > len(by):
            ranks = ranks.copy()
            for part in np.split(np.argpartition(x[:, k], half), [half]):
                ranks[part] = raised(x[part], ranks[part], by, by_ranks, depth + 1)
        else:
            for part in np.split(np.argpartition(by[:, k], half), [half]):
                ranks = raised(x, ranks, by[part], by_ranks[part], depth + 1)
        return ranks

    def ended(x: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Ranks of rows in lexicographic order from their lower bounds."""
        if len(x) <= 32:
            for i in range(1, len(x)):
                over = (x[:i] <= x[i]).all(1)
                if over.any():
                    ranks[i] = max(ranks[i], ranks[:i][over].max() + 1)
            return ranks
        half = len(x) // 2
        first = ended(x[:half], ranks[:half])
        return np.concatenate([first, ended(x[half:], raised(x[half:], ranks[half:], x[:half], first))])

    def step(now: int):
        def rank(key: tuple, own: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
            own = own.sort_values(keys)
            x, ranks = own[keys].to_numpy(), own["rank"].to_numpy(copy=True)
            if len(above):
                ranks = raised(x, ranks, above[keys].to_numpy(), above["rank"].to_numpy())
            return own.assign(rank=ended(x, ranks) if key[0] == now else ranks)

        return rank

    finished: list[DataFrame] = []
    for now in range(panels):
        above = finished[-1] if finished else left.limit(0)
        ahead = above.select(F.explode(F.sequence(F.lit(now), F.lit(panels - 1))).alias("panel"), *keys, "rank")
        sides = (side.repartition(min(TASKS, panels - now), "panel").groupBy("panel") for side in (left, ahead))
        done = next(sides).cogroup(next(sides)).applyInPandas(step(now), shape)
        raised_ = materialize(done, "ranks")
        finished.append(raised_.where(F.col("panel") == now))
        left = raised_.where(F.col("panel") > now)
    ranks = finished[0]
    for one in finished[1:]:
        ranks = ranks.unionByName(one)
    ranks = ranks.select(*(F.col(k).alias(f"{k}_r") for k in keys), F.col("rank").alias(name))
    same = [c == F.col(f"{k}_r") for k, c in zip(keys, costs.values(), strict=True)]
    return materialize(rows.join(ranks, same).drop(*(f"{k}_r" for k in keys)), "ranked")


def crowding_distances(ranked: DataFrame, objectives: Mapping[str, str], trial: str = "trial_id", rank: str = "rank", name: str = "crowding") -> DataFrame:
    """``ranked`` with the sum, over the objectives, of the gap between a row's neighbours in its front, as a share of the front's range.

    The first and last row of a front in any objective have infinity; an objective that is the same in a whole front adds
    nothing. Rows of one value go by ``trial``.
    """
    spans = ranked.groupBy(F.col(rank).alias("__front")).agg(*(F.max(c).cast("double").alias(f"__max{i}") for i, c in enumerate(objectives)), *(F.min(c).cast("double").alias(f"__min{i}") for i, c in enumerate(objectives)))
    out, total, edge = ranked.join(spans, F.col(rank) == F.col("__front")), F.lit(0.0), F.lit(False)
    for i, c in enumerate(objectives):
        value = F.col(c).cast("double")
        out = materialize(neighbours(out, {"front": F.col(rank), "value": value, "trial": F.col(trial)}, {f"__f{i}": F.col(rank), f"__v{i}": value}), "crowded")
        inner = (F.col(f"__f{i}_before") == F.col(rank)) & (F.col(f"__f{i}_after") == F.col(rank))
        share = F.try_divide(F.col(f"__v{i}_after") - F.col(f"__v{i}_before"), F.col(f"__max{i}") - F.col(f"__min{i}"))
        edge = edge | ~F.coalesce(inner, F.lit(False))
        total = total + F.coalesce(share, F.lit(0.0))
    out = out.withColumn(name, F.when(edge, F.lit(float("inf"))).otherwise(total))
    return out.select(*(F.col(f"`{c}`") for c in ranked.columns), name)


def survivors(df: DataFrame, objectives: Mapping[str, str], n: int, trial: str = "trial_id") -> DataFrame:
    """The first ``n`` rows by rank, then by crowding (the loneliest first), then by ``trial``, numbered in ``place``."""
    crowded = crowding_distances(nondominated_ranks(df, objectives), objectives, trial)
    order = {"rank": F.col("rank"), "crowding": -F.col("crowding"), "trial": F.col(trial)}
    return numbered(crowded, order, "place").where(F.col("place") < n)


#: How closely children keep to their parents, and how far mutation goes: the larger the closer.
CROSSOVER_ETA, MUTATION_ETA = 15.0, 20.0


def crossed(a: Column, b: Column, u: Column, eta: float = CROSSOVER_ETA) -> Column:
    """One child of simulated binary crossover of two unit values, for a uniform ``u``, within [0, 1)."""
    spread = F.when(u <= 0.5, F.pow(2 * u, F.lit(1 / (eta + 1)))).otherwise(F.pow(1 / (2 * (1 - u)), F.lit(1 / (eta + 1))))
    return ((1 + spread) * a + (1 - spread) * b) / 2


def mutated(x: Column, u: Column, eta: float = MUTATION_ETA) -> Column:
    """A unit value moved by polynomial mutation, for a uniform ``u``."""
    down = F.pow(2 * u, F.lit(1 / (eta + 1))) - 1
    up = 1 - F.pow(2 * (1 - u), F.lit(1 / (eta + 1)))
    return x + F.when(u < 0.5, down).otherwise(up)


def offspring(spark: SparkSession, space: Space, parents: DataFrame, n: int, seed: int, crossover: float = 0.9, mutation: float | None = None) -> DataFrame:
    """(row_index, unit columns) of ``n`` children of ``parents`` (as ``survivors`` gives them, with the space's columns).

    Both parents win a tournament of two: of two places drawn at random the smaller one. Whatever is drawn is a hash of the
    seed, the child and what it is for, so a generation is the same whenever it is made.
    """
    dims = space.sampled
    size = parents.count()
    if not size:
        raise PlanError("a generation needs parents")
    mutation = 1 / max(1, len(dims)) if mutation is None else mutation
    draw = lambda *what: designs.hash_unit(F.lit(seed), *(F.lit(w) for w in what), F.col("row_index"))
    place = lambda side, k: F.floor(draw("place", side, k) * size)
    children = spark.range(n).select(F.col("id").alias("row_index"))
    children = children.select("row_index", *(F.least(place(s, 0), place(s, 1)).alias(f"__{s}") for s in "ab"))
    known = parents.select("place", *(p.to_unit(named(p.column)).alias(f"__u{j}") for j, p in enumerate(dims)))
    for side in "ab":
        own = known.select(F.col("place").alias(f"__p{side}"), *(F.col(f"__u{j}").alias(f"__{side}{j}") for j in range(len(dims))))
        children = children.join(own, F.col(f"__{side}") == F.col(f"__p{side}"))
    columns = []
    for j, p in enumerate(dims):
        # a conditional parameter that one parent doesn't have comes from the other, or at random
        a, b = (F.coalesce(F.col(f"__{x}{j}"), F.col(f"__{y}{j}"), draw("lost", j)) for x, y in ("ab", "ba"))
        blend = (draw("cross", 0) < crossover) & (draw("either", j) < 0.5)
        child = F.when(blend, crossed(a, b, draw("spread", j))).otherwise(a)
        child = F.when(draw("mutate", j) < mutation, mutated(child, draw("move", j))).otherwise(child)
        columns.append(F.least(F.greatest(child, F.lit(0.0)), F.lit(1 - 2.0**-53)).alias(unit_column(p)))
    return children.select("row_index", *columns)


def next_generation(spark: SparkSession, space: Space, request: designs.Request, history: DataFrame | None, objectives: Mapping[str, str], trial: str = "trial_id", spare: int = 4) -> DataFrame:
    """Ask/tell by non-dominated sorting: ``request.n`` trials bred from the best ``request.n`` rows of ``history``.

    Without a history the design is random. ``spare`` children are made for each trial, for those that fail a constraint.
    """
    told = _known(history, objectives) if history is not None else None
    if told is None or told.isEmpty():
        return designs.propose(spark, space, request)
    parents = materialize(survivors(told, objectives, request.n, trial), "parents")
    n = request.n * (spare if space.constraints else 1)
    units = materialize(offspring(spark, space, parents, n, request.seed), "children")
    discard(parents)
    return designs.trials(units, space, request, "nsga2", n)
