"""Reductions and array operations of dataflow blocks, as columns and aggregations."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_or_zero(values: Column) -> Column:
    """Mean of an array; 0 of an empty one."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.greatest(F.size(values), F.lit(1))


def scaled(values: Column, factor: float) -> Column:
    return F.transform(values, lambda x: x * F.lit(factor))


def fan_in(df: DataFrame, keys: list[str], index: str, lists: list[str] = (), scalars: list[str] = ()) -> DataFrame:
    """Partition outputs of each key put back in partition order: lists are concatenated, scalars become lists."""
    rows = F.array_sort(F.collect_list(F.struct(index, *lists, *scalars)))
    out = df.groupBy(*keys).agg(rows.alias("__rows"))
    every = lambda c: F.transform("__rows", lambda r: r[c])
    return out.select(*keys, *(F.flatten(every(c)).alias(c) for c in lists), *(every(c).alias(c) for c in scalars))


def fan_out(df: DataFrame, field: str, parallelism: int | None = None) -> DataFrame:
    """A row per item of a list field, numbered as ``partition_id`` (eight digits); other fields are copied."""
    others = [c for c in df.columns if c != field]
    out = df.select(*others, F.posexplode(field).alias("__i", "__item"))
    out = out.select(*others, F.array("__item").alias(field), F.lpad(F.col("__i").cast("string"), 8, "0").alias("partition_id"))
    return out.repartition(parallelism) if parallelism else out


#: Groups whose moments are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000


def standardize(df: DataFrame, column: str, keys: list[str] = (), name: str = "z") -> DataFrame:
    """(x - mean) / population deviation, by key, null where that is 0: moments are summed within tasks first, then joined to the rows."""
    mean, deviation = F.avg(column), F.stddev_pop(column)
    if not keys:
        one = df.agg(mean.alias("m"), deviation.alias("d")).first()
        return df.withColumn(name, F.try_divide(F.col(column) - F.lit(one.m).cast("double"), F.lit(one.d).cast("double")))
    moments = df.groupBy(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys))).agg(mean.alias("__m"), deviation.alias("__d"))
    moments = F.broadcast(moments) if moments.count() <= BROADCAST_ROWS else moments
    same = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)]
    out = df.join(moments, same).withColumn(name, F.try_divide(F.col(column) - F.col("__m"), F.col("__d")))
    return out.drop("__m", "__d", *(f"__k{i}" for i in range(len(keys))))


def centred(values: Column) -> Column:
    """An array less its mean."""
    return F.transform(values, lambda x: x - mean_or_zero(values))


def line_fit(df: DataFrame, x: str, y: str, keys: list[str] = ()) -> DataFrame:
    """Least-squares slope, intercept and mean squared error in one pass over sums."""
    n, sxy = F.regr_count(y, x), F.regr_sxy(y, x)
    out = df.groupBy(*keys).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_syy(y, x).alias("syy"), sxy.alias("sxy"), n.alias("n"))
    return out.withColumn("mse", (F.col("syy") - F.col("slope") * F.col("sxy")) / F.col("n")).drop("syy", "sxy", "n")


def rates(df: DataFrame, value: str, limit: float, keys: list[str] = ()) -> DataFrame:
    """Mean, population deviation and share of values up to a limit."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.avg((F.col(value) <= limit).cast("double")).alias("rate"))


def profile(df: DataFrame, bin_: Column, weight: str, least_bins: int = 0) -> DataFrame:
    """Mean weight per bin; bins below ``least_bins`` that no row is in have 0."""
    out = df.groupBy(bin_.alias("bin")).agg((F.sum(weight) / F.greatest(F.count("*"), F.lit(1))).alias("profile"))
    if not least_bins:
        return out
    every = df.sparkSession.range(least_bins).select(F.col("id").cast(out.schema["bin"].dataType).alias("bin"))
    return out.join(every, "bin", "full").withColumn("profile", F.coalesce("profile", F.lit(0.0)))


def nearest_error(candidates: Column, truth: Column) -> Column:
    return F.array_min(F.transform(candidates, lambda x: F.abs(x - truth)))


def distinct_sorted(values: Column, limit: int, digits: int = 4) -> Column:
    """The first distinct rounded finite values in order."""
    finite = F.filter(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.slice(F.array_sort(F.array_distinct(F.transform(finite, lambda x: F.bround(x, digits)))), 1, limit)


def argmax(values: Column, first: int = 0, last: int | None = None) -> Column:
    """Position (from 0) of the first maximum among the places ``first`` to ``last``, all by default."""
    part = _places(values, first, last)
    return F.array_position(part, F.array_max(part)) - 1 + first


def second_argmax(values: Column, first: int = 0, last: int | None = None, after: int = 3) -> Column:
    """Position of the maximum among the same places without the first one and the ``after`` places behind it."""
    part = _places(values, first, last)
    top = F.array_position(part, F.array_max(part)) - 1
    rest = F.transform(part, lambda x, i: F.when((i < top) | (i > top + after), x))
    return F.array_position(rest, F.array_max(rest)) - 1 + first


def _places(values: Column, first: int, last: int | None) -> Column:
    return values if last is None and not first else F.slice(values, first + 1, (F.size(values) if last is None else F.lit(last + 1)) - first)


def translated(points: Column, x: float = 1.0, y: float = -1.0) -> Column:
    """Points (structs of x and y) moved by an offset."""
    return F.transform(points, lambda p: F.struct((p["x"] + x).alias("x"), (p["y"] + y).alias("y")))


def reduced(df: DataFrame, keys: list[str], index: str, start: Column, step: Callable[[Column, Column], Column], value: str, name: str) -> DataFrame:
    """A reducer behind a mapped block: values of each key folded in partition order."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(index).alias("at"), F.col(value).alias("v"))))
    folded = F.aggregate(F.col("__rows"), start, lambda state, row: step(state, row["v"]))
    return df.groupBy(*keys).agg(rows.alias("__rows")).select(*keys, folded.alias(name))


@dataclass(frozen=True)
class Reducer:
    """A reducer whose states can be merged: ``zero``, ``step(state, value)``, ``merge(earlier, later)``, ``finish(state)``.

    ``merge`` has to be associative, with ``zero`` as its neutral element, and may depend on the order.
    """

    zero: Column
    step: Callable[[Column, Column], Column]
    merge: Callable[[Column, Column], Column]
    finish: Callable[[Column], Column] = lambda state: state


#: Rows that are folded into one state at a time, and states that are merged into one.
FOLD_ROWS, FOLD_STATES = 1024, 64


def tree_reduced(df: DataFrame, keys: list[str], index: str, reducer: Reducer, value: str, name: str, rows: int = FOLD_ROWS, states: int = FOLD_STATES) -> DataFrame:
    """The values of each key reduced in the order of ``index`` (nulls first, ties by value), as a tree.

    One shuffle deals ranges of keys and index to tasks, which sort them; at most ``rows`` neighbours of a key in a task become
    a state, then at most ``states`` neighbouring states another one, until each key has one. So no task holds a key's
    values, however many there are, and where the ranges are cut makes no difference.
    """
    order = [*(F.col(k) for k in keys), F.col(index), F.col(value)]
    placed = df.select(*keys, index, value).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    task, place = F.shiftright("__at", 33).alias("__task"), F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    cells = F.array_sort(F.collect_list(F.struct(F.col("__at").alias("at"), F.col(value).alias("v"))))
    folded = F.aggregate("__cells", reducer.zero, lambda state, cell: reducer.step(state, cell["v"]))
    out = placed.groupBy(*keys, task, F.floor(place / rows).alias("__part")).agg(cells.alias("__cells")).select(*keys, "__task", "__part", folded.alias("__state"))

    def merged_by(out: DataFrame, at: str, *groups: Column) -> DataFrame:
        cells = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("__state").alias("v"))))
        whole = F.aggregate("__cells", reducer.zero, lambda state, cell: reducer.merge(state, cell["v"]))
        return out.groupBy(*keys, *groups).agg(cells.alias("__cells")).withColumn("__state", whole).drop("__cells")

    parts, tasks = -(-df.count() // rows), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1:
        parts = -(-parts // states)
        out = merged_by(out, "__part", F.col("__task"), F.floor(F.col("__part") / states).alias("__part"))
    while tasks > states:
        tasks = -(-tasks // states)
        out = merged_by(out, "__task", F.floor(F.col("__task") / states).alias("__task"))
    return merged_by(out, "__task").select(*keys, reducer.finish(F.col("__state")).alias(name))


def longest_run() -> Reducer:
    """The length of the longest stretch of values that never fall: a state keeps its ends, the stretches there, and the best one."""
    none = F.lit(None).cast("double")
    count = lambda n: F.lit(n).cast("long")
    zero = F.struct(none.alias("first"), none.alias("last"), count(0).alias("head"), count(0).alias("tail"), count(0).alias("best"), count(0).alias("n"))

    def merge(a: Column, b: Column) -> Column:
        joins = a["last"] <= b["first"]
        head = F.when(joins & (a["head"] == a["n"]), a["n"] + b["head"]).otherwise(a["head"])
        tail = F.when(joins & (b["tail"] == b["n"]), b["n"] + a["tail"]).otherwise(b["tail"])
        across = F.when(joins, a["tail"] + b["head"]).otherwise(count(0))
        both = F.struct(a["first"].alias("first"), b["last"].alias("last"), head.alias("head"), tail.alias("tail"), F.greatest(a["best"], b["best"], across).alias("best"), (a["n"] + b["n"]).alias("n"))
        return F.when(a["n"] == 0, b).when(b["n"] == 0, a).otherwise(both)

    def step(state: Column, value: Column) -> Column:
        v = value.cast("double")
        one = F.struct(v.alias("first"), v.alias("last"), count(1).alias("head"), count(1).alias("tail"), count(1).alias("best"), count(1).alias("n"))
        return F.when(v.isNull(), state).otherwise(merge(state, one))

    return Reducer(zero, step, merge, lambda state: state["best"])


def merged(left: Column, right: Column) -> Column:
    """Maps merged, the right one's values winning."""
    return F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)


def flatten_json(df: DataFrame, column: str, schema: str, cut: int = 500) -> DataFrame:
    """A JSON column's leaves as columns with dotted names, their texts cut."""
    from pyspark.sql import types as T

    def leaves(t: T.StructType, at: Column, path: str):
        for f in t:
            name = f"{path}.{f.name}" if path else f.name
            if isinstance(f.dataType, T.StructType):
                yield from leaves(f.dataType, at[f.name], name)
            else:
                yield F.substring(at[f.name].cast("string"), 1, cut).alias(name)

    t = T.StructType.fromDDL(schema)
    others = [c for c in df.columns if c != column]
    return df.withColumn("__j", F.from_json(column, t)).select(*others, *leaves(t, F.col("__j"), ""))
