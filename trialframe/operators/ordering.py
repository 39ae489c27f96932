"""Global row numbers and running sums that no single task computes.

A sample of the distinct keys cuts the order into chunks of about ``every`` rows. A row finds its chunk
among the sorted cuts by itself, chunks are summed with partial aggregation, and windows run within chunks,
behind what the chunks before them add up to. Rows equal in all keys share a chunk.
"""

from __future__ import annotations

from collections.abc import Mapping
from itertools import accumulate
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVERY = 65_536
#: Cuts at most; beyond EVERY times as many rows, chunks grow.
MOST_CUTS = 250_000


def _key(order: Mapping[str, Column]) -> Column:
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order.values())))


def chunk_of(df: DataFrame, order: Mapping[str, Column], every: int = EVERY, seed: int = 0) -> tuple[Column, int]:
    """The number of a row's chunk, ascending in the columns of ``order`` (nulls first), and how many chunks there are.

    Every chunk but perhaps the first holds a row. The cuts are a hash sample of the distinct keys, so they are the same
    whenever the rows are; at most about ``MOST_CUTS`` of them reach the driver, and the tasks, as nested arrays.
    """
    rows = df.count()
    if rows <= every:
        return F.lit(0).cast("long"), 1
    step = max(every, rows // MOST_CUTS)
    keys = df.select(_key(order).alias("key"))
    sample = keys.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(step)) == 0).distinct().orderBy("key")
    cuts = [r.key for r in sample.select(F.to_json("key").alias("key")).collect()]
    if not cuts:
        return F.lit(0).cast("long"), 1
    block = isqrt(len(cuts)) + 1
    kind = keys.schema["key"].dataType
    shape = T.ArrayType(T.StructType([T.StructField("at", kind), T.StructField("cuts", T.ArrayType(kind))]))
    blocks = (f'{{"at":{cuts[i]},"cuts":[{",".join(cuts[i : i + block])}]}}' for i in range(0, len(cuts), block))
    table = F.from_json(F.lit(f"[{','.join(blocks)}]"), shape)  # folded to a literal
    key = _key(order)
    at = F.size(F.filter(table, lambda b: b["at"] <= key))
    inside = F.size(F.filter(F.element_at(table, F.greatest(at, F.lit(1)))["cuts"], lambda c: c <= key))
    return F.when(at == 0, 0).otherwise((at - 1) * block + inside).cast("long"), len(cuts) + 1


def running(df: DataFrame, order: Mapping[str, Column], sums: Mapping[str, Column], every: int = EVERY) -> DataFrame:
    """``df`` with the sums of each of ``sums`` over the rows before a row in ``order``; ties are put in any order."""
    chunk, chunks = chunk_of(df, order, every)
    rows = df.withColumn("__chunk", chunk)
    window = Window.partitionBy("__chunk").orderBy(*(c.asc_nulls_first() for c in order.values()))
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    start: dict[str, Column] = {name: F.lit(0) for name in sums}
    if chunks > 1:
        per = rows.groupBy("__chunk").agg(*(F.sum(c).alias(name) for name, c in sums.items())).orderBy("__chunk").collect()
        zero = {name: next((type(r[name])(0) for r in per if r[name] is not None), None) for name in sums}
        totals = [list(accumulate((zero[name] if r[name] is None else r[name] for r in per), initial=zero[name])) for name in sums]
        kinds = [df.select(F.sum(c).alias(name)).schema[name].dataType for name, c in sums.items()]
        shape = T.StructType([T.StructField("__at", T.LongType()), *(T.StructField(f"__from_{k}", kind) for k, kind in enumerate(kinds))])
        offsets = df.sparkSession.createDataFrame([(r["__chunk"], *(t[i] for t in totals)) for i, r in enumerate(per)], shape)
        rows = rows.join(F.broadcast(offsets), F.col("__chunk") == F.col("__at"))  # MOST_CUTS rows at most
        start = {name: F.coalesce(F.col(f"__from_{k}"), F.lit(0)) for k, name in enumerate(sums)}
    added = {name: start[name] + F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in sums.items()}
    keep = [c for c in df.columns if c not in added]
    return rows.select(*(F.col(f"`{c}`") for c in keep), *(c.alias(name) for name, c in added.items()))


def numbered(df: DataFrame, order: Mapping[str, Column], name: str, every: int = EVERY) -> DataFrame:
    """``df`` with the number of each row, from 0, in ``order``."""
    return running(df, order, {name: F.lit(1).cast("long")}, every)


def neighbours(df: DataFrame, order: Mapping[str, Column], values: Mapping[str, Column], every: int = EVERY) -> DataFrame:
    """``df`` with ``<name>_before`` and ``<name>_after``: what each of ``values`` is in the rows before and behind a row in ``order``.

    Windows run within chunks; only the first and last row of each chunk meet their neighbours in other ones. Rows equal in
    all keys come in any order, so give keys that tell rows apart.
    """
    chunk, chunks = chunk_of(df, order, every)
    rows = df.withColumn("__chunk", chunk)
    window = Window.partitionBy("__chunk").orderBy(*(c.asc_nulls_first() for c in order.values()))
    whole = F.struct(*(c.alias(name) for name, c in values.items()))
    sides = {"before": F.lag(whole).over(window), "after": F.lead(whole).over(window)}
    if chunks > 1:
        ends = rows.groupBy("__chunk").agg(F.max_by(whole, _key(order)).alias("last"), F.min_by(whole, _key(order)).alias("first"))
        place = Window.orderBy("__chunk")  # a row for each chunk, MOST_CUTS at most
        ends = ends.select(F.col("__chunk").alias("__at"), F.lag("last").over(place).alias("__last"), F.lead("first").over(place).alias("__first"))
        rows = rows.join(F.broadcast(ends), F.col("__chunk") == F.col("__at"))
        sides = {"before": F.coalesce(sides["before"], F.col("__last")), "after": F.coalesce(sides["after"], F.col("__first"))}
    out = rows.select(*(F.col(f"`{c}`") for c in df.columns), *(c.alias(f"__{side}") for side, c in sides.items()))
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *(F.col(f"__{side}.{name}").alias(f"{name}_{side}") for side in sides for name in values))
