"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one representative a group.

The vectors of a label and length are one cell at first. Every cell of more than ``BLOCK`` vectors is split
by centroids that are fitted on a bounded sample of its unit vectors; so are those that come of it, until no
cell is larger or splitting no longer helps. So the number of cells grows with the rows, and no fit and no
assignment holds more than a few thousand vectors. A vector has a home among the cells that its cell is split
into, and also goes to every one whose border is within half the chord sqrt(2-2c) of it: vectors at cosine c
or more are no further apart than the chord, so of two on different sides of a border one is within half of
it. Two linked vectors that are in one cell are thus in one cell again after the split, and no link is lost.

Cells that stay larger than ``BLOCK`` are compared as pairs of blocks, each in its own task. A pair of vectors
counts in the lowest cell that both are in. A block pair yields link counts per vector and a spanning forest,
never its pairs. Equal vectors are one node with a count.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.llm.components import components, forest
from trialframe.scratch import discard, materialize

#: Vectors that are compared with as many by one task.
BLOCK = 2048
#: Vectors of a cell that its centroids are fitted on, and that are assigned to them by one task, about.
SAMPLE = 4096
#: Cells that one is split into, at most, and vectors that each is meant to have.
FAN, FILL = 64, 1024
#: A split is undone unless it leaves at most this share of the cell's comparisons.
WORTH = 0.5
#: Equal vectors beyond which their rows are joined by broadcast, as one key with that many rows would be one task.
HOT = 4096
BROADCAST_ROWS = 200_000


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def spherical_kmeans(unit: np.ndarray, k: int, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """``k`` unit centroids of the rows of ``unit``; empty cells are drawn anew."""
    rng = np.random.default_rng(seed)
    centres = unit[rng.choice(len(unit), k, replace=False)]
    for _ in range(rounds):
        home = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, unit)
        norms = np.linalg.norm(sums, axis=1)
        lost = norms < 1e-9
        sums[lost] = unit[rng.choice(len(unit), int(lost.sum()))]
        norms[lost] = 1.0
        centres = sums / norms[:, None]
    return centres


def visits(unit: np.ndarray, centres: np.ndarray, reach: float) -> np.ndarray:
    """Which cells each vector is in: its home and those whose border is no further away than ``reach``."""
    near = unit @ centres.T
    home = np.argmax(near, axis=1)
    gaps = np.maximum(np.linalg.norm(centres[:, None] - centres[None], axis=2), 1e-9)
    margin = (near[np.arange(len(unit)), home][:, None] - near) / gaps[home]
    inside = margin <= reach + 1e-9
    inside[np.arange(len(unit)), home] = True
    return inside


def _fit(fan: int, fill: int):
    """Centroids of a cell's sample, in the order of its nodes."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        unit = np.stack(rows["unit"].to_numpy())
        k = min(fan, max(2, math.ceil(int(rows["size"].iloc[0]) / fill)), len(unit))
        return rows.iloc[[0]][["label", "dim", "cell"]].assign(centres=[spherical_kmeans(unit, k).tobytes()])

    return scan


def _assign(reach: float):
    def scan(rows: pd.DataFrame, centres: pd.DataFrame) -> pd.DataFrame:
        if not len(rows):
            return pd.DataFrame({"node": [], "child": []})
        unit = np.stack(rows["unit"].to_numpy())
        found = np.frombuffer(centres["centres"].iloc[0]).reshape(-1, unit.shape[1])
        at, child = np.nonzero(visits(unit, found, reach))
        return rows.iloc[at].assign(child=child.astype(np.int64))[["label", "dim", "cell", "node", "unit", "child"]]

    return scan


def earlier_cells(cells: list, cell: int) -> np.ndarray:
    """Bits for the cells below ``cell`` that two or more of the vectors are in, as words per vector."""
    owner = np.repeat(np.arange(len(cells)), [len(c) if c is not None else 0 for c in cells])
    lists = [np.asarray(c, np.int64) for c in cells if c is not None]
    value = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    owner, value = owner[value < cell], value[value < cell]
    _, place, counts = np.unique(value, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    some = counts[place] > 1 if len(place) else np.zeros(0, bool)
    owner, bit = owner[some], number[place[some]] if len(place) else np.zeros(0, np.int64)
    out = np.zeros((len(cells), max(1, -(-int((counts > 1).sum()) // 64))), np.uint64)
    np.bitwise_or.at(out, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    return out


def _compare(cosine: float):
    """One pair of blocks of a cell: link counts and spanning edges."""

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        a, b = (np.flatnonzero(rows["block"].to_numpy() == rows[side].iloc[0]) for side in ("left", "right"))
        node, n = rows["node"].to_numpy(), rows["n"].to_numpy()
        unit = np.stack(rows["unit"].to_numpy())
        earlier = earlier_cells(list(rows["cells"]), int(rows["cell"].iloc[0]))
        linked = np.zeros((len(rows), len(rows)), bool)
        for at in range(0, len(a), 256):
            part = a[at : at + 256]
            i, j = np.nonzero(unit[part] @ unit[b].T >= cosine)
            i, j = part[i], b[j]
            own = (i != j) & ~(earlier[i] & earlier[j]).any(axis=1)
            linked[i[own], j[own]] = linked[j[own], i[own]] = True
        counts = linked @ n
        edges = np.array(forest(linked), np.int64).reshape(-1, 2)
        out = pd.DataFrame({"node": node, "links": counts, "other": np.int64(-1), "edge": False})[counts > 0]
        tree = pd.DataFrame({"node": node[edges[:, 0]], "links": np.int64(0), "other": node[edges[:, 1]], "edge": True})
        return pd.concat([out, tree])

    return scan


def cells_of(nodes: DataFrame, reach: float) -> DataFrame:
    """(label, dim, cell, node, unit) of ``nodes(label, dim, node, unit)``: every vector in each of its cells."""
    key = ["label", "dim", "cell"]
    kind = nodes.schema["label"].dataType.simpleString()
    now = nodes.select("label", "dim", F.lit(0).cast("long").alias("cell"), "node", "unit")
    ready: list[DataFrame] = []
    turn = 0
    while True:
        sizes = materialize(now.groupBy(*key).agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "crowded")
        if sizes.isEmpty():
            discard(sizes)
            return reduce(DataFrame.unionByName, [*ready, now])
        sizes = _small(sizes)
        ready.append(now.join(sizes, key, "left_anti"))
        crowded = now.join(sizes, key)
        share = F.least(F.lit(1.0), SAMPLE / F.col("size")) * 1_000_000
        sample = crowded.where(F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1_000_000)) < share)
        centres = sample.groupBy(*key).applyInPandas(_fit(FAN, FILL), f"label {kind}, dim int, cell long, centres binary")
        centres = materialize(centres, "centres")
        tasks = F.ceil(F.col("size") / SAMPLE)
        dealt = crowded.withColumn("task", F.pmod(F.xxhash64("node", F.lit("task")), tasks)).drop("size")
        copies = centres.join(sizes, key).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), tasks - 1))).drop("size")
        split = dealt.groupBy(*key, "task").cogroup(copies.groupBy(*key, "task")).applyInPandas(_assign(reach), f"label {kind}, dim int, cell long, node long, unit array<double>, child long")
        split = materialize(split, "split")
        squares = F.sum(F.col("n").cast("double") * F.col("n")).alias("after")
        grown = split.groupBy(*key, "child").agg(F.count("*").alias("n")).groupBy(*key).agg(squares)
        helps = F.col("after") <= WORTH * F.col("size").cast("double") * F.col("size")
        helped = materialize(grown.join(sizes, key).where(helps).select(*key), "helped")
        undone = materialize(sizes.select(*key).join(helped, key, "left_anti"), "undone")
        ready.append(now.join(_small(undone), key, "left_semi"))
        child = F.xxhash64("cell", "child", F.lit(turn)).alias("cell")
        now = split.join(_small(helped), key, "left_semi").select("label", "dim", child, "node", "unit")
        turn += 1


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.98
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``.

    Only vectors of equal, non-null labels are compared, in double precision. Vectors that are null,
    empty, zero, or hold null or non-finite components link with nothing, and vectors of different
    lengths do not link. Equal vectors link with each other; finite ones of any magnitude do. Rows that
    repeat an id are rows of their own. A null id counts as a link and names no group: a component is null
    only where all its ids are, and then each of its rows is kept. An empty table gives no rows.
    Other columns are not read and may have any names.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double") + F.lit(0.0))  # no negative zeros
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    fine = F.col("label").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    largest = F.when(fine, F.array_max(F.transform("v", lambda x: F.abs(x))))
    rows = rows.withColumn("largest", largest).withColumn("ok", F.coalesce(F.col("largest") > 0, F.lit(False)))
    rows = rows.withColumn("key", F.when(F.col("ok"), F.struct(F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))))
    scaled = F.transform("v", lambda x: x / F.col("largest"))  # no square of these over- or underflows altogether
    norm = F.sqrt(F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.where("ok").withColumn("scaled", scaled).withColumn("norm", norm).withColumn("unit", F.transform("scaled", lambda x: x / F.col("norm")))
    nodes = unit.groupBy("label", "key").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("unit").alias("unit"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "label", "key", "least", "n", F.size("unit").alias("dim"), "unit")
    nodes = materialize(nodes, "nodes")
    placed = materialize(cells_of(nodes.select("label", "dim", "node", "unit"), math.sqrt(2 - 2 * cosine) / 2), "cells")
    several = placed.groupBy("node").agg(F.sort_array(F.collect_list("cell")).alias("cells")).where(F.size("cells") > 1)
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = placed.join(sizes, key).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.join(several, "node", "left").join(nodes.select("node", "n"), "node")
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: F.struct(F.least(b, F.col("block")).alias("left"), F.greatest(b, F.col("block")).alias("right")))
    dealt = dealt.withColumn("pair", F.explode(pairs)).select(*key, "pair.left", "pair.right", "block", "node", "n", "cells", "unit")
    found = dealt.groupBy(*key, "left", "right").applyInPandas(_compare(cosine), "node long, links long, other long, edge boolean")
    found = materialize(found, "links")
    discard(placed)
    links = found.where("not edge").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.where("edge").select(F.col("node").alias("a"), F.col("other").alias("b")))
    classes = nodes.drop("unit", "dim").join(links, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    classes = classes.join(classes.groupBy("root").agg(F.min("least").alias("component")), "root")
    classes = materialize(classes.select("label", "key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), "component"), "classes")
    out = rows.select("vec_id", "label", "ok", "key")
    for k, part in enumerate((_small(classes.where(F.col("n") > HOT)), classes.where(F.col("n") <= HOT))):
        part = part.select(F.col("label").alias(f"l{k}"), F.col("key").alias(f"k{k}"), F.col("links").alias(f"links{k}"), F.col("component").alias(f"component{k}"))
        out = out.join(part, (F.col("label") == F.col(f"l{k}")) & (F.col("key") == F.col(f"k{k}")), "left").drop(f"k{k}")
        # what has found its class, or has none, must not meet in one task of the next join
        out = out.withColumn("key", F.when(F.col(f"l{k}").isNull() & F.col("ok"), F.col("key")).otherwise(F.struct(F.monotonically_increasing_id().alias("a"), F.lit(-1).cast("long").alias("b"))))
    component = F.when(F.col("l0").isNotNull(), F.col("component0")).when(F.col("l1").isNotNull(), F.col("component1")).otherwise(F.col("vec_id"))
    out = out.select("vec_id", F.coalesce("links0", "links1", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
