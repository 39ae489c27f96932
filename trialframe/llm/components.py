"""Connected components of a distributed edge list.

Every round draws a random order of the nodes. Each node hooks onto its first neighbour in that
order if that comes before itself, parents are followed twice, and the edges are relabelled with
what they reach; edges inside one label vanish. Chains that descend in a random order are short,
so the nodes that still have edges shrink by a constant factor a round, for paths and stars
alike. Before a round, each task replaces the edges it reads, ``AT_ONCE`` at a time, by stars that
join the same nodes, around the first one in the order. Only narrow tables are moved. At the end each component is named by its smallest node.
Edges that come later are first relabelled with the components known so far, so that only what they
join is gone over again: each statement and stage also leaves its record in the driver's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialframe.scratch import discard, materialize


#: Edges that a task makes stars of at once.
AT_ONCE = 1 << 18


def _starred(a: np.ndarray, b: np.ndarray, ha: np.ndarray, hb: np.ndarray) -> pa.RecordBatch:
    """Stars that join the same nodes as the edges (a, b), each around its first node by (hash, node)."""
    nodes, first, at = np.unique(np.r_[a, b], return_index=True, return_inverse=True)
    order = np.lexsort((nodes, np.r_[ha, hb][first]))
    rank = np.argsort(order)[at]
    x, y, top = rank[: len(a)], rank[len(a) :], np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(top[x], top[y]), np.maximum(top[x], top[y])
        np.minimum.at(top, high, low)
        while (top[top] != top).any():
            top = top[top]
        apart = top[x] != top[y]
        x, y = x[apart], y[apart]
    leaf = np.flatnonzero(top != np.arange(len(top)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[order[top[leaf]]]), pa.array(nodes[order[leaf]])], names=["a", "b"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    for batch in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
        if sum(len(c[0]) for c in held) >= AT_ONCE:
            yield _starred(*map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        yield _starred(*map(np.concatenate, zip(*held, strict=True)))


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, root) for every node of ``edges(a long, b long)``; root is the smallest reachable node.

    Loops, repeated and reversed edges are allowed, null ends are ignored, and no edges give no rows.
    ``known`` is what this function gave for other edges; the rows are then those for both. It is given back as
    it is where ``edges`` join nothing, and is never discarded here.
    """
    if known is not None:
        for c in "ab":
            edges = edges.join(known.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root")), c, "left")
        edges = edges.select(*(F.coalesce(f"{c}_root", c).alias(c) for c in "ab"))
    live = edges.where(F.col("a") != F.col("b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    live = edged = materialize(live, "edges")
    steps: list[DataFrame] = []
    while not live.isEmpty():
        turn = F.lit(len(steps))
        live = live.select("a", "b", F.xxhash64("a", turn), F.xxhash64("b", turn)).mapInArrow(_stars, "a long, b long")
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = F.min(F.struct(F.xxhash64("b", turn).alias("h"), F.col("b").alias("id"))).alias("first")
        hook = both.groupBy(F.col("a").alias("node")).agg(first)
        up = F.when(F.col("first.h") < F.xxhash64("node", turn), F.col("first.id")).otherwise(F.col("node"))
        first_hook = hook = materialize(hook.select("node", up.alias("up")), "hooks")
        for _ in range(2):
            above = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            hook = hook.join(above, "up").select("node", F.col("top").alias("up"))
        hook = materialize(hook, "hooks")
        discard(first_hook)
        steps.append(hook)
        a, b = (hook.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up")) for c in "ab")
        live = live.join(a, "a").join(b, "b").where("a_up <> b_up")
        left = materialize(live.select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(), "edges")
        discard(edged)
        live = edged = left
    if not steps:
        discard(edged)
        return edges.sparkSession.createDataFrame([], "node long, root long") if known is None else known
    out = steps[0].select("node", F.col("up").alias("root"))
    for step in steps[1:]:
        nxt = step.select(F.col("node").alias("root"), "up")
        out = out.join(nxt, "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = tops = materialize(out, "tops")
    discard(edged, *steps)
    least = out.groupBy("root").agg(F.min("node").alias("least"))
    out = out.join(least, "root").select("node", F.col("least").alias("root"))
    if known is not None:  # a known root stands for all nodes of its component, itself too
        new = out.select(F.col("node").alias("root"), F.col("root").alias("top"))
        moved = known.join(new, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        out = moved.unionByName(out.join(known.select("node"), "node", "left_anti"))
    out = materialize(out, "roots")
    discard(tops)
    return out


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix; every row is looked at once."""
    left = linked.any(axis=1)
    out: list[tuple[int, int]] = []
    for root in np.flatnonzero(left):
        if not left[root]:
            continue
        front = np.array([root])
        left[root] = False
        while len(front):
            reached = np.flatnonzero(linked[front].any(axis=0) & left)
            left[reached] = False
            out.extend((int(root), int(x)) for x in reached)
            front = reached
    return out
