"""Exact top-k against brute force in Python integers."""

from __future__ import annotations

import math

import numpy as np

from trialframe.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, row string, x int, shard string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "r", 2, "s") for i, v in rows], SCHEMA)


def _brute(rows, k, every):
    known = [(n, i, [math.floor(256 * c) for c in v]) for n, (i, v) in enumerate(rows) if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, i, x in known:
        if i is None or i % every:
            continue
        scores = [(max(-topk.LONG, min(topk.LONG, sum(a * b for a, b in zip(x, y, strict=True)))), j) for m, j, y in known if m != n and len(x) == len(y)]
        best = sorted(scores, key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(i, r + 1, j, s) for r, (s, j) in enumerate(best)]
    return sorted(out, key=str)


def _found(spark, rows, **options):
    return sorted((tuple(r) for r in topk.top_k(_table(spark, rows), **options).collect()), key=str)


def test_clustered_and_repeated_vectors_over_many_shards(spark):
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(12, 24))
    rows = [(i, (centers[i % 12] * draw.uniform(0.2, 1.5) + draw.normal(scale=0.1, size=24)).tolist()) for i in range(2400)]
    rows += [(5000 + i, rows[7][1]) for i in range(1200)]
    assert _found(spark, rows, k=5, every=50, shard_rows=500) == _brute(rows, 5, 50)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (None, [1.0, 2.0]), (50, [0.0, 0.0]), (7, [1.0, None]), (100, [nan, 1.0]), (150, [inf, 1.0]), (200, None)]
    rows += [(250, [1.0, 2.0, 3.0]), (3, [-1.0, 0.5, 0.25]), (300, []), (4, []), (350, [5.0]), (-50, [3e200, -1e200]), (9, [1e30, 1e30])]
    for size in (3, 100):
        assert _found(spark, rows, k=3, every=50, shard_rows=size) == _brute(rows, 3, 50)
    assert _found(spark, [], k=3) == []


def test_a_tree_prunes_and_its_bounds_hold():
    draw = np.random.default_rng(2)
    x = np.floor(256 * (np.repeat(draw.normal(size=(16, 32)), 128, axis=0) + draw.normal(scale=0.05, size=(2048, 32))))
    tree = topk.BallTree(np.arange(2048), np.arange(2048), x)
    q = x[::97]
    bounds = tree.bounds(q)
    scores = q @ tree.x.T
    for node, (low, high) in enumerate(tree.spans):
        assert (scores[:, low:high].max(axis=1) <= bounds[:, node]).all()
    kth = np.sort(scores, axis=1)[:, -6]
    leaves = [n for n, c in enumerate(tree.children) if c is None]
    assert (bounds[:, leaves] >= kth[:, None]).mean() < 0.3
