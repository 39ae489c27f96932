from __future__ import annotations

import numpy as np

from tests.llm import brute
from trialframe.llm import embeddings


def _vectors(seed=0, n=500, d=24):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((n, d))
    near = np.concatenate([base[i] + rng.standard_normal((k, d)) * 0.08 for i, k in ((0, 60), (1, 5), (2, 200))])
    x = np.concatenate([base, near, base[:20], base[:20] * 3.0]).astype(np.float32)
    rows = [(int(i), [float(v) for v in x[i]], int(i % 3) if i < n else int(i % 2)) for i in range(len(x))]
    first = len(rows)
    odd = [None, [], [0.0] * d, [None] + [1.0] * (d - 1), [float("nan")] * d, [float("inf")] + [1.0] * (d - 1), [1.0, 2.0], [2.0, 4.0]]
    rows += [(first + i, v, 0) for i, v in enumerate(odd)]
    rows += [(first + 50, rows[0][1], None), (first + 51, rows[0][1], None)]
    return rows


def _brute(rows):
    links = []
    unit = {}
    for i, v, label in rows:
        if v and label is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(v, float)
            unit.setdefault((label, len(v)), []).append((i, a / np.sqrt((a * a).sum())))
    for own in unit.values():
        m = np.stack([u for _, u in own])
        for a, b in zip(*np.nonzero(m @ m.T >= 0.98), strict=True):
            if a < b:
                links.append((own[a][0], own[b][0]))
    return links


def _check(rows, got):
    links = _brute(rows)
    count = {i: 0 for i, *_ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    want = brute.components(count, links)
    assert len(links) > 1000
    assert {r.vec_id: r.n_links for r in got} == count
    assert {r.vec_id: r.component_id for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_brute_force(spark):
    rows = _vectors()
    _check(rows, embeddings.embedding_dedup(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())


def test_many_cells_and_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 50), ("FILL", 20), ("FAN", 4), ("SAMPLE", 60), ("HOT", 1), ("WORTH", 0.9), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(embeddings, name, value)
    rows = _vectors(1)
    _check(rows, embeddings.embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect())


def test_no_link_is_lost_in_few_dimensions(spark, monkeypatch):
    for name, value in (("BLOCK", 60), ("FILL", 24), ("SAMPLE", 400)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2400, 4)) @ rng.standard_normal((4, 96))  # 100 cells of rank 4 in 96 dimensions
    rows = [(i, [float(v) for v in x[i].astype(np.float32)], 0) for i in range(len(x))]
    _check(rows, embeddings.embedding_dedup(spark.createDataFrame(rows, SCHEMA)).collect())


def test_nothing_to_link(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert embeddings.embedding_dedup(none).count() == 0
    got = embeddings.embedding_dedup(spark.createDataFrame([(4, None, 1), (None, [1.0], None)], SCHEMA)).collect()
    assert {(r.vec_id, r.n_links, r.component_id, r.kept) for r in got} == {(4, 0, 4, True), (None, 0, None, True)}
    twice = embeddings.embedding_dedup(spark.createDataFrame([(7, [1.0, 2.0], 1), (7, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], SCHEMA)).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in twice) == [(0, 2, 7), (7, 2, 7), (7, 2, 7)]


def test_centroids_are_unit_and_distinct():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    c = embeddings.spherical_kmeans(x / np.linalg.norm(x, axis=1)[:, None], 6)
    assert np.allclose(np.linalg.norm(c, axis=1), 1) and len(np.unique(c.round(6), axis=0)) == 6


def test_vectors_of_any_magnitude_and_sign_of_zero(spark):
    rows = [(1, [1e200, 1e200], 0), (2, [1e200, 1e200], 0), (3, [2e200, 2e200], 0), (4, [1e-200, 1e-200], 0), (5, [5e-324, 5e-324], 0), (6, [0.0, 1.0], 0), (7, [-0.0, 1e308], 0)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {i: (4, 1) for i in range(1, 6)} | {6: (1, 6), 7: (1, 6)}


def test_every_vector_meets_its_partners_over_many_cells(spark, monkeypatch):
    for name, value in (("BLOCK", 100), ("FILL", 40), ("SAMPLE", 1000), ("FAN", 16), ("WORTH", 4.0)):
        monkeypatch.setattr(embeddings, name, value)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3000, 32))
    x = np.concatenate([base, base[:1500] + rng.standard_normal((1500, 32)) * 0.1])
    nodes = spark.createDataFrame([(0, 32, i, [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)], "label int, dim int, node long, unit array<double>")
    placed = embeddings.cells_of(nodes, np.sqrt(2 - 2 * 0.98) / 2).select("cell", "node").collect()
    cells = {}
    for r in placed:
        cells.setdefault(r.node, set()).add(r.cell)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    links = [(a, b) for a, b in zip(*np.nonzero(unit @ unit.T >= 0.98), strict=True) if a < b]
    assert len(links) > 500 and len({c for own in cells.values() for c in own}) >= 100
    assert all(cells[a] & cells[b] for a, b in links)


def test_pairs_count_in_their_lowest_cell():
    bits = embeddings.earlier_cells([[1, 2, 9], [2, 9], None, [1, 9], [3]], 9)
    together = (bits[:, None] & bits[None]).any(2)
    assert together[0, 1] and together[0, 3] and not together[1, 3] and not together[2].any() and not together[4].any()
