from __future__ import annotations

import random
from itertools import combinations

import pytest

from tests.llm import brute
from trialframe.llm import simhash
from trialframe.llm.components import components


def _texts(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocab, k=r.choice([5, 40, 200]))) for _ in range(40)]
    near = []
    for t in base[:10]:
        for _ in range(8):
            w = t.split()
            w[r.randrange(len(w))] = "edited"
            near.append(" ".join(w))
    odd = [None, "", " \t\n", "one", "One two", "ONE  TWO", "a\x0bb\x0cc d", "x " * 30000, "é É ß", "a b c d", "z" * 50000]
    return base + near + base[:5] + [base[0]] * 40 + odd


def test_position_sets_cover_every_three_differences():
    assert len(simhash.POSITION_SETS) == 14
    for lost in combinations(range(8), 3):
        assert any(not set(lost) & set(s) for s in simhash.POSITION_SETS)


def test_against_brute_force(spark):
    texts = _texts()
    got = {r.id: r for r in simhash.simhash_dedup(brute.documents(spark, texts).repartition(3)).collect()}
    fps = {i: brute.simhash(t) for i, t in enumerate(texts)}
    assert {i: r.fp % 2**64 for i, r in got.items()} == fps
    links = [(a, b) for a, b in combinations(fps, 2) if (fps[a] ^ fps[b]).bit_count() <= 3]
    assert {i: r.component for i, r in got.items()} == brute.components(fps, links)


@pytest.mark.parametrize("longest,block,broadcast", [(8192, 2048, 200_000), (300, 100, 200_000), (300, 100, 0)])
def test_long_lists_go_by_blocks(spark, monkeypatch, longest, block, broadcast):
    for name, value in (("LONG_LIST", longest), ("BLOCK", block), ("BROADCAST_ROWS", broadcast)):
        monkeypatch.setattr(simhash, name, value)
    r = random.Random(5)
    values = {0} | {sum(1 << b for b in r.sample(range(20), r.randint(0, 6))) for _ in range(3000)}
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(sorted(values))], "id long, fp long")
    got = {r.fp: r.component for r in simhash.near_classes(rows).collect()}
    ids = {v: i for i, v in enumerate(sorted(values))}
    links = [(ids[a], ids[b]) for a, b in combinations(sorted(values), 2) if (a ^ b).bit_count() <= 3]
    want = brute.components(ids.values(), links)
    assert got == {v: want[i] for v, i in ids.items()}


def test_nulls_and_repeated_ids(spark):
    rows = [(None, "a b c"), (4, "a b c"), (None, "zz"), (7, "q r s"), (7, "never like it at all"), (None, "q r s")]
    got = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.id or 0, r.fp, r.component) for r in got) == sorted((i or 0, simhash.fingerprint(t.encode()), {"a b c": 4, "zz": None}.get(t, 7)) for i, t in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_dedup(empty).count() == 0


def test_components_of_a_path_and_a_star(spark):
    n = 300
    path = [(i, i + 1) for i in range(n)] + [(7, 7), (3, 2)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(n + 1)} | {1000 + i: 1000 for i in range(200)}


def test_components_go_on_from_known_ones(spark):
    first = [(1, 2), (2, 3), (10, 11), (20, 21), (30, 31)]
    more = [(3, 11), (11, 2), (21, 40), (40, 41), (50, 51), (31, 30), (7, 7), (None, 1), (60, None)]
    frame = lambda rows: spark.createDataFrame(rows, "a long, b long")
    known = components(frame(first))
    got = {r.node: r.root for r in components(frame(more), known).collect()}
    assert got == {r.node: r.root for r in components(frame(first + more)).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 1, 11: 1, 20: 20, 21: 20, 30: 30, 31: 30, 40: 20, 41: 20, 50: 50, 51: 50}
    assert components(frame([(1, 3), (5, 5)]), known) is known
