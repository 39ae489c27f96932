from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from trialframe.llm import mixing


def _targets(sizes, pattern=(3, 1, 2), budget=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: pattern[i % len(pattern)] for i, s in enumerate(names)}
    left, open_, out = budget * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > most * sizes[s]]
        if not over:
            out |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= set(over)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_targets_copies_and_reruns(spark, seed):
    r = random.Random(seed)
    texts = [" ".join(["w"] * int(r.paretovariate(0.9) * 20)) for _ in range(900)] + [None, "", "\t"]
    docs = brute.documents(spark, texts, ["b", "a", "a", "a", "é", None, "Z", "tiny" if seed else "z"])
    sized = docs.withColumn("size", mixing.word_count(F.col("text")))
    rows = mixing.mix(sized, "size").collect()
    assert {(x.doc_id, x.copies) for x in rows} == {(x.doc_id, x.copies) for x in mixing.mix(sized.repartition(5), "size").collect()}
    assert len(rows) == len(texts) and set(rows[0].asDict()) == {*docs.columns, "size", "source_size", "target"}
    sizes = {}
    for x in rows:
        assert x["size"] == len(brute.words(x.text)) and 0 <= x.copies <= 2
        sizes[x.source] = sizes.get(x.source, 0) + x["size"]
    want = _targets(sizes)
    for s in sizes:
        own = [x for x in rows if x.source == s]
        assert {x.source_size for x in own} == {sizes[s]} and own[0].target == pytest.approx(want[s])
        assert abs(sum(x.copies * x["size"] for x in own) - want[s]) <= max(2, 0.002 * want[s])


def test_rank_needs_no_whole_source(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SLICE", 16)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
    docs = spark.range(3000).selectExpr("id doc_id", "case when id % 3 = 0 then 'hot' else concat('s', id % 7) end source", "1 + id % 50 size")
    rows = mixing.mix(docs, "size").collect()
    for s in {x.source for x in rows}:
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.copies * x["size"] for x in own) - own[0].target) <= 25


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_a_long_document_leaves_its_gap_to_later_slices(spark, monkeypatch, broadcast):
    monkeypatch.setattr(mixing, "SLICE", 16)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", broadcast)
    # 20 sources of 400 documents, one of each with 30 % of the words
    docs = spark.range(8000).selectExpr("id doc_id", "concat('s', id % 20) source", "case when id < 20 then 4300 else 1 + id % 50 end size")
    rows = mixing.mix(docs, "size", pattern=(1,), budget=0.5).collect()
    assert len(rows) == 8000
    for s in {x.source for x in rows}:
        own = [x for x in rows if x.source == s]
        assert abs(sum(x.copies * x["size"] for x in own) - own[0].target) <= 25


def test_heavier_documents_are_likelier(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "'s' || (id % 2) source", "10 size", "case when id % 4 < 2 then 0.3D else 1.2D end weight")
    rows = mixing.mix(docs, "size", weight_col="weight", budget=0.5).collect()
    light, heavy = (sum(x.copies for x in rows if x.weight == w) for w in (0.3, 1.2))
    assert heavy > 3 * light > 0 and abs(light + heavy - 2000) <= 2


def test_nothing_to_mix(spark):
    docs = spark.createDataFrame([], "doc_id long, source string, size long")
    assert mixing.mix(docs, "size").count() == 0
    zero = spark.createDataFrame([(1, None, 0), (None, "a", None)], "doc_id long, source string, size long")
    assert {x.copies for x in mixing.mix(zero, "size").collect()} == {0}


def test_alike_rows_are_drawn_one_by_one(spark, tmp_path):
    rows = [(None, "a", 10)] * 1000 + [(5, "b", 20)] * 500 + [(i, "b", 7) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long")
    got = mixing.mix(docs, "size", budget=0.7).collect()
    assert len(got) == len(rows)
    for s in "ab":
        own = [x for x in got if x.source == s]
        assert abs(sum(x.copies * x["size"] for x in own) - own[0].target) <= 10
    again = mixing.mix(docs.repartition(7), "size", budget=0.7).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_the_draw_is_paretos(spark, monkeypatch):
    # equal sizes: exactly the documents of the smallest ranks are taken, but for what is exchanged at the cut
    docs = spark.range(4000).selectExpr("id doc_id", "'s' source", "10 size", "case when id % 2 = 0 then 0.5D else 1.5D end weight")
    got = {x.doc_id: x.copies for x in mixing.mix(docs, "size", weight_col="weight", budget=0.6).collect()}
    draw = spark.range(4000).selectExpr("id", "xxhash64('s', id, 10L, cast(null as long), 7, 0L) u").collect()
    rank = {}
    for x in draw:
        f, u = 0.6 * (0.5, 1.5)[x.id % 2], ((x.u % 2**64 >> 11) + 0.5) / 2**53
        rank[x.id] = u / (1 - u) / (f / (1 - f))
    assert sum(got.values()) == 2400
    assert {i for i, c in got.items() if c} == set(sorted(rank, key=rank.get)[:2400])


def test_exchanges_come_nearer():
    import numpy as np

    size, taken = np.array([50.0, 40, 30, 23, 9]), np.array([True, True, False, False, False])
    after = mixing.exchanged(size, taken, 13.0)
    assert abs(13 - (size[after].sum() - 90)) <= 4
    assert (mixing.exchanged(size, taken, 0.0) == taken).all()
    long = np.array([2065.0, 453, 372, 261, 243, 189, 150, 142, 141, 46])  # one long document in place of several
    after = mixing.exchanged(long, long < 2000, 758.0)
    assert abs(758 - (long[after].sum() - 1997)) < 40


@pytest.mark.parametrize("every", [65_536, 16])
def test_targets_of_many_sources(spark, monkeypatch, every):
    from trialframe.operators import ordering

    monkeypatch.setattr(ordering.running, "__defaults__", (every,))
    monkeypatch.setattr(ordering.numbered, "__defaults__", (every,))
    r = random.Random(3)
    sizes = {f"{r.choice('abZé')}{i}": int(r.paretovariate(0.7) * 10) for i in range(200)} | {None: 77}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    want = _targets(sizes)
    assert {x.source: x.target for x in mixing.source_targets(rows).collect()} == pytest.approx(want)
