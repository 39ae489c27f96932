from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import brute
from trialframe.llm import near_copies, simhash


def _sets(texts):
    out = {}
    for i, t in enumerate(texts):
        w = brute.words(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    return out


def _links(texts):
    sets = _sets(texts)
    return [(a, b) for a, b in combinations(sets, 2) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]


def _texts(seed=3):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(r.choices(vocab, k=r.choice([6, 40, 200]))) for _ in range(40)]
    near = []
    for t in base[:20]:
        for _ in range(8):
            w = t.split()
            for _ in range(r.randint(1, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"edit{r.randrange(50)}"
            near.append(" ".join(w))
    line = " ".join(vocab[:12])
    lined = [f"{line} {' '.join(r.choices(vocab, k=20))}" for _ in range(60)]
    odd = [None, "", " \t\n", "one", "One two", "ONE  TWO", "a\x0bb\x0cc d", "x " * 30000, "é É ß", "a b c d"]
    return base + near + lined + base[:5] + [base[0]] * 40 + odd


@pytest.mark.parametrize("common,chunk", [(64, 512), (1, 3)])
def test_against_brute_force(spark, monkeypatch, common, chunk):
    monkeypatch.setattr(near_copies, "COMMON", common)
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    texts = _texts()
    got = {r.id: r.component for r in near_copies.near_copies(brute.documents(spark, texts).repartition(3)).collect()}
    links = _links(texts)
    assert len(links) > 500
    assert got == brute.components(range(len(texts)), links)


def test_prefixes_of_similar_sets_meet():
    r = np.random.default_rng(4)
    for n in (1, 4, 5, 9, 10, 11, 100):
        for _ in range(50):
            a = np.unique(r.integers(0, 3 * n + 1, n))
            b = np.unique(np.concatenate([a[r.random(len(a)) < 0.9], r.integers(0, 3 * n + 1, max(n // 10, 1))]))
            shared = len(np.intersect1d(a, b))
            if shared >= 0.8 * (len(a) + len(b) - shared):
                common = np.unique(r.integers(0, 3 * n + 1, n))
                met = np.intersect1d(near_copies.prefix(a, common, 0.8), near_copies.prefix(b, common, 0.8))
                assert len(met) >= near_copies._need(np.array([len(a)]), len(b), 0.8)[0] > 0


def test_stage_drops_copies_that_differ_in_many_bits(spark, tmp_path):
    texts = _texts(7)[:200]
    sets, fps = _sets(texts), [brute.simhash(t) for t in texts]
    far = [(a, b) for a, b in _links(texts) if sets[a] != sets[b] and (fps[a] ^ fps[b]).bit_count() > 3]
    assert len(far) > 20  # op9's radius does not link these
    docs = brute.documents(spark, texts).select(*corpus_pipeline.COLUMNS)
    roots = brute.components(range(len(texts)), _links(texts))
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).collect()}
    assert kept == {i for i in roots if roots[i] == i}


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_keep_one_loses_no_text(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    texts = ["a b c d e f g", "a b c d e f g", "q r s t u v", None, "", "one of a kind this is", "another of its own kind"]
    docs = brute.documents(spark, texts)
    kept = simhash.keep_one(docs.unionByName(docs))
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(0, texts[0]), (2, texts[2]), (3, None), (5, texts[5]), (6, texts[6])]
    # unlike texts without ids, or with one id, are all kept; copies go for the one with an id
    rows = [(None, t) for t in texts[2:3] + texts[5:]] + [(4, "so unlike each other"), (4, "as these two are here"), (None, "so unlike each other"), (9, None)]
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in got) == sorted((i or 0, t or "") for i, t in rows if (i, t) != (None, "so unlike each other"))
    empty = docs.where("false")
    assert near_copies.near_copies(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_columns_may_clash(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, h string")
    assert [tuple(r) for r in simhash.keep_one(docs).collect()] == rows[:1]


def test_signatures_never_rule_out_a_link():

    draw = np.random.default_rng(4)
    for _ in range(400):
        n, similarity = int(draw.integers(1, 400)), 0.8
        a = np.unique(draw.integers(-(2**63), 2**63, n))
        b = np.unique(np.concatenate([draw.choice(a, max(1, int(len(a) * draw.uniform(0.7, 1))), replace=False), draw.integers(-(2**63), 2**63, int(draw.integers(0, 1 + len(a) // 6)))]))
        shared = len(np.intersect1d(a, b))
        sides = [tuple(np.array([v]) for v in (len(x), *near_copies.signature(x))) for x in (a, b)]
        if shared >= similarity * (len(a) + len(b) - shared) - 1e-9:
            assert near_copies._may_link(*sides, similarity)[0]


def test_a_shared_passage_below_the_similarity_offers_few_pairs():

    draw = np.random.default_rng(5)
    passage = draw.integers(-(2**63), 2**63, 60)
    sets = [np.unique(np.concatenate([passage, draw.integers(-(2**63), 2**63, 20)])) for _ in range(2000)]  # a similarity of 0.6
    node, size = np.arange(2000), np.array(list(map(len, sets)))
    signs = [x.copy() for x in np.array([near_copies.signature(x) for x in sets]).T]
    found = near_copies._crossing(0.8)(np.array([0]), np.array([2000]), np.zeros(2000, np.int64), node, size, node, *signs)
    assert sum(len(x[0]) for x in found) < 5 * 2000


def test_a_large_group_of_near_copies_offers_few_pairs(spark, monkeypatch):
    r = random.Random(7)  # the smallest node has a long edit: it is similar to the few texts with a short one only, as are all others
    texts = []
    for i in range(300):
        w, edit, at = [f"w{k}" for k in range(150)], 5 if i % 15 else 3, r.randrange(4, 141)
        w[at : at + edit] = [f"edit{i}.{k}" for k in range(edit)]
        texts.append(" ".join(w))
    offered, real = [], near_copies.materialize

    def counted(df, what):
        out = real(df, what)
        if what == "pairs":
            offered.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "materialize", counted)
    got = {r.id: r.component for r in near_copies.near_copies(brute.documents(spark, texts)).collect()}
    assert got == brute.components(range(len(texts)), _links(texts))
    assert sum(offered) < 15 * len(texts), offered


def test_few_jobs_leave_their_records_with_the_driver(spark):
    context = spark.sparkContext
    context.setJobGroup("few-jobs", "")
    try:
        near_copies.keep_one(brute.documents(spark, _texts())).count()
        jobs = len(context.statusTracker().getJobIdsForGroup("few-jobs"))
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 175  # 204 when every round of links began its components anew
