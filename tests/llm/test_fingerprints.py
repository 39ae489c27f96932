from __future__ import annotations

import hashlib
import random
import re

import pytest

from tests.llm import brute
from trialframe.llm import fingerprints


def _parts(text):
    return {p.strip(" ") for p in re.split(r"\n+|(?<=[.!?])[ \t]+", text) if p.strip(" ")}


def _likeness(a, b):
    a, b = _parts(a), _parts(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def _texts(n=120):
    r = random.Random(8)
    say = lambda: " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(r.randint(2, 9))) + r.choice([". ", "! ", "\n", ".\n\n"])
    texts = ["".join(say() for _ in range(r.choice([1, 3, 12, 60]))) for _ in range(n)]
    return [*texts, None, "", "  \n ", texts[0], texts[0], "😀" * 9 + ". b", "".join(say() for _ in range(1500)), "one. one. one."]


@pytest.mark.parametrize("chunk", [2048, 7])
def test_against_plain_sets(spark, monkeypatch, chunk):
    monkeypatch.setattr(fingerprints, "CHUNK", chunk)
    texts = _texts(60 if chunk == 7 else 120)
    docs = brute.documents(spark, texts, first=-5).repartition(3)
    rows = {r.doc_id + 5: r for r in fingerprints.version_fingerprints(docs).collect()}
    assert sorted(rows) == list(range(len(texts)))
    seen = {}
    for i, r in rows.items():
        text, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        k = len(text) // 4
        edited = text[: len(text) - k] + after[:k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(_likeness(text, edited)) and r.near_next == pytest.approx(_likeness(text, after))
        assert seen.setdefault(text, r.fingerprint) == r.fingerprint
        assert (r.fingerprint == r.edited_fingerprint) == (_parts(text) == _parts(edited))


def test_sketches_subtract_and_peel(spark):
    keys = ["id", "w"]
    rows = [(1, 8, s, d) for s, ds in ((1, range(0, 1000)), (-1, range(6, 1004))) for d in ds] + [(2, 8, 1, d) for d in range(60)]
    digests = spark.createDataFrame(rows, "id long, w int, sign int, digest long")
    got = fingerprints.peel(fingerprints.sketch(digests, keys), keys).collect()
    found = {(r.k, r.p) for r in got if r.id == 1 and r.cell < 0}
    assert found == {(d, 1) for d in range(6)} | {(d, -1) for d in range(1000, 1004)} and not [r for r in got if r.id == 1 and r.cell >= 0]
    assert [r for r in got if r.id == 2 and r.cell >= 0]  # 60 digests do not peel out of 24 cells: to be tried larger


PAIRS = "id long, pair string, a array<long>, b array<long>, guess long"


@pytest.mark.parametrize("tries", [5, 0])
def test_digests_are_recovered(spark, monkeypatch, tries):
    monkeypatch.setattr(fingerprints, "TRIES", tries)
    r = random.Random(2)
    sets = [([r.getrandbits(63) - 2**62 for _ in range(n)], [r.getrandbits(63) - 2**62 for _ in range(m)], [r.getrandbits(63) for _ in range(k)]) for n, m, k in ((0, 3, 5), (400, 600, 300), (1, 0, 0), (0, 0, 4))]
    rows = [(i, "e", a + c, c + b, g) for i, (a, b, c) in enumerate(sets) for g in [None if i % 2 else 3]]
    pairs = spark.createDataFrame(rows, PAIRS)
    got = {x.id: (sorted(x.only_a), sorted(x.only_b)) for x in fingerprints.differences(pairs).collect()}
    assert {i: got.get(i, ([], [])) for i in range(4)} == {i: (sorted(a), sorted(b)) for i, (a, b, _) in enumerate(sets)}
    like = {x.id: x for x in fingerprints.likeness(pairs).collect()}
    for i, (a, b, c) in enumerate(sets):
        xor = 0
        for d in a + b:
            xor ^= d
        assert (like[i].near, like[i].removed, like[i].added, like[i].checksum) == (pytest.approx(len(c) / len(a + b + c)), len(a), len(b), xor)


def test_unbroken_texts_are_cut(spark):
    r = random.Random(6)
    words = " ".join("".join(r.choices("abcdefgh", k=r.randint(2, 9))) for _ in range(600))
    solid = "".join(r.choices("abcdefgh", k=5000))
    few = ["Nd, " * n + "end" for n in (640, 1400)] + ["aa bb " * 900, "e " * 3000, "." * 4000, "\r\u2028 x" * 900]
    docs = brute.documents(spark, [words, solid, "x", *few, "y"])
    near = {x.doc_id: x.near_edited for x in fingerprints.version_fingerprints(docs).collect()}
    assert near[0] > 0.4 and near[1] > 0.4
    assert min(near[3 + k] for k in range(len(few))) > 0.4, sorted(near.items())


def test_shuffles_do_not_stay(spark):
    from trialframe.scratch import CLEANUP, no_shuffles_left

    before = spark.conf.get(CLEANUP)
    with pytest.raises(ValueError), no_shuffles_left(spark):
        assert spark.conf.get(CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(CLEANUP) == before


def test_chunks_are_by_rows_not_by_values(spark):
    from trialframe.operators.ordering import chunk_of

    # 30,000 rows without an id; ids in two clusters and an outlier
    rows = spark.range(30_000).selectExpr("cast(-9223372036854775808 as long) i", "xxhash64(id) h").unionByName(spark.range(40_000).selectExpr("case when id < 20000 then id when id = 39999 then 9000000000000000000 else 1000000000000 + id end i", "1L h"))
    chunk, n = chunk_of(rows, {c: rows[c] for c in ("i", "h")}, 1024)
    sizes = [x["count"] for x in rows.groupBy(chunk.alias("c")).count().collect()]
    assert n > 40 and max(sizes) < 10_000 and len(sizes) >= n - 1


def test_no_python_in_the_plan(spark):
    plan = fingerprints.version_fingerprints(brute.documents(spark, ["a. b.", "c"]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_few_rows_and_odd_ids(spark):
    assert fingerprints.version_fingerprints(brute.documents(spark, ["a"]).where("false")).count() == 0
    one = fingerprints.version_fingerprints(brute.documents(spark, ["abcd"])).collect()
    assert one[0].edited_sha256 == hashlib.sha256(b"abca").hexdigest() and one[0].near_next == 1.0
    odd = spark.createDataFrame([(None, "wxyz"), (2**62, "efgh"), (2**62, "efgh"), (-7, "abcd")], "doc_id long, text string")
    got = sorted(r.edited_sha256 for r in fingerprints.version_fingerprints(odd).collect())
    assert got == sorted(hashlib.sha256(x).hexdigest() for x in (b"wxya", b"abce", b"efge", b"efgw"))
