"""Ranked lexical search against a plain count, on odd texts and both ways of joining."""

from __future__ import annotations

import math
import re
from collections import Counter

import pytest

from trialframe.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k):
    tallies = [(i, Counter(_terms(t))) for i, t in docs]
    tallies = [(i, c) for i, c in tallies if c]
    n_docs, n_terms = len(tallies), sum(sum(c.values()) for _, c in tallies)
    df = Counter(t for _, c in tallies for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in tallies:
            m = 50 + (50 * sum(c.values()) * n_docs) // n_terms
            weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(_terms(text)) if c[t]}
            scored.append((sum(w * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t, w in weights.items()), i))
        best = sorted((s for s in scored if s[0] > 0), key=lambda s: (-s[0], s[1] is None, s[1] or 0))[:k]
        out += [(item, r + 1, i, s) for r, (s, i) in enumerate(best)]
    return sorted(out, key=str)


DOCS = [(i, f"The {w} of {w} runs; AND {v}-{v}9 Été\u00a0{i % 7}") for i, (w, v) in enumerate((a, b) for a in ("cat", "DOG", "emu", "fox", "gnu") for b in ("red", "blue", "Straße"))]
DOCS += [(3, None), (40, ""), (41, " .,;\x00\x7f"), (None, "cat cat red"), (5, "cat cat red"), (5, "cat cat red"), (50, "the of and " * 30_000), (60, "ÀB çD\u2028x")]
ITEMS = [(1, "cat red the"), (1, "dog"), (None, "FOX blue 9 été\u00a03"), (2, None), (3, "..."), (4, "nowhere"), (5, "the the of"), (6, "straße ÀB çd\u2028x")]


@pytest.mark.parametrize("bound", [lexical.MAX_TERMS, 3])
def test_against_a_plain_count(spark, monkeypatch, bound):
    monkeypatch.setattr(lexical, "MAX_TERMS", bound)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], "doc_id long, text string, term string, tf int, row int")
    items = spark.createDataFrame([(i, t, 3) for i, t in ITEMS], "item_id long, text string, w int")
    found = lexical.search(docs, items, k=4)
    assert sorted((tuple(r) for r in found.collect()), key=str) == _brute(DOCS, ITEMS, 4)


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical.search(docs.limit(0), items).collect() == [] == lexical.search(docs, items.limit(0)).collect()


def test_a_common_word_is_dealt_over_many_buckets(spark):
    docs = spark.createDataFrame([(i, f"the w{i}") for i in range(2000)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "the w7")], "item_id long, text string")
    assert [(r["rank"], r.doc_id) for r in lexical.search(docs, items, k=3).collect()] and lexical.SLICES > 8
