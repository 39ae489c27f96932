from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm import brute
from trialframe.llm import quality


def _corpus(spark, n=900):
    r = random.Random(2)
    vocab = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(2, 9))) for _ in range(500)]
    texts, labels = [], []
    for i in range(n):
        w = r.choices(vocab, k=r.randint(5, 300))
        good = r.random() < 0.7
        texts.append(" ".join(w).capitalize() + "." if good else " | ".join(x.upper() for x in w))
        labels.append((i, int(good), 0))
    return brute.documents(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_held_out_labels(spark):
    docs, labels = _corpus(spark)
    model = quality.fit_quality(docs, labels)
    rows = quality.with_quality(docs, model).join(labels, "doc_id").withColumn("held", quality.remainder("doc_id", 5) == 0).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held]
    assert sum(r.predicted == r.quality for r in held) >= 0.97 * len(held)


def test_held_out_labels_are_not_used(spark):
    docs, labels = _corpus(spark, 300)
    flipped = labels.withColumn("quality", F.when(quality.remainder("doc_id", 5) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit_quality(docs, x) for x in (labels, flipped))
    assert np.allclose(a.weights, b.weights) and np.allclose(a.levels, b.levels)


def test_isotonic_is_the_monotone_fit():
    x, y = np.array([1.0, 2, 3, 3, 4, 5]), np.array([0.0, 1, 0, 0, 1, 1])
    knots, levels = quality.isotonic(x, y)
    assert np.all(np.diff(levels) > 0) and np.allclose(np.interp([1, 2.5, 4], knots, levels), [0, levels[1], 1], atol=0.35)
    assert levels[1] == 1 / 3


def test_odd_inputs(spark):
    docs, labels = _corpus(spark, 200)
    model = quality.fit_quality(docs, labels)
    odd = brute.documents(spark, [None, "", " \n", "x" * 200_000, "\x00 �", "a b"])
    rows = quality.with_quality(odd, model).collect()
    assert all(0 <= r.score <= 1 for r in rows) and rows[0].score == rows[1].score
    assert quality.with_quality(odd.where("false"), model).count() == 0
    none = quality.fit_quality(docs, labels.where("false"))
    assert {r.score >= 0.3 for r in quality.with_quality(odd, none).collect()} == {True}
    nulls = labels.selectExpr("doc_id", "cast(null as int) quality")
    assert quality.fit_quality(docs, nulls).levels.tolist() == [0.5]


def test_the_fit_against_numpy(spark):
    r = random.Random(5)
    words = ["".join(r.choices("abcdefgh", k=r.randint(1, 9))) for _ in range(200)]
    texts = [" ".join(r.choices(words, k=r.randint(3, 80))) + ("." if i % 2 else " | %% ##") for i in range(300)]
    labels = [int(i % 2 and r.random() < 0.9) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = quality.fit_quality(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, quality int"), n_features=40)
    fold = [zlib.crc32(str(i).encode()) % 5 for i in range(300)]
    x = np.array([quality.statistics(t.encode()) for t in texts])
    y = np.array(labels, float)
    fits, holds = np.array([f > 1 for f in fold]), np.array([f == 1 for f in fold])
    centre = x[fits].mean(0)
    scale = np.sqrt(np.maximum((x[fits] ** 2).mean(0) - centre**2, 1e-8))
    z = np.clip((x - centre) / scale, -6, 6)
    z = np.c_[np.cos(z @ model.directions + model.phases) * np.sqrt(2 / 40), np.ones(300)]
    weights = np.linalg.solve(z[fits].T @ z[fits] + 1e-3 * fits.sum() / 41 * np.eye(41), z[fits].T @ y[fits])
    assert np.allclose(model.centre, centre) and np.allclose(model.scale, scale) and np.allclose(model.weights, weights, atol=1e-6)
    raw = z @ weights
    order = np.argsort(raw[holds])
    own, values = y[holds][order], raw[holds][order]
    n = len(own)
    fitted = [max(min(own[a : b + 1].mean() for b in range(i, n)) for a in range(i + 1)) for i in range(n)]  # the max-min form of isotonic regression
    assert np.allclose(sorted(set(np.round(model.levels, 9))), sorted(set(np.round(fitted, 9))))
    block = [np.flatnonzero(np.isclose(fitted, level)) for level in model.levels]
    assert np.allclose(model.knots, [values[b].mean() for b in block])
    scores = {r.doc_id: r.score for r in quality.with_quality(docs, model).collect()}
    assert np.allclose([scores[i] for i in range(300)], model.score(x))
