"""A quality classifier: random Fourier features over document statistics, ridge, isotonic calibration.

Random Fourier features z(x) = sqrt(2/D) cos(Wx + b) approximate a Gaussian kernel over
standardised statistics of the whole text. Ridge scores come from the normal equations, whose
matrices are summed within partitions and then over them. Scores of labelled rows that the fit has
not seen are calibrated to probabilities by pooling adjacent violators.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trialframe.scratch import materialize
from trialframe.llm.workers import bound_batches, parts

#: Bytes that are counted one by one.
MARKS = b"|#$%&*!?.,;:'\"-_/\\@=<>{}[]()+~^`"
_CLASS = np.zeros(256, np.int64)
for _at, _set in enumerate((range(65, 91), range(97, 123), range(48, 58), range(128, 256), (32, 9), (10, 13)), 1):
    _CLASS[list(_set)] = _at
PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text of any length, without its language, source or id."""
    n = len(text)
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    size = max(n, 1)
    kinds = np.bincount(_CLASS, weights=bytes_, minlength=7) / size
    words = text.split()
    k = max(len(words), 1)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    top = counts.most_common(5)
    lines = [x for x in text.split(b"\n") if x.strip()]
    m = max(len(lines), 1)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) if lines else np.zeros(1, np.int64)
    pairs = len(set(zip(words, words[1:], strict=False)))
    p = bytes_[bytes_ > 0] / size
    tails = [w[-1:] for w in words]
    odd = sum(w[-1] in PUNCTUATION and w[-1:] not in b".,;:!?" for w in words)
    twice = sum(len(w) > 1 and w[-1] == w[-2] and w[-1] in PUNCTUATION for w in words)
    return [
        math.log1p(n),
        math.log1p(len(words)),
        *kinds[1:],
        *(np.minimum(bytes_[list(MARKS)] / k, 3.0)),
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths == 1).sum() / k),
        float((lengths > 15).sum() / k),
        len(counts) / k,
        pairs / k,
        top[0][1] / k if top else 0.0,
        sum(c for _, c in top) / k,
        math.log1p(len(lines)),
        float(np.log1p(sizes.mean())),
        float((sizes < 30).sum() / m),
        len(set(lines)) / m,
        float(-(p * np.log(p)).sum()),
        sum(w[:1].isupper() for w in words) / k,
        sum(w.isupper() for w in words) / k,
        sum(t in (b".", b"!", b"?") for t in tails) / k,
        sum(t == b"," for t in tails) / k,
        odd / k,
        twice / k,
    ]


N_STATISTICS = len(statistics(b""))


@dataclass(frozen=True)
class QualityModel:
    """Standardisation, random features, ridge weights and the calibration's steps."""

    centre: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        return np.c_[np.cos(z @ self.directions + self.phases) * math.sqrt(2 / len(self.phases)), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated, and within a step still in the order of the ridge scores (by at most 0.001)."""
        r = self.raw(x)
        r = np.round(r, 9)  # sums of products differ in their last digits between batches
        return np.clip(0.999 * np.interp(r, self.knots, self.levels) + 0.001 / (1 + np.exp(-np.clip(r, -30, 30))), 0.0, 1.0)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: centres and means of the blocks; ties in ``x`` are one point."""
    points, where = np.unique(x, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, weights=y) / weight
    blocks: list[list[float]] = []  # mean, weight, sum of weight * x
    for m, w, p in zip(mean, weight, points, strict=True):
        blocks.append([m, w, w * p])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            b = blocks.pop()
            a = blocks[-1]
            a[0], a[1], a[2] = (a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] for b in blocks])


def remainder(id_col: str | Column, mod: int) -> Column:
    """crc32 of the id's text, modulo ``mod``; 0 for a null id."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(mod)), F.lit(0))


def _sums(rows: DataFrame, per_row) -> np.ndarray | None:
    """Sum of ``per_row(x, y)`` over ``rows(x, y)``, first within partitions. One vector a partition reaches the driver."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                part = per_row(np.stack(batch["x"].to_numpy()).astype(float), batch["y"].to_numpy(float))
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"v": [total.tobytes()]})

    parts = [np.frombuffer(r.v) for r in rows.mapInPandas(scan, "v binary").toLocalIterator()]
    return np.sum(parts, axis=0) if parts else None


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    folds: int = 5,
    max_rows: int = 40_000,
    n_features: int = 384,
    ridge: float = 1e-3,
    seed: int = 11,
) -> QualityModel:
    """Fit on labelled rows whose crc32 remainder modulo ``folds`` is not 0.

    About ``max_rows`` labelled rows at most are used (chosen by a hash of the id); their labels are
    broadcast, so that bound is also the broadcast's. Remainder 1 calibrates, the others fit.
    Null labels and ids are ignored; several labels of one id count as their maximum, and every document of a
    labelled id is a row of its own. Null and empty texts have statistics like any others; very long ones are
    measured whole. Without any labelled text, an empty table too, or with one class only, every score is the
    share of label 1 (0.5 if none). Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).where(remainder(id_col, folds) != 0)
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("double").alias("y"))
    share = min(1.0, max_rows / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("__id"), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    rows = rows.select("text", "y", (remainder("__id", folds) == 1).alias("calibrates"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, 0):
            x = [statistics(t or b"") for t in part.column(0).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), part.column(1), part.column(2)], names=["x", "y", "calibrates"])

    rows = materialize(rows.mapInArrow(measure, "x array<double>, y double, calibrates boolean"), "statistics").repartition(8)
    fitting, held = rows.where("not calibrates"), rows.where("calibrates")
    d = N_STATISTICS
    moments = _sums(fitting, lambda x, y: np.r_[len(x), y.sum(), x.sum(0), (x * x).sum(0)])
    rng = np.random.default_rng(seed)
    directions = rng.standard_normal((d, n_features)) / math.sqrt(d)
    phases = rng.uniform(0, 2 * math.pi, n_features)
    if moments is None or not 0 < moments[1] < moments[0]:
        flat = 0.5 if moments is None else float(moments[1] / moments[0])
        return QualityModel(np.zeros(d), np.ones(d), directions, phases, np.zeros(n_features + 1), np.zeros(1), np.array([flat]))
    n = moments[0]
    centre = moments[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(moments[2 + d :] / n - centre**2, 1e-8))
    model = QualityModel(centre, scale, directions, phases, np.zeros(n_features + 1), np.zeros(1), np.zeros(1))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = model.features(x)
        return np.r_[(z.T @ z).ravel(), z.T @ y]

    sums = _sums(fitting, normal)
    k = n_features + 1
    weights = np.linalg.solve(sums[: k * k].reshape(k, k) + ridge * n / k * np.eye(k), sums[k * k :])
    model = QualityModel(centre, scale, directions, phases, weights, np.zeros(1), np.zeros(1))

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield pd.DataFrame({"r": model.raw(np.stack(batch["x"].to_numpy()).astype(float)), "y": batch["y"]})

    points = (held if not held.isEmpty() else fitting).mapInPandas(scored, "r double, y double").toPandas()
    knots, levels = isotonic(points["r"].to_numpy(), points["y"].to_numpy())
    return QualityModel(centre, scale, directions, phases, weights, knots, levels)


def quality_score(model: QualityModel, text: Column) -> Column:
    """The score of each whole text, from 0 to 1. Null and empty texts are scored like any others."""

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = [np.empty(0)]
            for part in parts(iter([pa.RecordBatch.from_arrays([texts], names=["text"])]), 0):
                x = np.array([statistics(t or b"") for t in part.column(0).cast(pa.large_binary()).to_pylist()])
                out.append(model.score(x.reshape(part.num_rows, N_STATISTICS)))
            yield pa.array(np.concatenate(out))

    return score(text.cast("string"))


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` with ``score`` and ``predicted`` (1 from ``threshold`` on), which replace any columns so named.

    Null, empty and very long texts are scored whole like any others, equal texts alike; repeated rows each for
    itself; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    out = docs.withColumn("score", quality_score(model, F.col(text_col)))
    return out.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
