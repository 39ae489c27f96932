"""Array functions for image blocks, in NumPy: smoothing, edges, a quantile threshold, a bounded minimum.

``per_image`` makes any of them a column expression over (values array<double>, width int), row-major images.
Borders are mirrored, with the edge value repeated.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Deviations after which a Gaussian is cut off.
REACH = 4.0


def _along(image: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a kernel of odd length along one axis."""
    r = len(kernel) // 2
    width = [(0, 0)] * image.ndim
    width[axis] = (r, r)
    padded = np.pad(image, width, mode="symmetric")
    n = image.shape[axis]
    return sum(k * np.take(padded, range(i, i + n), axis=axis) for i, k in enumerate(kernel))


def _gaussian(sigma: float, order: int = 0) -> np.ndarray:
    r = int(REACH * sigma + 0.5)
    x = np.arange(-r, r + 1)
    g = np.exp(-(x**2) / (2 * sigma**2))
    g /= g.sum()
    return g if order == 0 else g * (x**2 - sigma**2) / sigma**4


def smooth(image: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    for axis in range(image.ndim):
        image = _along(image, _gaussian(sigma), axis)
    return image


def gradient(image: np.ndarray) -> np.ndarray:
    """Length of the Sobel gradient."""
    slope, blur = np.array([-1.0, 0.0, 1.0]), np.array([1.0, 2.0, 1.0])
    return np.hypot(*(_along(_along(image, slope, axis), blur, 1 - axis) for axis in (0, 1)))


def laplacian(image: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Laplacian of a Gaussian: second derivatives along each axis, smoothed along the other."""
    return sum(_along(_along(image, _gaussian(sigma, 2), axis), _gaussian(sigma), 1 - axis) for axis in (0, 1))


def edges(image: np.ndarray, method: str = "sobel", quantile: float = 0.84, sigma: float = 1.0) -> np.ndarray:
    """1 where the edge score reaches its quantile, else 0."""
    score = np.abs(laplacian(image, sigma)) if method == "log" else gradient(smooth(image, sigma))
    return (score >= np.quantile(score, quantile)).astype(float)


def minimum(f: Callable[[float], float], low: float, high: float, tolerance: float = 1e-8) -> float:
    """Where a function of one extreme in an interval is least, by golden sections."""
    ratio = (math.sqrt(5) - 1) / 2
    a, b = low, high
    c, d = b - ratio * (b - a), a + ratio * (b - a)
    fc, fd = f(c), f(d)
    while b - a > tolerance:
        if fc < fd:
            b, d, fd = d, c, fc
            c = b - ratio * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + ratio * (b - a)
            fd = f(d)
    return (a + b) / 2


def per_image(function: Callable[[np.ndarray], np.ndarray], values: Column, width: Column) -> Column:
    """``function`` of each row's image, flat again; null for null, empty for empty."""

    @F.pandas_udf("array<double>")
    def apply(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for images, widths in batches:
            yield pd.Series([v if v is None or not len(v) else function(np.asarray(v, float).reshape(-1, int(w))).ravel() for v, w in zip(images, widths, strict=True)])

    return apply(values, width)
