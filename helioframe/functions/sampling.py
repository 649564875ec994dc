"""Resampling of images in numpy: nearest, bilinear, and splines of order 2 and 3.

Sampling looks up neighbours of every pixel, and splines need a filter that runs along each line in both directions.
Expressions over arrays are interpreted value by value, so these kernels run on Arrow batches. Images of one shape are
worked on together, CELLS values at a time; a large image is cut into bands of rows.
"""

from __future__ import annotations

from collections.abc import Callable
from math import sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from helioframe.functions.images import LIMITS, _like, rotation
from helioframe.plans.workers import ship

#: Values of the output that are computed together.
CELLS = 1 << 20


def prefilter(x: np.ndarray, order: int) -> np.ndarray:
    """B-spline coefficients along the first axis, the signal mirrored about its end samples."""
    n = len(x)
    if n < 2:
        return x.astype(np.float64)
    z = sqrt(8) - 3 if order == 2 else sqrt(3) - 2
    c = x.astype(np.float64) * ((1 - z) * (1 - 1 / z))
    k = np.arange(n)
    weight = z**k + np.where((k > 0) & (k < n - 1), z ** (2 * n - 2 - k), 0.0)
    c[0] = np.tensordot(weight, c, 1) / (1 - z ** (2 * n - 2))
    for i in range(1, n):
        c[i] += z * c[i - 1]
    c[-1] = z / (z * z - 1) * (c[-1] + z * c[-2])
    for i in range(n - 2, -1, -1):
        c[i] = z * (c[i + 1] - c[i])
    return c


def taps(at: np.ndarray, order: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of the order + 1 values around each sample; splines mirror places into the signal."""
    if order == 0:
        return np.clip(np.floor(at + 0.5), 0, n - 1).astype(int)[..., None], np.ones((*at.shape, 1))
    if order == 1:
        low = np.clip(np.floor(at), 0, n - 1).astype(int)
        return np.stack([low, np.minimum(low + 1, n - 1)], -1), np.stack([1 - (at - low), at - low], -1)
    base = np.floor(at).astype(int) - 1 if order == 3 else np.floor(at + 0.5).astype(int) - 1
    place = base[..., None] + np.arange(order + 1)
    d = np.abs(at[..., None] - place)
    if order == 3:
        w = np.where(d < 1, 2 / 3 - d * d + d**3 / 2, np.clip(2 - d, 0, None) ** 3 / 6)
    else:
        w = np.where(d <= 0.5, 0.75 - d * d, np.clip(1.5 - d, 0, None) ** 2 / 2)
    place = np.abs(place) % (2 * n - 2) if n > 1 else place * 0
    return np.where(place >= n, 2 * n - 2 - place, place), w


def _coefficients(x: np.ndarray, order: int) -> np.ndarray:
    """Of (images, height, width, channels) what the taps weigh."""
    if order < 2:
        return x
    rows = prefilter(np.moveaxis(x, 1, 0), order)  # height first
    return np.moveaxis(prefilter(np.moveaxis(rows, 2, 0), order), 0, 2).swapaxes(0, 1)


def _along(c: np.ndarray, axis: int, place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sums of c's slices along an axis; places and weights are (samples, taps)."""
    shape = [1] * c.ndim
    shape[axis] = len(place)
    return sum(np.take(c, place[:, t], axis) * weight[:, t].reshape(shape) for t in range(place.shape[1]))


def resample_grid(x: np.ndarray, y: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Images (n, h, w, c) sampled at rows y and columns `at`."""
    c, (py, wy), (px, wx) = _coefficients(x, order), taps(y, order, x.shape[1]), taps(at, order, x.shape[2])
    step = max(1, CELLS // max(1, len(x) * len(at) * x.shape[3]))
    return np.concatenate([_along(_along(c, 1, py[i : i + step], wy[i : i + step]), 2, px, wx) for i in range(0, len(y), step)], 1)


def sample(x: np.ndarray, y: np.ndarray, at: np.ndarray, order: int, cval: float) -> np.ndarray:
    """Images (n, h, w, c) at real places (y, at), two arrays of the output's shape; outside an image it is cval."""
    n, h, w, c = x.shape
    flat = _coefficients(x, order).reshape(n, h * w, c)
    out = np.empty((n, *y.shape, c))
    step = max(1, CELLS // max(1, n * y.shape[1] * c))
    for i in range(0, len(y), step):
        rows, cols = y[i : i + step], at[i : i + step]
        (py, wy), (px, wx) = taps(rows, order, h), taps(cols, order, w)
        total = np.zeros((n, *rows.shape, c))
        for a in range(order + 1):
            for b in range(order + 1):
                total += np.take(flat, py[..., a] * w + px[..., b], 1) * (wy[..., a] * wx[..., b])[..., None]
        inside = (rows >= 0) & (rows <= h - 1) & (cols >= 0) & (cols <= w - 1)
        out[:, i : i + step] = np.where(inside[..., None], total, cval)
    return out


def as_kind(x: np.ndarray, dtype: str) -> np.ndarray:
    """Values as an image of this kind holds them: integers clipped and cut towards zero (NaN: 0), float32 rounded, others as they are."""
    if dtype in LIMITS:
        return np.trunc(np.clip(np.nan_to_num(x, nan=0.0), *map(float, LIMITS[dtype])))
    return x.astype(np.float32).astype(np.float64) if dtype == "float32" else x


def _apply(img: Column, height: int, width: int, made: Callable[[np.ndarray], np.ndarray], preserve: bool) -> Column:
    """img with the values that made() gives for arrays (n, h, w, c)."""
    ship()

    @F.pandas_udf("array<double>")
    def run(data: pd.Series, h: pd.Series, w: pd.Series, c: pd.Series, kind: pd.Series) -> pd.Series:
        shapes = pd.DataFrame({"h": h, "w": w, "c": c, "kind": kind})
        out = pd.Series([None] * len(data), index=data.index, dtype=object)
        for (a, b, k, t), rows in shapes[data.notna()].groupby(["h", "w", "c", "kind"]).groups.items():
            step = max(1, CELLS // max(1, a * b * k, height * width * k))
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                got = made(np.stack([np.asarray(data[r], np.float64) for r in part]).reshape(-1, int(a), int(b), int(k)))
                got = as_kind(got, t) if preserve else got
                for r, x in zip(part, got.reshape(len(part), -1)):
                    out[r] = x
        return out

    return _like(img, run(img["data"], img["height"], img["width"], img["channels"], img["dtype"]), F.lit(height), F.lit(width), None if preserve else "float64")


def resized(img: Column, height: int, width: int, order: int, preserve: bool) -> Column:
    def at(have: int, want: int) -> np.ndarray:
        return np.minimum(np.arange(want) * ((have - 1) / (want - 1)), have - 1.0) if want > 1 else np.zeros(want)

    return _apply(img, height, width, lambda x: resample_grid(x, at(x.shape[1], height), at(x.shape[2], width), order), preserve)


def turned(img: Column, angle: float, shape: tuple[int, int], order: int, reshape: bool, cval: float, preserve: bool) -> Column:
    (c, s), (oy, ox), height, width = rotation(angle, *shape, reshape)

    def made(x: np.ndarray) -> np.ndarray:
        y, at = np.mgrid[0:height, 0:width].astype(np.float64)
        return sample(x, y * c + at * s + oy, y * -s + at * c + ox, order, float(cval))

    return _apply(img, height, width, made, preserve)
