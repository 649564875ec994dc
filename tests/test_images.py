"""Image kernels against numpy, and their edges."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helioframe.functions import images as I
from helioframe.functions.instruments import BANDS, aia_intscale, hmi_intscale
from helioframe.functions.sampling import prefilter, resample_grid, sample


def run(spark, array, kernel, dtype="float64"):
    a = np.asarray(array, float)
    h, w, c = (*a.shape, 1)[:3]
    df = spark.createDataFrame([([float(v) for v in a.ravel()],)], "d array<double>").select(I.image("d", h, w, c, dtype).alias("img"))
    r = df.select(kernel(F.col("img")).alias("o")).select("o.*").first()
    return np.array(r["data"]).reshape(r["height"], r["width"], r["channels"]).squeeze(2 if r["channels"] == 1 else ()), r["dtype"]


def test_bytescale(spark):
    x = np.array([[0.0, 1.0], [2.0, np.nan]])
    got, kind = run(spark, x, I.bytescale_image)
    assert kind == "uint8" and got.tolist() == [[0, 127], [255, 0]]
    assert run(spark, np.full((2, 2), np.nan), I.bytescale_image)[0].tolist() == [[0, 0], [0, 0]]
    with pytest.raises(PySparkException):
        run(spark, np.ones((2, 2)), I.bytescale_image)
    with pytest.raises(ValueError):
        I.bytescale_image(F.col("img"), omax=300)


def test_masks(spark):
    y, x = np.ogrid[:7, :9]
    d = np.sqrt((y - 3.5) ** 2 + (x - 4.5) ** 2)
    got = lambda m: np.array(spark.range(1).select(m.alias("m")).first()["m"]).reshape(7, 9)
    inner, outer = got(I.circle_mask((7, 9), 3)), got(I.circle_mask((7, 9), 3, mask_type="outer"))
    assert (inner == (d < 3)).all() and (inner ^ outer).all()
    assert (got(I.annulus_mask((7, 9), 1, 3)) == ((d >= 1) & (d < 3))).all() and not got(I.annulus_mask((7, 9), 3, 1)).any()
    with pytest.raises(ValueError):
        I.circle_mask(3, 1, mask_type="other")


@pytest.mark.parametrize("shape", [(3, 4), (3, 4, 3), (1, 5)])
def test_pad_and_crop(spark, shape):
    a = np.arange(np.prod(shape), dtype=float).reshape(shape)
    h, w = shape[:2]
    padded, _ = run(spark, a, lambda i: I.pad_image(i, (h + 3, w + 2), 9))
    spec = [(1, 2), (1, 1), (0, 0)][: a.ndim]
    assert (padded == np.pad(a, spec, constant_values=9)).all()
    back, _ = run(spark, padded, lambda i: I.crop_or_pad(i, (h, w)))
    assert (back == a).all()
    with pytest.raises(PySparkException):
        run(spark, a, lambda i: I.pad_image(i, (h - 1, w)))


def test_resize_and_kinds(spark):
    a = np.array([[0.0, 10.0], [20.0, 30.0]])
    got, kind = run(spark, a, lambda i: I.resize_image(i, (3, 3)), "uint8")
    assert kind == "uint8" and got.tolist() == [[0, 5, 10], [10, 15, 20], [20, 25, 30]]
    assert run(spark, a, lambda i: I.resize_image(i, (2, 2), order=0))[0].tolist() == a.tolist()
    same, kind = run(spark, a, lambda i: I.resize_image(i, (3, 3), preserve_range=False), "uint8")
    assert kind == "float64"
    with pytest.raises(ValueError):
        I.resize_image(F.col("img"), (3, 3), order=7)


def test_rotate(spark):
    a = np.arange(12, dtype=float).reshape(3, 4)
    assert (run(spark, a, lambda i: I.rotate_image(i, 180, (3, 4), order=0))[0] == a[::-1, ::-1]).all()
    turned, _ = run(spark, a, lambda i: I.rotate_image(i, 90, (3, 4), order=1, reshape=True))
    assert turned.shape == (4, 3) and (turned == np.rot90(a)).all()
    assert np.allclose(run(spark, a, lambda i: I.rotate_image(i, 360, (3, 4), order=3))[0], a)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_samples_at_pixels_are_the_pixels(order):
    a = np.random.default_rng(1).normal(size=(3, 6, 7, 2))
    y, x = np.mgrid[0:6, 0:7].astype(float)
    assert np.allclose(sample(a, y, x, order, 0.0), a) and np.allclose(resample_grid(a, np.arange(6.0), np.arange(7.0), order), a)
    assert prefilter(np.arange(12.0), 3).shape == (12,)


@pytest.mark.parametrize("order", [0, 1, 2, 3])
def test_grid_and_places_agree(order, monkeypatch):
    """Both ways to sample, also in bands of a few rows, and bilinear values by the plain formula."""
    from helioframe.functions import sampling

    a = np.random.default_rng(3).normal(size=(2, 5, 9, 1))
    rows, cols = np.linspace(0, 4, 11), np.linspace(0, 8, 6)
    y, x = np.broadcast_arrays(rows[:, None], cols[None, :])
    whole = sample(a, y, x, order, 0.0)
    monkeypatch.setattr(sampling, "CELLS", 20)
    assert np.allclose(whole, sample(a, y, x, order, 0.0)) and np.allclose(whole, resample_grid(a, rows, cols, order))
    if order == 1:
        p = a[0, :, :, 0]
        f = lambda v, u: p[int(v), int(u)]
        want = f(1, 3) * 0.5 * 0.75 + f(1, 4) * 0.5 * 0.25 + f(2, 3) * 0.5 * 0.75 + f(2, 4) * 0.5 * 0.25
        assert np.isclose(sample(a[:1], np.array([[1.5]]), np.array([[3.25]]), 1, 0.0)[0, 0, 0, 0], want)
    assert (sample(a, y - 10, x, order, 7.0) == 7.0).all()


def test_large_image(spark):
    """A large image goes through in one row."""
    side = 2048
    df = spark.range(1).select(I.image(F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda i: (i % side).cast("double")), side, side).alias("img"))
    r = df.select(I.resize_image(F.col("img"), (1024, 1024)).alias("o")).select(F.size("o.data").alias("n"), F.col("o.data")[1023].alias("corner")).first()
    assert r["n"] == 1 << 20 and abs(r["corner"] - 2047) < 1e-9


def test_splines_match_the_library_in_spark(spark):
    a = np.random.default_rng(2).normal(size=(5, 5))
    got, _ = run(spark, a, lambda i: I.resize_image(i, (5, 5), order=3))
    assert np.allclose(got, a)


def test_instruments(spark):
    x = np.array([[-150.0, -100.0, 0.0, 100.0, np.nan]])
    assert run(spark, x, hmi_intscale)[0].tolist() == [[0, 0, 127, 254, 0]]  # 200 * 1.275 lies just under 255
    for w, (low, high, _, _) in BANDS.items():
        got, _ = run(spark, np.array([[-1e9, 1e9, np.nan]]), lambda i, w=w: aia_intscale(i, 2.0, float(w)))
        assert got[0][0] == 0 and got[0][1] == 255, (w, low, high)
    with pytest.raises(PySparkException):
        run(spark, x, lambda i: aia_intscale(i, 2.0, 999.0))
