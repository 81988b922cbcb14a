"""Splines against a dense system of equations, zooms against loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgq.operators import splines, transform

from .test_fourier import back, frame

rng = np.random.default_rng(11)
A, B = rng.random((9, 12)), rng.random((7, 5))
FOLD = {"mirror": "reflect", "reflect": "symmetric", "wrap": "wrap", "nearest": "edge", "constant": "reflect"}


def beta(u, order):
    return sum((-1) ** k * math.comb(order + 1, k) * max(u + (order + 1) / 2 - k, 0.0) ** order for k in range(order + 2)) / math.factorial(order)


def value_along(line, at, order, mode):
    """The spline through the line and its continuation, solved densely, at one place."""
    if mode == "nearest":
        at = min(max(at, 0), len(line) - 1)
    wide = np.pad(line, 40, mode=FOLD[mode])
    m = np.array([[beta(i - j, order) for j in range(len(wide))] for i in range(len(wide))])
    c = np.linalg.solve(m, wide)
    return sum(c[j] * beta(at + 40 - j, order) for j in range(len(wide)))


@pytest.mark.parametrize("order", [2, 3, 4, 5])
@pytest.mark.parametrize("mode", ["mirror", "nearest"])
def test_lines_against_dense_equations(order, mode):
    line = rng.random(11)
    c = splines.line_coefficients(line, order, mode)
    more = splines.BEYOND if mode == "nearest" else 0
    wide = np.pad(line, 40, mode=FOLD[mode])
    want = np.linalg.solve(np.array([[beta(i - j, order) for j in range(len(wide))] for i in range(len(wide))]), wide)
    assert np.allclose(c, want[40 - more : 51 + more], atol=1e-9)


def test_published_poles():
    assert np.allclose(splines.poles(2), [8**0.5 - 3]) and np.allclose(splines.poles(3), [3**0.5 - 2])
    assert np.allclose(sorted(splines.poles(5)), sorted([(67.5 - 4436.25**0.5) ** 0.5 + 26.25**0.5 - 6.5, (67.5 + 4436.25**0.5) ** 0.5 - 26.25**0.5 - 6.5]))


@pytest.mark.parametrize(("order", "mode"), [(3, "mirror"), (2, "reflect"), (5, "nearest"), (4, "wrap"), (3, "constant")])
def test_warp_by_splines(spark, order, mode):
    p = frame(spark, {"a": A, "b": B})
    got = back(transform.warp(p, 6, 5, lambda y, x: (y * 1.7 - 1.3, x * 1.9 - 0.6), order, mode, cval=-5.0))
    for k, image in (("a", A), ("b", B)):
        for y, x in [(0, 0), (1, 1), (2, 3), (3, 2), (5, 4)]:
            sy, sx = y * 1.7 - 1.3, x * 1.9 - 0.6
            if mode == "constant" and not (0 <= sy <= image.shape[0] - 1 and 0 <= sx <= image.shape[1] - 1):
                want = -5.0
            else:
                rows = np.array([value_along(line, sx, order, mode) for line in image])
                want = value_along(rows, sy, order, mode)
            assert abs(got[k][y, x] - want) < 1e-7, (k, y, x)


def test_splines_go_through_the_places(spark):
    p = frame(spark, {"a": A})
    assert np.allclose(back(transform.warp(p, 9, 12, lambda y, x: (y, x), 3, "reflect"))["a"], A)
    assert splines.coefficients(p.where("false"), 3).count() == 0
    with pytest.raises(ValueError, match="orders"):
        splines.coefficients(p, 6)


def zoomed(a, fy, fx):
    h, w = a.shape
    oh, ow = math.floor(h * fy), math.floor(w * fx)
    if (oh, ow) == (h, w):
        return a
    z = np.array([[a[i * h // oh : -(-(i + 1) * h // oh), j * w // ow : -(-(j + 1) * w // ow)].mean() for j in range(ow)] for i in range(oh)])
    if oh > h:
        t, s = (oh - h) // 2, (ow - w) // 2
        return z[t : t + h, s : s + w]
    t, s = (h - oh) // 2, (w - ow) // 2
    return np.pad(z, [(t, h - oh - t), (s, w - ow - s)], mode="edge")


@pytest.mark.parametrize("f", [(1.5, 1.4), (0.6, 0.8), (1.0, 1.01), (2.0, 3.0)])
def test_zoom_against_loops(spark, f):
    got = back(transform.zoom(frame(spark, {"a": A, "b": B}), *f))
    assert np.allclose(got["a"], zoomed(A, *f)) and np.allclose(got["b"], zoomed(B, *f))


def test_zoom_by_image_and_what_it_refuses(spark):
    p = frame(spark, {"a": A, "b": B})
    got = back(transform.zoom(p, *[F.when(F.col("image_id") == "a", 1.5).otherwise(0.5)] * 2))
    assert np.allclose(got["a"], zoomed(A, 1.5, 1.5)) and np.allclose(got["b"], zoomed(B, 0.5, 0.5))
    with pytest.raises(Exception, match="enlarge both"):
        transform.zoom(p, 1.5, 0.5).count()
