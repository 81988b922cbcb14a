"""Second derivatives, ridges, blobs, Gabor filters and iterative restoration."""

from __future__ import annotations

import cmath
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .stencil import _blurred, eigenvalues, far, gaussian_weights, rectangle
from .tiles import Plane, Tile, tiled

PLACE = ["image_id", "y", "x"]


def gradient(pixels: DataFrame, axis: str) -> DataFrame:
    """Central differences, one-sided at both ends."""
    return tiled(pixels, 1, lambda t, p: (t.gradient(p, axis),))


def _hessian_of(t: Tile, p: Plane, sigma: float, mode: str) -> tuple[Plane, Plane, Plane]:
    w = gaussian_weights(sigma) if sigma else [1.0]
    g = t.blur(p, w, w, mode)
    gy, gx = t.gradient(g, "y"), t.gradient(g, "x")
    return t.gradient(gy, "y"), t.gradient(gy, "x"), t.gradient(gx, "x")


def _hessian_reach(sigma: float) -> int:
    return (len(gaussian_weights(sigma)) // 2 if sigma else 0) + 2


def hessian_matrix(pixels: DataFrame, sigma: float = 1.0, mode: str = "constant") -> DataFrame:
    """Second derivatives of the smoothed image: hrr, hrc, hcc."""
    return tiled(pixels, _hessian_reach(sigma), lambda t, p: _hessian_of(t, p, sigma, mode), outputs=("hrr", "hrc", "hcc"), mode=mode)


def hessian_eigenvalues(pixels: DataFrame, sigma: float = 1.0, mode: str = "constant") -> DataFrame:
    h = hessian_matrix(pixels, sigma, mode)
    a, b = eigenvalues(F.col("hrr"), F.col("hrc"), F.col("hcc"))
    return h.select(*PLACE, a.alias("l1"), b.alias("l2"))


def shape_index(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    e = hessian_eigenvalues(pixels, sigma)
    flat = F.col("l1") == F.col("l2")
    return e.select(*PLACE, F.when(~flat, 2 / math.pi * F.atan(F.try_divide(F.col("l2") + F.col("l1"), F.col("l2") - F.col("l1")))).alias("v"))


def hessian_determinant(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    h = hessian_matrix(pixels, sigma)
    return h.select(*PLACE, (F.col("hrr") * F.col("hcc") - F.col("hrc") * F.col("hrc")).alias("v"))


def sato(pixels: DataFrame, sigmas: tuple[float, ...] = (1, 3), black_ridges: bool = True) -> DataFrame:
    """Tubeness: the largest, over scales, of sigma squared times the positive larger curvature."""
    image = pixels if black_ridges else pixels.withColumn("v", -F.col("v"))

    def steps(t: Tile, p: Plane) -> tuple[Plane]:
        best = None
        for s in sigmas:
            a, b, c = _hessian_of(t, p, s, "reflect")
            larger = (a.v + c.v) / 2 + np.sqrt(4 * b.v * b.v + (a.v - c.v) * (a.v - c.v)) / 2
            v = s * s * np.maximum(larger, 0.0)
            best = v if best is None else np.maximum(best, v)
        return (a.map(best),)

    return tiled(image, _hessian_reach(max(sigmas)), steps)


def frangi(pixels: DataFrame, sigmas: tuple[float, ...] = (1, 3), beta: float = 0.5, gamma: float | None = None, black_ridges: bool = True) -> DataFrame:
    """Vesselness; gamma is half the largest Hessian norm at the first scale unless given."""
    image = pixels if black_ridges else pixels.withColumn("v", -F.col("v"))
    out, limits = None, None
    for s in sigmas:
        e = hessian_eigenvalues(image, s, "reflect")
        small = F.abs("l1") < F.abs("l2")
        l1, l2 = F.when(small, F.col("l1")).otherwise(F.col("l2")), F.when(small, F.col("l2")).otherwise(F.col("l1"))
        norm = F.col("l1") * F.col("l1") + F.col("l2") * F.col("l2")
        if limits is None:
            limits = e.groupBy("image_id").agg((F.lit(float(gamma)) if gamma is not None else F.sqrt(F.max(norm)) / 2).alias("g"))
        big = F.greatest(l2, F.lit(1e-10))
        ratio = (l1 / big) * (l1 / big)
        v = F.when(l2 > 0, F.exp(-ratio / (2 * beta**2)) * (1 - F.exp(-norm / (2 * F.col("g") * F.col("g"))))).otherwise(0.0)
        e = e.join(limits, "image_id").select(*PLACE, v.alias("v"))
        out = e if out is None else out.unionByName(e)
    return out.groupBy(*PLACE).agg(F.max("v").alias("v"))


def gaussian_derivative_weights(sigma: float, order: int) -> list[float]:
    """Weights of a correlation that smooths and takes the first or second derivative."""
    w = gaussian_weights(sigma)
    r = len(w) // 2
    factor = (lambda k: k / sigma**2) if order == 1 else (lambda k: k * k / sigma**4 - 1 / sigma**2)
    return [x * factor(k - r) for k, x in enumerate(w)]


def gaussian_derivative(pixels: DataFrame, sigma: float, order: tuple[int, int], mode: str = "nearest") -> DataFrame:
    """Smoothed, with derivatives of the given order (0, 1 or 2) along y and x."""
    wy, wx = (gaussian_derivative_weights(sigma, n) if n else gaussian_weights(sigma) for n in order)
    return _blurred(pixels, wy, wx, mode)


def gaussian_gradient_magnitude(pixels: DataFrame, sigma: float, mode: str = "reflect") -> DataFrame:
    gy = gaussian_derivative(pixels, sigma, (1, 0), mode)
    both = gy.join(gaussian_derivative(pixels, sigma, (0, 1), mode).withColumnRenamed("v", "_x"), PLACE)
    return both.select(*PLACE, F.hypot("v", "_x").alias("v"))


def gaussian_laplace(pixels: DataFrame, sigma: float, mode: str = "reflect") -> DataFrame:
    both = gaussian_derivative(pixels, sigma, (2, 0), mode).join(gaussian_derivative(pixels, sigma, (0, 2), mode).withColumnRenamed("v", "_x"), PLACE)
    return both.select(*PLACE, (F.col("v") + F.col("_x")).alias("v"))


def _neurites(t: Tile, p: Plane, sigma: float, alpha: float, mode: str) -> Plane:
    """From Gaussian derivatives, each taken as two first ones of narrower Gaussians."""
    half = sigma / math.sqrt(2)
    w, d = gaussian_weights(half), gaussian_derivative_weights(half, 1)
    gy, gx = t.blur(p, d, w, mode), t.blur(p, w, d, mode)
    hrr, hrc, hcc = t.blur(gy, d, w, mode).v, t.blur(gy, w, d, mode).v, t.blur(gx, w, d, mode)
    root = np.sqrt(4 * hrc * hrc + (hrr - hcc.v) * (hrr - hcc.v)) / 2
    l1, l2 = (hrr + hcc.v) / 2 + root, (hrr + hcc.v) / 2 - root
    a, b = l1 + alpha * l2, l2 + alpha * l1
    return hcc.map(np.maximum(np.where(np.abs(a) >= np.abs(b), a, b), 0.0))


def meijering(pixels: DataFrame, sigmas: tuple[float, ...] = (1, 3), alpha: float = 1 / 3, black_ridges: bool = True, mode: str = "reflect") -> DataFrame:
    """Neuriteness: the larger, in size, of each eigenvalue with a share of the other; each scale by its image's maximum."""
    image = pixels if black_ridges else pixels.withColumn("v", -F.col("v"))
    names = [f"r{k}" for k in range(len(sigmas))]
    reach = 2 * (len(gaussian_weights(max(sigmas) / math.sqrt(2))) // 2)
    e = materialize(tiled(image, reach, lambda t, p: tuple(_neurites(t, p, s, alpha, mode) for s in sigmas), outputs=tuple(names), mode=mode), "ridges")
    tops = e.groupBy("image_id").agg(*[F.max(n).alias(f"_{n}") for n in names])
    shares = [F.when(F.col(f"_{n}") > 0, F.col(n) / F.col(f"_{n}")).otherwise(0.0) for n in names]
    return e.join(F.broadcast(tops), "image_id").select(*PLACE, (F.greatest(*shares) if len(shares) > 1 else shares[0]).alias("v"))


def hessian(pixels: DataFrame, sigmas: tuple[float, ...] = (1, 3), beta: float = 0.5, gamma: float = 15.0, black_ridges: bool = True) -> DataFrame:
    """Vesselness with 1 where there is none."""
    return frangi(pixels, sigmas, beta, gamma, black_ridges).select(*PLACE, F.when(F.col("v") <= 0, 1.0).otherwise(F.col("v")).alias("v"))


def match_template(pixels: DataFrame, template: list[list[float]]) -> DataFrame:
    """Normalised correlation of a small template laid with its corner on each place where it fits.

    Windows are summed up in tiles, as four sums; one without variation has 0.
    """
    h, w = len(template), len(template[0])
    n = h * w
    mean = sum(map(sum, template)) / n
    steps = [(dy, dx, template[dy][dx] - mean) for dy in range(h) for dx in range(w)]
    spread = sum(t * t for *_, t in steps)

    def run(t: Tile, p: Plane) -> tuple[Plane]:
        k, s, q, c = (np.zeros(p.v.shape) for _ in range(4))
        for v, there, (_, _, weight) in t.around(p, steps, "constant", None):
            k, s, q, c = k + there, s + v, q + v * v, c + v * weight
        below = (q - s * s / n) * spread
        return (Plane(np.where(below > 1e-20, c / np.sqrt(np.maximum(below, 1e-20)), 0.0), t.place & (k == n)),)

    return tiled(pixels, max(h, w) - 1, run).where("v IS NOT NULL")


def _blobs(pixels: DataFrame, reach: int, scales, sigmas: list[float], threshold: float, mode: str) -> DataFrame:
    """image_id, y, x, sigma, v: places of the planes that ``scales`` makes over the threshold that no neighbour in place or scale exceeds."""
    names = [f"s{k}" for k in range(len(sigmas))]

    def steps(t: Tile, p: Plane) -> tuple[Plane, ...]:
        stack = scales(t, p)
        near = [t.extreme(s, rectangle(3, 3), True, "constant", None).v for s in stack]
        top = [np.maximum.reduce(near[max(k - 1, 0) : k + 2]) for k in range(len(stack))]
        return tuple(Plane(s.v, s.ok & (s.v == m) & (s.v > threshold)) for s, m in zip(stack, top, strict=True))

    found = tiled(pixels, reach + 1, steps, outputs=tuple(names), mode=mode)
    each = F.explode(F.array(*[F.struct(F.lit(float(s)).alias("sigma"), F.col(n).alias("v")) for s, n in zip(sigmas, names, strict=True)]))
    return found.where(F.coalesce(*names).isNotNull()).select(*PLACE, each.alias("b")).select(*PLACE, "b.sigma", "b.v").where("v IS NOT NULL")


def _shared_area(apart: Column, small: Column, large: Column) -> Column:
    """The part of the smaller disk that lies in the larger one; radii are the root of two times sigma."""
    d, r = apart / (large * math.sqrt(2)), small / large
    angle = lambda c: F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    lens = r * r * angle((d * d + r * r - 1) / (2 * d * r)) + angle((d * d + 1 - r * r) / (2 * d)) - F.sqrt(F.abs((1 + r - d) * (d - 1 + r) * (d + 1 - r) * (d + 1 + r))) / 2
    return F.when(d > 1 + r, 0.0).when(d <= 1 - r, 1.0).otherwise(lens / (math.pi * r * r))


def prune_blobs(blobs: DataFrame, overlap: float, largest: float) -> DataFrame:
    """``blobs`` (image_id, y, x, sigma, v) without those that share more than ``overlap`` of their area with a larger one.

    Of two of one size the brighter goes, then the one that comes first by y,
    then x. All pairs count, also with a blob that goes itself, so that no order
    matters. Blobs meet in cells as wide as two of ``largest`` sigma reach.
    """
    side = max(1, math.ceil(2 * math.sqrt(2) * largest))
    blobs = materialize(blobs.select(*PLACE, "sigma", "v"), "blobs")
    cell = lambda c, k=0: F.floor(F.col(c) / side) + k
    near = F.explode(F.array(*[F.struct(cell("y", dy).alias("cy"), cell("x", dx).alias("cx")) for dy, dx in rectangle(3, 3)]))
    named = lambda n: F.struct("sigma", (-F.col("v")).alias("dark"), "y", "x").alias(n)
    a = blobs.select("image_id", named("a"), near.alias("_c"))
    b = blobs.select("image_id", named("b"), F.struct(cell("y").alias("cy"), cell("x").alias("cx")).alias("_c"))
    apart = F.sqrt(F.pow(F.col("a.y") - F.col("b.y"), F.lit(2.0)) + F.pow(F.col("a.x") - F.col("b.x"), F.lit(2.0)))
    pairs = a.join(b, ["image_id", "_c"]).where((F.col("a") < F.col("b")) & (_shared_area(apart, F.col("a.sigma"), F.col("b.sigma")) > overlap))
    return blobs.join(pairs.select("image_id", "a.y", "a.x", "a.sigma").distinct(), [*PLACE, "sigma"], "left_anti")


def blob_dog(pixels: DataFrame, sigmas: tuple[float, ...] = (1.0, 1.6, 2.56, 4.096), threshold: float = 0.5, overlap: float = 0.5) -> DataFrame:
    """Maxima over place and scale of differences between neighbouring Gaussians: y, x, sigma, v.

    Of two blobs that share more than ``overlap`` of the smaller one's area only the larger stays.
    """
    weights = [gaussian_weights(s) for s in sigmas]

    def scales(t: Tile, p: Plane) -> list[Plane]:
        soft = [t.blur(p, w, w, "reflect") for w in weights]
        return [a.map((a.v - b.v) * (1 / (sigmas[k + 1] / sigmas[k] - 1))) for k, (a, b) in enumerate(zip(soft, soft[1:], strict=False))]

    found = _blobs(pixels, max(map(len, weights)) // 2, scales, list(sigmas[:-1]), threshold, "reflect")
    return prune_blobs(found, overlap, max(sigmas[:-1]))


def blob_doh(pixels: DataFrame, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0), threshold: float = 0.01) -> DataFrame:
    """Maxima over place and scale of the Hessian's determinant: y, x, sigma, v."""
    def scales(t: Tile, p: Plane) -> list[Plane]:
        return [a.map(float(s) ** 4 * (a.v * c.v - b.v * b.v)) for s in sigmas for a, b, c in [_hessian_of(t, p, s, "nearest")]]

    return _blobs(pixels, _hessian_reach(max(sigmas)), scales, list(sigmas), threshold, "nearest")


def gabor_kernel(frequency: float, theta: float = 0.0, sigma: float = 1.0) -> list[tuple[int, int, complex]]:
    """Offsets with complex weights, three standard deviations wide."""
    n = math.ceil(max(abs(3 * sigma * math.cos(theta)), abs(3 * sigma * math.sin(theta)), 1))
    out = []
    for dy, dx in rectangle(2 * n + 1, 2 * n + 1):
        r = dx * math.cos(theta) + dy * math.sin(theta)
        c = -dx * math.sin(theta) + dy * math.cos(theta)
        out.append((dy, dx, math.exp(-0.5 * (r * r + c * c) / sigma**2) / (2 * math.pi * sigma**2) * cmath.exp(2j * math.pi * frequency * r)))
    return out


def gabor(pixels: DataFrame, frequency: float, theta: float = 0.0, sigma: float = 1.0, mode: str = "reflect") -> DataFrame:
    """Real and imaginary responses (convolution): re, im."""
    kernel = gabor_kernel(frequency, theta, sigma)
    parts = [[(-dy, -dx, w.real) for dy, dx, w in kernel], [(-dy, -dx, w.imag) for dy, dx, w in kernel]]
    return tiled(pixels, far(kernel), lambda t, p: tuple(t.correlate(p, k, mode) for k in parts), outputs=("re", "im"), mode=mode)


def blob_log(pixels: DataFrame, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0), threshold: float = 0.1) -> DataFrame:
    """Maxima over place and scale of the negative, normalised Laplacian of Gaussian: y, x, sigma, v."""
    def scales(t: Tile, p: Plane) -> list[Plane]:
        return [a.map(-s * s * (a.v + c.v)) for s in sigmas for a, _, c in [_hessian_of(t, p, s, "nearest")]]

    return _blobs(pixels, _hessian_reach(max(sigmas)), scales, list(sigmas), threshold, "nearest")


def richardson_lucy(pixels: DataFrame, psf: list[tuple[int, int, float]], rounds: int = 10, eps: float = 1e-12) -> DataFrame:
    """Iterated deconvolution with a small point spread; outside is zero.

    As many rounds as 64 places around a tile allow run in one go.
    """
    turned = [(-dy, -dx, w) for dy, dx, w in psf]
    now, step = pixels.select(*PLACE, F.col("v").alias("i"), F.lit(0.5).alias("v")), 2 * far(psf)
    block = max(1, 64 // max(step, 1))

    def some(count: int):
        def run(t: Tile, i: Plane, p: Plane) -> tuple[Plane, Plane]:
            for _ in range(count):
                seen = t.correlate(p, turned, "constant").v
                p = p.map(p.v * t.correlate(p.map(np.where(seen < eps, 0.0, i.v / np.where(seen < eps, 1.0, seen))), psf, "constant").v)
            return i, p

        return run

    for first in range(0, rounds, block):
        count = min(block, rounds - first)
        now = materialize(tiled(now, step * count, some(count), ("i", "v"), ("i", "v")), "deconvolved")
    return now.select(*PLACE, F.greatest(F.least("v", F.lit(1.0)), F.lit(-1.0)).alias("v"))
