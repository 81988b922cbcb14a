"""Neighbourhood operators.

Correlations, order statistics and what is made of them run in tiles with their
surroundings (``tiles``): one shuffle for a whole chain of steps, and no group
that grows with the image. Other aggregates gather each output's sources by an
equi-join on their places, shifted by the footprint's offsets and folded at the
border. What is absent or null among the sources is left out.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tiles import Plane, Tile, tiled

MODES = ("reflect", "mirror", "nearest", "wrap", "constant")


def fold(i: Column, n: Column, mode: str) -> Column:
    """The place inside 0..n-1 that stands for ``i``; -1 where a constant does."""
    if mode == "reflect":
        k = F.pmod(i, 2 * n)
        return F.when(k < n, k).otherwise(2 * n - 1 - k)
    if mode == "mirror":
        period = F.greatest(2 * n - 2, F.lit(1))
        k = F.pmod(i, period)
        return F.when(k < n, k).otherwise(period - k)
    if mode == "nearest":
        return F.least(F.greatest(i, F.lit(0)), n - 1)
    if mode == "wrap":
        return F.pmod(i, n)
    if mode == "constant":
        return F.when((i >= 0) & (i < n), i).otherwise(F.lit(-1))
    raise ValueError(f"unknown mode {mode!r}")


def along(pixels: DataFrame, axis: str, f, columns: tuple[str, ...] = ("v",)) -> DataFrame:
    """Each line along ``axis`` through ``f``: an array of structs of ``columns`` to an array of doubles."""
    other = "x" if axis == "y" else "y"
    line = F.array_sort(F.collect_list(F.struct(axis, *columns)))
    lines = pixels.groupBy("image_id", other).agg(line.alias("_l"))
    out = lines.select("image_id", other, F.posexplode(F.arrays_zip(F.transform("_l", lambda p: p[axis]).alias("at"), f(F.col("_l")).alias("out"))))
    return out.select("image_id", other, F.col("col.at").alias(axis), F.col("col.out").alias("v")).select("image_id", "y", "x", "v")


def correlate1d(pixels: DataFrame, weights: list[float], axis: str, mode: str = "reflect", cval: float = 0.0, origin: int = 0) -> DataFrame:
    """Correlation along one axis; the middle weight (or the one after) stands on the pixel."""
    _known(mode)
    half = len(weights) // 2 + origin
    return tiled(pixels, max(abs(half), abs(len(weights) - 1 - half)), lambda t, p: (t.correlate1d(p, weights, axis, mode, cval, origin),), mode=mode)


def _known(mode: str) -> None:
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")


def _blurred(pixels: DataFrame, wy: list[float], wx: list[float], mode: str, cval: float = 0.0) -> DataFrame:
    """Correlated along both axes in one go."""
    _known(mode)
    return tiled(pixels, max(len(wy), len(wx)) // 2, lambda t, p: (t.blur(p, wy, wx, mode, cval),), mode=mode)


def _zip(a: DataFrame, b: DataFrame, f) -> DataFrame:
    both = a.join(b.withColumnRenamed("v", "_w"), ["image_id", "y", "x"])
    return both.select("image_id", "y", "x", f(F.col("v"), F.col("_w")).alias("v"))


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    r = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def gaussian(pixels: DataFrame, sigma: float = 1.0, mode: str = "nearest", cval: float = 0.0, truncate: float = 4.0) -> DataFrame:
    if sigma == 0:
        return pixels.select("image_id", "y", "x", "v")
    w = gaussian_weights(sigma, truncate)
    return _blurred(pixels, w, w, mode, cval)


def uniform(pixels: DataFrame, size: int = 3, mode: str = "reflect") -> DataFrame:
    w = [1.0 / size] * size
    return _blurred(pixels, w, w, mode)


# Smoothing and derivative weights of the edge operators.
SMOOTH = {"sobel": [1 / 4, 2 / 4, 1 / 4], "scharr": [3 / 16, 10 / 16, 3 / 16], "prewitt": [1 / 3, 1 / 3, 1 / 3]}
DERIVATIVE = [1.0, 0.0, -1.0]
FARID_SMOOTH = [0.0376593171958126, 0.249153396177344, 0.426374573253687, 0.249153396177344, 0.0376593171958126]
FARID_EDGE = [0.109603762960254, 0.276690988455557, 0.0, -0.276690988455557, -0.109603762960254]


def edge(pixels: DataFrame, kind: str, axis: str, mode: str = "reflect") -> DataFrame:
    """sobel, scharr, prewitt or farid along one axis ("y" finds horizontal edges)."""
    _known(mode)
    return tiled(pixels, 2, lambda t, p: (edge_of(t, p, kind, axis, mode),), mode=mode)


def edge_of(t: Tile, p: Plane, kind: str, axis: str, mode: str = "reflect") -> Plane:
    smooth, derive = (FARID_SMOOTH, FARID_EDGE) if kind == "farid" else (SMOOTH[kind], DERIVATIVE)
    # Kernels of convolutions are turned round for a correlation.
    return t.correlate1d(t.correlate1d(p, derive[::-1], axis, mode), smooth, "x" if axis == "y" else "y", mode)


def edge_magnitude(pixels: DataFrame, kind: str, mode: str = "reflect") -> DataFrame:
    _known(mode)

    def steps(t: Tile, p: Plane) -> tuple[Plane]:
        a, b = edge_of(t, p, kind, "y", mode), edge_of(t, p, kind, "x", mode)
        return (a.map(np.sqrt((a.v * a.v + b.v * b.v) / 2)),)

    return tiled(pixels, 2, steps, mode=mode)


def laplace(pixels: DataFrame, mode: str = "reflect") -> DataFrame:
    second = [-1.0, 2.0, -1.0]
    return _zip(correlate1d(pixels, second, "y", mode), correlate1d(pixels, second, "x", mode), lambda a, b: a + b)


def difference_of_gaussians(pixels: DataFrame, low: float, high: float | None = None, mode: str = "nearest") -> DataFrame:
    return _zip(gaussian(pixels, low, mode), gaussian(pixels, high or 1.6 * low, mode), lambda a, b: a - b)


def unsharp_mask(pixels: DataFrame, radius: float = 1.0, amount: float = 1.0, preserve_range: bool = False) -> DataFrame:
    """Sharpen by what a Gaussian (mode reflect) takes away; clipped to [0, 1], or [-1, 1] where an image has negatives."""
    out = _zip(pixels.select("image_id", "y", "x", "v"), gaussian(pixels, radius, "reflect"), lambda v, g: v + (v - g) * amount)
    if preserve_range:
        return out
    low = pixels.groupBy("image_id").agg(F.when(F.min("v") < 0, F.lit(-1.0)).otherwise(F.lit(0.0)).alias("_low"))
    return out.join(low, "image_id").select("image_id", "y", "x", F.least(F.greatest("v", "_low"), F.lit(1.0)).alias("v"))


# -- any footprint -----------------------------------------------------------------


def rectangle(height: int, width: int) -> list[tuple[int, int]]:
    return [(dy - height // 2, dx - width // 2) for dy in range(height) for dx in range(width)]


def diamond(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy, dx in rectangle(2 * radius + 1, 2 * radius + 1) if abs(dy) + abs(dx) <= radius]


def disk(radius: int, strict: bool = True) -> list[tuple[int, int]]:
    limit = radius**2 if strict else (radius + 0.5) ** 2
    return [(dy, dx) for dy, dx in rectangle(2 * radius + 1, 2 * radius + 1) if dy * dy + dx * dx <= limit]


def mirror(footprint: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return sorted((-dy, -dx) for dy, dx in footprint)


def shapes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))


def gather(pixels: DataFrame, offsets: list[tuple], aggregates: list[Column], mode: str = "reflect", cval: float | None = 0.0) -> DataFrame:
    """For each place the aggregates over its neighbours ``n`` (with ``weight`` where offsets have one).

    ``cval`` None leaves places outside out, with mode "constant".
    """
    rows = [(dy, dx, float(w[0]) if w else 1.0) for dy, dx, *w in offsets]
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx"), F.lit(w).alias("weight")) for dy, dx, w in rows])
    places = pixels.select("image_id", "y", "x").join(shapes(pixels), "image_id").withColumn("_s", F.explode(steps))
    wanted = places.select("image_id", "y", "x", fold(F.col("y") + F.col("_s.dy"), F.col("_h"), mode).alias("_y"), fold(F.col("x") + F.col("_s.dx"), F.col("_w"), mode).alias("_x"), F.col("_s.weight").alias("weight"))
    sources = pixels.select("image_id", F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("v").alias("n"))
    inside = mode != "constant" or cval is None
    got = wanted.join(sources, ["image_id", "_y", "_x"], "inner" if inside else "left")
    if not inside:
        got = got.withColumn("n", F.coalesce("n", F.lit(float(cval))))
    return got.groupBy("image_id", "y", "x").agg(*aggregates)


def correlate(pixels: DataFrame, kernel: list[tuple[int, int, float]], mode: str = "reflect", cval: float = 0.0) -> DataFrame:
    _known(mode)
    return tiled(pixels, far(kernel), lambda t, p: (t.correlate(p, kernel, mode, cval),), mode=mode)


def far(offsets: list[tuple]) -> int:
    """How many rows or columns away the farthest of ``offsets`` is."""
    return max((max(abs(o[0]), abs(o[1])) for o in offsets), default=0)


def roberts_diagonal(pixels: DataFrame, positive: bool = True) -> DataFrame:
    """The difference along one diagonal of the 2 x 2 square that begins at each place."""
    return correlate(pixels, [(0, 0, -1.0), (1, 1, 1.0)] if positive else [(0, 1, -1.0), (1, 0, 1.0)])


def roberts(pixels: DataFrame) -> DataFrame:
    return _zip(roberts_diagonal(pixels, True), roberts_diagonal(pixels, False), lambda p, q: F.sqrt((p * p + q * q) / 2))


def erosion(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "reflect") -> DataFrame:
    return _extremes(pixels, [(footprint, False)], mode)


def dilation(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "reflect") -> DataFrame:
    return _extremes(pixels, [(mirror(footprint), True)], mode)


def _extremes(pixels: DataFrame, steps: list[tuple[list, bool]], mode: str) -> DataFrame:
    """Smallest and largest neighbours one after the other, in one go."""
    mode, cval = _border(mode)
    _known(mode)

    def run(t: Tile, p: Plane) -> tuple[Plane]:
        for footprint, largest in steps:
            p = t.extreme(p, footprint, largest, mode, cval)
        return (p,)

    return tiled(pixels, sum(far(f) for f, _ in steps), run, mode=mode)


def _border(mode: str) -> tuple[str, float | None]:
    """"ignore" leaves what is outside out, which is right for binary images too."""
    return ("constant", None) if mode == "ignore" else (mode, 0.0)


def opening(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "reflect") -> DataFrame:
    return _extremes(pixels, [(footprint, False), (mirror(footprint), True)], mode)


def closing(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "reflect") -> DataFrame:
    return _extremes(pixels, [(mirror(footprint), True), (footprint, False)], mode)


def white_tophat(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "reflect") -> DataFrame:
    return _zip(pixels.select("image_id", "y", "x", "v"), opening(pixels, footprint, mode), lambda v, o: v - o)


def black_tophat(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "reflect") -> DataFrame:
    return _zip(closing(pixels, footprint, mode), pixels.select("image_id", "y", "x", "v"), lambda c, v: c - v)


def median(pixels: DataFrame, footprint: list[tuple[int, int]], mode: str = "nearest") -> DataFrame:
    _known(mode)
    return tiled(pixels, far(footprint), lambda t, p: (t.median(p, footprint, mode),), mode=mode)


def local_statistics(pixels: DataFrame, size: int, mode: str = "mirror") -> DataFrame:
    """Mean and standard deviation in a square window around each place: image_id, y, x, m, s."""
    square = pixels.withColumn("v", F.col("v") * F.col("v"))
    both = uniform(pixels, size, mode).withColumnRenamed("v", "m").join(uniform(square, size, mode).withColumnRenamed("v", "q"), ["image_id", "y", "x"])
    return both.select("image_id", "y", "x", "m", F.sqrt(F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0))).alias("s"))


def threshold_niblack(pixels: DataFrame, size: int = 15, k: float = 0.2) -> DataFrame:
    return local_statistics(pixels, size).select("image_id", "y", "x", (F.col("m") - k * F.col("s")).alias("v"))


def threshold_sauvola(pixels: DataFrame, size: int = 15, k: float = 0.2, r: float = 1.0) -> DataFrame:
    return local_statistics(pixels, size).select("image_id", "y", "x", (F.col("m") * (1 + k * (F.col("s") / r - 1))).alias("v"))


def threshold_local(pixels: DataFrame, size: int = 3, method: str = "gaussian", offset: float = 0.0, mode: str = "reflect") -> DataFrame:
    if method == "gaussian":
        out = gaussian(pixels, (size - 1) / 6.0, mode)
    elif method == "mean":
        out = uniform(pixels, size, mode)
    elif method == "median":
        out = median(pixels, rectangle(size, size), mode)
    else:
        raise NotImplementedError(f"threshold_local has no method {method!r}")
    return out.withColumn("v", F.col("v") - offset)


# -- derivatives, corners, ridges ------------------------------------------------------


def structure_tensor(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    """arr, arc, acc: Gaussian means of products of plain Sobel derivatives, zero outside."""
    derive = lambda axis, other: correlate1d(correlate1d(pixels, [-1.0, 0.0, 1.0], axis, "constant"), [1.0, 2.0, 1.0], other, "constant")
    both = derive("y", "x").withColumnRenamed("v", "dy").join(derive("x", "y").withColumnRenamed("v", "dx"), ["image_id", "y", "x"])
    products = {"arr": F.col("dy") * F.col("dy"), "arc": F.col("dy") * F.col("dx"), "acc": F.col("dx") * F.col("dx")}
    out = None
    for name, product in products.items():
        g = gaussian(both.select("image_id", "y", "x", product.alias("v")), sigma, "constant").withColumnRenamed("v", name)
        out = g if out is None else out.join(g, ["image_id", "y", "x"])
    return out


def eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """Of [[a, b], [b, c]], the larger first."""
    root = F.sqrt(4 * b * b + (a - c) * (a - c)) / 2
    return (a + c) / 2 + root, (a + c) / 2 - root


def corner_kitchen_rosenfeld(pixels: DataFrame) -> DataFrame:
    """Curvature of the level line times the gradient, from plain Sobel derivatives; zero where there is no gradient."""
    derive = lambda p, axis, other: correlate1d(correlate1d(p, [-1.0, 0.0, 1.0], axis, "constant"), [1.0, 2.0, 1.0], other, "constant")
    dy, dx = derive(pixels, "y", "x"), derive(pixels, "x", "y")
    parts = {"dy": dy, "dx": dx, "dxy": derive(dx, "y", "x"), "dxx": derive(dx, "x", "y"), "dyy": derive(dy, "y", "x")}
    out = None
    for name, part in parts.items():
        part = part.withColumnRenamed("v", name)
        out = part if out is None else out.join(part, ["image_id", "y", "x"])
    dy, dx = F.col("dy"), F.col("dx")
    bend = F.col("dxx") * dy * dy + F.col("dyy") * dx * dx - 2 * F.col("dxy") * dx * dy
    return out.select("image_id", "y", "x", F.coalesce(F.try_divide(bend, dx * dx + dy * dy), F.lit(0.0)).alias("v"))


def corner_harris(pixels: DataFrame, k: float = 0.05, sigma: float = 1.0) -> DataFrame:
    t = structure_tensor(pixels, sigma)
    det, trace = F.col("arr") * F.col("acc") - F.col("arc") * F.col("arc"), F.col("arr") + F.col("acc")
    return t.select("image_id", "y", "x", (det - k * trace * trace).alias("v"))


def corner_shi_tomasi(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    t = structure_tensor(pixels, sigma)
    return t.select("image_id", "y", "x", eigenvalues(F.col("arr"), F.col("arc"), F.col("acc"))[1].alias("v"))


def corner_foerstner(pixels: DataFrame, sigma: float = 1.0) -> DataFrame:
    """w and q: size and roundness of the error ellipse; zero where there is no gradient."""
    t = structure_tensor(pixels, sigma)
    det, trace = F.col("arr") * F.col("acc") - F.col("arc") * F.col("arc"), F.col("arr") + F.col("acc")
    w, q = F.try_divide(det, trace), F.try_divide(4 * det, trace * trace)
    return t.select("image_id", "y", "x", F.coalesce(w, F.lit(0.0)).alias("w"), F.coalesce(q, F.lit(0.0)).alias("q"))


def peak_local_max(pixels: DataFrame, min_distance: int = 1, threshold: float = 0.0, exclude_border: bool = True) -> DataFrame:
    """Places that are the largest within ``min_distance`` and above the threshold."""
    d, square = min_distance, rectangle(2 * min_distance + 1, 2 * min_distance + 1)

    def steps(t: Tile, p: Plane) -> tuple[Plane]:
        keep = (p.v == t.extreme(p, square, True, "constant", None).v) & (p.v > threshold)
        if exclude_border:
            keep &= ((t.y >= d) & (t.y < t.h - d))[:, None] & ((t.x >= d) & (t.x < t.w - d))[None, :]
        return (Plane(p.v, p.ok & keep),)

    out = tiled(pixels, d, steps).where("v IS NOT NULL")
    return out.select("image_id", "y", "x", "v")
