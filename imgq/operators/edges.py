"""Canny edges, boundaries drawn on images, total-variation denoising and feature stacks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .filters import hessian_eigenvalues
from .regions import apply_hysteresis_threshold, find_boundaries
from .stencil import edge_magnitude, edge_of, gaussian, gaussian_weights, rectangle
from .tiles import Plane, Tile, tiled

PLACE = ["image_id", "y", "x"]


def _inside(i: np.ndarray, n: int, w: list[float]) -> np.ndarray:
    """The share of the weights at place ``i`` that falls on places 0 to n - 1."""
    r, sums = len(w) // 2, np.array([sum(w[:k]) for k in range(len(w) + 1)])
    i = np.clip(i, 0, n - 1)
    return sums[np.minimum(n - 1 - i, r) + r + 1] - sums[np.maximum(r - i, 0)]


def canny(pixels: DataFrame, sigma: float = 1.0, low: float = 0.1, high: float = 0.2) -> DataFrame:
    """Thin edges: local maxima of the gradient across it, interpolated, kept by hysteresis: image_id, y, x, mask.

    Smoothing leaves out what lies outside the image. Gradients are Sobel sums
    (not means); components of places of at least ``low`` stay that hold one of
    at least ``high``. The outermost places are never edges. Up to the thinned
    edges all runs in tiles, in one go.
    """
    weights = gaussian_weights(sigma) if sigma else [1.0]

    def steps(t: Tile, p: Plane) -> tuple[Plane]:
        soft = t.blur(p, weights, weights, "constant")
        soft = soft.map(soft.v / (_inside(t.y, t.h, weights)[:, None] * _inside(t.x, t.w, weights)[None, :]))
        gy, gx = 4 * edge_of(t, soft, "sobel", "y").v, 4 * edge_of(t, soft, "sobel", "x").v
        g = soft.map(np.hypot(gy, gx))
        n = {o[:2]: v for v, _, o in t.around(g, rectangle(3, 3), "constant", None)}
        steep, same = np.abs(gy) >= np.abs(gx), gy * gx >= 0
        most = np.maximum(np.abs(gy), np.abs(gx))
        w = np.where(most > 0, np.minimum(np.abs(gy), np.abs(gx)) / np.where(most > 0, most, 1.0), 0.0)
        # Along the gradient on both sides: the straight neighbour and the diagonal one, weighed.
        side = lambda k: np.where(steep, (1 - w) * n[k, 0] + w * np.where(same, n[k, k], n[k, -k]), (1 - w) * n[0, k] + w * np.where(same, n[k, k], n[-k, k]))
        inner = ((t.y > 0) & (t.y < t.h - 1))[:, None] & ((t.x > 0) & (t.x < t.w - 1))[None, :]
        thin = inner & (g.v >= low) & (g.v >= side(1)) & (g.v >= side(-1))
        return (g.map(np.where(thin & (g.v > 0), np.where(g.v >= high, 2.0, 1.0), 0.0)),)

    thin = materialize(tiled(pixels, len(weights) // 2 + 2, steps), "thin")
    return apply_hysteresis_threshold(thin, 0.5, 1.5, 2)


def mark_boundaries(pixels: DataFrame, colour: tuple[float, float, float] = (1.0, 1.0, 0.0)) -> DataFrame:
    """The image (r, g, b, label) with the labels' boundaries in one colour."""
    b = find_boundaries(pixels.select(*PLACE, "label"))
    p = pixels.select(*PLACE, "r", "g", "b").join(b, PLACE)
    return p.select(*PLACE, *[F.when(F.col("boundary"), F.lit(c)).otherwise(F.col(k)).alias(k) for k, c in zip("rgb", colour, strict=True)])


def denoise_tv(pixels: DataFrame, weight: float = 0.1, rounds: int = 200, eps: float = 2e-4) -> DataFrame:
    """Chambolle's total-variation denoising.

    Each image stops by itself at the round whose energy differs from that of
    the round before by less than ``eps`` times the first, or after ``rounds``.
    Eight rounds run in tiles at once.
    """
    image = pixels.select(*PLACE, F.col("v").alias("i"))
    now = image.withColumns({"py": F.lit(0.0), "px": F.lit(0.0)})
    state, done = None, None

    def steps(count: int):
        def run(t: Tile, i: Plane, py: Plane, px: Plane) -> tuple[Plane, ...]:
            seen, energies = [], []
            inner_y, inner_x = (t.y < t.h - 1)[:, None], (t.x < t.w - 1)[None, :]
            for _ in range(count):
                d = i.map(-py.v - px.v + t.correlate1d(py, [1.0, 0.0, 0.0], "y", "constant").v + t.correlate1d(px, [1.0, 0.0, 0.0], "x", "constant").v)
                o = i.map(i.v + d.v)
                gy = np.where(inner_y, t.correlate1d(o, [0.0, -1.0, 1.0], "y", "constant").v, 0.0)
                gx = np.where(inner_x, t.correlate1d(o, [0.0, -1.0, 1.0], "x", "constant").v, 0.0)
                g = np.sqrt(gy * gy + gx * gx)
                norm = 1 + 0.25 / weight * g
                py, px = i.map((py.v - 0.25 * gy) / norm), i.map((px.v - 0.25 * gx) / norm)
                seen.append(o)
                energies.append(i.map(d.v * d.v + weight * g))
            return i, py, px, *seen, *energies

        return run

    for first in range(0, rounds, 8):
        block = range(first, min(first + 8, rounds))
        names = ("i", "py", "px", *[f"o{k}" for k in block], *[f"e{k}" for k in block])
        now = materialize(tiled(now, 2 * len(block), steps(len(block)), ("i", "py", "px"), names), "denoised")
        energy = now.groupBy("image_id").agg(*[F.avg(f"e{k}").alias(f"e{k}") for k in block])
        energy = energy.withColumns({"start": F.col("e0"), "before": F.col("e0")}) if state is None else energy.join(state, "image_id")
        settled = lambda k: (F.abs(F.col("before" if k == first else f"e{k - 1}") - F.col(f"e{k}")) < eps * F.col("start")) | (F.col("start") == 0)  # noqa: E731, B023
        stops = [F.when(settled(k), F.lit(k)) for k in block if k > 0]
        stop = F.coalesce(*stops, F.lit(rounds - 1 if block[-1] == rounds - 1 else None).cast("int"))
        energy = materialize(energy.select("image_id", "start", F.col(f"e{block[-1]}").alias("before"), stop.alias("stop")), "energy")
        v = F.coalesce(*[F.when(F.col("stop") == k, F.col(f"o{k}")) for k in block])
        ended = now.join(energy.where(F.col("stop").isNotNull()).select("image_id", "stop"), "image_id").select(*PLACE, v.alias("v"))
        done = ended if done is None else done.unionByName(ended)
        state = energy.where(F.col("stop").isNull()).drop("stop")
        if state.isEmpty():
            break
        now = now.join(state.select("image_id"), "image_id").select(*PLACE, "i", "py", "px")
    return done


def multiscale_basic_features(pixels: DataFrame, sigmas: tuple[float, ...] = (1.0, 2.0)) -> DataFrame:
    """Smoothed intensity, edge strength and Hessian eigenvalues at each scale, side by side."""
    out = pixels.select(*PLACE)
    for s in sigmas:
        g = materialize(gaussian(pixels, s), "smooth")
        name = str(s).replace(".", "_")
        out = out.join(g.withColumnRenamed("v", f"intensity_{name}"), PLACE)
        out = out.join(edge_magnitude(g, "sobel").withColumnRenamed("v", f"edges_{name}"), PLACE)
        out = out.join(hessian_eigenvalues(g, 0.5).withColumnsRenamed({"l1": f"texture_{name}_0", "l2": f"texture_{name}_1"}), PLACE)
    return out
