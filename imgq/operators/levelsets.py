"""Level sets: initial shapes, morphological curvature and contours that evolve by it."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, materialize
from .filters import gaussian_gradient_magnitude
from .stencil import dilation, gather, rectangle, shapes

PLACE = ["image_id", "y", "x"]
#: Segments of three places in four directions.
SEGMENTS = [[(-dy, -dx), (0, 0), (dy, dx)] for dy, dx in ((1, 1), (1, 0), (1, -1), (0, 1))]


def disk_level_set(pixels: DataFrame, centre: tuple[int, int] | None = None, radius: float | None = None) -> DataFrame:
    """1 inside a disk, by default in the middle and 3/8 of the shorter side: image_id, y, x, v."""
    p = pixels.select(*PLACE).join(shapes(pixels), "image_id")
    cy, cx = (F.lit(c) for c in centre) if centre else (F.floor(F.col("_h") / 2), F.floor(F.col("_w") / 2))
    r = F.lit(float(radius)) if radius is not None else F.least("_h", "_w") * 3 / 8
    inside = F.sqrt(F.pow(F.col("y") - cy, F.lit(2.0)) + F.pow(F.col("x") - cx, F.lit(2.0))) < r
    return p.select(*PLACE, inside.cast("double").alias("v"))


def checkerboard_level_set(pixels: DataFrame, square: int = 5) -> DataFrame:
    odd = (F.floor(F.col("y") / square) + F.floor(F.col("x") / square)) % 2
    return pixels.select(*PLACE, odd.cast("double").alias("v"))


def sup_inf(level_set: DataFrame) -> DataFrame:
    """Where some segment around a place is all 1; outside is 0."""
    return _over_segments(level_set, F.min, F.greatest)


def inf_sup(level_set: DataFrame) -> DataFrame:
    """Where every segment around a place holds a 1."""
    return _over_segments(level_set, F.max, F.least)


def _over_segments(level_set: DataFrame, within, among) -> DataFrame:
    # One gathering of the eight neighbours; which segment each is of follows from its number.
    steps = [(dy, dx, float(k)) for k, s in enumerate(SEGMENTS) for dy, dx in s]
    parts = [within(F.when(F.col("weight") == k, F.col("n"))).alias(f"s{k}") for k in range(len(SEGMENTS))]
    got = gather(level_set, steps, parts, "constant", 0.0)
    return got.select(*PLACE, among(*[f"s{k}" for k in range(len(SEGMENTS))]).alias("v"))


def inverse_gaussian_gradient(pixels: DataFrame, alpha: float = 100.0, sigma: float = 5.0) -> DataFrame:
    """Near 1 where the image is flat, near 0 at edges."""
    return gaussian_gradient_magnitude(pixels, sigma, "nearest").select(*PLACE, (1 / F.sqrt(1 + alpha * F.col("v"))).alias("v"))


def _slopes(column: str) -> tuple[Column, Column]:
    """Central differences along y and x, one-sided at the ends."""
    out = []
    for axis, other in (("y", "x"), ("x", "y")):
        line = Window.partitionBy("image_id", other).orderBy(axis)
        a, b, v = F.lag(column).over(line), F.lead(column).over(line), F.col(column)
        out.append(F.when(a.isNull(), F.coalesce(b - v, F.lit(0.0))).when(b.isNull(), v - a).otherwise((b - a) / 2))
    return out[0], out[1]


def _smoothed(u: DataFrame, times: int, turn: int) -> tuple[DataFrame, int]:
    """Curvature steps; the two compositions take turns over all rounds."""
    for _ in range(times):
        u = sup_inf(inf_sup(u)) if turn % 2 == 0 else inf_sup(sup_inf(u))
        turn += 1
    return u, turn


def morphological_chan_vese(pixels: DataFrame, rounds: int, level_set: DataFrame, smoothing: int = 1, inside: float = 1.0, outside: float = 1.0) -> DataFrame:
    """The level set (v of 0 and 1) after ``rounds``, drawn to regions of even intensity.

    Each round is one aggregate of the image and a written table.
    """
    image = pixels.select(*PLACE, F.col("v").alias("i"))
    u, turn = level_set.select(*PLACE, (F.col("v") > 0).cast("double").alias("v")), 0
    for _ in range(rounds):
        both = image.join(u, PLACE)
        v, i = F.col("v"), F.col("i")
        means = both.groupBy("image_id").agg((F.sum(i * (1 - v)) / (F.sum(1 - v) + 1e-8)).alias("_c0"), (F.sum(i * v) / (F.sum(v) + 1e-8)).alias("_c1"))
        gy, gx = _slopes("v")
        pull = (F.abs(gy) + F.abs(gx)) * (inside * (i - F.col("_c1")) * (i - F.col("_c1")) - outside * (i - F.col("_c0")) * (i - F.col("_c0")))
        drawn = both.join(means, "image_id").withColumn("_pull", pull)
        u, turn = _smoothed(drawn.select(*PLACE, F.when(F.col("_pull") < 0, 1.0).when(F.col("_pull") > 0, 0.0).otherwise(v).alias("v")), smoothing, turn)
        u = materialize(u, "level-set")
    return u


def morphological_geodesic_active_contour(image: DataFrame, rounds: int, level_set: DataFrame, threshold: float, smoothing: int = 1, balloon: float = 0.0) -> DataFrame:
    """The level set after ``rounds``, drawn to the low places of ``image`` (such as an inverse gradient)."""
    gy, gx = _slopes("v")
    slopes = materialize(image.select(*PLACE, F.col("v").alias("i"), gy.alias("iy"), gx.alias("ix")), "slopes")
    u, turn = level_set.select(*PLACE, (F.col("v") > 0).cast("double").alias("v")), 0
    square = rectangle(3, 3)
    for _ in range(rounds):
        if balloon:
            grown = dilation(u, square, "ignore") if balloon > 0 else gather(u, square, [F.min("n").alias("v")], "constant", 0.0)
            moved = grown.withColumnRenamed("v", "_g").join(u, PLACE).join(slopes.select(*PLACE, "i"), PLACE)
            u = moved.select(*PLACE, F.when(F.col("i") > threshold / abs(balloon), F.col("_g")).otherwise(F.col("v")).alias("v"))
        both = u.join(slopes, PLACE)
        uy, ux = _slopes("v")
        drawn = both.withColumn("_pull", F.col("iy") * uy + F.col("ix") * ux)
        u, turn = _smoothed(drawn.select(*PLACE, F.when(F.col("_pull") > 0, 1.0).when(F.col("_pull") < 0, 0.0).otherwise(F.col("v")).alias("v")), smoothing, turn)
        u = materialize(u, "level-set")
    return u


def chan_vese(pixels: DataFrame, level_set: DataFrame | None = None, mu: float = 0.25, inside: float = 1.0, outside: float = 1.0, tolerance: float = 1e-3, max_rounds: int = 500, step: float = 0.5) -> DataFrame:
    """Two regions of even intensity, by a level set that evolves: image_id, y, x, v, ``phi`` and ``mask`` (phi over 0).

    Values are stretched to [0, 1] for each image first. The level set begins as
    ``level_set`` (v) or a product of sines with squares of five places. Each
    round is one aggregate, two windows and a written table, after which those of
    the round before are deleted; an image stops once the root mean square of its
    change is at most ``tolerance``.
    """
    span = pixels.groupBy("image_id").agg(F.min("v").alias("_a"), F.max("v").alias("_b"))
    even = F.coalesce(F.try_divide(F.col("v") - F.col("_a"), F.when(F.col("_b") != F.col("_a"), F.col("_b") - F.col("_a"))), F.lit(0.0))
    image = pixels.join(span, "image_id").select(*PLACE, even.cast("double").alias("i"))
    if level_set is None:
        level_set = pixels.select(*PLACE, (F.sin(F.col("y") * F.lit(math.pi / 5)) * F.sin(F.col("x") * F.lit(math.pi / 5))).alias("v"))
    now = materialize(image.join(level_set.select(*PLACE, F.col("v").cast("double").alias("phi")), PLACE).withColumn("moving", F.lit(True)), "level-set")
    for _ in range(max_rounds):
        phi, i, on = F.col("phi"), F.col("i"), (F.col("phi") > 0).cast("double")
        mean = lambda h: F.sum(F.col("i") * h) / F.when(F.sum(h) == 0, F.lit(1.0)).otherwise(F.sum(h))
        means = now.where("moving").groupBy("image_id").agg(mean(on).alias("_c1"), mean(1 - on).alias("_c2"))
        near = {}
        for axis, other in (("y", "x"), ("x", "y")):
            line = Window.partitionBy("image_id", other).orderBy(axis)
            near[axis] = F.coalesce(F.lag("phi").over(line), phi), F.coalesce(F.lead("phi").over(line), phi)
        both = now.where("moving").withColumns({"_u": near["y"][0], "_d": near["y"][1], "_l": near["x"][0], "_r": near["x"][1]}).join(means, "image_id")
        # One weight for each neighbour: the curvature's denominators on the four sides of a place.
        across_y, across_x = F.pow((F.col("_d") - F.col("_u")) / 2, F.lit(2.0)), F.pow((F.col("_r") - F.col("_l")) / 2, F.lit(2.0))
        weights = {n: 1 / F.sqrt(1e-16 + F.pow(phi - F.col(n), F.lit(2.0)) + (across_y if n in ("_l", "_r") else across_x)) for n in ("_r", "_l", "_d", "_u")}
        bend, total = sum((F.col(n) * w for n, w in weights.items()), F.lit(0.0)), sum(weights.values(), F.lit(0.0))
        force = outside * F.pow(i - F.col("_c2"), F.lit(2.0)) - inside * F.pow(i - F.col("_c1"), F.lit(2.0))
        pace = step / (1 + phi * phi)
        moved = both.select(*PLACE, "i", phi.alias("_old"), ((phi + pace * (mu * bend + force)) / (1 + mu * pace * total)).alias("phi"))
        moved = materialize(moved, "level-set")
        change = moved.groupBy("image_id").agg((F.sqrt(F.avg(F.pow(F.col("phi") - F.col("_old"), F.lit(2.0)))) > tolerance).alias("moving"))
        before = now
        now = materialize(moved.join(change, "image_id").select(*PLACE, "i", "phi", "moving").unionByName(before.where("NOT moving")), "level-set")
        drop(moved)
        drop(before)
        if now.where("moving").isEmpty():
            break
    return now.select(*PLACE, F.col("i").alias("v"), "phi", (F.col("phi") > 0).alias("mask"))
