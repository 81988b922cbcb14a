"""Distances, reconstruction, extrema and outlines of regions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..storage import materialize
from .regions import label
from .stencil import along, correlate, diamond, gather, rectangle
from .tiles import tiled

PLACE = ["image_id", "y", "x"]
FAR = 1e12
MAX_ROUNDS = 500


def distance_transform_edt(mask: DataFrame, sampling: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Exact distance from each place with v <> 0 to the nearest with v = 0.

    One pass along columns finds the distance to the background there, one
    along rows the smallest sum of squares.
    """
    sy, sx = sampling

    def columns(line: Column) -> Column:
        zeros = F.filter(line, lambda p: p["v"] == 0)

        def nearest(p: Column) -> Column:
            d = F.array_min(F.transform(zeros, lambda z: F.abs(z["y"] - p["y"])))
            return F.coalesce(d * sy * d * sy, F.lit(FAR))

        return F.transform(line, nearest)

    def rows(line: Column) -> Column:
        return F.transform(line, lambda p: F.array_min(F.transform(line, lambda q: q["v"] + (q["x"] - p["x"]) * (q["x"] - p["x"]) * sx * sx)))

    squares = along(along(mask, "y", columns), "x", rows)
    return squares.withColumn("v", F.when(F.col("v") >= FAR, F.lit(float("inf"))).otherwise(F.sqrt("v")))


def isotropic(mask: DataFrame, radius: float, kind: str) -> DataFrame:
    """Erosion, dilation, opening or closing by a ball, from the distance transform."""
    if kind in ("opening", "closing"):
        first, then = ("erosion", "dilation") if kind == "opening" else ("dilation", "erosion")
        return isotropic(materialize(isotropic(mask, radius, first), first), radius, then)
    if kind == "erosion":
        return distance_transform_edt(mask).withColumn("v", (F.col("v") > radius).cast("double"))
    inverse = mask.withColumn("v", (F.col("v") == 0).cast("double"))
    return distance_transform_edt(inverse).withColumn("v", (F.col("v") <= radius).cast("double"))


@F.pandas_udf(ArrayType(DoubleType()))
def _sweep(lines: pd.Series, bounds: pd.Series) -> pd.Series:
    """Each line spread forwards and backwards under its bound."""

    def one(v: np.ndarray, m: np.ndarray) -> list[float]:
        out = [float(x) for x in v]
        for order in (range(1, len(out)), range(len(out) - 2, -1, -1)):
            step = 1 if order.step == 1 else -1
            for i in order:
                out[i] = max(out[i], min(float(m[i]), out[i - step]))
        return out

    return pd.Series([one(v, m) for v, m in zip(lines, bounds, strict=True)])


def _sweep_axis(both: DataFrame, axis: str) -> DataFrame:
    """image_id, y, x, v, m with v spread along all lines of one axis."""
    other = "x" if axis == "y" else "y"
    line = F.array_sort(F.collect_list(F.struct(axis, "v", "m")))
    lines = both.groupBy("image_id", other).agg(line.alias("l"))
    part = lambda c: F.transform("l", lambda p: p[c])
    lines = lines.select("image_id", other, part(axis).alias("at"), part("m").alias("m"), _sweep(part("v"), part("m")).alias("v"))
    return lines.select("image_id", other, F.explode(F.arrays_zip("at", "v", "m")).alias("p")).select("image_id", other, F.col("p.at").alias(axis), "p.v", "p.m")


def reconstruction(seed: DataFrame, mask: DataFrame, by_erosion: bool = False, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Geodesic dilation (or erosion) of the seed under (over) the mask until nothing changes, over 8 neighbours.

    Each round spreads along whole columns and rows and then one step to all
    sides, so the number of rounds follows the bends of the way, not its length.
    """
    sign = -1.0 if by_erosion else 1.0
    both = seed.select(*PLACE, (F.col("v") * sign).alias("v")).join(mask.select(*PLACE, (F.col("v") * sign).alias("m")), PLACE)
    now = materialize(both.select(*PLACE, F.least("v", "m").alias("v"), "m"), "seed")
    for _ in range(max_rounds):
        swept = _sweep_axis(_sweep_axis(now, "y"), "x").select(*PLACE, "v", "m")
        near = gather(swept, rectangle(3, 3), [F.max("n").alias("w")], "constant", None)
        new = materialize(swept.join(near, PLACE).select(*PLACE, F.least("w", "m").alias("v"), "m"), "seed")
        if new.join(now.select(*PLACE, F.col("v").alias("o")), PLACE).where("v <> o").limit(1).count() == 0:
            return new.select(*PLACE, (F.col("v") * sign).alias("v"))
        now = new
    raise RuntimeError("the reconstruction did not settle")


def h_maxima(pixels: DataFrame, h: float) -> DataFrame:
    """1 where the image stands at least ``h`` above its reconstruction from h below."""
    back = reconstruction(pixels.withColumn("v", F.col("v") - h), pixels)
    both = pixels.select(*PLACE, "v").join(back.withColumnRenamed("v", "r"), PLACE)
    return both.select(*PLACE, (F.col("v") - F.col("r") >= h - 1e-12).cast("double").alias("v"))


def local_maxima(pixels: DataFrame, connectivity: int = 1, allow_borders: bool = True) -> DataFrame:
    """1 on plateaus of equal values with no higher neighbour."""
    steps = diamond(1) if connectivity == 1 else rectangle(3, 3)
    plateaus = label(pixels.withColumn("v", F.col("v") + 0.0), connectivity, background=float("inf"))
    around = gather(pixels, steps, [F.max("n").alias("top"), F.count(F.lit(1)).alias("k")], "constant", None)
    p = plateaus.join(pixels.select(*PLACE, "v"), PLACE).join(around, PLACE)
    lost = F.col("top") > F.col("v")
    if not allow_borders:
        lost = lost | (F.col("k") < len(steps))
    bad = p.groupBy("image_id", "label").agg(F.bool_or(lost).alias("lost"))
    return p.join(bad, ["image_id", "label"]).select(*PLACE, (~F.col("lost")).cast("double").alias("v"))


def _negative(pixels: DataFrame) -> DataFrame:
    return pixels.withColumn("v", -F.col("v"))


def h_minima(pixels: DataFrame, h: float) -> DataFrame:
    """1 where the image lies at least ``h`` below its reconstruction from h above."""
    return h_maxima(_negative(pixels), h)


def local_minima(pixels: DataFrame, connectivity: int = 1, allow_borders: bool = True) -> DataFrame:
    """1 on plateaus of equal values with no lower neighbour."""
    return local_maxima(_negative(pixels), connectivity, allow_borders)


def remove_small_holes(mask: DataFrame, max_size: int = 64, connectivity: int = 1) -> DataFrame:
    """Background components of at most ``max_size`` places are filled."""
    holes = label(mask.withColumn("v", (F.col("v") == 0).cast("double")), connectivity)
    small = holes.where("label <> 0").groupBy("image_id", "label").count().where(F.col("count") <= max_size).select("image_id", "label", F.lit(True).alias("_s"))
    both = holes.join(small, ["image_id", "label"], "left").join(mask.select(*PLACE, "v"), PLACE)
    return both.select(*PLACE, F.when(F.col("_s"), F.lit(1.0)).otherwise(F.col("v")).alias("v"))


# Weights of the outline's places by the code of their neighbourhood.
OUTLINE = {1.0: (5, 7, 15, 17, 25, 27), math.sqrt(2): (21, 33), (1 + math.sqrt(2)) / 2: (13, 23)}


def perimeter(mask: DataFrame) -> DataFrame:
    """Length of the outline of all places with v = 1, from 4-connected border places: image_id, perimeter."""
    inner = gather(mask, diamond(1), [F.min("n").alias("low"), F.count(F.lit(1)).alias("k")], "constant", None)
    border = mask.select(*PLACE, "v").join(inner, PLACE)
    border = border.select(*PLACE, ((F.col("v") == 1) & ((F.col("low") == 0) | (F.col("k") < 5))).cast("double").alias("v"))
    code = correlate(border, [(dy, dx, 10.0 if dy and dx else 2.0 if dy or dx else 1.0) for dy, dx in rectangle(3, 3)], "constant")
    weight = F.lit(0.0)
    for w, codes in OUTLINE.items():
        weight = F.when(F.col("v").cast("int").isin(list(codes)), F.lit(w)).otherwise(weight)
    return code.groupBy("image_id").agg(F.sum(weight).alias("perimeter"))


# Weights of the sixteen 2 x 2 neighbourhoods by code, for 2 and 4 directions.
_S = math.sqrt(2)
CROFTON = {
    2: [0, math.pi / 2, 0, 0, 0, math.pi / 2, 0, 0, math.pi / 2, math.pi, 0, 0, math.pi / 2, math.pi, 0, 0],
    4: [
        0, math.pi / 4 * (1 + 1 / _S), math.pi / (4 * _S), math.pi / (2 * _S), 0, math.pi / 4 * (1 + 1 / _S), 0, math.pi / (4 * _S),
        math.pi / 4, math.pi / 2, math.pi / (4 * _S), math.pi / (4 * _S), math.pi / 4, math.pi / 2, 0, 0,
    ],
}
#: The neighbourhoods that a place belongs to, with its part of their codes.
CORNERS = [(0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)]


def perimeter_crofton(mask: DataFrame, directions: int = 4) -> DataFrame:
    """Crofton's estimate of the outline's length: image_id, perimeter.

    Only places with v <> 0 are sent on, as empty neighbourhoods weigh nothing;
    an image without any has length 0.
    """
    corner = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(k).alias("k")) for dy, dx, k in CORNERS])).alias("c")
    codes = mask.where("v <> 0").select("image_id", corner).groupBy("image_id", "c.y", "c.x").agg(F.sum("c.k").cast("int").alias("code"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in CROFTON[directions]]), F.col("code") + 1)
    lengths = codes.groupBy("image_id").agg(F.sum(weight).alias("perimeter"))
    return mask.select("image_id").distinct().join(lengths, "image_id", "left").select("image_id", F.coalesce("perimeter", F.lit(0.0)).alias("perimeter"))


def rolling_ball(pixels: DataFrame, radius: int) -> DataFrame:
    """The background that a ball rolled below the surface traces."""
    ball = [(dy, dx, math.sqrt(radius**2 - dy * dy - dx * dx)) for dy, dx in rectangle(2 * radius + 1, 2 * radius + 1) if dy * dy + dx * dx <= radius**2]
    steps = [(dy, dx, radius - k) for dy, dx, k in ball]
    return tiled(pixels, radius, lambda t, p: (t.extreme(p, steps, False, "constant", None),))
