"""Peaks that keep their distance from better ones."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .stencil import peak_local_max

PLACE = ["image_id", "y", "x"]


def ensure_spacing(points: DataFrame, spacing: float, p_norm: float = math.inf, inclusive: bool = False) -> DataFrame:
    """The points (image_id, y, x, v; whole places) that stay when the best come first and push away what is nearer than ``spacing``.

    The order is by falling v (null last), then y, then x; a place that comes
    more than once counts once, with its largest v. ``inclusive``: what is just
    ``spacing`` away goes too. Points are linked with better ones through cells
    as wide as the spacing, so a point has no more links than places around it.
    In each round the points without a better neighbour push theirs away, which
    gives the same points as going through all of them in order; what is
    decided leaves the links. An empty table gives no rows.
    """
    if p_norm < 1:
        raise ValueError("p_norm must be at least 1")
    best = materialize(points.groupBy(*PLACE).agg(F.max("v").alias("v")), "points")
    side = max(1, math.ceil(spacing))
    cell = lambda c, k=0: F.floor(F.col(c) / side) + k
    near = F.explode(F.array(*[F.struct(cell("y", dy).alias("cy"), cell("x", dx).alias("cx")) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]))
    a = best.select("image_id", F.struct("y", "x").alias("best"), F.col("v").alias("_v"), near.alias("_c"))
    b = best.select("image_id", F.struct("y", "x").alias("other"), F.col("v").alias("_w"), F.struct(cell("y").alias("cy"), cell("x").alias("cx")).alias("_c"))
    dy, dx = (F.abs(F.col(f"best.{c}") - F.col(f"other.{c}")).cast("double") for c in "yx")
    if math.isinf(p_norm):
        apart, reach = F.greatest(dy, dx), float(spacing)
    else:
        apart, reach = F.pow(dy, F.lit(float(p_norm))) + F.pow(dx, F.lit(float(p_norm))), float(spacing) ** p_norm
    rank = lambda v, p: F.struct((-F.coalesce(v, F.lit(-math.inf))).alias("s"), F.col(p).alias("p"))
    first = rank("_v", "best") < rank("_w", "other")
    links = a.join(b, ["image_id", "_c"]).where(first & ((apart <= reach) if inclusive else (apart < reach))).select("image_id", "best", "other")
    links, gone = materialize(links, "links"), []
    while not links.isEmpty():
        tops = links.select("image_id", "best").distinct().join(links.select("image_id", F.col("other").alias("best")).distinct(), ["image_id", "best"], "left_anti")
        pushed = materialize(links.join(tops, ["image_id", "best"]).select("image_id", "other").distinct(), "pushed")
        gone.append(pushed)
        left = links.join(pushed, ["image_id", "other"], "left_anti").join(pushed.withColumnRenamed("other", "best"), ["image_id", "best"], "left_anti")
        links = materialize(left.select("image_id", "best", "other"), "links")
    if not gone:
        return best
    away = reduce(DataFrame.unionByName, gone).select("image_id", F.col("other.y").alias("y"), F.col("other.x").alias("x"))
    return best.join(away, PLACE, "left_anti")


def corner_peaks(pixels: DataFrame, min_distance: int = 1, threshold: float = 0.0, exclude_border: bool = True, p_norm: float = math.inf) -> DataFrame:
    """Peaks of a corner response: of two within ``min_distance`` of each other only the better one stays."""
    return ensure_spacing(peak_local_max(pixels, min_distance, threshold, exclude_border), min_distance, p_norm, inclusive=True)
