"""Convex hulls of regions.

A place stands for the middles of its four sides. Of each half line of a region
only the two outermost points matter, so a region is reduced to two numbers for
each half line by an aggregation before its hull is taken; what one group holds
follows the region's height, never its area. Hulls are in whole half places,
without rounding, and come back as one span of columns for each row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regions import KEY, label

SPAN = "image_id {id}, label long, y int, x0 int, x1 int, feret double"


def _chain(at: np.ndarray, value: np.ndarray) -> list[tuple[int, int]]:
    """The lower boundary of points in the order of ``at`` (Andrew's monotone chain)."""
    kept: list[tuple[int, int]] = []
    for t, v in zip(at.tolist(), value.tolist(), strict=True):
        while len(kept) > 1:
            (a, p), (b, q) = kept[-2:]
            if (q - p) * (t - a) < (v - p) * (b - a):
                break
            kept.pop()
        kept.append((t, v))
    return kept


def _least_places(chain: list[tuple[int, int]], rows: range) -> list[int]:
    """The first whole place on or right of the chain (in half places) at each row."""
    out, i = [], 0
    for y in rows:
        t = 2 * y
        while i + 2 < len(chain) and chain[i + 1][0] < t:
            i += 1
        (a, p), (b, q) = chain[i], chain[i + 1]
        out.append(-(-(p * (b - a) + (q - p) * (t - a)) // (2 * (b - a))))
    return out


def _diameter(points: np.ndarray) -> float:
    """The largest distance between two of the points, among the vertices of their hull only."""
    left = _chain(points[:, 0], points[:, 1])
    right = _chain(points[:, 0], -points[:, 2])
    ends = np.array([*left, *[(t, -v) for t, v in right]], dtype=float)
    return float(max(np.sqrt(((ends - e) ** 2).sum(axis=1)).max() for e in ends))


def hull_spans(labels: DataFrame) -> DataFrame:
    """``(image_id, label, y, x0, x1, feret)``: the columns of each region's hull, row by row.

    ``feret`` is the largest distance between the middles of two places of the
    hull, the same in all rows of a region. Label 0 and null have no hull; an
    image without any label gives no rows.
    """
    ends = labels.where("label <> 0").groupBy(*KEY, "y").agg(F.min("x").alias("a"), F.max("x").alias("b"))
    half = lambda d, e: F.struct((2 * F.col("y") + d).alias("t"), (2 * F.col("a") - e).alias("lo"), (2 * F.col("b") + e).alias("hi"))
    lines = ends.select(*KEY, F.explode(F.array(half(-1, 0), half(0, 1), half(1, 0))).alias("p"))
    lines = lines.groupBy(*KEY, F.col("p.t").alias("t")).agg(F.min("p.lo").cast("long").alias("lo"), F.max("p.hi").cast("long").alias("hi"))

    def spans(group: pd.DataFrame) -> pd.DataFrame:
        g = group.sort_values("t")
        t = g["t"].to_numpy()
        rows = range((int(t[0]) + 1) // 2, int(t[-1]) // 2 + 1)
        x0 = _least_places(_chain(t, g["lo"].to_numpy()), rows)
        x1 = [-x for x in _least_places(_chain(t, -g["hi"].to_numpy()), rows)]
        far = _diameter(np.column_stack([np.array(rows), x0, x1]))
        return pd.DataFrame({"image_id": [g["image_id"].iloc[0]] * len(x0), "label": g["label"].iloc[0], "y": rows, "x0": x0, "x1": x1, "feret": far})

    lines = lines.withColumn("label", F.col("label").cast("long"))
    return lines.groupBy(*KEY).applyInPandas(spans, SPAN.format(id=labels.schema["image_id"].dataType.simpleString()))


def region_convexity(labels: DataFrame) -> DataFrame:
    """``(image_id, label, area_convex, solidity, feret_diameter_max)``."""
    spans = hull_spans(labels).groupBy(*KEY).agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area_convex"), F.max("feret").alias("feret_diameter_max"))
    area = labels.where("label <> 0").groupBy(*KEY).agg(F.count(F.lit(1)).alias("_n"))
    return spans.join(area, KEY).select(*KEY, F.col("area_convex").cast("double").alias("area_convex"), (F.col("_n") / F.col("area_convex")).alias("solidity"), "feret_diameter_max")


def region_image_convex(labels: DataFrame) -> DataFrame:
    """Each region's hull in its box: image_id, label, y, x from the box's corner, ``inside``."""
    box = labels.where("label <> 0").groupBy(*KEY).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.max("x").alias("_w"))
    rows = hull_spans(labels).join(box, KEY)
    cells = rows.select(*KEY, (F.col("y") - F.col("_y0")).alias("y"), F.explode(F.sequence("_x0", "_w")).alias("_x"), "_x0", "x0", "x1")
    return cells.select(*KEY, "y", (F.col("_x") - F.col("_x0")).alias("x"), F.col("_x").between(F.col("x0"), F.col("x1")).alias("inside"))


def _painted(pixels: DataFrame, spans: DataFrame) -> DataFrame:
    """1 in places that any span covers; spans are cut into places first, so that rows meet by equality."""
    covered = spans.select("image_id", "y", F.explode(F.sequence("x0", "x1")).alias("x")).distinct().withColumn("_in", F.lit(1.0))
    return pixels.select("image_id", "y", "x").join(covered, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("_in", F.lit(0.0)).alias("v"))


def convex_hull_image(pixels: DataFrame) -> DataFrame:
    """The hull of all places that are not 0, as 0 and 1; an image of zeros stays so."""
    marked = pixels.select("image_id", "y", "x", (F.col("v") != 0).cast("long").alias("label"))
    return _painted(pixels, hull_spans(marked))


def convex_hull_object(pixels: DataFrame, connectivity: int = 2) -> DataFrame:
    """The union of the hulls of all connected objects, as 0 and 1."""
    binary = pixels.select("image_id", "y", "x", (F.col("v") != 0).cast("double").alias("v"))
    return _painted(pixels, hull_spans(label(binary, connectivity).select("image_id", "y", "x", "label")))
