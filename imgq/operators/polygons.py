"""Chains of points with fewer points."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize


def _from_segment() -> Column:
    """Distance of y, x from the segment between the points ``a`` and ``b``, to nine digits; beyond its ends that from the nearer end."""
    dy, dx = F.col("b.y") - F.col("a.y"), F.col("b.x") - F.col("a.x")
    py, px, qy, qx = F.col("y") - F.col("a.y"), F.col("x") - F.col("a.x"), F.col("y") - F.col("b.y"), F.col("x") - F.col("b.x")
    beside = (py * dy + px * dx > 0) & (-qy * dy - qx * dx > 0)
    across = F.abs(py * dx - px * dy) / F.sqrt(dy * dy + dx * dx)
    return F.round(F.when(beside, across).otherwise(F.least(F.sqrt(py * py + px * px), F.sqrt(qy * qy + qx * qx))), 9)


def approximate_polygon(points: DataFrame, tolerance: float) -> DataFrame:
    """The points (chain_id, i, y, x) that Douglas and Peucker keep, for all chains at once.

    A chain runs by rising i, each of which it has once; its ends stay (a
    closed chain repeats its first point under its last i). Every round splits
    each segment at the farthest of its points (ties: the smallest i) if that
    is farther than ``tolerance``, so the rounds follow the depth of the
    splits. What lies between is summed up before the shuffle, so a long chain
    is no hot group; points of finished segments leave. With a tolerance of 0
    or less all points stay. Points with a null coordinate or i are left out;
    an empty table gives no rows.
    """
    whole = points.select("chain_id", "i", F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x")).dropna(subset=["i", "y", "x"])
    if tolerance <= 0:
        return whole
    point = F.struct("i", "y", "x")
    same = lambda u, v: u.join(v.withColumnRenamed("chain_id", "_c"), F.col("chain_id").eqNullSafe(F.col("_c"))).drop("_c")
    ends = materialize(whole.groupBy("chain_id").agg(F.min_by(point, "i").alias("a"), F.max_by(point, "i").alias("b")), "ends")
    kept = [ends.select("chain_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("p"))]
    between = (F.col("i") > F.col("a.i")) & (F.col("i") < F.col("b.i"))
    left = materialize(same(whole, ends).where(between), "open")
    while True:
        far = F.struct(_from_segment().alias("d"), (-F.col("i")).alias("m"), "y", "x")
        tops = left.groupBy("chain_id", F.col("a.i").alias("_a")).agg(F.max(far).alias("t")).where(F.col("t.d") > tolerance)
        tops = materialize(tops.select("chain_id", "_a", F.struct((-F.col("t.m")).alias("i"), "t.y", "t.x").alias("p")), "splits")
        if tops.isEmpty():
            break
        kept.append(tops.select("chain_id", "p"))
        hit = tops.withColumnsRenamed({"chain_id": "_c"})
        split = left.join(hit, F.col("chain_id").eqNullSafe(F.col("_c")) & (F.col("a.i") == F.col("_a"))).where("i <> p.i")
        before = F.col("i") < F.col("p.i")
        left = materialize(split.select("chain_id", "i", "y", "x", F.when(before, F.col("a")).otherwise(F.col("p")).alias("a"), F.when(before, F.col("p")).otherwise(F.col("b")).alias("b")), "open")
    return reduce(DataFrame.unionByName, kept).select("chain_id", "p.i", "p.y", "p.x")
