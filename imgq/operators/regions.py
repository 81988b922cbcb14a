"""Labelled regions: components, relabelling, joins and tables of properties.

``labels``: image_id, y, x, label (0 is the background), with v where
intensities are asked for. A property table is one aggregation of power sums
for each region; every property is an expression over them, so that pruning
columns prunes the sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .stencil import gather, rectangle, shapes

MAX_ROUNDS = 60
KEY = ["image_id", "label"]


def _node(y: str, x: str) -> Column:
    """A value for a place that follows the raster order, whatever the image's size or the kind of its id."""
    return F.struct(F.col("image_id").alias("i"), F.col(y).alias("y"), F.col(x).alias("x"))


def _roots(edges: DataFrame) -> DataFrame:
    """Smallest node that each node of ``edges`` (a > b) reaches: hooking with pointer jumping.

    Written tables of nodes pack so well that their size on disk makes them look
    small enough for a broadcast, which the driver has to hold; all joins say
    that they merge.
    """
    nodes = edges.select(F.col("a").alias("n")).union(edges.select("b")).distinct()
    both = materialize(edges.union(edges.select("b", "a")), "edges")
    parent = materialize(nodes.select("n", F.col("n").alias("p")), "parents")
    for _ in range(MAX_ROUNDS):
        # The smallest parent among the neighbours, handed on to the own parent.
        near = both.join(parent.select(F.col("n").alias("b"), F.col("p").alias("q")).hint("merge"), "b").groupBy("a").agg(F.min("q").alias("q"))
        low = parent.join(near.hint("merge"), F.col("n") == F.col("a")).select("n", "p", F.least("p", "q").alias("q"))
        both_ways = F.explode(F.array(F.struct("n", F.col("q").alias("m")), F.struct(F.col("p").alias("n"), F.col("q").alias("m")))).alias("s")
        step = low.select(both_ways).groupBy("s.n").agg(F.min("s.m").alias("m"))
        new = parent.join(step.hint("merge"), "n").select("n", F.least("p", "m").alias("p"))
        jumped = new.join(new.select(F.col("n").alias("p"), F.col("p").alias("g")).hint("merge"), "p").select("n", F.col("g").alias("p"))
        jumped = materialize(jumped, "parents")
        if jumped.join(parent.withColumnRenamed("p", "o").hint("merge"), "n").where("p <> o").limit(1).count() == 0:
            return jumped
        parent = jumped
    raise RuntimeError("components did not settle")


def label(pixels: DataFrame, connectivity: int = 1, background: float = 0.0) -> DataFrame:
    """Connected places of equal value, numbered in raster order from 1: image_id, y, x, label.

    Runs along rows are the nodes; an edge joins touching runs of neighbouring rows.
    """
    on = pixels.where(F.col("v") != background).select("image_id", "y", "x", "v")
    row = Window.partitionBy("image_id", "y").orderBy("x")
    begins = F.coalesce((F.lag("x").over(row) != F.col("x") - 1) | (F.lag("v").over(row) != F.col("v")), F.lit(True))
    runs = on.withColumn("_s", F.when(begins, _node("y", "x"))).withColumn("run", F.last("_s", ignorenulls=True).over(row)).drop("_s")
    runs = materialize(runs, "runs")
    reach = [0] if connectivity == 1 else [-1, 0, 1]
    below = runs.select("image_id", F.col("run").alias("a"), F.col("v").alias("w"), (F.col("y") - 1).alias("y"), F.explode(F.array(*[F.col("x") + d for d in reach])).alias("x"))
    edges = runs.join(below.hint("merge"), ["image_id", "y", "x"]).where("v = w AND a <> run").select("a", F.col("run").alias("b")).distinct()
    roots = _roots(edges)
    named = runs.join(roots.hint("merge"), F.col("run") == F.col("n"), "left").select("image_id", "y", "x", F.coalesce("p", "run").alias("root"))
    numbers = named.select("image_id", "root").distinct().withColumn("label", F.row_number().over(Window.partitionBy("image_id").orderBy("root")).cast("long"))
    every = pixels.select("image_id", "y", "x").join(named.join(numbers.hint("merge"), ["image_id", "root"]).drop("root").hint("merge"), ["image_id", "y", "x"], "left")
    return every.select("image_id", "y", "x", F.coalesce("label", F.lit(0)).alias("label"))


def relabel_sequential(labels: DataFrame, offset: int = 1) -> DataFrame:
    """Labels renumbered from ``offset`` without gaps in their order; 0 stays."""
    used = labels.where("label <> 0").select(*KEY).distinct()
    lut = used.withColumn("_new", F.row_number().over(Window.partitionBy("image_id").orderBy("label")).cast("long") + (offset - 1))
    return labels.join(lut, KEY, "left").withColumn("label", F.coalesce("_new", F.lit(0))).drop("_new")


def join_segmentations(a: DataFrame, b: DataFrame) -> DataFrame:
    """The common refinement: one label for each pair of labels, 0 only where both are 0."""
    both = a.select("image_id", "y", "x", "label").join(b.select("image_id", "y", "x", F.col("label").alias("other")), ["image_id", "y", "x"])
    pairs = both.select("image_id", "label", "other").distinct()
    lut = pairs.where("label <> 0 OR other <> 0").withColumn("_new", F.row_number().over(Window.partitionBy("image_id").orderBy("label", "other")).cast("long"))
    return both.join(lut, ["image_id", "label", "other"], "left").select("image_id", "y", "x", F.coalesce("_new", F.lit(0)).alias("label"))


def map_array(labels: DataFrame, lut: DataFrame) -> DataFrame:
    """Labels through ``lut`` (label, value); what it does not hold becomes 0."""
    return labels.join(lut, "label", "left").select("image_id", "y", "x", F.coalesce("value", F.lit(0)).alias("value"))


def remove_small_objects(labels: DataFrame, max_size: int = 64) -> DataFrame:
    """Labels of ``max_size`` places or fewer become 0."""
    small = labels.where("label <> 0").groupBy(*KEY).count().where(F.col("count") <= max_size).select(*KEY, F.lit(True).alias("_small"))
    return labels.join(small, KEY, "left").withColumn("label", F.when(F.col("_small"), F.lit(0)).otherwise(F.col("label"))).drop("_small")


def clear_border(labels: DataFrame, buffer: int = 0) -> DataFrame:
    """Labels that touch the border, or come within ``buffer`` of it, become 0."""
    d = buffer
    edge = labels.join(shapes(labels), "image_id").where((F.col("y") <= d) | (F.col("x") <= d) | (F.col("y") >= F.col("_h") - 1 - d) | (F.col("x") >= F.col("_w") - 1 - d))
    gone = edge.where("label <> 0").select(*KEY).distinct().withColumn("_gone", F.lit(True))
    return labels.join(gone, KEY, "left").withColumn("label", F.when(F.col("_gone"), F.lit(0)).otherwise(F.col("label"))).drop("_gone")


def find_boundaries(labels: DataFrame, connectivity: int = 1) -> DataFrame:
    """Thick boundaries: places with another label among their neighbours."""
    steps = [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)] if connectivity == 1 else rectangle(3, 3)
    values = labels.withColumn("v", F.col("label").cast("double"))
    span = gather(values, steps, [F.min("n").alias("a"), F.max("n").alias("b")], "constant", None)
    return span.select("image_id", "y", "x", (F.col("a") != F.col("b")).alias("boundary"))


def expand_labels(labels: DataFrame, distance: int = 1) -> DataFrame:
    """Background within ``distance`` of labels takes the nearest one (ties: the smallest)."""
    steps = [(dy, dx, float(dy * dy + dx * dx)) for dy, dx in rectangle(2 * distance + 1, 2 * distance + 1) if dy * dy + dx * dx <= distance**2]
    values = labels.withColumn("v", F.col("label").cast("double"))
    near = gather(values, steps, [F.min(F.when(F.col("n") != 0, F.struct("weight", "n"))).alias("b")], "constant", None)
    out = labels.select("image_id", "y", "x", "label").join(near, ["image_id", "y", "x"])
    return out.select("image_id", "y", "x", F.when(F.col("label") != 0, F.col("label")).otherwise(F.coalesce(F.col("b.n").cast("long"), F.lit(0))).alias("label"))


def apply_hysteresis_threshold(pixels: DataFrame, low: float, high: float, connectivity: int = 1) -> DataFrame:
    """Components above ``low`` that hold a place above ``high``."""
    parts = label(pixels.withColumn("v", (F.col("v") > low).cast("double")), connectivity)
    both = materialize(parts.join(pixels.select("image_id", "y", "x", "v").hint("merge"), ["image_id", "y", "x"]).select("image_id", "y", "x", "label", (F.col("v") > high).alias("_high")), "parts")
    strong = both.where("_high AND label <> 0").select(*KEY).distinct().withColumn("_on", F.lit(True))
    return both.join(strong.hint("merge"), KEY, "left").select("image_id", "y", "x", F.coalesce("_on", F.lit(False)).alias("mask"))


# -- tables of properties ---------------------------------------------------------------


def _sums(weight: Column | None) -> list[Column]:
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    out = []
    for p in range(4):
        for q in range(4 - p):
            term = F.lit(1.0)
            for c, n in ((y, p), (x, q)):
                for _ in range(n):
                    term = term * c
            out.append(F.sum(term * weight if weight is not None else term).alias(f"{'w' if weight is not None else 's'}{p}{q}"))
    return out


def power_sums(labels: DataFrame, intensity: bool = False) -> DataFrame:
    """The aggregation that all properties follow from, one row for each label but 0."""
    aggregates = [*_sums(None), F.min("y").alias("y0"), F.min("x").alias("x0"), (F.max("y") + 1).alias("y1"), (F.max("x") + 1).alias("x1")]
    if intensity:
        aggregates += [*_sums(F.col("v")), F.min("v").alias("v_min"), F.max("v").alias("v_max"), F.stddev_pop("v").alias("v_std"), F.percentile("v", F.lit(0.5)).alias("v_median")]
    return labels.where("label <> 0").groupBy(*KEY).agg(*aggregates)


def _shifted(p: int, q: int, cy: Column, cx: Column, kind: str) -> Column:
    """The moment (p, q) about (cy, cx), by the binomial theorem."""
    out = F.lit(0.0)
    for i in range(p + 1):
        for j in range(q + 1):
            term = F.lit(float(math.comb(p, i) * math.comb(q, j))) * F.col(f"{kind}{i}{j}")
            for c, n in ((-cy, p - i), (-cx, q - j)):
                for _ in range(n):
                    term = term * c
            out = out + term
    return out


def moment(p: int, q: int, weighted: bool = False) -> Column:
    """Raw, in the coordinates of the bounding box."""
    return _shifted(p, q, F.col("y0").cast("double"), F.col("x0").cast("double"), "w" if weighted else "s")


def centroid(weighted: bool = False) -> tuple[Column, Column]:
    k = "w" if weighted else "s"
    return F.col(f"{k}10") / F.col(f"{k}00"), F.col(f"{k}01") / F.col(f"{k}00")


def central(p: int, q: int, weighted: bool = False) -> Column:
    if (p, q) in ((1, 0), (0, 1)):
        return F.lit(0.0)
    return _shifted(p, q, *centroid(weighted), "w" if weighted else "s")


def normalized(p: int, q: int, weighted: bool = False) -> Column:
    return central(p, q, weighted) / F.pow(central(0, 0, weighted), F.lit((p + q) / 2 + 1))


def hu(weighted: bool = False) -> list[Column]:
    """Hu's seven invariants."""
    n = {(p, q): normalized(p, q, weighted) for p in range(4) for q in range(4 - p) if p + q >= 2}
    a, b = n[3, 0] + n[1, 2], n[2, 1] + n[0, 3]
    c, d = n[3, 0] - 3 * n[1, 2], 3 * n[2, 1] - n[0, 3]
    e, f = n[2, 0] + n[0, 2], n[2, 0] - n[0, 2]
    return [
        e, f * f + 4 * n[1, 1] * n[1, 1], c * c + d * d, a * a + b * b,
        c * a * (a * a - 3 * b * b) + d * b * (3 * a * a - b * b),
        f * (a * a - b * b) + 4 * n[1, 1] * a * b,
        d * a * (a * a - 3 * b * b) - c * b * (3 * a * a - b * b),
    ]


def inertia() -> tuple[Column, Column, Column]:
    """The tensor's entries (0,0), (0,1), (1,1)."""
    n = F.col("s00")
    return central(0, 2) / n, -central(1, 1) / n, central(2, 0) / n


def inertia_eigenvalues() -> tuple[Column, Column]:
    a, b, c = inertia()
    root = F.sqrt(4 * b * b + (a - c) * (a - c)) / 2
    return F.greatest((a + c) / 2 + root, F.lit(0.0)), F.greatest((a + c) / 2 - root, F.lit(0.0))


def inertia_eigenvectors() -> list[tuple[Column, Column]]:
    """Unit vectors (y, x) of the larger and the smaller eigenvalue; the first part that isn't 0 is positive."""
    a, b, c = inertia()
    angle = 0.5 * F.atan2(2 * b, a - c)
    out = []
    for t in (angle, angle + math.pi / 2):
        y, x = F.cos(t), F.sin(t)
        sign = F.when((y > 1e-12) | ((F.abs(y) <= 1e-12) & (x > 0)), 1.0).otherwise(-1.0)
        out.append((y * sign, x * sign))
    return out


def properties() -> dict[str, Column]:
    """Expressions over ``power_sums``; a name that begins with intensity or weighted needs intensities."""
    n = F.col("s00")
    box = ((F.col("y1") - F.col("y0")) * (F.col("x1") - F.col("x0"))).cast("double")
    l1, l2 = inertia_eigenvalues()
    a, b, c = inertia()
    cy, cx = centroid()
    wy, wx = centroid(True)
    angle = F.when(a == c, F.when(b < 0, F.lit(math.pi / 4)).otherwise(F.lit(-math.pi / 4))).otherwise(0.5 * F.atan2(-2 * b, c - a))
    return {
        "num_pixels": n.cast("long"), "area": n, "area_bbox": box, "extent": n / box,
        "bbox_0": F.col("y0"), "bbox_1": F.col("x0"), "bbox_2": F.col("y1"), "bbox_3": F.col("x1"),
        "centroid_0": cy, "centroid_1": cx, "centroid_local_0": cy - F.col("y0"), "centroid_local_1": cx - F.col("x0"),
        "equivalent_diameter_area": F.sqrt(4 * n / math.pi),
        "inertia_tensor_00": a, "inertia_tensor_01": b, "inertia_tensor_11": c, "inertia_tensor_eigvals_0": l1, "inertia_tensor_eigvals_1": l2,
        "axis_major_length": 4 * F.sqrt(l1), "axis_minor_length": 4 * F.sqrt(l2),
        "eccentricity": F.when(l1 == 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(1 - l2 / F.when(l1 == 0, F.lit(1.0)).otherwise(l1), F.lit(0.0)))),
        "orientation": angle,
        "intensity_mean": F.col("w00") / n, "intensity_min": F.col("v_min"), "intensity_max": F.col("v_max"), "intensity_std": F.col("v_std"), "intensity_median": F.col("v_median"),
        "weighted_centroid_0": wy, "weighted_centroid_1": wx,
        "weighted_centroid_local_0": wy - F.col("y0"), "weighted_centroid_local_1": wx - F.col("x0"),
    } | {f"moments_{p}_{q}": moment(p, q) for p in range(4) for q in range(4 - p)} | {
        f"moments_central_{p}_{q}": central(p, q) for p in range(4) for q in range(4 - p)
    } | {f"moments_normalized_{p}_{q}": normalized(p, q) for p in range(4) for q in range(4 - p) if p + q >= 2} | {f"moments_hu_{i}": h for i, h in enumerate(hu())} | {
        f"weighted_moments_{p}_{q}": moment(p, q, True) for p in range(4) for q in range(4 - p)
    } | {f"weighted_moments_central_{p}_{q}": central(p, q, True) for p in range(4) for q in range(4 - p)} | {
        f"weighted_moments_normalized_{p}_{q}": normalized(p, q, True) for p in range(4) for q in range(4 - p) if p + q >= 2
    } | {f"inertia_tensor_eigenvector_{i}_{k}": c for i, v in enumerate(inertia_eigenvectors()) for k, c in enumerate(v)} | {f"weighted_moments_hu_{i}": h for i, h in enumerate(hu(True))}


def region_images(labels: DataFrame) -> DataFrame:
    """Each region cut out by its box: image_id, label, y, x from the box's corner, ``inside``, and v where there are intensities."""
    box = labels.where("label <> 0").groupBy(*KEY).agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.max("y").alias("_y1"), F.max("x").alias("_x1"))
    cells = box.select(*KEY, "_y0", "_x0", "_x1", F.explode(F.sequence("_y0", "_y1")).alias("y"))
    cells = cells.select(*KEY, "_y0", "_x0", "y", F.explode(F.sequence("_x0", "_x1")).alias("x"))
    values = [F.col("label").alias("_own"), *(["v"] if "v" in labels.columns else [])]
    got = cells.join(labels.select("image_id", "y", "x", *values), ["image_id", "y", "x"], "left")
    inside = F.coalesce(F.col("_own") == F.col("label"), F.lit(False))
    v = [F.when(inside, F.col("v")).otherwise(0.0).alias("v")] if "v" in labels.columns else []
    return got.select(*KEY, (F.col("y") - F.col("_y0")).alias("y"), (F.col("x") - F.col("_x0")).alias("x"), inside.alias("inside"), *v)


def region_coords(labels: DataFrame, spacing: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """The places of each region, scaled by ``spacing``: image_id, label, y, x."""
    return labels.where("label <> 0").select(*KEY, *[(F.col(c) * d if d != 1 else F.col(c)).alias(c) for c, d in zip("yx", spacing, strict=True)])


def _as_images(regions: DataFrame) -> DataFrame:
    """Regions that were cut out, as images of their own with v of 0 and 1."""
    return regions.select(F.struct(*KEY).alias("image_id"), "y", "x", F.col("inside").cast("double").alias("v"))


def region_filled(labels: DataFrame) -> DataFrame:
    """``region_images`` with ``inside`` true in holes too: what 4-connected background does not link to the box's border."""
    cut = materialize(_as_images(region_images(labels.select(*KEY, "y", "x"))), "regions")
    holes = label(cut.withColumn("v", 1 - F.col("v")), 1)
    outer = clear_border(holes).select("image_id", "y", "x", (F.col("label") != 0).alias("_hole"))
    both = cut.join(outer, ["image_id", "y", "x"])
    return both.select("image_id.*", "y", "x", ((F.col("v") == 1) | F.col("_hole")).alias("inside"))


def per_region(labels: DataFrame, measure, name: str) -> DataFrame:
    """A measure of whole masks (``image_id`` and ``name``) taken of every region by itself."""
    return measure(_as_images(region_images(labels.select(*KEY, "y", "x")))).select("image_id.*", name)


def moments_coords(points: DataFrame, order: int = 3, centre: bool = False) -> DataFrame:
    """Raw or central moments of points (image_id, y, x), a column for each exponent pair."""
    y, x = F.col("y").cast("double"), F.col("x").cast("double")
    if centre:
        mean = points.groupBy("image_id").agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
        points, y, x = points.join(mean, "image_id"), y - F.col("_cy"), x - F.col("_cx")
    pairs = [(p, q) for p in range(order + 1) for q in range(order + 1)]
    power = lambda c, n: F.pow(c, F.lit(float(n))) if n else F.lit(1.0)
    return points.groupBy("image_id").agg(*[F.sum(power(y, p) * power(x, q)).alias(f"m_{p}_{q}") for p, q in pairs])


def region_table(labels: DataFrame, names: list[str], intensity: bool = False) -> DataFrame:
    known = properties()
    return power_sums(labels, intensity).select(*KEY, *[known[n].alias(n) for n in names])


def boundary_counts(labels: DataFrame) -> DataFrame:
    """Pixels on the image's border and on the region's own rim (4-neighbours), by label."""
    values = labels.withColumn("v", F.col("label").cast("double"))
    rim = gather(values, [(0, 1), (1, 0), (0, -1), (-1, 0)], [F.count(F.lit(1)).alias("k"), F.min("n").alias("a"), F.max("n").alias("b")], "constant", None)
    both = labels.where("label <> 0").join(rim, ["image_id", "y", "x"])
    on_edge = F.col("k") < 4
    outer = on_edge | (F.col("a") != F.col("label")) | (F.col("b") != F.col("label"))
    return both.groupBy(*KEY).agg(F.count_if(on_edge).alias("num_boundary_pixels"), F.count_if(outer).alias("num_perimeter_pixels"))


def euler_number(labels: DataFrame, connectivity: int = 2) -> DataFrame:
    """Objects minus holes, from the counts of 2 x 2 squares around each corner."""
    on = labels.where("label <> 0").select(*KEY, "y", "x")
    corners = on.select(*KEY, F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x"), F.lit(2 * dy + dx).alias("k")) for dy in (0, 1) for dx in (0, 1)])).alias("c"))
    squares = corners.groupBy(*KEY, "c.y", "c.x").agg(F.sum(F.pow(F.lit(2), F.col("c.k")).cast("int")).alias("code"))
    ones = F.count_if(F.col("code").isin(1, 2, 4, 8))
    threes = F.count_if(F.col("code").isin(7, 11, 13, 14))
    diagonal = F.count_if(F.col("code").isin(6, 9))
    sign = -2 if connectivity == 2 else 2
    return squares.groupBy(*KEY).agg(((ones - threes + sign * diagonal) / 4).cast("long").alias("euler_number"))
