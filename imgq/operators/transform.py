"""Geometry: flips, crops, blocks, integral images, pyramids and warps."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import splines
from .stencil import fold, gaussian, shapes

PLACE = ["image_id", "y", "x"]


def flip(pixels: DataFrame, axis: str) -> DataFrame:
    size = "_h" if axis == "y" else "_w"
    return pixels.join(shapes(pixels), "image_id").withColumn(axis, F.col(size) - 1 - F.col(axis)).drop("_h", "_w")


def rotate90(pixels: DataFrame, turns: int = 1) -> DataFrame:
    """Quarter turns against the clock."""
    turns %= 4
    if not turns:
        return pixels
    p = pixels.join(shapes(pixels), "image_id")
    y, x, h, w = (F.col(c) for c in ("y", "x", "_h", "_w"))
    ny, nx = {1: (w - 1 - x, y), 2: (h - 1 - y, w - 1 - x), 3: (x, h - 1 - y)}[turns]
    return p.select("image_id", ny.cast("int").alias("y"), nx.cast("int").alias("x"), "v")


def crop(pixels: DataFrame, top: int, bottom: int, left: int, right: int) -> DataFrame:
    p = pixels.join(shapes(pixels), "image_id").where((F.col("y") >= top) & (F.col("y") < F.col("_h") - bottom) & (F.col("x") >= left) & (F.col("x") < F.col("_w") - right))
    return p.select("image_id", (F.col("y") - top).alias("y"), (F.col("x") - left).alias("x"), "v")


def block_reduce(pixels: DataFrame, height: int, width: int, aggregate, cval: float = 0.0) -> DataFrame:
    """``aggregate`` over blocks; ones that stick out are padded with ``cval``: sum and mean take it into account."""
    key = [(F.col("y") / height).cast("int").alias("y"), (F.col("x") / width).cast("int").alias("x")]
    n = height * width
    total = pixels.groupBy("image_id", *key).agg(aggregate("v").alias("v"), F.count(F.lit(1)).alias("_n"), F.sum("v").alias("_s"))
    padded = aggregate.__name__
    if padded in ("avg", "mean"):
        total = total.withColumn("v", (F.col("_s") + (n - F.col("_n")) * cval) / n)
    elif padded == "sum":
        total = total.withColumn("v", F.col("_s") + (n - F.col("_n")) * cval)
    elif padded in ("min", "max"):
        pick = F.least if padded == "min" else F.greatest
        total = total.withColumn("v", F.when(F.col("_n") < n, pick("v", F.lit(float(cval)))).otherwise(F.col("v")))
    return total.select(*PLACE, "v")


def downscale_local_mean(pixels: DataFrame, height: int, width: int) -> DataFrame:
    return block_reduce(pixels, height, width, F.avg)


def integral_image(pixels: DataFrame) -> DataFrame:
    """Sums over all places above and to the left, both included."""
    down = Window.partitionBy("image_id", "x").orderBy("y")
    right = Window.partitionBy("image_id", "y").orderBy("x")
    return pixels.withColumn("v", F.sum("v").over(down)).withColumn("v", F.sum("v").over(right)).select(*PLACE, "v")


def integrate(integral: DataFrame, boxes: DataFrame) -> DataFrame:
    """Sums over ``boxes`` (image_id, box, y0, x0, y1, x1; ends included) by four look-ups each."""
    corner = lambda y, x, s: F.struct(y.alias("y"), x.alias("x"), F.lit(s).alias("s"))
    y0, x0, y1, x1 = (F.col(c) for c in ("y0", "x0", "y1", "x1"))
    corners = boxes.select("image_id", "box", F.explode(F.array(corner(y1, x1, 1.0), corner(y0 - 1, x1, -1.0), corner(y1, x0 - 1, -1.0), corner(y0 - 1, x0 - 1, 1.0))).alias("c"))
    got = corners.select("image_id", "box", F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.s").alias("s")).join(integral, PLACE)
    return got.groupBy("image_id", "box").agg(F.sum(F.col("v") * F.col("s")).alias("v"))


def warp(pixels: DataFrame, height: int, width: int, inverse, order: int = 1, mode: str = "constant", cval: float = 0.0) -> DataFrame:
    """Each output place (y, x) takes its value at ``inverse(y, x)`` of the input: nearest (0), bilinear (1) or by a spline of order 2 to 5."""
    grid = pixels.select("image_id").distinct().join(shapes(pixels), "image_id")
    grid = grid.select("image_id", "_h", "_w", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y")).select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    sy, sx = inverse(F.col("y").cast("double"), F.col("x").cast("double"))
    grid = grid.withColumns({"_sy": sy, "_sx": sx})
    if order == 0:
        corners = [(F.floor(F.col("_sy") + 0.5), F.floor(F.col("_sx") + 0.5), F.lit(1.0))]
    elif order == 1:
        y0, x0 = F.floor("_sy"), F.floor("_sx")
        fy, fx = F.col("_sy") - y0, F.col("_sx") - x0
        corners = [(y0, x0, (1 - fy) * (1 - fx)), (y0, x0 + 1, (1 - fy) * fx), (y0 + 1, x0, fy * (1 - fx)), (y0 + 1, x0 + 1, fy * fx)]
    else:
        return _warp_by_spline(pixels, grid, order, mode, cval)
    rows = F.array(*[F.struct(fold(y.cast("int"), F.col("_h"), mode).alias("y"), fold(x.cast("int"), F.col("_w"), mode).alias("x"), w.alias("w")) for y, x, w in corners])
    wanted = grid.select(*PLACE, F.explode(rows).alias("c")).select(F.col("image_id"), F.col("y").alias("oy"), F.col("x").alias("ox"), F.col("c.y").alias("y"), F.col("c.x").alias("x"), F.col("c.w").alias("w"))
    got = wanted.join(pixels.select(*PLACE, "v"), PLACE, "left").withColumn("v", F.coalesce("v", F.lit(float(cval))))
    return got.groupBy("image_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def _warp_by_spline(pixels: DataFrame, grid: DataFrame, order: int, mode: str, cval: float) -> DataFrame:
    (ys, in_y), (xs, in_x) = splines.taps(F.col("_sy"), F.col("_h"), order, mode), splines.taps(F.col("_sx"), F.col("_w"), order, mode)
    tap = lambda t: F.array(*[F.struct(p.alias("at"), w.alias("w")) for p, w in t])
    wide = grid.select(*PLACE, (in_y & in_x).alias("_in"), tap(xs).alias("_xs"), F.explode(tap(ys)).alias("_t")).select(*PLACE, "_in", "_t", F.explode("_xs").alias("_u"))
    wanted = wide.select("image_id", F.col("y").alias("oy"), F.col("x").alias("ox"), "_in", F.col("_t.at").alias("y"), F.col("_u.at").alias("x"), (F.col("_t.w") * F.col("_u.w")).alias("w"))
    got = wanted.join(splines.coefficients(pixels, order, mode), PLACE)
    return got.groupBy("image_id", F.col("oy").alias("y"), F.col("ox").alias("x")).agg(F.when(F.first("_in"), F.sum(F.col("v") * F.col("w"))).otherwise(F.lit(float(cval))).alias("v"))


def zoom(pixels: DataFrame, factor_y: Column | float, factor_x: Column | float) -> DataFrame:
    """Zoomed about the middle, in the size that the image had: parts cut off, or the border spread out.

    A place of the zoomed image is the mean of all places that it touches. The
    factors may be columns of ``image_id``; one that enlarges beside one that
    reduces raises an error. A side that rounds to its own size stays as it is;
    an image that a side of is reduced to nothing has no rows.
    """
    col = lambda f: f if isinstance(f, Column) else F.lit(float(f))
    sizes = shapes(pixels).withColumns({"_fh": F.floor(F.col("_h") * col(factor_y)).cast("long"), "_fw": F.floor(F.col("_w") * col(factor_x)).cast("long")})
    p = pixels.select(*PLACE, "v").join(sizes, "image_id")
    parted = (F.col("_fh") > F.col("_h")) & (F.col("_fw") < F.col("_w")) | (F.col("_fh") < F.col("_h")) & (F.col("_fw") > F.col("_w"))
    p = p.where(F.when(~parted, (F.col("_fh") > 0) & (F.col("_fw") > 0)).otherwise(F.raise_error(F.lit("a zoom must enlarge both sides or reduce both"))))
    touched = lambda c, n, m: F.explode(F.sequence(F.floor(F.col(c) * F.col(m) / F.col(n)), F.ceil((F.col(c) + 1) * F.col(m) / F.col(n)) - 1))
    off = lambda n, m: F.floor(F.abs(F.col(m) - F.col(n)) / 2)
    wide = p.withColumn("_oy", touched("y", "_h", "_fh")).withColumn("_ox", touched("x", "_w", "_fw"))
    shown = lambda o, n, m: (F.col(m) <= F.col(n)) | (F.col(o) >= off(n, m)) & (F.col(o) < off(n, m) + F.col(n))
    means = wide.where(shown("_oy", "_h", "_fh") & shown("_ox", "_w", "_fw")).groupBy("image_id", "_oy", "_ox", "_h", "_w", "_fh", "_fw").agg(F.avg("v").alias("v"))

    def places(o: str, n: str, m: str) -> Column:
        k = F.when(F.col(m) > F.col(n), F.col(o) - off(n, m)).otherwise(F.col(o) + off(n, m))
        low = F.when((F.col(m) < F.col(n)) & (F.col(o) == 0), F.lit(0)).otherwise(k)
        high = F.when((F.col(m) < F.col(n)) & (F.col(o) == F.col(m) - 1), F.col(n) - 1).otherwise(k)
        return F.explode(F.sequence(low.cast("int"), high.cast("int")))

    return means.withColumn("y", places("_oy", "_h", "_fh")).withColumn("x", places("_ox", "_w", "_fw")).select(*PLACE, "v")


def resize(pixels: DataFrame, shape: tuple[int, int], height: int, width: int, order: int = 1, mode: str = "reflect") -> DataFrame:
    """Images of ``shape`` to height x width, pixel centres on pixel centres."""
    fy, fx = shape[0] / height, shape[1] / width
    return warp(pixels, height, width, lambda y, x: ((y + 0.5) * fy - 0.5, (x + 0.5) * fx - 0.5), order, mode)


def affine(matrix: np.ndarray):
    """The inverse map of an affine transform given as a 3 x 3 matrix on (x, y)."""
    m = np.linalg.inv(np.asarray(matrix, dtype=float))

    def inverse(y: Column, x: Column) -> tuple[Column, Column]:
        return float(m[1, 0]) * x + float(m[1, 1]) * y + float(m[1, 2]), float(m[0, 0]) * x + float(m[0, 1]) * y + float(m[0, 2])

    return inverse


def euclidean_matrix(rotation: float = 0.0, translation: tuple[float, float] = (0.0, 0.0), scale: float = 1.0) -> np.ndarray:
    c, s = scale * math.cos(rotation), scale * math.sin(rotation)
    return np.array([[c, -s, translation[0]], [s, c, translation[1]], [0, 0, 1]])


def rotate(pixels: DataFrame, shape: tuple[int, int], angle: float, order: int = 1) -> DataFrame:
    """By degrees against the clock around the centre; the shape stays."""
    cy, cx = shape[0] / 2 - 0.5, shape[1] / 2 - 0.5
    shift = euclidean_matrix(translation=(cx, cy))
    m = shift @ euclidean_matrix(math.radians(angle)) @ np.linalg.inv(shift)
    return warp(pixels, *shape, affine(np.linalg.inv(m)), order)


def pyramid_reduce(pixels: DataFrame, shape: tuple[int, int], downscale: int = 2, sigma: float | None = None) -> DataFrame:
    """Smooth (reflect), then resize by the factor."""
    soft = gaussian(pixels, sigma or 2 * downscale / 6.0, "reflect")
    return resize(soft, shape, math.ceil(shape[0] / downscale), math.ceil(shape[1] / downscale))


def rescale(pixels: DataFrame, shape: tuple[int, int], scale: float, order: int = 1, mode: str = "reflect") -> DataFrame:
    """Resized by a factor; sides are rounded."""
    return resize(pixels, shape, max(1, round(shape[0] * scale)), max(1, round(shape[1] * scale)), order, mode)


def resize_local_mean(pixels: DataFrame, shape: tuple[int, int], height: int, width: int) -> DataFrame:
    """Resized by means over the part of the input that each output place covers."""
    fy, fx = shape[0] / height, shape[1] / width
    spread = lambda c, f, n: F.explode(F.sequence(F.floor(F.col(c) / f), F.least(F.ceil((F.col(c) + 1) / f) - 1, F.lit(n - 1))))
    rows = pixels.select(*PLACE, "v", spread("y", fy, height).alias("oy")).select("*", spread("x", fx, width).alias("ox"))
    share = lambda c, o, f: F.greatest(F.least(F.col(c) + 1, (F.col(o) + 1) * f) - F.greatest(F.col(c), F.col(o) * f), F.lit(0.0)) / f
    w = share("y", "oy", fy) * share("x", "ox", fx)
    return rows.groupBy("image_id", F.col("oy").cast("int").alias("y"), F.col("ox").cast("int").alias("x")).agg(F.sum(F.col("v") * w).alias("v"))


def pyramid_expand(pixels: DataFrame, shape: tuple[int, int], upscale: int = 2, sigma: float | None = None) -> DataFrame:
    """Resized by the factor, then smoothed (reflect)."""
    return gaussian(resize(pixels, shape, shape[0] * upscale, shape[1] * upscale), sigma or 2 * upscale / 6.0, "reflect")


def pyramid_gaussian(pixels: DataFrame, shape: tuple[int, int], levels: int, downscale: int = 2) -> DataFrame:
    """The image and ``levels`` reductions, each of the one before: level, image_id, y, x, v."""
    out, now, (h, w) = pixels.select(F.lit(0).alias("level"), *PLACE, "v"), pixels, shape
    for k in range(1, levels + 1):
        now = pyramid_reduce(now, (h, w), downscale)
        h, w = math.ceil(h / downscale), math.ceil(w / downscale)
        out = out.unionByName(now.select(F.lit(k).alias("level"), *PLACE, "v"))
    return out


def warp_coords(pixels: DataFrame, inverse) -> DataFrame:
    """Where each place of the output takes its value from: image_id, y, x, from_y, from_x."""
    y, x = inverse(F.col("y").cast("double"), F.col("x").cast("double"))
    return pixels.select(*PLACE, y.alias("from_y"), x.alias("from_x"))


def pyramid_laplacian(pixels: DataFrame, shape: tuple[int, int], levels: int, factor: int = 2) -> DataFrame:
    """What smoothing takes away at each level: level, image_id, y, x, v."""
    out, now, (h, w) = None, pixels, shape
    for level in range(levels):
        smooth = gaussian(now, 2 * factor / 6.0, "reflect").withColumnRenamed("v", "_s")
        left = now.join(smooth, ["image_id", "y", "x"]).select(F.lit(level).alias("level"), "image_id", "y", "x", (F.col("v") - F.col("_s")).alias("v"))
        out = left if out is None else out.unionByName(left)
        if level + 1 < levels:
            now = pyramid_reduce(now, (h, w), factor)
            h, w = -(-h // factor), -(-w // factor)
    return out


def mean_pyramid(pixels: DataFrame, levels: int) -> DataFrame:
    """Levels 0 to ``levels`` - 1, each the 2 x 2 means of the one before, with a column ``level``."""
    out, now = pixels.select(F.lit(0).alias("level"), *PLACE, "v"), pixels
    for k in range(1, levels):
        key = [(F.col("y") / 2).cast("int").alias("y"), (F.col("x") / 2).cast("int").alias("x")]
        now = now.groupBy("image_id", *key).agg(F.avg("v").alias("v"))
        out = out.unionByName(now.select(F.lit(k).alias("level"), *PLACE, "v"))
    return out


def montage(pixels: DataFrame, columns: int, height: int, width: int, fill: float | None = None) -> DataFrame:
    """Images side by side, in the order of their ids, in rows of ``columns``.

    Places that no image has get ``fill``, or the mean of all places.
    """
    # One row for each image, in one task.
    order = pixels.select("image_id").distinct().withColumn("_i", F.row_number().over(Window.orderBy("image_id")) - 1)
    mean = pixels.agg(F.avg("v").alias("_fill")) if fill is None else pixels.sparkSession.createDataFrame([(float(fill),)], "_fill double")
    last = order.agg(F.max("_i").alias("_last")).join(mean)  # one row
    every = last.select("_fill", F.explode(F.sequence(F.lit(0), F.floor(F.col("_last") / columns).cast("int") * columns + columns - 1)).alias("_i"))
    every = every.join(order, "_i", "left").select("_fill", "_i", "image_id", F.explode(F.sequence(F.lit(0), F.lit(height - 1))).alias("y"))
    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("x"))
    p = every.join(pixels.select("image_id", "y", "x", "v"), ["image_id", "y", "x"], "left")
    return p.select(
        F.lit(0).cast("long").alias("image_id"), (F.floor(F.col("_i") / columns).cast("int") * height + F.col("y")).alias("y"),
        (F.col("_i") % columns * width + F.col("x")).alias("x"), F.coalesce("v", "_fill").alias("v"),
    )


def profile_line(pixels: DataFrame, y0: float, x0: float, y1: float, x1: float) -> DataFrame:
    """Values along a line of width one, bilinear between places; outside is 0: image_id, step, v."""
    length = int(math.ceil(math.hypot(y1 - y0, x1 - x0) + 1))
    dy, dx = ((y1 - y0) / max(length - 1, 1), (x1 - x0) / max(length - 1, 1))
    line = warp(pixels, 1, length, lambda y, x: (y0 + x * dy, x0 + x * dx), 1, "constant")
    return line.select("image_id", F.col("x").alias("step"), "v")
