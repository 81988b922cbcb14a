"""Region queries on tiled images: tiles by their indexes, decoded only where a region meets them.

``tiles``: image_id, level, ty, tx, data (array of doubles, row by row), all of
one size. A table partitioned by image and level prunes to the tiles that the
regions need by an equi-join on the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_tiles(pixels: DataFrame, side: int, level: int = 0, background: float = 0.0) -> DataFrame:
    """Square tiles; border tiles are filled up with the background."""
    at = (F.col("y") % side) * side + F.col("x") % side
    key = ["image_id", F.lit(level).alias("level"), (F.col("y") / side).cast("int").alias("ty"), (F.col("x") / side).cast("int").alias("tx")]
    rows = pixels.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), "v"))).alias("m"))
    gap = lambda n: F.array_repeat(F.lit(float(background)), n.cast("int"))
    before = lambda k: F.when(k > 0, F.get("m", k - 1)["at"]).otherwise(F.lit(-1))
    held = F.flatten(F.transform("m", lambda p, k: F.concat(gap(p["at"] - before(k) - 1), F.array(p["v"]))))
    return rows.select("image_id", "level", "ty", "tx", F.concat(held, gap(side * side - 1 - F.element_at("m", -1)["at"])).alias("data"))


def read_region(tiles: DataFrame, regions: DataFrame, side: int, downsample: Column | float = 1.0, background: float = 0.0) -> DataFrame:
    """Pixels of ``regions`` (region, image_id, level, y, x, height, width): region, y, x, v from the region's corner.

    Corners are in coordinates of level 0 and divided by the downsample; sizes
    are at the level. Outside of the image is background.
    """
    scale = downsample if isinstance(downsample, Column) else F.lit(float(downsample))
    r = regions.withColumns({"_y": F.floor(F.col("y") / scale).cast("int"), "_x": F.floor(F.col("x") / scale).cast("int")})
    span = lambda a, n: F.explode(F.sequence(F.floor(F.col(a) / side).cast("int"), F.floor((F.col(a) + F.col(n) - 1) / side).cast("int")))
    need = r.select("*", span("_y", "height").alias("ty")).select("*", span("_x", "width").alias("tx"))
    got = need.join(tiles, ["image_id", "level", "ty", "tx"], "left")
    cells = got.select("region", "_y", "_x", "height", "width", "ty", "tx", "data", F.explode(F.sequence(F.lit(0), F.lit(side * side - 1))).alias("i"))
    y = F.col("ty") * side + (F.col("i") / side).cast("int") - F.col("_y")
    x = F.col("tx") * side + F.col("i") % side - F.col("_x")
    cells = cells.select("region", y.alias("y"), x.alias("x"), "height", "width", F.coalesce(F.get("data", F.col("i")), F.lit(background)).alias("v"))
    return cells.where("y >= 0 AND x >= 0 AND y < height AND x < width").select("region", "y", "x", "v")


def batches(locations: DataFrame, size: int, drop_last: bool = False) -> DataFrame:
    """``locations`` (region, ...) with ``batch`` and ``place`` in it, in their order."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.orderBy("region")) - 1  # a list of locations, not of pixels
    out = locations.withColumns({"batch": F.floor(at / size).cast("int"), "place": (at % size).cast("int")})
    if drop_last:
        full = out.groupBy("batch").count().where(F.col("count") == size).select("batch")
        out = out.join(full, "batch", "left_semi")
    return out


def preferred_memory_capacity(width: Column, height: Column, tile: Column, patch: Column, bytes_per_pixel: Column) -> Column:
    """MiB, rounded up, that hold the tiles which a row of patches meets."""
    across = F.ceil(width / tile)
    rows = F.ceil(F.least(height, patch) / tile) + 1
    return F.ceil(across * tile * tile * rows * bytes_per_pixel / (1024 * 1024))
