"""Contrast-limited adaptive equalisation, and filters of one channel lent to colour images."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from .histogram import value_range
from .stencil import shapes

PLACE = ["image_id", "y", "x"]
GREYS = 2**14
TILE = ["image_id", "_ty", "_tx"]


def clip_histograms(counts: DataFrame, limit: Column) -> DataFrame:
    """``counts`` (TILE, _bin, _n, _size; a row for every bin) with no ``_n`` above ``limit``.

    What is cut off is poured over all bins of the tile like water over steps:
    every bin has room up to the limit, those with the least room fill up first,
    and the others rise alike. The last few counts, fewer than there are bins left,
    go to bins spread evenly over those. What no bin has room for is lost.
    """
    tile = Window.partitionBy(*TILE)
    by_room, by_bin = tile.orderBy("_room", "_bin"), tile.orderBy("_bin")
    c = counts.withColumn("_low", F.least(F.col("_n"), limit)).withColumn("_room", limit - F.col("_low"))
    c = c.withColumn("_cut", F.sum(F.col("_n") - F.col("_low")).over(tile)).withColumn("_bins", F.count(F.lit(1)).over(tile))
    # With the water as high as this bin's room: all before it are full, and those from it on as high.
    poured = F.coalesce(F.sum("_room").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + (F.col("_bins") - F.row_number().over(by_room) + 1) * F.col("_room")
    c = c.withColumn("_full", poured <= F.col("_cut"))
    c = c.withColumn("_left", F.col("_cut") - F.sum(F.when(F.col("_full"), F.col("_room")).otherwise(0)).over(tile))
    c = c.withColumn("_open", F.sum((~F.col("_full")).cast("long")).over(tile)).withColumn("_turn", F.sum((~F.col("_full")).cast("long")).over(by_bin))
    share, rest = F.floor(F.col("_left") / F.col("_open")), F.col("_left") % F.col("_open")
    spread = lambda k: F.floor(k * rest / F.col("_open"))
    more = F.when(F.col("_full"), F.col("_room")).otherwise(share + spread(F.col("_turn")) - spread(F.col("_turn") - 1))
    return c.select(*TILE, "_bin", (F.col("_low") + more).cast("long").alias("_n"), "_size")


def equalize_adapthist(pixels: DataFrame, kernel: tuple[int, int] | None = None, clip_limit: float = 0.01, bins: int = 256) -> DataFrame:
    """Each place through the equalised histograms of the four tiles around it, linear between their middles; in [0, 1].

    Tiles have the size ``kernel``, by default an eighth of each side; the last
    ones are filled up with mirrored places. Counts are combined map-side before
    the shuffle, and what one group holds is the bins of one tile. An image
    without contrast becomes 0; null values count as the image's smallest.
    """
    r = value_range(pixels).join(shapes(pixels), "image_id")
    side = lambda k, c: F.lit(kernel[k]) if kernel else F.greatest(F.floor(F.col(c) / 8), F.lit(1)).cast("int")
    r = r.select("*", side(0, "_h").alias("_ky"), side(1, "_w").alias("_kx"))
    level = F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    p = pixels.select(*PLACE, "v").join(r, "image_id").withColumn("_bin", F.floor(F.rint(level * (GREYS - 1)) / (1 + GREYS // bins)).cast("int"))

    def copies(c: str, n: str, k: str) -> Column:
        """The place itself and its mirror image in the last tile."""
        mirrored = 2 * (F.col(n) - 1) - F.col(c)
        end = F.ceil(F.col(n) / F.col(k)) * F.col(k)
        return F.explode(F.array_compact(F.array(F.col(c), F.when((mirrored >= F.col(n)) & (mirrored < end), mirrored))))

    spread = p.withColumn("_yy", copies("y", "_h", "_ky")).withColumn("_xx", copies("x", "_w", "_kx"))
    tile = lambda c, k: F.floor(F.col(c) / F.col(k)).cast("int")
    counts = spread.groupBy("image_id", tile("_yy", "_ky").alias("_ty"), tile("_xx", "_kx").alias("_tx"), "_bin").agg(F.count(F.lit(1)).alias("_n"), F.first(F.col("_ky") * F.col("_kx")).alias("_size"))

    held = counts.groupBy(*TILE).agg(F.map_from_entries(F.collect_list(F.struct("_bin", "_n"))).alias("_held"), F.first("_size").alias("_size"))
    every = held.select(*TILE, "_size", "_held", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("_bin"))
    full = every.select(*TILE, "_bin", F.coalesce(F.try_element_at("_held", F.col("_bin")), F.lit(0)).cast("long").alias("_n"), F.col("_size").cast("long").alias("_size"))
    if clip_limit > 0:
        full = clip_histograms(full, F.greatest(F.floor(clip_limit * F.col("_size")), F.lit(1)).cast("long"))
    upto = F.sum("_n").over(Window.partitionBy(*TILE).orderBy("_bin"))
    maps = full.select(*TILE, "_bin", F.floor(F.least(upto * (F.lit(GREYS - 1.0) / F.col("_size")), F.lit(GREYS - 1.0))).alias("_level"))

    def around(c: str, n: str, k: str) -> Column:
        """The two tiles around a place, with weights; beyond the border is the last tile again."""
        at = F.col(c) + F.floor(F.col(k) / 2)
        b, part, last = F.floor(at / F.col(k)), (at % F.col(k)) / F.col(k), F.ceil(F.col(n) / F.col(k)) - 1
        inside = lambda t: F.least(F.greatest(t, F.lit(0)), last).cast("int")
        return F.explode(F.array(F.struct(inside(b - 1).alias("t"), (1 - part).alias("w")), F.struct(inside(b).alias("t"), part.alias("w"))))

    asked = p.withColumn("_a", around("y", "_h", "_ky")).withColumn("_b", around("x", "_w", "_kx"))
    asked = asked.select(*PLACE, "_bin", F.col("_a.t").alias("_ty"), F.col("_b.t").alias("_tx"), (F.col("_a.w") * F.col("_b.w")).alias("_weight"))
    mixed = asked.join(maps, [*TILE, "_bin"]).groupBy(*PLACE).agg(F.floor(F.sum(F.col("_level") * F.col("_weight")) + 1e-6).cast("double").alias("v"))
    ends = value_range(mixed)
    return mixed.join(ends, "image_id").select(*PLACE, F.coalesce(F.try_divide(F.col("v") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0)).alias("v"))


# -- colours -------------------------------------------------------------------------------


def is_rgb_like(pixels: DataFrame) -> bool:
    """Whether a table of places has red, green and blue."""
    return set("rgb") <= set(pixels.columns)


def each_channel(pixels: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A filter of v over r, g and b, each as an image of its own, in one run of the filter."""
    apart = pixels.select(F.explode(F.array(*[F.struct(F.struct("image_id", F.lit(k).alias("k")).alias("image_id"), "y", "x", F.col(c).alias("v")) for k, c in enumerate("rgb")])).alias("p")).select("p.*")
    done = f(apart).select("image_id.image_id", "image_id.k", "y", "x", "v")
    return done.groupBy(*PLACE).agg(*[F.max(F.when(F.col("k") == k, F.col("v"))).alias(c) for k, c in enumerate("rgb")])


def hsv_value(pixels: DataFrame, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A filter of v over the value of hue, saturation and value; the other two stay."""
    h, s, v = color.rgb2hsv((F.col("r"), F.col("g"), F.col("b")))
    hsv = pixels.select(*PLACE, h.alias("_h"), s.alias("_s"), v.alias("v"))
    both = hsv.drop("v").join(f(hsv.select(*PLACE, "v")), PLACE)
    return both.select(*PLACE, *[c.alias(n) for c, n in zip(color.hsv2rgb((F.col("_h"), F.col("_s"), F.col("v"))), "rgb", strict=True)])


def adapt_rgb(pixels: DataFrame, f: Callable[[DataFrame], DataFrame], how: Callable = each_channel) -> DataFrame:
    """A filter of v over a grey image as it is, over a colour image by ``how``."""
    return how(pixels, f) if is_rgb_like(pixels) else f(pixels)
