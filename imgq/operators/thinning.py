"""Thinning of binary images by the rules of Guo and Hall (1989).

Only places that are on are kept. Each half round sends every such place to its
eight neighbours and adds up what a place gets, one shuffle with map-side
combining; the rules are bit expressions of that sum. The number of rounds
follows the thickness of the objects, and each round is a written table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialize

PLACE = ["image_id", "y", "x"]
#: Neighbours anticlockwise from the east; the k-th has the bit 2^k.
RING = [(0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1), (1, 0), (1, 1)]


def removable(code: Column, first: bool) -> Column:
    """Whether a place whose neighbours are the bits of ``code`` goes in the first or the second half of a round."""
    x = [F.shiftright(code, k).bitwiseAND(1) for k in range(8)]
    either = lambda a, b: F.greatest(x[a % 8], x[b % 8])
    total = lambda parts: parts[0] + parts[1] + parts[2] + parts[3]
    gaps = total([(1 - x[k]) * either(k + 1, k + 2) for k in (0, 2, 4, 6)])
    pairs = F.least(total([either(k, k + 1) for k in (0, 2, 4, 6)]), total([either(k + 1, k + 2) for k in (0, 2, 4, 6)]))
    k = 0 if first else 4
    side = F.greatest(x[k + 1], x[k + 2], 1 - x[(k + 7) % 8]) * x[k]
    return (gaps == 1) & pairs.between(2, 3) & (side == 0)


def _half(on: DataFrame, first: bool) -> DataFrame:
    sent = [F.struct(F.lit(0).alias("dy"), F.lit(0).alias("dx"), F.lit(0).alias("bit"), F.lit(1).alias("own"))]
    sent += [F.struct(F.lit(-dy).alias("dy"), F.lit(-dx).alias("dx"), F.lit(1 << k).alias("bit"), F.lit(0).alias("own")) for k, (dy, dx) in enumerate(RING)]
    to = on.select(*PLACE, F.explode(F.array(*sent)).alias("s")).select("image_id", (F.col("y") + F.col("s.dy")).alias("y"), (F.col("x") + F.col("s.dx")).alias("x"), "s.bit", "s.own")
    codes = to.groupBy(*PLACE).agg(F.sum("bit").cast("int").alias("code"), F.max("own").alias("own")).where("own = 1")
    return codes.where(~removable(F.col("code"), first)).select(*PLACE)


def thin(pixels: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Places that are not 0, thinned until nothing changes or ``max_rounds`` have passed, as 0 and 1.

    Null values are background; an image without objects stays as it is.
    """
    on = materialize(pixels.where("v <> 0").select(*PLACE), "thin")
    before, now, rounds = -1, on.count(), 0
    while before != now and (max_rounds is None or rounds < max_rounds):
        on = materialize(_half(_half(on, True), False), "thin")
        before, now, rounds = now, on.count(), rounds + 1
    left = pixels.select(*PLACE).join(on.withColumn("_on", F.lit(1.0)), PLACE, "left")
    return left.select(*PLACE, F.coalesce("_on", F.lit(0.0)).alias("v"))
