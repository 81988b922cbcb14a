"""Histograms and what follows from them: CDFs, equalisation, matching, thresholds.

A histogram is one aggregation of the pixels with map-side combining; all that
follows works on its bins, a fixed number of rows for each image.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 256


def value_range(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.min("v").alias("low"), F.max("v").alias("high"))


def with_bins(pixels: DataFrame, nbins: int = BINS) -> DataFrame:
    """Pixels with ``bin``, ``low`` and ``high``; the last bin is closed, a constant image is widened by a half."""
    r = value_range(pixels)
    flat = F.col("low") == F.col("high")
    r = r.select("image_id", F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"), F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"))
    at = F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * nbins)
    return pixels.join(r, "image_id").withColumn("bin", F.least(F.lit(nbins - 1), at.cast("int")))


def histogram(pixels: DataFrame, nbins: int = BINS) -> DataFrame:
    """``(image_id, bin, center, cnt)``: equal widths from the smallest to the largest value, empty bins too."""
    binned = with_bins(pixels, nbins).groupBy("image_id", "bin").agg(F.count(F.lit(1)).alias("cnt"), F.first("low").alias("low"), F.first("high").alias("high"))
    span = binned.groupBy("image_id").agg(F.first("low").alias("low"), F.first("high").alias("high"))
    every = span.select("image_id", "low", "high", F.explode(F.sequence(F.lit(0), F.lit(nbins - 1))).alias("bin"))
    full = every.join(binned.select("image_id", "bin", "cnt"), ["image_id", "bin"], "left")
    center = F.col("low") + (F.col("bin") + 0.5) * (F.col("high") - F.col("low")) / nbins
    return full.select("image_id", "bin", center.alias("center"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def integer_histogram(pixels: DataFrame) -> DataFrame:
    """The same for whole numbers: one bin for each from the smallest to the largest."""
    n = pixels.groupBy("image_id", F.col("v").cast("long").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    span = n.groupBy("image_id").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    every = span.select("image_id", F.explode(F.sequence("a", "b")).alias("value"), "a")
    full = every.join(n, ["image_id", "value"], "left")
    return full.select("image_id", (F.col("value") - F.col("a")).cast("int").alias("bin"), F.col("value").cast("double").alias("center"), F.coalesce("cnt", F.lit(0)).alias("cnt"))


def _up():
    return Window.partitionBy("image_id").orderBy("bin")


def _whole():
    return Window.partitionBy("image_id")


def cumulative_distribution(hist: DataFrame) -> DataFrame:
    return hist.withColumn("cdf", F.sum("cnt").over(_up()) / F.sum("cnt").over(_whole()))


def equalize(pixels: DataFrame, nbins: int = BINS) -> DataFrame:
    """Values replaced by the CDF, linear between the bins' centres."""
    cdf = cumulative_distribution(histogram(pixels, nbins))
    lut = cdf.select("image_id", "bin", "center", "cdf", F.lag("center").over(_up()).alias("c0"), F.lag("cdf").over(_up()).alias("p0"), F.lead("center").over(_up()).alias("c1"), F.lead("cdf").over(_up()).alias("p1"))
    both = with_bins(pixels, nbins).select("image_id", "bin", "y", "x", "v").join(lut, ["image_id", "bin"])
    left = F.col("v") < F.col("center")
    a, pa_ = F.when(left, F.col("c0")).otherwise(F.col("center")), F.when(left, F.col("p0")).otherwise(F.col("cdf"))
    b, pb = F.when(left, F.col("center")).otherwise(F.col("c1")), F.when(left, F.col("cdf")).otherwise(F.col("p1"))
    out = F.when(a.isNull() | b.isNull(), F.col("cdf")).otherwise(pa_ + (pb - pa_) * (F.col("v") - a) / (b - a))
    return both.select("image_id", "y", "x", out.alias("v"))


def match_histograms(pixels: DataFrame, reference: DataFrame) -> DataFrame:
    """Whole-number images: each value goes where the reference has the same quantile, linear between its values.

    Both are matched by ``image_id``.
    """
    quantiles = lambda p: (
        p.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("q", F.sum("n").over(Window.partitionBy("image_id").orderBy("v")) / F.sum("n").over(_whole()))
    )
    w = Window.partitionBy("image_id").orderBy("v")
    ref = quantiles(reference).select("image_id", F.col("v").alias("r"), F.col("q").alias("q1"), F.lag("q").over(w).alias("q0"), F.lag("v").over(w).alias("r0"))
    src = quantiles(pixels).select("image_id", "v", "q")
    # The first reference quantile at or above: both sides have one row for each value.
    hit = src.join(ref, "image_id").where((F.col("q") <= F.col("q1")) & (F.col("q0").isNull() | (F.col("q") > F.col("q0"))))
    out = F.when(F.col("q0").isNull(), F.col("r")).otherwise(F.col("r0") + (F.col("r") - F.col("r0")) * (F.col("q") - F.col("q0")) / (F.col("q1") - F.col("q0")))
    lut = hit.select("image_id", "v", out.alias("w"))
    return pixels.select("image_id", "y", "x", "v").join(lut, ["image_id", "v"]).select("image_id", "y", "x", F.col("w").alias("v"))


# -- thresholds: (image_id, threshold) ---------------------------------------------


def _first_best(rows: DataFrame, score: Column) -> DataFrame:
    """The centre of the first bin with the highest score."""
    return rows.where(score.isNotNull()).groupBy("image_id").agg(F.max_by("center", F.struct(score.alias("s"), -F.col("bin"))).alias("threshold"))


def _halves(hist: DataFrame) -> DataFrame:
    """With sums of counts and of moments up to each bin and above it."""
    m = F.col("cnt") * F.col("center")
    out = hist.withColumns({"w1": F.sum("cnt").over(_up()), "m1": F.sum(m).over(_up()), "total": F.sum("cnt").over(_whole()), "moment": F.sum(m).over(_whole())})
    return out.withColumns({"w2": F.col("total") - F.col("w1"), "m2": F.col("moment") - F.col("m1")})


def threshold_otsu(hist: DataFrame) -> DataFrame:
    d = F.try_divide("m1", "w1") - F.try_divide("m2", "w2")
    return _first_best(_halves(hist), F.col("w1") * F.col("w2") * d * d)


def threshold_yen(hist: DataFrame) -> DataFrame:
    p = F.col("cnt") / F.sum("cnt").over(_whole())
    rows = hist.withColumn("p", p).withColumns({"p1": F.sum("p").over(_up()), "s1": F.sum(F.col("p") * F.col("p")).over(_up()), "s": F.sum(F.col("p") * F.col("p")).over(_whole())})
    s2 = F.col("s") - F.col("s1")
    inside = (F.col("s1") > 0) & (s2 > 1e-15) & (F.col("p1") < 1 - 1e-15)
    t = F.col("p1") * (1 - F.col("p1"))
    return _first_best(rows, F.when(inside, F.ln(t * t / (F.col("s1") * s2))))


def threshold_isodata(hist: DataFrame) -> DataFrame:
    mid = (F.try_divide("m1", "w1") + F.try_divide("m2", "w2")) / 2
    rows = _halves(hist).withColumn("d", mid - F.col("center")).withColumn("width", F.lead("center").over(_up()) - F.col("center"))
    return rows.where("d >= 0 AND d < width").groupBy("image_id").agg(F.min("center").alias("threshold"))


def threshold_mean(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id").agg(F.avg("v").alias("threshold"))


def threshold_triangle(hist: DataFrame) -> DataFrame:
    """The bin furthest below the line from the peak to the longer tail's end."""
    used = hist.where("cnt > 0").groupBy("image_id").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.max_by("bin", F.struct("cnt", -F.col("bin"))).alias("peak"), F.max("cnt").alias("top"))
    r = hist.join(used, "image_id").withColumn("flip", F.col("peak") - F.col("lo") < F.col("hi") - F.col("peak"))
    # As if the longer tail were to the left.
    x = F.when(F.col("flip"), F.col("hi") - F.col("bin")).otherwise(F.col("bin") - F.col("lo"))
    width = F.when(F.col("flip"), F.col("hi") - F.col("peak")).otherwise(F.col("peak") - F.col("lo"))
    r = r.withColumns({"t": x, "width": width}).where("t >= 0 AND t < width")
    norm = F.hypot(F.col("top").cast("double"), F.col("width").cast("double"))
    r = r.withColumn("s", F.col("top") / norm * F.col("t") - F.col("width") / norm * F.col("cnt"))
    best = r.groupBy("image_id").agg(F.max_by(F.struct("center"), F.struct("s", -F.col("t"))).alias("b"))
    return best.select("image_id", F.col("b.center").alias("threshold"))


def threshold_li(pixels: DataFrame, tolerance: float | None = None, max_rounds: int = 200) -> DataFrame:
    """Iterated minimum cross entropy; one aggregation of the distinct values a round."""
    values = pixels.where(~F.isnan("v")).groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n")).cache()
    w = Window.partitionBy("image_id").orderBy("v")
    gaps = values.withColumn("gap", F.col("v") - F.lag("v").over(w))
    start = gaps.groupBy("image_id").agg(F.min("v").alias("low"), (F.min("gap") / 2).alias("tol"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"))
    state = {r["image_id"]: [r["low"], tolerance or r["tol"], r["mean"], None] for r in start.collect()}  # one row for each image
    spark = pixels.sparkSession
    for _ in range(max_rounds):
        going = [(i, float(s[2])) for i, s in state.items() if s[1] is not None and (s[3] is None or abs(s[2] - s[3]) > s[1])]
        if not going:
            break
        now = spark.createDataFrame(going, "image_id long, t double")
        means = values.join(now, "image_id").groupBy("image_id").agg(
            F.try_divide(F.sum(F.when(F.col("v") > F.col("t"), F.col("v") * F.col("n"))), F.sum(F.when(F.col("v") > F.col("t"), F.col("n")))).alias("fore"),
            F.try_divide(F.sum(F.when(F.col("v") <= F.col("t"), F.col("v") * F.col("n"))), F.sum(F.when(F.col("v") <= F.col("t"), F.col("n")))).alias("back"),
        )
        for r in means.collect():
            s = state[r["image_id"]]
            fore, back = r["fore"] - s[0], r["back"] - s[0]
            s[3] = s[2]
            s[2] = s[0] + ((back - fore) / (np.log(back) - np.log(fore)) if back > 0 else 0.0)
            if back <= 0:
                s[3] = s[2]
    values.unpersist()
    return spark.createDataFrame([(i, float(s[2])) for i, s in state.items()], "image_id long, threshold double")


def threshold_minimum(hist: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """The lowest bin between the two maxima that are left when the histogram has been smoothed enough.

    Null for an image whose histogram never has just two.
    """

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bin")
        h, centers = rows["cnt"].to_numpy(float), rows["center"].to_numpy()
        for _ in range(max_rounds):
            padded = np.concatenate([h[:1], h, h[-1:]])
            h = (padded[:-2] + padded[1:-1] + padded[2:]) / 3
            rise, peaks = True, []
            for i in range(len(h) - 1):
                if rise and h[i + 1] < h[i]:
                    rise = False
                    peaks.append(i)
                elif not rise and h[i + 1] > h[i]:
                    rise = True
            if len(peaks) < 3:
                break
        if len(peaks) != 2:
            return pd.DataFrame({"image_id": rows["image_id"].iloc[:1], "threshold": [None]})
        at = peaks[0] + int(np.argmin(h[peaks[0] : peaks[1] + 1]))
        return pd.DataFrame({"image_id": rows["image_id"].iloc[:1], "threshold": [centers[at]]})

    # Groups are the bins of one image: a fixed number of rows.
    return hist.groupBy("image_id").applyInPandas(one, "image_id long, threshold double")


def threshold_multiotsu(hist: DataFrame) -> DataFrame:
    """Two thresholds for three classes: the pair of bins with the largest variance between classes."""
    total = F.sum("cnt").over(_whole())
    rows = hist.withColumns({"w": F.sum("cnt").over(_up()), "m": F.sum(F.col("cnt") * F.col("center")).over(_up()), "tw": total, "tm": F.sum(F.col("cnt") * F.col("center")).over(_whole())})
    a = rows.select("image_id", F.col("bin").alias("i"), F.col("center").alias("c1"), F.col("w").alias("wa"), F.col("m").alias("ma"))
    b = rows.select("image_id", F.col("bin").alias("j"), F.col("center").alias("c2"), F.col("w").alias("wb"), F.col("m").alias("mb"), "tw", "tm")
    part = lambda m, w: F.coalesce(F.try_divide(m * m, w), F.lit(0.0))
    pairs = a.join(b, "image_id").where("i < j")  # as many as pairs of bins
    pairs = pairs.withColumn("s", part(F.col("ma"), F.col("wa")) + part(F.col("mb") - F.col("ma"), F.col("wb") - F.col("wa")) + part(F.col("tm") - F.col("mb"), F.col("tw") - F.col("wb")))
    best = pairs.groupBy("image_id").agg(F.max_by(F.struct("c1", "c2"), F.struct("s", -F.col("i"), -F.col("j"))).alias("b"))
    return best.select("image_id", F.col("b.c1").alias("threshold_1"), F.col("b.c2").alias("threshold_2"))


def shannon_entropy(pixels: DataFrame, base: float = 2) -> DataFrame:
    n = pixels.groupBy("image_id", "v").agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.sum("n").over(_whole())
    return n.withColumn("p", p).groupBy("image_id").agg((-F.sum(F.col("p") * F.ln("p")) / np.log(base)).alias("entropy"))


def is_low_contrast(pixels: DataFrame, span: float, fraction: float = 0.05, low: float = 0.01, high: float = 0.99) -> DataFrame:
    limits = pixels.groupBy("image_id").agg(F.percentile("v", F.lit(low)).alias("a"), F.percentile("v", F.lit(high)).alias("b"))
    return limits.select("image_id", ((F.col("b") - F.col("a")) / span < fraction).alias("low_contrast"))


def quantiles(pixels: DataFrame, shares: dict[str, float], bins: int = 4096) -> DataFrame:
    """Exact quantiles of v, linear between values: image_id and a column for each of ``shares``.

    Counts in bins say in which of them the wanted ranks lie; only the values of
    those are ordered. Nulls do not count; an image without values has no row.
    """
    p = pixels.select("image_id", "v").where("v IS NOT NULL")
    ends = p.groupBy("image_id").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.count(F.lit(1)).alias("_n"))
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col("v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * bins), F.lit(bins - 1)), F.lit(0))
    binned = p.join(F.broadcast(ends), "image_id").withColumn("_bin", at)
    counts = binned.groupBy("image_id", "_bin").agg(F.count(F.lit(1)).alias("_c"), F.first("_n").alias("_n"))
    before = F.sum("_c").over(Window.partitionBy("image_id").orderBy("_bin")) - F.col("_c")
    place = lambda q: (F.col("_n") - 1) * F.lit(float(q))
    ranks = F.array_distinct(F.array(*[f(place(q)).cast("long") for q in shares.values() for f in (F.floor, F.ceil)]))
    held = counts.withColumn("_before", before).withColumn("_ranks", F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_c")))).where(F.size("_ranks") > 0)
    values = binned.join(F.broadcast(held.select("image_id", "_bin", "_before", "_ranks")), ["image_id", "_bin"]).groupBy("image_id", "_bin", "v").agg(F.count(F.lit(1)).alias("_c"), F.first("_before").alias("_before"), F.first("_ranks").alias("_ranks"), F.first("_n").alias("_n"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("image_id", "_bin").orderBy("v"))
    ranked = values.withColumn("_to", upto).withColumn("_r", F.explode(F.filter("_ranks", lambda r: (r >= F.col("_to") - F.col("_c")) & (r < F.col("_to")))))
    by_rank = ranked.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("_r", "v"))).alias("_m"), F.first("_n").alias("_n"))

    def one(q: float) -> Column:
        a, b = F.floor(place(q)).cast("long"), F.ceil(place(q)).cast("long")
        low, high = F.element_at("_m", a), F.element_at("_m", b)
        return F.when(low == high, low).otherwise((b - place(q)) * low + (place(q) - a) * high)

    return by_rank.select("image_id", *[one(q).alias(n) for n, q in shares.items()])
