"""Comparisons of image pairs and of segmentations.

``pairs``: image_id, y, x, v and w for images; label and other for label maps.
All are one or two aggregations of the joined places.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

from .stencil import shapes, uniform

def _whole():
    return Window.partitionBy("image_id")


def simple_metrics(pairs: DataFrame, data_range: float) -> DataFrame:
    """mse, psnr (decibels), and nrmse by the true image's norm, range and mean."""
    d = F.col("v") - F.col("w")
    s = pairs.groupBy("image_id").agg(F.avg(d * d).alias("mse"), F.avg(F.col("v") * F.col("v")).alias("q"), (F.max("v") - F.min("v")).alias("r"), F.avg("v").alias("m"))
    root = F.sqrt("mse")
    return s.select(
        "image_id", "mse", (10 * F.log10(F.try_divide(F.lit(data_range * data_range), "mse"))).alias("psnr"),
        F.try_divide(root, F.sqrt("q")).alias("nrmse_euclidean"), F.try_divide(root, "r").alias("nrmse_min_max"), F.try_divide(root, "m").alias("nrmse_mean"),
    )


def structural_similarity(pairs: DataFrame, data_range: float, size: int = 7, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """Mean SSIM over places at least half a window from the border."""
    mean = lambda c: uniform(pairs.select("image_id", "y", "x", c.alias("v")), size)
    v, w = F.col("v"), F.col("w")
    out = None
    for name, c in (("ux", v), ("uy", w), ("uxx", v * v), ("uyy", w * w), ("uxy", v * w)):
        m = mean(c).withColumnRenamed("v", name)
        out = m if out is None else out.join(m, ["image_id", "y", "x"])
    norm = size * size / (size * size - 1)
    ux, uy = F.col("ux"), F.col("uy")
    vx, vy, vxy = norm * (F.col("uxx") - ux * ux), norm * (F.col("uyy") - uy * uy), norm * (F.col("uxy") - ux * uy)
    c1, c2 = (k1 * data_range) ** 2, (k2 * data_range) ** 2
    s = (2 * ux * uy + c1) * (2 * vxy + c2) / ((ux * ux + uy * uy + c1) * (vx + vy + c2))
    pad = (size - 1) // 2
    inner = out.join(shapes(out), "image_id").where((F.col("y") >= pad) & (F.col("x") >= pad) & (F.col("y") < F.col("_h") - pad) & (F.col("x") < F.col("_w") - pad))
    return inner.groupBy("image_id").agg(F.avg(s).alias("ssim"))


def contingency_table(pairs: DataFrame, ignore: tuple[int, ...] = ()) -> DataFrame:
    """(image_id, label, other, n); places whose true label is ignored are left out."""
    rows = pairs.where(~F.col("label").isin(list(ignore))) if ignore else pairs
    return rows.groupBy("image_id", "label", "other").agg(F.count(F.lit(1)).alias("n"))


def _margins(table: DataFrame) -> DataFrame:
    return table.withColumns({
        "a": F.sum("n").over(Window.partitionBy("image_id", "label")), "b": F.sum("n").over(Window.partitionBy("image_id", "other")), "t": F.sum("n").over(_whole())
    })


def adapted_rand_error(table: DataFrame) -> DataFrame:
    """Adapted Rand error with its precision and recall; places whose true label is 0 are ignored by the caller."""
    squares = lambda key: table.groupBy("image_id", key).agg(F.sum("n").alias("m")).groupBy("image_id").agg((F.sum(F.col("m") * F.col("m")) - F.sum("m")).cast("double").alias(f"_{key}"))
    p = table.groupBy("image_id").agg((F.sum(F.col("n") * F.col("n")) - F.sum("n")).cast("double").alias("p"))
    out = p.join(squares("label"), "image_id").join(squares("other"), "image_id")
    precision, recall = F.try_divide("p", "_other"), F.try_divide("p", "_label")
    return out.select("image_id", (1 - 2 * F.try_divide(precision * recall, precision + recall)).alias("error"), precision.alias("precision"), recall.alias("recall"))


def variation_of_information(table: DataFrame) -> DataFrame:
    """Conditional entropies H(other | label) and H(label | other), in bits."""
    m = _margins(table)
    n = F.col("n") / F.col("t")
    return m.groupBy("image_id").agg((-F.sum(n * F.log2(F.col("n") / F.col("a")))).alias("vi_split"), (-F.sum(n * F.log2(F.col("n") / F.col("b")))).alias("vi_merge"))


def normalized_mutual_information(pairs: DataFrame, bins: int = 100) -> DataFrame:
    """(H(v) + H(w)) / H(v, w) of the joint histogram."""
    r = pairs.groupBy("image_id").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.min("w").alias("c"), F.max("w").alias("d"))
    cut = lambda v, a, b: F.least(F.lit(bins - 1), F.coalesce(F.floor(F.try_divide(v - a, b - a) * bins), F.lit(bins // 2)).cast("int"))
    rows = pairs.join(r, "image_id").select("image_id", cut(F.col("v"), F.col("a"), F.col("b")).alias("label"), cut(F.col("w"), F.col("c"), F.col("d")).alias("other"))
    table = contingency_table(rows)

    def entropy(keys: list[str], name: str) -> DataFrame:
        m = table.groupBy("image_id", *keys).agg(F.sum("n").alias("m")).withColumn("p", F.col("m") / F.sum("m").over(_whole()))
        return m.groupBy("image_id").agg((-F.sum(F.col("p") * F.ln("p"))).alias(name))

    out = entropy(["label"], "hv").join(entropy(["other"], "hw"), "image_id").join(entropy(["label", "other"], "hj"), "image_id")
    return out.select("image_id", ((F.col("hv") + F.col("hw")) / F.col("hj")).alias("nmi"))


def colocalization(pairs: DataFrame, mask_v: Column, mask_w: Column) -> DataFrame:
    """Pearson's and Manders' coefficients, and overlaps of two masks."""
    v, w = F.col("v"), F.col("w")
    return pairs.groupBy("image_id").agg(
        F.corr("v", "w").alias("pearson"),
        F.try_divide(F.sum(F.when(mask_w, v).otherwise(0.0)), F.sum(v)).alias("manders_coloc_coeff"),
        F.try_divide(F.sum(v * w), F.sqrt(F.sum(v * v) * F.sum(w * w))).alias("manders_overlap_coeff"),
        F.try_divide(F.count_if(mask_v & mask_w), F.count_if(mask_v)).alias("intersection_coeff"),
    )


def hausdorff_distance(a: DataFrame, b: DataFrame, radius: int = 16) -> DataFrame:
    """Largest distance from a place of one mask to the nearest of the other; null where a mask is empty.

    Places meet in square cells of ``radius``, so no place is compared with all;
    those that have no partner so near look again in cells twice as large, until
    all that an image can have are found. ``radius`` says only where to begin.
    """

    def one(p: DataFrame, q: DataFrame) -> DataFrame:
        left, r, parts = p.select("image_id", "y", "x").join(q.select("image_id").distinct(), "image_id", "left_semi"), radius, []
        while True:
            cell = lambda c, r=r: F.floor(F.col(c) / r).cast("int")
            near = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
            here = left.select("image_id", "y", "x", near.alias("d")).select("image_id", "y", "x", (cell("y") + F.col("d.i")).alias("cy"), (cell("x") + F.col("d.j")).alias("cx"))
            right = q.select("image_id", F.col("y").alias("qy"), F.col("x").alias("qx"), cell("y").alias("cy"), cell("x").alias("cx"))
            d = (F.col("y") - F.col("qy")) * (F.col("y") - F.col("qy")) + (F.col("x") - F.col("qx")) * (F.col("x") - F.col("qx"))
            nearest = materialize(here.join(right, ["image_id", "cy", "cx"], "left").groupBy("image_id", "y", "x").agg(F.min(d).alias("d")), "nearest")
            parts.append(nearest.where(F.col("d") <= r * r).groupBy("image_id").agg(F.max("d").alias("d")))
            left = nearest.where(F.col("d").isNull() | (F.col("d") > r * r)).select("image_id", "y", "x")
            if left.isEmpty():
                break
            r *= 2
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out.groupBy("image_id").agg(F.max("d").alias("d"))

    every = a.select("image_id").unionByName(b.select("image_id")).distinct()
    both = every.join(one(a, b), "image_id", "left").join(one(b, a).withColumnRenamed("d", "e"), "image_id", "left")
    return both.select("image_id", F.when(F.col("d").isNotNull() & F.col("e").isNotNull(), F.sqrt(F.greatest("d", "e").cast("double"))).alias("hausdorff"))


def blur_effect(pixels: DataFrame, size: int = 11) -> DataFrame:
    """How much sharpness a uniform blur takes away, for each axis; the larger is the image's."""
    from .stencil import correlate1d

    out = None
    for axis, n in (("y", "_h"), ("x", "_w")):
        other = "x" if axis == "y" else "y"
        soft = correlate1d(pixels, [1.0 / size] * size, axis)
        sharp_edges = lambda p, axis=axis, other=other: correlate1d(correlate1d(p, [-1.0, 0.0, 1.0], axis), [0.25, 0.5, 0.25], other).withColumn("v", F.abs("v"))
        both = sharp_edges(pixels).join(sharp_edges(soft).withColumnRenamed("v", "b"), ["image_id", "y", "x"]).join(shapes(pixels), "image_id")
        inner = both.where((F.col("y") >= 2) & (F.col("x") >= 2) & (F.col("y") < F.col("_h") - 1) & (F.col("x") < F.col("_w") - 1))
        m = inner.groupBy("image_id").agg(F.sum("v").alias("m1"), F.sum(F.greatest(F.lit(0.0), F.col("v") - F.col("b"))).alias("m2"))
        b = m.select("image_id", F.abs(F.try_divide(F.col("m1") - F.col("m2"), "m1")).alias(axis + "_blur"))
        out = b if out is None else out.join(b, "image_id")
    return out.select("image_id", F.greatest("y_blur", "x_blur").alias("blur"))


