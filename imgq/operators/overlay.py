"""Labels drawn over images, stains and random views."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exposure import absorbance_to_image
from .transform import zoom

PLACE = ["image_id", "y", "x"]

# The colours of labels, in turn: red, blue, yellow, magenta, green, indigo, darkorange, cyan, pink, yellowgreen.
COLOURS = [(1, 0, 0), (0, 0, 1), (1, 1, 0), (1, 0, 1), (0, 128 / 255, 0), (75 / 255, 0, 130 / 255), (1, 140 / 255, 0), (0, 1, 1), (1, 192 / 255, 203 / 255), (154 / 255, 205 / 255, 50 / 255)]


def label_means(pixels: DataFrame) -> DataFrame:
    """Each region in the mean colour of its places (r, g, b, label); the background is black."""
    mean = pixels.groupBy("image_id", "label").agg(*[F.avg(c).alias(f"_{c}") for c in "rgb"])
    return pixels.select(*PLACE, "label").join(mean, ["image_id", "label"]).select(*PLACE, *[F.when(F.col("label") == 0, F.lit(0.0)).otherwise(F.col(f"_{c}")).alias(c) for c in "rgb"])


def label_overlay(pixels: DataFrame, alpha: float = 0.3) -> DataFrame:
    """Colours in turn, by the order of the labels in use, laid over the grey image v; the background stays grey."""
    used = pixels.where("label <> 0").select("image_id", "label").distinct()
    turn = used.withColumn("_i", (F.row_number().over(Window.partitionBy("image_id").orderBy("label")) - 1) % len(COLOURS))
    palette = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in COLOURS])
    p = pixels.join(turn, ["image_id", "label"], "left")
    blend = lambda k: F.when(F.col("_i").isNull(), F.col("v")).otherwise(F.element_at(palette, F.col("_i") + 1)[k] * alpha + F.col("v") * (1 - alpha))
    return p.select(*PLACE, *[blend(k).alias(c) for k, c in enumerate("rgb")])


STAINS = [f"{k}{c}" for k in "pq" for c in "rgb"]
# Stain vectors (a column for each stain) and largest concentrations of the reference slide.
REFERENCE_STAINS = ((0.5626, 0.2159), (0.7201, 0.8012), (0.4062, 0.5581))
REFERENCE_MOST = (1.9705, 1.0308)


def _absorbance(source: float) -> dict[str, Column]:
    return {c: -F.ln(F.greatest(F.least(F.col(c), F.lit(source)), F.lit(1.0)) / source) for c in "rgb"}


def stain_table(pixels: DataFrame, source: float = 240.0, alpha: float = 1.0, beta: float = 0.345) -> DataFrame:
    """Two stain vectors, ``pr, pg, pb`` and ``qr, qg, qb``, for each image (r, g, b from 0 to 255).

    They are the extreme angles in the plane of the two largest components of
    the places whose absorbance is over ``beta`` in some channel. An image with
    fewer than two such places has no row. Only one row for each image (six
    covariances, then two angles) is worked on in Python.
    """
    p = pixels.select("image_id", *[v.alias(c) for c, v in _absorbance(source).items()]).where((F.col("r") > beta) | (F.col("g") > beta) | (F.col("b") > beta))
    pairs = [(a, b) for i, a in enumerate("rgb") for b in "rgb"[i:]]
    spread = p.groupBy("image_id").agg(*[F.covar_samp(a, b).alias(a + b) for a, b in pairs]).dropna()
    id_type = pixels.schema["image_id"].dataType.simpleString()
    plane = [f"{k}{c}" for k in "uv" for c in "rgb"]

    def planes(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in it:
            out = []
            for r in rows.to_dict("records"):
                cov = np.array([[r["".join(sorted((a, b), key="rgb".index))] for b in "rgb"] for a in "rgb"])
                vectors = np.linalg.eigh(cov)[1][:, [1, 2]]
                vectors = vectors * np.where(vectors.sum(axis=0) < 0, -1, 1)
                out.append((r["image_id"], *vectors.T.ravel()))
            yield pd.DataFrame(out, columns=["image_id", *plane])

    frame = spread.mapInPandas(planes, f"image_id {id_type}, " + ", ".join(f"{c} double" for c in plane))
    t = p.join(frame, "image_id")
    dot = lambda k: sum((F.col(c) * F.col(k + c) for c in "rgb"), F.lit(0.0))
    angles = t.groupBy("image_id", *plane).agg(F.percentile(F.atan2(dot("u"), dot("v")), F.array(F.lit(alpha / 100), F.lit(1 - alpha / 100))).alias("a"))
    end = lambda i: [F.col(f"u{c}") * F.sin(F.col("a")[i]) + F.col(f"v{c}") * F.cos(F.col("a")[i]) for c in "rgb"]
    low, high = end(0), end(1)
    first = low[0] > high[0]
    ordered = [F.when(first, x).otherwise(y) for x, y in (*zip(low, high, strict=True), *zip(high, low, strict=True))]
    return angles.select("image_id", *[c.alias(n) for c, n in zip(ordered, STAINS, strict=True)])


def stain_matrix(pixels: DataFrame, source: float = 240.0, alpha: float = 1.0, beta: float = 0.345) -> dict[int, np.ndarray]:
    """``stain_table`` as a 3 x 2 matrix for each image, for a few images at a time."""
    return {r["image_id"]: np.array([r[c] for c in STAINS]).reshape(2, 3).T for r in stain_table(pixels, source, alpha, beta).collect()}


def normalize_stains(pixels: DataFrame, stains: DataFrame, source: float = 240.0, alpha: float = 1.0, reference: tuple = REFERENCE_STAINS, most: tuple = REFERENCE_MOST) -> DataFrame:
    """Images (r, g, b from 0 to 255) recoloured as if stained like the reference, in whole numbers.

    Concentrations follow from the image's own ``stains`` by least squares, are
    scaled so that their (100 - alpha)th percentiles are ``most``, and are put
    together again with the reference's vectors. Images without stains are left out.
    """
    p = pixels.select(*PLACE, *[v.alias(c) for c, v in _absorbance(source).items()]).join(stains, "image_id")
    dot = lambda a, b: sum((F.col(f"{a}{c}") * F.col(f"{b}{c}") for c in "rgb"), F.lit(0.0))
    pp, pq, qq, pv, qv = dot("p", "p"), dot("p", "q"), dot("q", "q"), dot("p", ""), dot("q", "")
    det = pp * qq - pq * pq
    amounts = p.select(*PLACE, F.try_divide(qq * pv - pq * qv, det).alias("c0"), F.try_divide(pp * qv - pq * pv, det).alias("c1"))
    top = amounts.groupBy("image_id").agg(*[F.percentile(f"c{k}", F.lit(1 - alpha / 100)).alias(f"_t{k}") for k in (0, 1)])
    scaled = [F.col(f"c{k}") * F.try_divide(F.lit(float(most[k])), F.col(f"_t{k}")) for k in (0, 1)]
    out = [absorbance_to_image(float(row[0]) * scaled[0] + float(row[1]) * scaled[1], source).alias(c) for row, c in zip(reference, "rgb", strict=True)]
    return amounts.join(top, "image_id").select(*PLACE, *out)


def normalize_colors_pca(pixels: DataFrame, source: float = 240.0, alpha: float = 1.0, beta: float = 0.345) -> DataFrame:
    """``normalize_stains`` by the stains found in the images themselves."""
    return normalize_stains(pixels, stain_table(pixels, source, 1.0, beta), source, alpha)


def draw(seed: int, turn: int, low: float = 0.0, high: float = 1.0) -> Column:
    """A number from low to high for each image, the same whenever it is asked for."""
    digest = F.md5(F.concat_ws(":", F.col("image_id").cast("string"), F.lit(str(seed)), F.lit(str(turn))).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32 * (high - low) + low


def rand_colour_jitter(pixels: DataFrame, brightness: float = 0.0, contrast: float = 0.0, saturation: float = 0.0, seed: int = 0, prob: float = 1.0) -> DataFrame:
    """Colour jitter by factors drawn for each image, each from 1 minus to 1 plus its bound (0 at least)."""
    on = draw(seed, 0) < prob
    factor = lambda k, b: F.when(on, draw(seed, k, max(0.0, 1 - b), 1 + b)).otherwise(1.0)
    return colour_jitter(pixels, factor(1, brightness), factor(2, contrast), factor(3, saturation))


def rand_image_flip(pixels: DataFrame, axis: str = "x", prob: float = 0.5, seed: int = 0) -> DataFrame:
    """Images turned over along an axis with probability ``prob``, drawn for each."""
    side = pixels.groupBy("image_id").agg(F.max(axis).alias("_last"))
    at = F.when(draw(seed, 0) < prob, F.col("_last") - F.col(axis)).otherwise(F.col(axis))
    return pixels.join(side, "image_id").select(*[at.alias(c) if c == axis else F.col(f"`{c}`") for c in pixels.columns])


def rand_image_rotate_90(pixels: DataFrame, prob: float = 0.5, max_turns: int = 3, seed: int = 0) -> DataFrame:
    """Images turned by 90 degrees, from the y to the x axis, 1 to ``max_turns`` times with probability ``prob``."""
    side = pixels.groupBy("image_id").agg(F.max("y").alias("_b"), F.max("x").alias("_r"))
    k = F.when(draw(seed, 0) < prob, F.floor(draw(seed, 1) * max_turns) % 4 + 1).otherwise(0)
    p = pixels.join(side, "image_id").withColumn("_k", k)
    y = F.when(F.col("_k") == 1, F.col("_r") - F.col("x")).when(F.col("_k") == 2, F.col("_b") - F.col("y")).when(F.col("_k") == 3, F.col("x")).otherwise(F.col("y"))
    x = F.when(F.col("_k") == 1, F.col("y")).when(F.col("_k") == 2, F.col("_r") - F.col("x")).when(F.col("_k") == 3, F.col("_b") - F.col("y")).otherwise(F.col("x"))
    return p.select(*[{"y": y.alias("y"), "x": x.alias("x")}.get(c, F.col(f"`{c}`")) for c in pixels.columns])


def get_zoom_factor(min_zoom: float | tuple[float, float] = 0.9, max_zoom: float | tuple[float, float] = 1.1, seed: int = 0) -> tuple[Column, Column]:
    """A factor for each side, drawn for each image; one for both sides where the bounds are single numbers."""
    if isinstance(min_zoom, tuple) and isinstance(max_zoom, tuple):
        return draw(seed, 1, min_zoom[0], max_zoom[0]), draw(seed, 2, min_zoom[1], max_zoom[1])
    one = draw(seed, 1, min_zoom, max_zoom)
    return one, one


def rand_zoom(pixels: DataFrame, min_zoom: float | tuple[float, float] = 0.9, max_zoom: float | tuple[float, float] = 1.1, prob: float = 0.1, seed: int = 0) -> DataFrame:
    """Images zoomed with probability ``prob``, by factors drawn for each."""
    on = draw(seed, 0) < prob
    y, x = get_zoom_factor(min_zoom, max_zoom, seed)
    return zoom(pixels, F.when(on, y).otherwise(1.0), F.when(on, x).otherwise(1.0))


def colour_jitter(pixels: DataFrame, brightness: float = 1.0, contrast: float = 1.0, saturation: float = 1.0) -> DataFrame:
    """Brightness, contrast about the image's mean grey and saturation about each place's grey, in [0, 1]."""
    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    grey = lambda: 0.299 * F.col("r") + 0.587 * F.col("g") + 0.114 * F.col("b")
    p = pixels.select(*PLACE, *[clip(F.col(c) * brightness).alias(c) for c in "rgb"])
    mean = p.groupBy("image_id").agg(F.avg(grey()).alias("_m"))
    p = p.join(mean, "image_id").select(*PLACE, *[clip(F.col(c) * contrast + (1 - contrast) * F.col("_m")).alias(c) for c in "rgb"])
    return p.withColumn("_g", grey()).select(*PLACE, *[clip(F.col(c) * saturation + (1 - saturation) * F.col("_g")).alias(c) for c in "rgb"])


def random_noise(pixels: DataFrame, mode: str = "gaussian", amount: float = 0.05, variance: float = 0.01, seed: int = 0, clip: bool = True) -> DataFrame:
    """Additive Gaussian or speckle noise, or salt, pepper or both; the same seed and layout give the same noise."""
    v = F.col("v")
    if mode == "gaussian":
        out = v + F.randn(seed) * variance**0.5
    elif mode == "speckle":
        out = v + v * F.randn(seed) * variance**0.5
    elif mode in ("salt", "pepper", "s&p"):
        salt = {"salt": 1.0, "pepper": 0.0, "s&p": 0.5}[mode]
        out = F.when(F.rand(seed) < amount, (F.rand(seed + 1) < salt).cast("double")).otherwise(v)
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return pixels.select(*PLACE, (F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0)) if clip else out).alias("v"))
