"""Transforms of whole images by lines, and what is done in frequency space.

A spectrum has a row for each frequency: image_id, y, x, re, im. A transform
gathers each line along one axis (as long as the image's side), transforms it
and spreads it again, then the same along the other axis: two shuffles, and no
group is more than a line. What multiplies or filters a spectrum is a column
expression. Images must be without gaps and start at 0; a null value counts as
0. An empty table gives no rows; repeated places are not allowed.

The names follow the unitary convention: forward and back both divide by the
root of the number of places.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stencil import shapes

PLACE = ["image_id", "y", "x"]
#: The kernel that punishes roughness unless another is given.
LAPLACIAN = [[0.0, -1.0, 0.0], [-1.0, 4.0, -1.0], [0.0, -1.0, 0.0]]
#: What a phase is divided by at least.
_TINY = 100 * np.finfo(np.float64).eps


def complex_image(pixels: DataFrame, column: str = "v") -> DataFrame:
    return pixels.select(*PLACE, F.coalesce(F.col(column).cast("double"), F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"))


def transform_lines(values: DataFrame, axis: str, kind: str, width: Column | None = None) -> DataFrame:
    """Each line along ``axis`` through the unitary transform ``kind``: fft, ifft, rfft or irfft.

    rfft keeps the frequencies up to half the line, irfft gives lines of
    ``width`` (a column of ``values`` that is the same all over an image).
    """
    other = "x" if axis == "y" else "y"
    lines = values.groupBy("image_id", other).agg(F.array_sort(F.collect_list(F.struct(axis, "re", "im"))).alias("l"), (F.first(width) if width is not None else F.lit(0)).cast("int").alias("n"))
    lines = lines.select("image_id", other, F.transform("l", lambda p: p["re"]).alias("re"), F.transform("l", lambda p: p["im"]).alias("im"), "n")
    run = {"fft": lambda v, n: np.fft.fft(v, norm="ortho"), "ifft": lambda v, n: np.fft.ifft(v, norm="ortho"), "rfft": lambda v, n: np.fft.rfft(v.real, norm="ortho"), "irfft": lambda v, n: np.fft.irfft(v, n, norm="ortho").astype(complex)}[kind]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            re, im = batch.column(2), batch.column(3)
            made = [run(re[k].values.to_numpy() + 1j * im[k].values.to_numpy(), n) for k, n in enumerate(batch.column(4).to_pylist())]
            parts = [pa.array([f(v) for v in made], pa.list_(pa.float64())) for f in (np.real, np.imag)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *parts], names=["image_id", other, "re", "im"])

    id_type = values.schema["image_id"].dataType.simpleString()
    done = lines.mapInArrow(compute, f"image_id {id_type}, {other} int, re array<double>, im array<double>")
    out = done.select("image_id", other, F.posexplode(F.arrays_zip("re", "im")).alias(axis, "_v"))
    return out.select(*PLACE, F.col("_v.re").alias("re"), F.col("_v.im").alias("im"))


def ufft2(image: DataFrame) -> DataFrame:
    """The spectrum of an image (image_id, y, x, re, im); of real values see ``complex_image``."""
    return transform_lines(transform_lines(image, "x", "fft"), "y", "fft")


def uifft2(spectrum: DataFrame) -> DataFrame:
    return transform_lines(transform_lines(spectrum, "y", "ifft"), "x", "ifft")


def urfft2(pixels: DataFrame, column: str = "v") -> DataFrame:
    """The half of the spectrum of a real image with x up to half its width; the rest mirrors it."""
    return transform_lines(transform_lines(complex_image(pixels, column), "x", "rfft"), "y", "fft")


def uirfft2(half: DataFrame, sizes: DataFrame) -> DataFrame:
    """The real image (image_id, y, x, v) of half a spectrum; ``sizes`` (image_id, _h, _w) has a row for each image."""
    back = transform_lines(half, "y", "ifft").join(sizes.select("image_id", "_w"), "image_id")
    return transform_lines(back, "x", "irfft", F.col("_w")).select(*PLACE, F.col("re").alias("v"))


def image_quad_norm(spectrum: DataFrame, half: bool = False) -> DataFrame:
    """``(image_id, norm)``: the sum of squares; of half a spectrum all but the first column count twice (exact for odd widths)."""
    square = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    weight = F.when(F.col("x") == 0, 1.0).otherwise(2.0) if half else F.lit(1.0)
    return spectrum.groupBy("image_id").agg(F.sum(weight * square).alias("norm"))


def transfer(kernel: list[list[float]], h: Column, w: Column) -> tuple[Column, Column]:
    """Real and imaginary part, at the frequency (y, x) of an image of h x w, of a kernel whose middle stands on a place; not unitary."""
    my, mx = len(kernel) // 2, len(kernel[0]) // 2
    re, im = F.lit(0.0), F.lit(0.0)
    for i, line in enumerate(kernel):
        for j, k in enumerate(line):
            if k:
                turn = -2 * math.pi * (F.col("y") * (i - my) / h + F.col("x") * (j - mx) / w)
                re, im = re + k * F.cos(turn), im + k * F.sin(turn)
    return re, im


def frequency(k: Column, n: Column) -> Column:
    """The signed frequency of place ``k`` of ``n``."""
    return F.when(2 * k < n, k).otherwise(k - n)


def wiener(pixels: DataFrame, psf: list[list[float]], balance: float, reg: list[list[float]] = LAPLACIAN, clip: bool = True) -> DataFrame:
    """Wiener-Hunt deconvolution: blur ``psf`` is undone as far as ``balance`` times the roughness ``reg`` lets it."""
    sizes = shapes(pixels)
    s = urfft2(pixels).join(sizes, "image_id")
    (hr, hi), (rr, ri) = transfer(psf, F.col("_h"), F.col("_w")), transfer(reg, F.col("_h"), F.col("_w"))
    s = s.select(*PLACE, "re", "im", hr.alias("hr"), hi.alias("hi"), (rr * rr + ri * ri).alias("r2"))
    weight = F.col("hr") * F.col("hr") + F.col("hi") * F.col("hi") + balance * F.col("r2")
    out = uirfft2(s.select(*PLACE, ((F.col("hr") * F.col("re") + F.col("hi") * F.col("im")) / weight).alias("re"), ((F.col("hr") * F.col("im") - F.col("hi") * F.col("re")) / weight).alias("im")), sizes)
    return out.withColumn("v", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("v")))) if clip else out


def pad(pixels: DataFrame, n: int, mode: str = "edge", value: float = 0.0) -> DataFrame:
    """``n`` more places on each side; places stay numbered from 0, so all move by ``n``.

    Modes: edge, reflect (the border place once more), mirror (not once more),
    wrap, constant. Padding by more than the side needs edge or constant.
    """
    p = pixels.select(*PLACE, "v").join(shapes(pixels), "image_id")

    def copies(c: str, side: str) -> Column:
        k, s = F.col(c), F.col(side)
        if mode == "constant":
            return F.array(k)
        if mode == "edge":
            return F.sequence(F.when(k == 0, F.lit(-n)).otherwise(k), F.when(k == s - 1, s - 1 + n).otherwise(k))
        others = {"reflect": (-1 - k, 2 * s - 1 - k), "mirror": (-k, 2 * s - 2 - k), "wrap": (k - s, k + s)}[mode]
        inside = [F.when((o >= -n) & (o < s + n) & ~((o >= 0) & (o < s)), o) for o in others]
        return F.array_compact(F.array(k, *inside))

    if mode not in ("constant", "edge", "reflect", "mirror", "wrap"):
        raise ValueError(f"unknown mode {mode!r}")
    wide = p.withColumn("_y", F.explode(copies("y", "_h"))).withColumn("_x", F.explode(copies("x", "_w")))
    out = wide.select("image_id", (F.col("_y") + n).cast("int").alias("y"), (F.col("_x") + n).cast("int").alias("x"), "v")
    return out if mode != "constant" else on_grid(out, shapes(pixels).select("image_id", (F.col("_h") + 2 * n).alias("_h"), (F.col("_w") + 2 * n).alias("_w")), value)


def on_grid(pixels: DataFrame, sizes: DataFrame, value: float = 0.0) -> DataFrame:
    """``pixels`` on whole images of ``sizes`` (image_id, _h, _w), ``value`` where there was no place."""
    lines = sizes.select("image_id", "_w", F.explode(F.sequence(F.lit(0), (F.col("_h") - 1).cast("int"))).alias("y"))
    grid = lines.select("image_id", "y", F.explode(F.sequence(F.lit(0), (F.col("_w") - 1).cast("int"))).alias("x"))
    return grid.join(pixels, PLACE, "left").select(*PLACE, F.coalesce("v", F.lit(value)).alias("v"))


def crop_to(pixels: DataFrame, top: int, left: int, sizes: DataFrame) -> DataFrame:
    """The part of each image from (top, left) on that has the size of ``sizes``, numbered from 0."""
    p = pixels.join(sizes, "image_id").where((F.col("y") >= top) & (F.col("y") < top + F.col("_h")) & (F.col("x") >= left) & (F.col("x") < left + F.col("_w")))
    return p.select("image_id", (F.col("y") - top).cast("int").alias("y"), (F.col("x") - left).cast("int").alias("x"), "v")


def butterworth(pixels: DataFrame, cutoff: float = 0.005, high_pass: bool = True, order: float = 2.0, squared: bool = True, npad: int = 0) -> DataFrame:
    """Frequencies below (or with ``high_pass`` above) ``cutoff`` of the sampling rate pass, the others fall off smoothly."""
    if not 0 < cutoff <= 0.5:
        raise ValueError("the cutoff must be over 0 and at most 0.5")
    if npad < 0:
        raise ValueError("npad must not be negative")
    wide = pad(pixels, npad) if npad else pixels
    sizes = shapes(wide)
    s = urfft2(wide).join(sizes, "image_id")
    q = F.pow(frequency(F.col("y"), F.col("_h")) / (F.col("_h") * cutoff), 2) + F.pow(F.col("x") / (F.col("_w") * cutoff), 2)
    mask = 1 / (1 + F.pow(q, order))
    mask = 1 - mask if high_pass else mask
    mask = mask if squared else F.sqrt(mask)
    out = uirfft2(s.select(*PLACE, (mask * F.col("re")).alias("re"), (mask * F.col("im")).alias("im")), sizes)
    return crop_to(out, npad, npad, shapes(pixels)) if npad else out


def fft_convolve(pixels: DataFrame, kernel: DataFrame, mode: str = "full") -> DataFrame:
    """The convolution of each image with the kernel of the same image_id, both padded with 0.

    ``mode``: full, same (as large as the image, its middle) or valid (where the
    kernel lies inside). Costs two transforms whatever the kernel's size.
    """
    own, other = shapes(pixels), shapes(kernel).select("image_id", F.col("_h").alias("_kh"), F.col("_w").alias("_kw"))
    both = own.join(other, "image_id")
    sizes = both.select("image_id", (F.col("_h") + F.col("_kh") - 1).alias("_h"), (F.col("_w") + F.col("_kw") - 1).alias("_w"))
    a = urfft2(on_grid(pixels.select(*PLACE, "v"), sizes))
    b = urfft2(on_grid(kernel.select(*PLACE, "v"), sizes)).select(*PLACE, F.col("re").alias("br"), F.col("im").alias("bi"))
    scale = F.sqrt((F.col("_h") * F.col("_w")).cast("double"))  # both transforms are unitary
    product = a.join(b, PLACE).join(sizes, "image_id")
    out = uirfft2(product.select(*PLACE, (scale * (F.col("re") * F.col("br") - F.col("im") * F.col("bi"))).alias("re"), (scale * (F.col("re") * F.col("bi") + F.col("im") * F.col("br"))).alias("im")), sizes)
    if mode == "full":
        return out
    from_y, from_x = {"same": (F.floor((F.col("_kh") - 1) / 2), F.floor((F.col("_kw") - 1) / 2)), "valid": (F.col("_kh") - 1, F.col("_kw") - 1)}[mode]
    h, w = {"same": (F.col("_h"), F.col("_w")), "valid": (F.col("_h") - F.col("_kh") + 1, F.col("_w") - F.col("_kw") + 1)}[mode]
    moved = out.join(both, "image_id").select("image_id", (F.col("y") - from_y).cast("int").alias("y"), (F.col("x") - from_x).cast("int").alias("x"), "v", h.alias("_h"), w.alias("_w"))
    return moved.where("y >= 0 AND x >= 0 AND y < _h AND x < _w").select(*PLACE, "v")


def phase_cross_correlation(reference: DataFrame, moving: DataFrame, upsample: int = 1, normalization: str | None = "phase") -> DataFrame:
    """``(image_id, shift_y, shift_x, error, phasediff)``: how far ``moving`` has to go to lie on ``reference``.

    The peak of the cross-correlation is the largest of its values, the first in
    reading order of equal ones. With ``upsample`` over 1 the correlation is
    summed anew, to that part of a place, in the 1.5 places around the peak: by
    rows first, so what is summed for a row is a few numbers. Both images of one
    image_id must have the same size. Empty images give no row.
    """
    if normalization not in (None, "phase"):
        raise ValueError("normalization must be phase or None")
    a = ufft2(complex_image(reference))
    b = ufft2(complex_image(moving)).select(*PLACE, F.col("re").alias("br"), F.col("im").alias("bi"))
    sizes = shapes(reference)
    p = a.join(b, PLACE).select(
        *PLACE, (F.col("re") * F.col("br") + F.col("im") * F.col("bi")).alias("re"), (F.col("im") * F.col("br") - F.col("re") * F.col("bi")).alias("im"),
        (F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("_a"), (F.col("br") * F.col("br") + F.col("bi") * F.col("bi")).alias("_b"),
    )
    power = p.groupBy("image_id").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    if normalization == "phase":
        # The transforms are unitary; the bound is one for plain sums.
        size = F.greatest(F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")), _TINY / (F.col("_h") * F.col("_w")))
        p = p.join(sizes, "image_id").select(*PLACE, (F.col("re") / size).alias("re"), (F.col("im") / size).alias("im"))
        per = F.lit(1.0)
    else:
        p = p.select(*PLACE, "re", "im")
        per = (F.col("_h") * F.col("_w")).cast("double")  # plain sums of a product are so many times larger

    def peak(c: DataFrame, y: str, x: str) -> DataFrame:
        best = F.max_by(F.struct(y, x, "re", "im"), F.struct(F.round(F.col("re") * F.col("re") + F.col("im") * F.col("im"), 9), (-F.col(y)).alias("a"), (-F.col(x)).alias("b")))
        return c.groupBy("image_id").agg(best.alias("_p")).select("image_id", F.col(f"_p.{y}").alias("_y"), F.col(f"_p.{x}").alias("_x"), F.col("_p.re").alias("_re"), F.col("_p.im").alias("_im"))

    found = peak(uifft2(p), "y", "x").join(sizes, "image_id")
    signed = lambda k, n: F.when(F.col(k) > F.floor(F.col(n) / 2), F.col(k) - F.col(n)).otherwise(F.col(k)).cast("double")
    found = found.select("image_id", "_h", "_w", signed("_y", "_h").alias("shift_y"), signed("_x", "_w").alias("shift_x"), "_re", "_im")
    root = F.sqrt((F.col("_h") * F.col("_w")).cast("double"))
    if upsample == 1:  # the sum over frequencies by the number of places
        values = found.select("*", (F.col("_re") / root * per).alias("cr"), (F.col("_im") / root * per).alias("ci"))
        amplitude = lambda c: F.col(c)  # noqa: E731  unitary: the sum of squares of the plain transform by the number of places
    else:
        region = math.ceil(upsample * 1.5)
        middle = region // 2
        at = F.explode(F.sequence(F.lit(0), F.lit(region - 1)))
        rows = p.join(found.select("image_id", "_h", "_w", "shift_y", "shift_x"), "image_id").withColumn("_j", at)
        turn = lambda k, n, i, s: 2 * math.pi * frequency(F.col(k), F.col(n)) / F.col(n) * (F.col(s) + (F.col(i) - middle) / upsample)
        turned = lambda t: [(F.col("re") * F.cos(t) - F.col("im") * F.sin(t)).alias("re"), (F.col("re") * F.sin(t) + F.col("im") * F.cos(t)).alias("im")]
        kept = ["image_id", "_h", "shift_y", "_j", "y"]
        rows = rows.select(*kept, *turned(turn("x", "_w", "_j", "shift_x"))).groupBy(*kept).agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        rows = rows.withColumn("_i", at)
        rows = rows.select("image_id", "_i", "_j", *turned(turn("y", "_h", "_i", "shift_y"))).groupBy("image_id", "_i", "_j").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
        fine = peak(rows, "_i", "_j").select("image_id", F.col("_y").alias("_i"), F.col("_x").alias("_j"), F.col("_re").alias("_fr"), F.col("_im").alias("_fi"))
        values = found.join(fine, "image_id").select(
            "image_id", "_h", "_w", (F.col("shift_y") + (F.col("_i") - middle) / upsample).alias("shift_y"), (F.col("shift_x") + (F.col("_j") - middle) / upsample).alias("shift_x"),
            (F.col("_fr") * per).alias("cr"), (F.col("_fi") * per).alias("ci"),
        )
        amplitude = lambda c: F.col(c) * F.col("_h") * F.col("_w")
    one = lambda c, side: F.when(F.col(side) == 1, 0.0).otherwise(F.col(c)).alias(c)  # noqa: E731  an axis of one place has no shift
    error = F.sqrt(F.abs(1 - (F.col("cr") * F.col("cr") + F.col("ci") * F.col("ci")) / (amplitude("_a") * amplitude("_b"))))
    return values.join(power, "image_id").select("image_id", one("shift_y", "_h"), one("shift_x", "_w"), error.alias("error"), F.atan2("ci", "cr").alias("phasediff"))
