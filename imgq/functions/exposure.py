"""Intensity expressions: exposure, normalisation, comparison and dtype rescaling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ranges of the image types; floats are from -1 to 1.
RANGES = {
    "bool": (0, 1), "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65535), "int16": (-32768, 32767),
    "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1), "float32": (-1, 1), "float64": (-1, 1),
}


def dtype_limits(dtype: str, clip_negative: bool = False) -> tuple[int, int]:
    low, high = RANGES[dtype]
    return (0 if clip_negative else low), high


def clip(v: Column, low: Column | float, high: Column | float) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.least(F.greatest(v, lit(low)), lit(high))


def adjust_gamma(v: Column, gamma: float = 1, gain: float = 1, scale: float = 1) -> Column:
    return F.pow(v / scale, F.lit(float(gamma))) * scale * gain


def adjust_log(v: Column, gain: float = 1, inv: bool = False, scale: float = 1) -> Column:
    u = v / scale
    return ((F.pow(F.lit(2.0), u) - 1) if inv else F.log2(1 + u)) * scale * gain


def adjust_sigmoid(v: Column, cutoff: float = 0.5, gain: float = 10, inv: bool = False, scale: float = 1) -> Column:
    s = 1 / (1 + F.exp(gain * (cutoff - v / scale)))
    return ((1 - s) if inv else s) * scale


def rescale(v: Column, in_low: Column | float, in_high: Column | float, out_low: float, out_high: float) -> Column:
    """Clip to the input range, then stretch to the output range; a range without width only clips."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    a, b = lit(in_low), lit(in_high)
    width = F.when(a != b, b - a)
    return F.when(width.isNull(), clip(v, out_low, out_high)).otherwise((clip(v, a, b) - a) / F.coalesce(width, F.lit(1.0)) * (out_high - out_low) + out_low)


def invert(v: Column, dtype: str = "float64", signed_float: bool = False) -> Column:
    if dtype.startswith("float"):
        return -v if signed_float else 1 - v
    low, high = RANGES[dtype]
    return -1 - v if low < 0 else high - v


def normalize_data(v: Column, norm: float, low: float, high: float, kind: str = "range") -> Column:
    if kind == "range":
        return (v - low) * (norm / (high - low))
    if kind == "atan":
        return norm / (high - low) * F.atan(v - low)
    raise ValueError(f"unknown kind {kind!r}")


def scale_intensity_range(v: Column, b_max: float, b_min: float, a_max: float, a_min: float, clip_out: bool = False) -> Column:
    out = (v - a_min) / (a_max - a_min) * (b_max - b_min) + b_min
    return clip(out, b_min, b_max) if clip_out else out


def image_to_absorbance(v: Column, source: float = 255.0) -> Column:
    return -F.ln(clip(v, 1.0, source) / source)


def absorbance_to_image(a: Column, source: float = 255.0) -> Column:
    return F.rint(clip(F.exp(-a) * source, 0.0, 255.0))


def convert(v: Column, source: str, target: str) -> Column:
    """Rescale between image types; results of integer types are whole doubles."""
    (lo, hi), (tlo, thi) = RANGES[source], RANGES[target]
    is_float = lambda d: d.startswith("float")
    if source == target or is_float(source) and is_float(target):
        return v
    if target == "bool":
        return (v > (hi / 2 if not is_float(source) else 0.5)).cast("double")
    if source == "bool":
        return v if is_float(target) else v * thi
    if is_float(source):
        if tlo == 0:
            return clip(F.rint(v * thi), 0, thi)
        return clip(F.rint((v * (thi - tlo) - 1) / 2), tlo, thi)
    if is_float(target):
        return v / hi if lo == 0 else F.greatest(v / hi, F.lit(-1.0))
    # Between integers: by whole powers of two, negative values to zero where there are none.
    bits = lambda a, b: (b - a + 1).bit_length() - 1 - (a < 0)
    n, m = bits(lo, hi), bits(tlo, thi)
    u = F.greatest(v, F.lit(0.0)) if tlo == 0 else v
    if n >= m:
        return F.floor(u / 2 ** (n - m)).cast("double")
    k = -(-m // n)  # repeat the bits, so that the largest stays the largest
    up = u * sum(2 ** (n * i) for i in range(k))
    return F.floor(up / 2 ** (n * k - m)).cast("double")


def compare(a: Column, b: Column, method: str = "diff", parity: Column | None = None) -> Column:
    """Two images at one place: absolute difference, blend or checkerboard."""
    if method == "diff":
        return F.abs(b - a)
    if method == "blend":
        return 0.5 * (a + b)
    if method == "checkerboard" and parity is not None:
        return F.when(parity % 2 == 0, a).otherwise(b)
    raise ValueError(f"unknown method {method!r}")
