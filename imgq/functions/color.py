"""Colour conversions as column expressions: three channels in, three out.

All stay in generated code and fuse with their neighbours; values are doubles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

Channels = tuple[Column, Column, Column]

# Matrices and white points of the CIE and broadcast standards.
XYZ_FROM_RGB = np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]])
RGBCIE_FROM_XYZ_SCALE = np.array([[0.49, 0.31, 0.20], [0.17697, 0.81240, 0.01063], [0.00, 0.01, 0.99]]) / 0.17697
YUV_FROM_RGB = np.array([[0.299, 0.587, 0.114], [-0.14714119, -0.28886916, 0.43601035], [0.61497538, -0.51496512, -0.10001026]])
YIQ_FROM_RGB = np.array([[0.299, 0.587, 0.114], [0.59590059, -0.27455667, -0.32134392], [0.21153661, -0.52273617, 0.31119955]])
YPBPR_FROM_RGB = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
YCBCR_FROM_RGB = np.array([[65.481, 128.553, 24.966], [-37.797, -74.203, 112.0], [112.0, -93.786, -18.214]])
YDBDR_FROM_RGB = np.array([[0.299, 0.587, 0.114], [-0.45, -0.883, 1.333], [-1.333, 1.116, 0.217]])
RGB_FROM_HED = np.array([[0.65, 0.70, 0.29], [0.07, 0.99, 0.11], [0.27, 0.57, 0.78]])
WHITE_D65_2 = (0.95047, 1.0, 1.08883)
GRAY = (0.2125, 0.7154, 0.0721)


def _apply(matrix: np.ndarray, channels: Channels, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> Channels:
    return tuple(sum((F.lit(float(m)) * c for m, c in zip(row, channels, strict=True)), F.lit(o)) for row, o in zip(matrix, offset, strict=True))


def _clip01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def rgb2gray(rgb: Channels) -> Column:
    return sum((F.lit(w) * c for w, c in zip(GRAY, rgb, strict=True)), F.lit(0.0))


def gray2rgb(v: Column) -> Channels:
    return v, v, v


def gray2rgba(v: Column, alpha: float = 1.0) -> tuple[Column, Column, Column, Column]:
    return v, v, v, F.lit(alpha)


def rgba2rgb(rgba: tuple[Column, Column, Column, Column], background: tuple[float, float, float] = (1.0, 1.0, 1.0)) -> Channels:
    *rgb, a = rgba
    return tuple(_clip01((1 - a) * F.lit(b) + a * c) for c, b in zip(rgb, background, strict=True))


def rgb2hsv(rgb: Channels) -> Channels:
    r, g, b = rgb
    v, low = F.greatest(r, g, b), F.least(r, g, b)
    d = v - low
    safe = F.when(d == 0, F.lit(1.0)).otherwise(d)
    sector = F.when(r == v, (g - b) / safe).when(g == v, 2.0 + (b - r) / safe).otherwise(4.0 + (r - g) / safe) / 6.0
    # Where channels tie for the largest, the later one decides.
    sector = F.when(b == v, (4.0 + (r - g) / safe) / 6.0).when(g == v, (2.0 + (b - r) / safe) / 6.0).otherwise(sector)
    h = F.when(d == 0, F.lit(0.0)).otherwise(sector - F.floor(sector))
    return h, F.when(d == 0, F.lit(0.0)).otherwise(d / F.when(v == 0, F.lit(1.0)).otherwise(v)), v


def hsv2rgb(hsv: Channels) -> Channels:
    h, s, v = hsv
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    k = F.pmod(i, F.lit(6))
    pick = lambda *c: F.when(k == 0, c[0]).when(k == 1, c[1]).when(k == 2, c[2]).when(k == 3, c[3]).when(k == 4, c[4]).otherwise(c[5])
    return pick(v, q, p, p, t, v), pick(t, v, v, q, p, p), pick(p, p, t, v, v, q)


def rgb2xyz(rgb: Channels) -> Channels:
    linear = tuple(F.when(c > 0.04045, F.pow((c + 0.055) / 1.055, F.lit(2.4))).otherwise(c / 12.92) for c in rgb)
    return _apply(XYZ_FROM_RGB, linear)


def xyz2rgb(xyz: Channels) -> Channels:
    linear = _apply(np.linalg.inv(XYZ_FROM_RGB), xyz)
    gamma = (F.when(c > 0.0031308, 1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055).otherwise(c * 12.92) for c in linear)
    return tuple(_clip01(c) for c in gamma)


def rgb2rgbcie(rgb: Channels) -> Channels:
    return _apply(np.linalg.inv(RGBCIE_FROM_XYZ_SCALE) @ XYZ_FROM_RGB, rgb)


def rgbcie2rgb(rgb: Channels) -> Channels:
    return _apply(np.linalg.inv(XYZ_FROM_RGB) @ RGBCIE_FROM_XYZ_SCALE, rgb)


def xyz2lab(xyz: Channels, white: tuple[float, float, float] = WHITE_D65_2) -> Channels:
    t = [c / F.lit(w) for c, w in zip(xyz, white, strict=True)]
    fx, fy, fz = (F.when(c > 0.008856, F.cbrt(c)).otherwise(7.787 * c + 16 / 116) for c in t)
    return 116 * fy - 16, 500 * (fx - fy), 200 * (fy - fz)


def lab2xyz(lab: Channels, white: tuple[float, float, float] = WHITE_D65_2) -> Channels:
    l, a, b = lab
    fy = (l + 16) / 116
    fx, fz = a / 500 + fy, F.greatest(fy - b / 200, F.lit(0.0))
    return tuple(F.when(c > 0.2068966, c * c * c).otherwise((c - 16 / 116) / 7.787) * F.lit(w) for c, w in zip((fx, fy, fz), white, strict=True))


def xyz2luv(xyz: Channels, white: tuple[float, float, float] = WHITE_D65_2) -> Channels:
    x, y, z = xyz
    eps = 2.220446049250313e-16
    ratio = y / F.lit(white[1])
    l = F.when(ratio > 0.008856, 116 * F.cbrt(ratio) - 16).otherwise(903.3 * ratio)
    n = white[0] + 15 * white[1] + 3 * white[2]
    d = x + 15 * y + 3 * z + F.lit(eps)
    return l, 13 * l * (4 * x / d - F.lit(4 * white[0] / n)), 13 * l * (9 * y / d - F.lit(9 * white[1] / n))


def luv2xyz(luv: Channels, white: tuple[float, float, float] = WHITE_D65_2) -> Channels:
    l, u, v = luv
    eps = F.lit(2.220446049250313e-16)
    n = white[0] + 15 * white[1] + 3 * white[2]
    base = (l + 16) / 116
    y = F.when(l > 7.999625, base * base * base).otherwise(l / 903.3) * F.lit(white[1])
    a = F.lit(4 * white[0] / n) + u / (13 * l + eps)
    b = F.lit(9 * white[1] / n) + v / (13 * l + eps)
    c = 3 * y * (5 * b - 3)
    z = ((a - 4) * c - 15 * a * b * y) / (12 * b)
    return -(c / b + 3.0 * z), y, z


def rgb2lab(rgb: Channels) -> Channels:
    return xyz2lab(rgb2xyz(rgb))


def lab2rgb(lab: Channels) -> Channels:
    return xyz2rgb(lab2xyz(lab))


def rgb2luv(rgb: Channels) -> Channels:
    return xyz2luv(rgb2xyz(rgb))


def luv2rgb(luv: Channels) -> Channels:
    return xyz2rgb(luv2xyz(luv))


def separate_stains(rgb: Channels, matrix: np.ndarray) -> Channels:
    floor = F.lit(1e-6)
    logs = tuple(F.ln(F.greatest(c, floor)) / F.ln(floor) for c in rgb)
    return tuple(F.greatest(c, F.lit(0.0)) for c in _apply(matrix.T, logs))


def combine_stains(stains: Channels, matrix: np.ndarray) -> Channels:
    scaled = tuple(c * F.ln(F.lit(1e-6)) for c in stains)
    return tuple(_clip01(F.exp(c)) for c in _apply(matrix.T, scaled))


def rgb2hed(rgb: Channels) -> Channels:
    return separate_stains(rgb, np.linalg.inv(RGB_FROM_HED))


def hed2rgb(hed: Channels) -> Channels:
    return combine_stains(hed, RGB_FROM_HED)


def lab2lch(lab: Channels) -> Channels:
    l, a, b = lab
    h = F.atan2(b, a)
    return l, F.hypot(a, b), F.when(h < 0, h + 2 * np.pi).otherwise(h)


def lch2lab(lch: Channels) -> Channels:
    l, c, h = lch
    return l, c * F.cos(h), c * F.sin(h)


def rgb2yuv(rgb: Channels) -> Channels:
    return _apply(YUV_FROM_RGB, rgb)


def rgb2yiq(rgb: Channels) -> Channels:
    return _apply(YIQ_FROM_RGB, rgb)


def rgb2ypbpr(rgb: Channels) -> Channels:
    return _apply(YPBPR_FROM_RGB, rgb)


def rgb2ycbcr(rgb: Channels) -> Channels:
    return _apply(YCBCR_FROM_RGB, rgb, (16.0, 128.0, 128.0))


def rgb2ydbdr(rgb: Channels) -> Channels:
    return _apply(YDBDR_FROM_RGB, rgb)


def yuv2rgb(c: Channels) -> Channels:
    return _apply(np.linalg.inv(YUV_FROM_RGB), c)


def yiq2rgb(c: Channels) -> Channels:
    return _apply(np.linalg.inv(YIQ_FROM_RGB), c)


def ypbpr2rgb(c: Channels) -> Channels:
    return _apply(np.linalg.inv(YPBPR_FROM_RGB), c)


def ycbcr2rgb(c: Channels) -> Channels:
    y, cb, cr = c
    return _apply(np.linalg.inv(YCBCR_FROM_RGB), (y - 16, cb - 128, cr - 128))


def ydbdr2rgb(c: Channels) -> Channels:
    return _apply(np.linalg.inv(YDBDR_FROM_RGB), c)


#: Spaces that convert to and from RGB, for ``convert_colorspace``.
SPACES = {
    "hsv": (rgb2hsv, hsv2rgb), "rgb cie": (rgb2rgbcie, rgbcie2rgb), "xyz": (rgb2xyz, xyz2rgb), "yuv": (rgb2yuv, yuv2rgb), "yiq": (rgb2yiq, yiq2rgb),
    "ypbpr": (rgb2ypbpr, ypbpr2rgb), "ycbcr": (rgb2ycbcr, ycbcr2rgb), "ydbdr": (rgb2ydbdr, ydbdr2rgb),
}


def convert_colorspace(channels: Channels, source: str, target: str) -> Channels:
    """Between any two of RGB and ``SPACES``, by way of RGB."""
    source, target = source.lower(), target.lower()
    for name in (source, target):
        if name != "rgb" and name not in SPACES:
            raise ValueError(f"unknown colour space {name!r}")
    rgb = channels if source == "rgb" else SPACES[source][1](channels)
    return rgb if target == "rgb" else SPACES[target][0](rgb)


#: Degrees within which ``delta_e_2000`` takes hues as opposite, or as mirrored.
HUE_TIE = 1e-9


def delta_e_76(lab1: Channels, lab2: Channels) -> Column:
    return F.sqrt(sum(((a - b) * (a - b) for a, b in zip(lab1, lab2, strict=True)), F.lit(0.0)))


def hue_difference_squared(lab1: Channels, lab2: Channels) -> Column:
    """Squared hue difference, without cancellation for nearly equal hues."""
    (_, a1, b1), (_, a2, b2) = lab1, lab2
    return 2 * (F.hypot(a1, b1) * F.hypot(a2, b2) - (a1 * a2 + b1 * b2))


def delta_e_94(lab1: Channels, lab2: Channels, kh: float = 1, kc: float = 1, kl: float = 1, k1: float = 0.045, k2: float = 0.015) -> Column:
    c1, c2 = F.hypot(lab1[1], lab1[2]), F.hypot(lab2[1], lab2[2])
    dl, dc = lab1[0] - lab2[0], c1 - c2
    sc, sh = 1 + k1 * c1, 1 + k2 * c1
    out = dl * dl / kl**2 + (dc / (kc * sc)) * (dc / (kc * sc)) + hue_difference_squared(lab1, lab2) / (kh * kh * sh * sh)
    return F.sqrt(F.greatest(out, F.lit(0.0)))


def delta_e_cmc(lab1: Channels, lab2: Channels, kl: float = 1, kc: float = 1) -> Column:
    l1, c1, h1 = lab2lch(lab1)
    c2 = F.hypot(lab2[1], lab2[2])
    dc, dl = c1 - c2, l1 - lab2[0]
    deg = F.degrees(h1)
    t = F.when((deg >= 164) & (deg <= 345), 0.56 + 0.2 * F.abs(F.cos(F.radians(deg + 168)))).otherwise(0.36 + 0.4 * F.abs(F.cos(F.radians(deg + 35))))
    c4 = c1 * c1 * c1 * c1
    f = F.sqrt(c4 / (c4 + 1900))
    sl = F.when(l1 < 16, F.lit(0.511)).otherwise(0.040975 * l1 / (1 + 0.01765 * l1))
    sc = 0.638 + 0.0638 * c1 / (1 + 0.0131 * c1)
    sh = sc * (f * t + 1 - f)
    out = (dl / (kl * sl)) * (dl / (kl * sl)) + (dc / (kc * sc)) * (dc / (kc * sc)) + hue_difference_squared(lab1, lab2) / (sh * sh)
    return F.sqrt(F.greatest(out, F.lit(0.0)))


def delta_e_2000(lab1: Channels, lab2: Channels, kl: float = 1, kc: float = 1, kh: float = 1) -> Column:
    """CIEDE2000, by the published formula.

    Hues that differ by 180 degrees, or add up to 360, to within ``HUE_TIE``
    degrees count as if they did exactly, so that the last bit decides nothing.
    """
    (l1, a1, b1), (l2, a2, b2) = lab1, lab2
    seven = lambda x: F.sqrt(F.pow(x, F.lit(7.0)) / (F.pow(x, F.lit(7.0)) + 6103515625.0))
    g = 1 + 0.5 * (1 - seven((F.hypot(a1, b1) + F.hypot(a2, b2)) / 2))
    polar = lambda a, b: (F.hypot(a, b), F.pmod(F.atan2(b, a), F.lit(2 * np.pi)))
    (c1, h1), (c2, h2) = polar(a1 * g, b1), polar(a2 * g, b2)
    lm, cm = (l1 + l2) / 2, (c1 + c2) / 2
    square = (lm - 50) * (lm - 50)
    sl, sc = 1 + 0.015 * square / F.sqrt(20 + square), 1 + 0.045 * cm
    zero = c1 * c2 == 0
    d = h2 - h1
    tie = float(np.radians(HUE_TIE))
    dh = F.when(zero, F.lit(0.0)).when(d > np.pi + tie, d - 2 * np.pi).when(d < -np.pi - tie, d + 2 * np.pi).otherwise(d)
    s = h1 + h2
    far = F.abs(h1 - h2) > np.pi + tie
    hm = F.when(zero, s).when(far & (s < 2 * np.pi - tie), (s + 2 * np.pi) / 2).when(far, (s - 2 * np.pi) / 2).otherwise(s / 2)
    t = 1 - 0.17 * F.cos(hm - np.radians(30)) + 0.24 * F.cos(2 * hm) + 0.32 * F.cos(3 * hm + np.radians(6)) - 0.20 * F.cos(4 * hm - np.radians(63))
    sh = 1 + 0.015 * cm * t
    z = (F.degrees(hm) - 275) / 25
    rc = 2 * seven(cm)
    tl, tc, th = (l2 - l1) / (kl * sl), (c2 - c1) / (kc * sc), 2 * F.sqrt(c1 * c2) * F.sin(dh / 2) / (kh * sh)
    rotation = -F.sin(2 * F.radians(30 * F.exp(-z * z))) * rc * tc * th
    return F.sqrt(F.greatest(tl * tl + tc * tc + th * th + rotation, F.lit(0.0)))
