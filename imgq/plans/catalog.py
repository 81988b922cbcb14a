"""The registered queries over rasters of the driver's tables, each with its SQL.

Doubles are rounded to six places on both sides, as sums run in any order.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import raster
from ..functions import color, exposure
from ..operators import features, histogram, metrics, regions, stencil, transform
from . import region_query

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

EMBEDDING = "SELECT 0::BIGINT AS image_id, vec_id::INT AS y, (i - 1)::INT AS x, e::DOUBLE AS v, label AS l FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS e FROM embeddings)"
BYTES = f"SELECT image_id, y, x, least(255.0, greatest(0.0, floor((v + 0.75) / 1.5 * 256)))::DOUBLE AS v FROM ({EMBEDDING})"
LABELS = f"SELECT image_id, y, x, v, CASE WHEN v > 0 THEN l + 1 ELSE 0 END::BIGINT AS label FROM ({EMBEDDING})"
_CHANNEL = "least(255.0, greatest(0.0, floor((coalesce(embedding[3 * x + {k}]::DOUBLE, 0) + 0.75) / 1.5 * 256)))::DOUBLE / 255.0 AS {c}"
COLOURS = f"SELECT 0::BIGINT AS image_id, vec_id::INT AS y, x::INT AS x, {', '.join(_CHANNEL.format(k=k + 1, c=c) for k, c in enumerate('rgb'))} FROM (SELECT vec_id, embedding, unnest(range(((len(embedding) + 2) // 3)::BIGINT)) AS x FROM embeddings)"
GRID = """SELECT 0::BIGINT AS image_id, (l_partkey % 64)::INT AS y, (l_suppkey % 64)::INT AS x, sum(l_quantity) AS v, sum(l_tax) AS w,
  min(l_linenumber)::BIGINT AS label, max(l_linenumber)::BIGINT AS other FROM lineitem GROUP BY ALL"""
FULL = f"SELECT 0::BIGINT AS image_id, a.y::INT AS y, b.x::INT AS x, coalesce(v, 0) AS v, coalesce(w, 0) AS w, coalesce(label, 0) AS label, coalesce(other, 0) AS other FROM range(64) a(y) CROSS JOIN range(64) b(x) LEFT JOIN ({GRID}) g ON g.y = a.y AND g.x = b.x"
EVENTS = """SELECT 0::BIGINT AS image_id, g.y::INT AS y, g.x::INT AS x, coalesce(n, 0)::DOUBLE AS v
  FROM (SELECT y, x FROM range(720) a(y), range(64) b(x)) g
  LEFT JOIN (SELECT floor(epoch(ts) / 3600)::BIGINT % 720 AS y, user_id % 64 AS x, count(*) AS n FROM events GROUP BY ALL) c USING (y, x)"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select([(F.round(F.col(c), 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def register(name: str, query: Query, sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"{name} is there already")
    QUERIES[name] = lambda spark, sf_dir: rounded(query(spark, sf_dir))
    if sql is not None:
        SQL[name] = sql


# -- colours --------------------------------------------------------------------------


def _channels() -> color.Channels:
    return F.col("r"), F.col("g"), F.col("b")


def _colour(name: str, f: Callable, sql: tuple[str, ...], table: str = COLOURS) -> None:
    """Three channels in, one or three out, at every place; the oracle's ``sql`` reads r, g, b."""
    names = ("a0", "a1", "a2", "a3")[: len(sql)]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = f(_channels())
        out = out if isinstance(out, tuple | list) else (out,)
        return raster.embedding_colours(spark, sf_dir).select("y", "x", *[c.alias(n) for c, n in zip(out, names, strict=True)])

    register(name, query, f"SELECT y, x, {', '.join(_r(e, n) for e, n in zip(sql, names, strict=True))} FROM ({table})")


def _linear(m: np.ndarray, c: tuple[str, ...] = ("r", "g", "b"), o: tuple[float, ...] = (0, 0, 0)) -> tuple[str, ...]:
    return tuple(f"({k} + " + " + ".join(f"{float(w)!r}::DOUBLE * ({x})" for w, x in zip(row, c, strict=True)) + ")" for row, k in zip(m, o, strict=True))


def _gamma_in(c: str) -> str:
    return f"CASE WHEN {c} > 0.04045 THEN pow(({c} + 0.055) / 1.055, 2.4) ELSE {c} / 12.92 END"


def _gamma_out(c: str) -> str:
    return f"least(1, greatest(0, CASE WHEN {c} > 0.0031308 THEN 1.055 * pow({c}, 1 / 2.4) - 0.055 ELSE 12.92 * {c} END))"


XYZ = _linear(color.XYZ_FROM_RGB, tuple(map(_gamma_in, "rgb")))
WHITE = color.WHITE_D65_2


def _lab_sql(xyz: tuple[str, ...]) -> tuple[str, ...]:
    f = [f"(CASE WHEN {c} / {w} > 0.008856 THEN cbrt({c} / {w}) ELSE 7.787 * {c} / {w} + 16 / 116 END)" for c, w in zip(xyz, WHITE, strict=True)]
    return f"116 * {f[1]} - 16", f"500 * ({f[0]} - {f[1]})", f"200 * ({f[1]} - {f[2]})"


def _luv_sql(xyz: tuple[str, ...]) -> tuple[str, ...]:
    x, y, z = xyz
    l = f"(CASE WHEN {y} > 0.008856 THEN 116 * cbrt({y}) - 16 ELSE 903.3 * {y} END)"
    d, n = f"({x} + 15 * {y} + 3 * {z} + 2.220446049250313e-16)", WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    return l, f"13 * {l} * (4 * {x} / {d} - {4 * WHITE[0] / n!r})", f"13 * {l} * (9 * {y} / {d} - {9 * WHITE[1] / n!r})"


_HSV_H = """CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0
  WHEN greatest(r, g, b) = b THEN (4 + (r - g) / (greatest(r, g, b) - least(r, g, b))) / 6
  WHEN greatest(r, g, b) = g THEN (2 + (b - r) / (greatest(r, g, b) - least(r, g, b))) / 6
  ELSE (g - b) / (greatest(r, g, b) - least(r, g, b)) / 6 + CASE WHEN g < b THEN 1 ELSE 0 END END"""
_HSV_S = "CASE WHEN greatest(r, g, b) = least(r, g, b) THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END"


def _hsv2rgb_sql() -> tuple[str, ...]:
    i, f = "floor(r * 6)", "(r * 6 - floor(r * 6))"
    p, q, t, v = "b * (1 - g)", f"b * (1 - {f} * g)", f"b * (1 - (1 - {f}) * g)", "b"
    pick = lambda c: f"CASE {i}::INT % 6 " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(c)) + " END"
    return pick((v, q, p, p, t, v)), pick((t, v, v, q, p, p)), pick((p, p, t, v, v, q))


_colour("rgb2gray", color.rgb2gray, ("0.2125 * r + 0.7154 * g + 0.0721 * b",))
_colour("gray2rgb", lambda c: color.gray2rgb(c[0]), ("r", "r", "r"))
_colour("gray2rgba", lambda c: color.gray2rgba(c[0], 0.5), ("r", "r", "r", "0.5::DOUBLE"))
_colour("rgba2rgb", lambda c: color.rgba2rgb((*c, c[0]), (1.0, 0.5, 0.0)), ("(1 - r) * 1.0 + r * r", "(1 - r) * 0.5 + r * g", "r * b"))
_colour("rgb2hsv", color.rgb2hsv, (_HSV_H, _HSV_S, "greatest(r, g, b)"))
_colour("hsv2rgb", color.hsv2rgb, _hsv2rgb_sql())
_colour("rgb2xyz", color.rgb2xyz, XYZ)
_colour("xyz2rgb", color.xyz2rgb, tuple(map(_gamma_out, _linear(np.linalg.inv(color.XYZ_FROM_RGB)))))
_colour("rgb2lab", color.rgb2lab, _lab_sql(XYZ))
_colour("xyz2lab", color.xyz2lab, _lab_sql(("r", "g", "b")))
_colour("rgb2luv", color.rgb2luv, _luv_sql(XYZ))
_colour("xyz2luv", color.xyz2luv, _luv_sql(("r", "g", "b")))
for _name, _m, _o in (("yuv", color.YUV_FROM_RGB, 0), ("yiq", color.YIQ_FROM_RGB, 0), ("ypbpr", color.YPBPR_FROM_RGB, 0), ("ydbdr", color.YDBDR_FROM_RGB, 0)):
    _colour(f"rgb2{_name}", color.SPACES[_name][0], _linear(_m))
    _colour(f"{_name}2rgb", color.SPACES[_name][1], _linear(np.linalg.inv(_m)))
_colour("rgb2ycbcr", color.rgb2ycbcr, _linear(color.YCBCR_FROM_RGB, o=(16, 128, 128)))
_colour("ycbcr2rgb", color.ycbcr2rgb, _linear(np.linalg.inv(color.YCBCR_FROM_RGB), ("r - 16", "g - 128", "b - 128")))
_colour("rgb2rgbcie", color.rgb2rgbcie, _linear(np.linalg.inv(color.RGBCIE_FROM_XYZ_SCALE) @ color.XYZ_FROM_RGB))
_colour("rgbcie2rgb", color.rgbcie2rgb, _linear(np.linalg.inv(color.XYZ_FROM_RGB) @ color.RGBCIE_FROM_XYZ_SCALE))
_LOGS = tuple(f"ln(greatest({c}, 1e-6)) / ln(1e-6)" for c in "rgb")
_colour("rgb2hed", color.rgb2hed, tuple(f"greatest(0, {e})" for e in _linear(np.linalg.inv(color.RGB_FROM_HED).T, _LOGS)))
_colour("hed2rgb", color.hed2rgb, tuple(f"least(1, exp({e}))" for e in _linear(color.RGB_FROM_HED.T, tuple(f"{c} * ln(1e-6)" for c in "rgb"))))
_ab = lambda c: (100 * c[0], 200 * c[1] - 100, 200 * c[2] - 100)
_AB = ("(100 * r)", "(200 * g - 100)", "(200 * b - 100)")
_colour("lab2lch", lambda c: color.lab2lch(_ab(c)), (_AB[0], f"sqrt({_AB[1]} * {_AB[1]} + {_AB[2]} * {_AB[2]})", f"CASE WHEN atan2({_AB[2]}, {_AB[1]}) < 0 THEN 2 * pi() ELSE 0 END + atan2({_AB[2]}, {_AB[1]})"))
_colour("lch2lab", lambda c: color.lch2lab(c), ("r", "g * cos(b)", "g * sin(b)"))


def _lab2xyz_sql(lab: tuple[str, ...]) -> tuple[str, ...]:
    fy = f"(({lab[0]} + 16) / 116)"
    f = (f"({lab[1]} / 500 + {fy})", fy, f"greatest(0, {fy} - {lab[2]} / 200)")
    return tuple(f"(CASE WHEN {c} > 0.2068966 THEN pow({c}, 3) ELSE ({c} - 16 / 116) / 7.787 END * {w})" for c, w in zip(f, WHITE, strict=True))


_colour("lab2xyz", lambda c: color.lab2xyz(_ab(c)), _lab2xyz_sql(_AB))
_colour("lab2rgb", lambda c: color.lab2rgb(_ab(c)), tuple(map(_gamma_out, _linear(np.linalg.inv(color.XYZ_FROM_RGB), _lab2xyz_sql(_AB)))))


def _luv2xyz_sql(luv: tuple[str, ...]) -> tuple[str, ...]:
    n = WHITE[0] + 15 * WHITE[1] + 3 * WHITE[2]
    l, u, v = luv
    y = f"(CASE WHEN {l} > 7.999625 THEN pow(({l} + 16) / 116, 3) ELSE {l} / 903.3 END)"
    a, b = f"({4 * WHITE[0] / n!r} + {u} / (13 * {l} + 2.220446049250313e-16))", f"({9 * WHITE[1] / n!r} + {v} / (13 * {l} + 2.220446049250313e-16))"
    c = f"(3 * {y} * (5 * {b} - 3))"
    z = f"((({a} - 4) * {c} - 15 * {a} * {b} * {y}) / (12 * {b}))"
    return f"(-({c} / {b} + 3 * {z}))", y, z


_luv_in = lambda c: (100 * c[0] + 10, 10 * c[1] - 5, 10 * c[2] - 5)
_LUV_IN = ("(100 * r + 10)", "(10 * g - 5)", "(10 * b - 5)")
_colour("luv2xyz", lambda c: color.luv2xyz(_luv_in(c)), _luv2xyz_sql(_LUV_IN))
_colour("luv2rgb", lambda c: color.luv2rgb(_luv_in(c)), tuple(map(_gamma_out, _linear(np.linalg.inv(color.XYZ_FROM_RGB), _luv2xyz_sql(_LUV_IN)))))
_colour("convert_colorspace", lambda c: color.convert_colorspace(c, "YUV", "YIQ"), _linear(color.YIQ_FROM_RGB @ np.linalg.inv(color.YUV_FROM_RGB)))

# Two colours a place: one from the channels, one from the channels turned round.
_two = lambda f: lambda c: f(_ab(c), _ab((c[2], c[0], c[1])))
_A = ("(100 * r)", "(200 * g - 100)", "(200 * b - 100)")
_B = ("(100 * b)", "(200 * r - 100)", "(200 * g - 100)")
_C1, _C2 = (f"sqrt({c[1]} * {c[1]} + {c[2]} * {c[2]})" for c in (_A, _B))
_DH2 = f"(2 * ({_C1} * {_C2} - ({_A[1]} * {_B[1]} + {_A[2]} * {_B[2]})))"
_colour("deltaE_cie76", _two(color.delta_e_76), ("sqrt(" + " + ".join(f"pow({a} - {b}, 2)" for a, b in zip(_A, _B, strict=True)) + ")",))
_colour("get_dH2", _two(color.hue_difference_squared), (_DH2,))
_colour("deltaE_ciede94", _two(color.delta_e_94), (f"sqrt(greatest(0, pow({_A[0]} - {_B[0]}, 2) + pow(({_C1} - {_C2}) / (1 + 0.045 * {_C1}), 2) + {_DH2} / pow(1 + 0.015 * {_C1}, 2)))",))
SQL_CMC = f"""
WITH p AS (SELECT y, x, {_A[0]} AS l1, {_B[0]} AS l2, {_C1} AS c1, {_C2} AS c2, {_DH2} AS dh2, degrees(atan2({_A[2]}, {_A[1]})) AS h0 FROM ({COLOURS})),
q AS (SELECT *, CASE WHEN h0 < 0 THEN h0 + 360 ELSE h0 END AS h FROM p),
s AS (SELECT *, CASE WHEN h BETWEEN 164 AND 345 THEN 0.56 + 0.2 * abs(cos(radians(h + 168))) ELSE 0.36 + 0.4 * abs(cos(radians(h + 35))) END AS t,
  sqrt(pow(c1, 4) / (pow(c1, 4) + 1900)) AS f, CASE WHEN l1 < 16 THEN 0.511 ELSE 0.040975 * l1 / (1 + 0.01765 * l1) END AS sl, 0.638 + 0.0638 * c1 / (1 + 0.0131 * c1) AS sc FROM q)
SELECT y, x, round(sqrt(greatest(0, pow((l1 - l2) / sl, 2) + pow((c1 - c2) / sc, 2) + dh2 / pow(sc * (f * t + 1 - f), 2))), 6) + 0.0 AS a0 FROM s
"""
_colour("deltaE_cmc", _two(color.delta_e_cmc), ("0",))
SQL["deltaE_cmc"] = SQL_CMC
SQL_2000 = f"""
WITH p AS (SELECT y, x, {_A[0]} AS l1, {_A[1]} AS a1, {_A[2]} AS b1, {_B[0]} AS l2, {_B[1]} AS a2, {_B[2]} AS b2, ({_C1} + {_C2}) / 2 AS m FROM ({COLOURS})),
g AS (SELECT *, 1 + 0.5 * (1 - sqrt(pow(m, 7) / (pow(m, 7) + pow(25, 7)))) AS g FROM p),
c AS (SELECT *, sqrt(pow(a1 * g, 2) + b1 * b1) AS c1, sqrt(pow(a2 * g, 2) + b2 * b2) AS c2, degrees(atan2(b1, a1 * g)) AS i1, degrees(atan2(b2, a2 * g)) AS i2 FROM g),
h AS (SELECT *, CASE WHEN i1 < 0 THEN i1 + 360 ELSE i1 END AS h1, CASE WHEN i2 < 0 THEN i2 + 360 ELSE i2 END AS h2 FROM c),
d AS (SELECT *, CASE WHEN c1 * c2 = 0 THEN 0 WHEN h2 - h1 > 180 + {color.HUE_TIE} THEN h2 - h1 - 360 WHEN h2 - h1 < -180 - {color.HUE_TIE} THEN h2 - h1 + 360 ELSE h2 - h1 END AS dh,
  CASE WHEN c1 * c2 = 0 THEN h1 + h2 WHEN abs(h1 - h2) <= 180 + {color.HUE_TIE} THEN (h1 + h2) / 2 WHEN h1 + h2 < 360 - {color.HUE_TIE} THEN (h1 + h2 + 360) / 2 ELSE (h1 + h2 - 360) / 2 END AS hm,
  (l1 + l2) / 2 AS lm, (c1 + c2) / 2 AS cm FROM h),
s AS (SELECT *, 1 - 0.17 * cos(radians(hm - 30)) + 0.24 * cos(radians(2 * hm)) + 0.32 * cos(radians(3 * hm + 6)) - 0.2 * cos(radians(4 * hm - 63)) AS t FROM d),
k AS (SELECT *, (l2 - l1) / (1 + 0.015 * pow(lm - 50, 2) / sqrt(20 + pow(lm - 50, 2))) AS tl, (c2 - c1) / (1 + 0.045 * cm) AS tc,
  2 * sqrt(c1 * c2) * sin(radians(dh / 2)) / (1 + 0.015 * cm * t) AS th, 2 * sqrt(pow(cm, 7) / (pow(cm, 7) + pow(25, 7))) AS rc FROM s)
SELECT y, x, round(sqrt(greatest(0, tl * tl + tc * tc + th * th - sin(radians(60 * exp(-pow((hm - 275) / 25, 2)))) * rc * tc * th)), 6) + 0.0 AS a0 FROM k
"""
_colour("deltaE_ciede2000", _two(color.delta_e_2000), ("0",))
SQL["deltaE_ciede2000"] = SQL_2000

# -- intensities ---------------------------------------------------------------------


def _pixelwise(name: str, f: Callable, sql: str) -> None:
    """One expression over v, bytes scaled to [0, 1]."""
    register(
        name,
        lambda spark, sf_dir: raster.embedding_bytes(spark, sf_dir).withColumn("v", F.col("v") / 255).select("y", "x", f(F.col("v")).alias("v")),
        f"SELECT y, x, {_r(sql, 'v')} FROM (SELECT y, x, v / 255 AS v FROM ({BYTES}))",
    )


_pixelwise("adjust_gamma", lambda v: exposure.adjust_gamma(v, 1.7, 0.9), "pow(v, 1.7) * 0.9")
_pixelwise("adjust_log", lambda v: exposure.adjust_log(v, 1.5), "log2(1 + v) * 1.5")
_pixelwise("adjust_log_inverse", lambda v: exposure.adjust_log(v, 1.5, inv=True), "(pow(2, v) - 1) * 1.5")
_pixelwise("adjust_sigmoid", lambda v: exposure.adjust_sigmoid(v, 0.4, 8), "1 / (1 + exp(8 * (0.4 - v)))")
_pixelwise("invert", lambda v: exposure.invert(v), "1 - v")
_pixelwise("invert_uint8", lambda v: exposure.invert(v * 255, "uint8"), "255 - v * 255")
_pixelwise("normalize_data", lambda v: exposure.normalize_data(v, 2.0, 0.1, 0.9), "(v - 0.1) * 2 / (0.9 - 0.1)")
_pixelwise("normalize_data_atan", lambda v: exposure.normalize_data(v, 2.0, 0.1, 0.9, "atan"), "2 / (0.9 - 0.1) * atan(v - 0.1)")
_pixelwise("scale_intensity_range", lambda v: exposure.scale_intensity_range(v, 1.0, -1.0, 0.8, 0.2, True), "least(1, greatest(-1, (v - 0.2) / (0.8 - 0.2) * 2 - 1))")
_pixelwise("image_to_absorbance", lambda v: exposure.image_to_absorbance(v * 255), "-ln(greatest(v * 255, 1) / 255)")
_pixelwise("absorbance_to_image", lambda v: exposure.absorbance_to_image(v), "round_even(least(255, greatest(0, exp(-v) * 255)), 0)")
_pixelwise("img_as_ubyte", lambda v: exposure.convert(v, "float64", "uint8"), "round_even(v * 255, 0)")
_pixelwise("img_as_uint", lambda v: exposure.convert(v, "float64", "uint16"), "round_even(v * 65535, 0)")
_pixelwise("img_as_int", lambda v: exposure.convert(v, "float64", "int16"), "round_even((v * 65535 - 1) / 2, 0)")
_pixelwise("img_as_float", lambda v: exposure.convert(v * 255, "uint8", "float64"), "v * 255 / 255")
_pixelwise("img_as_bool", lambda v: exposure.convert(v * 255, "uint8", "bool"), "CASE WHEN v * 255 > 127.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END")


def _rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.embedding_image(spark, sf_dir)
    limits = histogram.quantiles(p, {"a": 0.02, "b": 0.98})
    return p.join(F.broadcast(limits), "image_id").select("y", "x", exposure.rescale(F.col("v"), F.col("a"), F.col("b"), 0, 255).alias("v"))


register("rescale_intensity", _rescale, f"WITH p AS ({EMBEDDING}), l AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM p) SELECT y, x, {_r('(least(b, greatest(a, v)) - a) / (b - a) * 255', 'v')} FROM p, l")


def _compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = raster.part_grid(spark, sf_dir).withColumns({"v": F.col("v") / 100, "w": F.col("w") * 10})
    parity = F.floor(F.col("y") / 8) + F.floor(F.col("x") / 8)
    return p.select("y", "x", *[exposure.compare(F.col("v"), F.col("w"), m, parity).alias(m) for m in ("diff", "blend", "checkerboard")])


register("compare_images", _compare, f"SELECT y, x, {_r('abs(w * 10 - v / 100)', 'diff')}, {_r('(v / 100 + w * 10) / 2', 'blend')}, {_r('CASE WHEN (y // 8 + x // 8) % 2 = 0 THEN v / 100 ELSE w * 10 END', 'checkerboard')} FROM ({GRID})")

# -- histograms and thresholds ---------------------------------------------------------

HIST = f"""p AS ({EMBEDDING}), r AS (SELECT min(v) AS a, max(v) AS b FROM p),
k AS (SELECT least(255, floor((v - a) / (b - a) * 256)::INT) AS bin, count(*) AS n FROM p, r GROUP BY 1),
h AS (SELECT bin, a + (bin + 0.5) * (b - a) / 256 AS center, coalesce(n, 0) AS cnt FROM (SELECT unnest(range(256))::INT AS bin) CROSS JOIN r LEFT JOIN k USING (bin)),
c AS (SELECT *, sum(cnt) OVER u AS w1, sum(cnt * center) OVER u AS m1, sum(cnt) OVER () AS t, sum(cnt * center) OVER () AS m, lead(center) OVER u AS next FROM h WINDOW u AS (ORDER BY bin))"""
_hist = lambda spark, sf_dir: histogram.histogram(raster.embedding_image(spark, sf_dir))
register("histogram", lambda s, d: _hist(s, d).select("bin", "center", "cnt"), f"WITH {HIST} SELECT bin, {_r('center', 'center')}, cnt FROM h")
register("cumulative_distribution", lambda s, d: histogram.cumulative_distribution(_hist(s, d)).select("bin", "cdf"), f"WITH {HIST} SELECT bin, {_r('w1 / t', 'cdf')} FROM c")
register("histogram_integers", lambda s, d: histogram.integer_histogram(raster.embedding_bytes(s, d)).select("center", "cnt"), f"WITH p AS ({BYTES}), k AS (SELECT v, count(*) AS n FROM p GROUP BY v) SELECT x::DOUBLE AS center, coalesce(n, 0) AS cnt FROM (SELECT unnest(range((SELECT min(v) FROM p)::BIGINT, (SELECT max(v) FROM p)::BIGINT + 1)) AS x) LEFT JOIN k ON v = x")
register(
    "equalize_hist", lambda s, d: histogram.equalize(raster.embedding_image(s, d)).select("y", "x", "v"),
    f"""WITH {HIST}, d AS (SELECT center AS c0, w1 / t AS p0, next AS c1, lead(w1 / t) OVER (ORDER BY bin) AS p1 FROM c), e AS (SELECT min(center) AS lo, max(center) AS hi, min(w1 / t) AS plo FROM c)
SELECT y, x, round(CASE WHEN v <= lo THEN plo WHEN v >= hi THEN 1 ELSE (SELECT p0 + (p1 - p0) * (p.v - c0) / (c1 - c0) FROM d WHERE p.v >= c0 AND p.v < c1) END, 6) + 0.0 AS v FROM p, e""",
)
_threshold = lambda f: lambda s, d: f(_hist(s, d)).select("threshold")
register("threshold_otsu", _threshold(histogram.threshold_otsu), f"WITH {HIST} SELECT round(arg_max(center, (w1 * (t - w1) * pow(m1 / w1 - (m - m1) / (t - w1), 2))), 6) + 0.0 AS threshold FROM c WHERE w1 > 0 AND w1 < t")
register("threshold_isodata", _threshold(histogram.threshold_isodata), f"WITH {HIST} SELECT round(min(center), 6) + 0.0 AS threshold FROM c WHERE w1 > 0 AND w1 < t AND (m1 / w1 + (m - m1) / (t - w1)) / 2 - center >= 0 AND (m1 / w1 + (m - m1) / (t - w1)) / 2 - center < next - center")
register("threshold_yen", _threshold(histogram.threshold_yen), f"""WITH {HIST}, q AS (SELECT center, w1, w1 / t AS p1, t, sum(pow(cnt / t, 2)) OVER (ORDER BY bin) AS s1, sum(pow(cnt / t, 2)) OVER () AS s FROM c)
SELECT round(arg_max(center, ln(pow(p1 * (1 - p1), 2) / (s1 * (s - s1)))), 6) + 0.0 AS threshold FROM q WHERE w1 > 0 AND w1 < t""")
register("threshold_triangle", _threshold(histogram.threshold_triangle), f"""WITH {HIST}, e AS (SELECT min(bin) AS lo, max(bin) AS hi, max(cnt) AS top, (SELECT min(bin) FROM h WHERE cnt = (SELECT max(cnt) FROM h)) AS peak FROM h WHERE cnt > 0),
f AS (SELECT center, cnt, top, CASE WHEN peak - lo < hi - peak THEN hi - bin ELSE bin - lo END AS t, greatest(peak - lo, hi - peak) AS w FROM h, e)
SELECT round(arg_max(center, top * t - w * cnt), 6) + 0.0 AS threshold FROM f WHERE t >= 0 AND t < w""")
register("threshold_mean", lambda s, d: histogram.threshold_mean(raster.embedding_image(s, d)).select("threshold"), f"SELECT round(avg(v), 6) + 0.0 AS threshold FROM ({EMBEDDING})")
register("threshold_multiotsu", lambda s, d: histogram.threshold_multiotsu(_hist(s, d)).select("threshold_1", "threshold_2"), f"""WITH {HIST}
SELECT round(arg_max(a.center, s), 6) + 0.0 AS threshold_1, round(arg_max(b.center, s), 6) + 0.0 AS threshold_2 FROM (
SELECT struct_pack(center := a.center) AS a, struct_pack(center := b.center) AS b, a.m1 * a.m1 / a.w1 + coalesce(pow(b.m1 - a.m1, 2) / nullif(b.w1 - a.w1, 0), 0) + coalesce(pow(b.m - b.m1, 2) / nullif(b.t - b.w1, 0), 0) AS s
FROM c a JOIN c b ON a.bin < b.bin WHERE a.w1 > 0)""")
register("threshold_li", lambda s, d: histogram.threshold_li(raster.embedding_bytes(s, d), tolerance=1e-9).select("threshold"), f"""WITH RECURSIVE p AS (SELECT v, count(*) AS n FROM ({BYTES}) GROUP BY v), lo AS (SELECT min(v) AS lo, sum(v * n) / sum(n) AS m FROM p),
k(i, t) AS (SELECT 0, m FROM lo UNION ALL SELECT i + 1, (SELECT lo + (b - f) / (ln(b) - ln(f)) FROM (SELECT lo, sum(v * n) FILTER (WHERE v > k.t) / sum(n) FILTER (WHERE v > k.t) - lo AS f, sum(v * n) FILTER (WHERE v <= k.t) / sum(n) FILTER (WHERE v <= k.t) - lo AS b FROM p, lo GROUP BY lo)) FROM k WHERE i < 60)
SELECT round(arg_max(t, i), 6) + 0.0 AS threshold FROM k""")
register("threshold_minimum", lambda s, d: histogram.threshold_minimum(_hist(s, d).withColumn("cnt", F.col("cnt") + F.when(F.col("bin").between(200, 220), 900).otherwise(0))).select("threshold"))
register("shannon_entropy", lambda s, d: histogram.shannon_entropy(raster.embedding_bytes(s, d)).select("entropy"), f"SELECT round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM (SELECT count(*) / sum(count(*)) OVER () AS p FROM ({BYTES}) GROUP BY v)")
register("is_low_contrast", lambda s, d: histogram.is_low_contrast(raster.embedding_bytes(s, d), 255).select("low_contrast"), f"SELECT (quantile_cont(v, 0.99) - quantile_cont(v, 0.01)) / 255 < 0.05 AS low_contrast FROM ({BYTES})")
register(
    "match_histograms",
    lambda s, d: histogram.match_histograms(raster.embedding_bytes(s, d), raster.event_image(s, d)).select("y", "x", "v"),
    f"""WITH a AS (SELECT v, sum(count(*)) OVER (ORDER BY v) / sum(count(*)) OVER () AS q FROM ({BYTES}) GROUP BY v),
b AS (SELECT v AS r, sum(count(*)) OVER (ORDER BY v) / sum(count(*)) OVER () AS q1 FROM ({EVENTS}) GROUP BY v),
e AS (SELECT r, q1, lag(q1) OVER (ORDER BY r) AS q0, lag(r) OVER (ORDER BY r) AS r0 FROM b),
l AS (SELECT a.v, CASE WHEN q0 IS NULL THEN r ELSE r0 + (r - r0) * (q - q0) / (q1 - q0) END AS m FROM a JOIN e ON q <= q1 AND (q0 IS NULL OR q > q0))
SELECT y, x, round(m, 6) + 0.0 AS v FROM ({BYTES}) p JOIN l USING (v)""",
)
register("rank_order", lambda s, d: features.rank_order(raster.embedding_bytes(s, d)).select("y", "x", "rank"), f"SELECT y, x, (dense_rank() OVER (ORDER BY v) - 1)::INT AS rank FROM ({BYTES})")

# -- neighbourhoods ------------------------------------------------------------------


def _shift_sql(table: str, steps: list[tuple], aggregate: str, mode: str = "reflect", digits: int = 6) -> str:
    """Gather by a self-join; n is the neighbour and k its weight."""
    values = ", ".join(f"({dy}, {dx}, {float(w[0]) if w else 1.0!r})" for dy, dx, *w in steps)
    f = {
        "reflect": lambda i, n: f"CASE WHEN {i} < 0 THEN -1 - ({i}) WHEN {i} >= {n} THEN 2 * {n} - 1 - ({i}) ELSE {i} END",
        "mirror": lambda i, n: f"CASE WHEN {i} < 0 THEN -({i}) WHEN {i} >= {n} THEN 2 * {n} - 2 - ({i}) ELSE {i} END",
        "nearest": lambda i, n: f"least(greatest({i}, 0), {n} - 1)",
        "ignore": lambda i, n: i,
    }[mode]
    return f"""WITH p AS MATERIALIZED ({table}), z AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM p), o(dy, dx, k) AS (VALUES {values}),
g AS (SELECT p.y, p.x, {f('p.y + dy', 'h')} AS sy, {f('p.x + dx', 'w')} AS sx, k FROM p, z, o)
SELECT g.y, g.x, round({aggregate}, {digits}) + 0.0 AS v FROM g JOIN (SELECT y AS sy, x AS sx, v AS n FROM p) USING (sy, sx) GROUP BY g.y, g.x"""


def _outer(a: list[float], b: list[float]) -> list[tuple]:
    return [(i - len(a) // 2, j - len(b) // 2, x * y) for i, x in enumerate(a) for j, y in enumerate(b)]


def _stencil(name: str, f: Callable, sql: str, image: Callable = raster.embedding_image) -> None:
    register(name, lambda s, d: f(image(s, d)).select("y", "x", "v"), sql)


for _kind, _smooth in stencil.SMOOTH.items():
    _stencil(f"{_kind}_h", lambda p, k=_kind: stencil.edge(p, k, "y"), _shift_sql(EMBEDDING, _outer([-1, 0, 1], _smooth), "sum(n * k)"))
    _stencil(f"{_kind}_v", lambda p, k=_kind: stencil.edge(p, k, "x"), _shift_sql(EMBEDDING, _outer(_smooth, [-1, 0, 1]), "sum(n * k)"))
    _h, _v = _outer([-1, 0, 1], _smooth), _outer(_smooth, [-1, 0, 1])
    _both = [(dy, dx, i) for i, (dy, dx, _) in enumerate(_h)]
    _case = lambda side: "sum(n * CASE k::INT " + " ".join(f"WHEN {i} THEN {w!r}::DOUBLE" for i, (_, _, w) in enumerate(side)) + " END)"
    _stencil(_kind, lambda p, k=_kind: stencil.edge_magnitude(p, k), _shift_sql(EMBEDDING, _both, f"sqrt((pow({_case(_h)}, 2) + pow({_case(_v)}, 2)) / 2)"))
_stencil("farid_h", lambda p: stencil.edge(p, "farid", "y"), _shift_sql(EMBEDDING, _outer(stencil.FARID_EDGE[::-1], stencil.FARID_SMOOTH), "sum(n * k)"))
_stencil("farid_v", lambda p: stencil.edge(p, "farid", "x"), _shift_sql(EMBEDDING, _outer(stencil.FARID_SMOOTH, stencil.FARID_EDGE[::-1]), "sum(n * k)"))
_stencil("roberts_pos_diag", lambda p: stencil.roberts_diagonal(p, True), _shift_sql(EMBEDDING, [(0, 0, -1), (1, 1, 1)], "sum(n * k)"))
_stencil("roberts_neg_diag", lambda p: stencil.roberts_diagonal(p, False), _shift_sql(EMBEDDING, [(0, 1, -1), (1, 0, 1)], "sum(n * k)"))
_stencil("laplace", stencil.laplace, _shift_sql(EMBEDDING, [(0, 0, 4), (0, 1, -1), (1, 0, -1), (0, -1, -1), (-1, 0, -1)], "sum(n * k)"))
_G1 = stencil.gaussian_weights(1.0)
_stencil("gaussian", lambda p: stencil.gaussian(p, 1.0), _shift_sql(EMBEDDING, _outer(_G1, _G1), "sum(n * k)", "nearest"))
_stencil("unsharp_mask", lambda p: stencil.unsharp_mask(p, 1.0, 0.7), _shift_sql(EMBEDDING, _outer(_G1, _G1), "least(1, greatest(-1, 1.7 * max(CASE WHEN k = (SELECT max(k) FROM o) THEN n END) - 0.7 * sum(n * k)))"))
_stencil("difference_of_gaussians", lambda p: stencil.difference_of_gaussians(p, 0.5, 1.0), _shift_sql(EMBEDDING, [(dy, dx, w - dict(((a, b), c) for a, b, c in _outer(_G1, _G1))[dy, dx]) for dy, dx, w in [(a, b, next((c for i, j, c in _outer(stencil.gaussian_weights(0.5), stencil.gaussian_weights(0.5)) if (i, j) == (a, b)), 0.0)) for a, b, _ in _outer(_G1, _G1)]], "sum(n * k)", "nearest"))
_stencil("threshold_local_mean", lambda p: stencil.threshold_local(p, 5, "mean", 0.01), _shift_sql(EMBEDDING, stencil.rectangle(5, 5), "avg(n) - 0.01"))
_stencil("threshold_local_median", lambda p: stencil.threshold_local(p, 3, "median"), _shift_sql(EMBEDDING, stencil.rectangle(3, 3), "median(n)"))
_NIBLACK = "avg(n) - 0.2 * sqrt(greatest(0, avg(n * n) - avg(n) * avg(n)))"
_stencil("threshold_niblack", lambda p: stencil.threshold_niblack(p, 5), _shift_sql(EMBEDDING, stencil.rectangle(5, 5), _NIBLACK, "mirror"))
_stencil("threshold_sauvola", lambda p: stencil.threshold_sauvola(p, 5), _shift_sql(EMBEDDING, stencil.rectangle(5, 5), "avg(n) * (1 + 0.2 * (sqrt(greatest(0, avg(n * n) - avg(n) * avg(n))) - 1))", "mirror"))
_stencil("median", lambda p: stencil.median(p, stencil.rectangle(3, 3)), _shift_sql(BYTES, stencil.rectangle(3, 3), "median(n)", "nearest"), raster.embedding_bytes)
for _name, _f, _agg in (("erosion", stencil.erosion, "min(n)"), ("dilation", stencil.dilation, "max(n)")):
    _stencil(_name, lambda p, f=_f: f(p, stencil.disk(2)), _shift_sql(BYTES, stencil.disk(2), _agg), raster.embedding_bytes)


def _twice_sql(table: str, steps: list[tuple], first: str, second: str, final: str = "v") -> str:
    inner = _shift_sql(table, steps, first)
    return f"WITH a AS MATERIALIZED ({inner}), b AS ({_shift_sql('SELECT * FROM a', steps, second)}), q AS ({table}) SELECT y, x, round({final}, 6) + 0.0 AS v FROM (SELECT q.y, q.x, b.v, q.v AS q FROM q JOIN b USING (y, x))"


_D1 = stencil.diamond(1)
_stencil("opening", lambda p: stencil.opening(p, _D1), _twice_sql(BYTES, _D1, "min(n)", "max(n)"), raster.embedding_bytes)
_stencil("closing", lambda p: stencil.closing(p, _D1), _twice_sql(BYTES, _D1, "max(n)", "min(n)"), raster.embedding_bytes)
_stencil("white_tophat", lambda p: stencil.white_tophat(p, _D1), _twice_sql(BYTES, _D1, "min(n)", "max(n)", "q - v"), raster.embedding_bytes)
_stencil("black_tophat", lambda p: stencil.black_tophat(p, _D1), _twice_sql(BYTES, _D1, "max(n)", "min(n)", "v - q"), raster.embedding_bytes)
_BINARY = f"SELECT image_id, y, x, (v > 0)::INT::DOUBLE AS v FROM ({EMBEDDING})"
_binary = lambda s, d: raster.embedding_image(s, d).withColumn("v", (F.col("v") > 0).cast("double"))
_stencil("binary_erosion", lambda p: stencil.erosion(p, _D1, "ignore"), _shift_sql(_BINARY, _D1, "min(n)", "ignore"), _binary)
_stencil("binary_dilation", lambda p: stencil.dilation(p, _D1, "ignore"), _shift_sql(_BINARY, _D1, "max(n)", "ignore"), _binary)
register("peak_local_max", lambda s, d: stencil.peak_local_max(raster.embedding_image(s, d), 2, 0.2).select("y", "x", "v"), f"""WITH m AS ({_shift_sql(EMBEDDING, stencil.rectangle(5, 5), 'max(n)', 'ignore')}), p AS ({EMBEDDING})
SELECT p.y, p.x, round(p.v, 6) + 0.0 AS v FROM p JOIN m USING (y, x), (SELECT max(y) AS h, max(x) AS w FROM p) z WHERE round(p.v, 6) = m.v AND p.v > 0.2 AND p.y BETWEEN 2 AND h - 2 AND p.x BETWEEN 2 AND w - 2""")


def _sums(table: str, steps: list[tuple], mode: str = "ignore") -> str:
    """A weighted sum without rounding, as a step of a longer oracle; "ignore" is zero outside."""
    return f"SELECT y, x, v FROM ({_shift_sql(table, steps, 'sum(n * k)', mode, 16)})"


_TENSOR = f"""WITH dy AS MATERIALIZED ({_sums(EMBEDDING, _outer([-1, 0, 1], [1, 2, 1]))}), dx AS MATERIALIZED ({_sums(EMBEDDING, _outer([1, 2, 1], [-1, 0, 1]))}),
t AS (SELECT y, x, a.v AS a, b.v AS b, c.v AS c FROM ({_sums('SELECT y, x, v * v AS v FROM dy', _outer(_G1, _G1))}) a
JOIN ({_sums('SELECT y, x, dy.v * dx.v AS v FROM dy JOIN dx USING (y, x)', _outer(_G1, _G1))}) b USING (y, x) JOIN ({_sums('SELECT y, x, v * v AS v FROM dx', _outer(_G1, _G1))}) c USING (y, x))"""
register("corner_harris", lambda s, d: stencil.corner_harris(raster.embedding_image(s, d)).select("y", "x", "v"), f"{_TENSOR} SELECT y, x, {_r('a * c - b * b - 0.05 * (a + c) * (a + c)', 'v')} FROM t")
register("corner_shi_tomasi", lambda s, d: stencil.corner_shi_tomasi(raster.embedding_image(s, d)).select("y", "x", "v"), f"{_TENSOR} SELECT y, x, {_r('(a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b)', 'v')} FROM t")
register("corner_foerstner", lambda s, d: stencil.corner_foerstner(raster.embedding_image(s, d)).select("y", "x", "w", "q"), f"{_TENSOR} SELECT y, x, {_r('coalesce((a * c - b * b) / nullif(a + c, 0), 0)', 'w')}, {_r('coalesce(4 * (a * c - b * b) / nullif(pow(a + c, 2), 0), 0)', 'q')} FROM t")

# -- regions ------------------------------------------------------------------------

_LOCAL = f"""q AS ({LABELS}), b AS (SELECT label, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM q WHERE label <> 0 GROUP BY label),
g AS (SELECT q.label, q.v, (q.y - y0)::DOUBLE AS y, (q.x - x0)::DOUBLE AS x, y0, x0, y1, x1 FROM q JOIN b USING (label)),
m AS (SELECT label, y0, x0, y1, x1, count(*) AS n, sum(y) AS sy, sum(x) AS sx, sum(v) AS sv, sum(v * y) AS vy, sum(v * x) AS vx, min(v) AS mn, max(v) AS mx, stddev_pop(v) AS sd, median(v) AS md FROM g GROUP BY ALL),
t AS (SELECT g.label, sum((x - sx / n) * (x - sx / n)) / any_value(n) AS a, -sum((y - sy / n) * (x - sx / n)) / any_value(n) AS b, sum((y - sy / n) * (y - sy / n)) / any_value(n) AS c FROM g JOIN m ON g.label = m.label GROUP BY g.label)"""
_table = lambda names, intensity=False: lambda s, d: regions.region_table(raster.embedding_labels(s, d), names, intensity).drop("image_id")
register("regionprops_basic", _table(["num_pixels", "area", "area_bbox", "extent", "bbox_0", "bbox_1", "bbox_2", "bbox_3", "centroid_0", "centroid_1", "centroid_local_0", "equivalent_diameter_area"]), f"""WITH {_LOCAL}
SELECT label, n AS num_pixels, n::DOUBLE AS area, ((y1 - y0) * (x1 - x0))::DOUBLE AS area_bbox, round(n / ((y1 - y0) * (x1 - x0)), 6) + 0.0 AS extent, y0 AS bbox_0, x0 AS bbox_1, y1 AS bbox_2, x1 AS bbox_3,
round(y0 + sy / n, 6) + 0.0 AS centroid_0, round(x0 + sx / n, 6) + 0.0 AS centroid_1, round(sy / n, 6) + 0.0 AS centroid_local_0, round(sqrt(4 * n / pi()), 6) + 0.0 AS equivalent_diameter_area FROM m""")
register("regionprops_intensity", _table(["intensity_mean", "intensity_min", "intensity_max", "intensity_std", "intensity_median", "weighted_centroid_0", "weighted_centroid_1"], True), f"""WITH {_LOCAL}
SELECT label, round(sv / n, 6) + 0.0 AS intensity_mean, round(mn, 6) + 0.0 AS intensity_min, round(mx, 6) + 0.0 AS intensity_max, round(sd, 6) + 0.0 AS intensity_std, round(md, 6) + 0.0 AS intensity_median,
round(y0 + vy / sv, 6) + 0.0 AS weighted_centroid_0, round(x0 + vx / sv, 6) + 0.0 AS weighted_centroid_1 FROM m""")
register("regionprops_shape", _table(["inertia_tensor_00", "inertia_tensor_01", "inertia_tensor_11", "inertia_tensor_eigvals_0", "inertia_tensor_eigvals_1", "axis_major_length", "axis_minor_length", "eccentricity", "orientation"]), f"""WITH {_LOCAL}, e AS (SELECT *, (a + c) / 2 + sqrt(b * b + (a - c) * (a - c) / 4) AS l1, (a + c) / 2 - sqrt(b * b + (a - c) * (a - c) / 4) AS l2 FROM t)
SELECT label, {_r('a', 'inertia_tensor_00')}, {_r('b', 'inertia_tensor_01')}, {_r('c', 'inertia_tensor_11')}, {_r('l1', 'inertia_tensor_eigvals_0')}, {_r('l2', 'inertia_tensor_eigvals_1')},
{_r('4 * sqrt(l1)', 'axis_major_length')}, {_r('4 * sqrt(l2)', 'axis_minor_length')}, {_r('sqrt(1 - l2 / l1)', 'eccentricity')}, {_r('0.5 * atan2(-2 * b, c - a)', 'orientation')} FROM e""")
_PQ = [(p, q) for p in range(3) for q in range(3 - p)]
register("moments", _table([f"moments_{p}_{q}" for p, q in _PQ]), f"WITH {_LOCAL} SELECT label, {', '.join(_r(f'sum(pow(y, {p}) * pow(x, {q}))', f'moments_{p}_{q}') for p, q in _PQ)} FROM g GROUP BY label")
register("moments_weighted", _table([f"weighted_moments_{p}_{q}" for p, q in _PQ], True), f"WITH {_LOCAL} SELECT label, {', '.join(_r(f'sum(v * pow(y, {p}) * pow(x, {q}))', f'weighted_moments_{p}_{q}') for p, q in _PQ)} FROM g GROUP BY label")
register("moments_normalized", _table([f"moments_normalized_{p}_{q}" for p, q in ((2, 0), (1, 1), (0, 2))]), f"WITH {_LOCAL} SELECT label, {_r('c / n', 'moments_normalized_2_0')}, {_r('-b / n', 'moments_normalized_1_1')}, {_r('a / n', 'moments_normalized_0_2')} FROM t JOIN m USING (label)")
register("moments_hu", _table([f"moments_hu_{i}" for i in range(2)]), f"WITH {_LOCAL} SELECT label, {_r('(a + c) / n', 'moments_hu_0')}, {_r('pow((c - a) / n, 2) + 4 * pow(b / n, 2)', 'moments_hu_1')} FROM t JOIN m USING (label)")
register("regionprops_boundaries", lambda s, d: regions.boundary_counts(raster.embedding_labels(s, d)).drop("image_id"), f"""WITH q AS MATERIALIZED ({LABELS}), o(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)), g AS (SELECT q.y, q.x, q.label, count(r.label) AS k, count(*) FILTER (WHERE r.label IS DISTINCT FROM q.label) AS d FROM q CROSS JOIN o LEFT JOIN q r ON r.y = q.y + dy AND r.x = q.x + dx GROUP BY ALL)
SELECT label, count(*) FILTER (WHERE k < 4) AS num_boundary_pixels, count(*) FILTER (WHERE d > 0) AS num_perimeter_pixels FROM g WHERE label <> 0 GROUP BY label""")
register("euler_number", lambda s, d: regions.euler_number(raster.embedding_labels(s, d)).drop("image_id"), f"""WITH q AS ({LABELS}), s AS (SELECT label, y + dy AS y, x + dx AS x, sum(CASE 2 * dy + dx WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 ELSE 8 END) AS k FROM q, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx) WHERE label <> 0 GROUP BY ALL)
SELECT label, ((count(*) FILTER (WHERE k IN (1, 2, 4, 8)) - count(*) FILTER (WHERE k IN (7, 11, 13, 14)) - 2 * count(*) FILTER (WHERE k IN (6, 9))) / 4)::BIGINT AS euler_number FROM s GROUP BY label""")
register("relabel_sequential", lambda s, d: regions.relabel_sequential(raster.part_grid(s, d).select("image_id", "y", "x", (F.col("label") * 10).alias("label")), 3).select("y", "x", "label"), f"SELECT y, x, (dense_rank() OVER (ORDER BY label) + 2)::BIGINT AS label FROM ({GRID})")
register("join_segmentations", lambda s, d: regions.join_segmentations(raster.part_grid(s, d), raster.part_grid(s, d).select("image_id", "y", "x", F.col("other").alias("label"))).select("y", "x", "label"), f"SELECT y, x, (dense_rank() OVER (ORDER BY label, other))::BIGINT AS label FROM ({GRID})")


def _map_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    lut = spark.createDataFrame([(1, 7.5), (3, -1.0), (11, 4.0)], "label long, value double")
    return regions.map_array(raster.embedding_labels(spark, sf_dir), lut).select("y", "x", "value")


register("map_array", _map_array, f"SELECT y, x, CASE label WHEN 1 THEN 7.5 WHEN 3 THEN -1 WHEN 11 THEN 4 ELSE 0 END::DOUBLE AS value FROM ({LABELS})")
register("remove_small_objects", lambda s, d: regions.remove_small_objects(raster.part_grid(s, d), 400).select("y", "x", "label"), f"WITH g AS ({GRID}) SELECT y, x, CASE WHEN count(*) OVER (PARTITION BY label) <= 400 THEN 0 ELSE label END AS label FROM g")
register("clear_border", lambda s, d: regions.clear_border(raster.part_grid(s, d)).select("y", "x", "label"), f"WITH g AS ({GRID}) SELECT y, x, CASE WHEN label IN (SELECT label FROM g WHERE y IN (0, (SELECT max(y) FROM g)) OR x IN (0, (SELECT max(x) FROM g))) THEN 0 ELSE label END AS label FROM g")
register("find_boundaries", lambda s, d: regions.find_boundaries(raster.part_grid(s, d)).select("y", "x", F.col("boundary").cast("double").alias("v")), _shift_sql(GRID.replace("sum(l_quantity) AS v", "min(l_linenumber)::DOUBLE AS v"), [(0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)], "(min(n) <> max(n))::INT::DOUBLE", "ignore"))
_CC = """WITH RECURSIVE p AS MATERIALIZED ({table}), e AS MATERIALIZED (SELECT a.y * 100000 + a.x AS a, b.y * 100000 + b.x AS b FROM p a JOIN p b ON a.v = b.v AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1)) WHERE a.v <> 0),
r(n, root) AS (SELECT y * 100000 + x, y * 100000 + x FROM p WHERE v <> 0 UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n WHERE r.root < e.b),
m AS (SELECT n, min(root) AS root FROM r GROUP BY n)
SELECT p.y, p.x, coalesce(dense_rank() OVER (ORDER BY m.root NULLS LAST), 0) * (p.v <> 0)::INT AS label FROM p LEFT JOIN m ON m.n = p.y * 100000 + p.x"""
register("label", lambda s, d: regions.label(_sparse(s, d)).select("y", "x", "label"), _CC.format(table=f"SELECT y, x, (v > 0.15)::INT AS v FROM ({EMBEDDING})"))


def _sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.embedding_image(spark, sf_dir).withColumn("v", (F.col("v") > 0.15).cast("double"))


register("apply_hysteresis_threshold", lambda s, d: regions.apply_hysteresis_threshold(raster.embedding_image(s, d), 0.15, 0.3).select("y", "x", F.col("mask").cast("int").alias("mask")), f"WITH l AS ({_CC.format(table=f'SELECT y, x, (v > 0.15)::INT AS v FROM ({EMBEDDING})')}), v AS ({EMBEDDING}) SELECT l.y, l.x, (label <> 0 AND label IN (SELECT label FROM l JOIN v USING (y, x) WHERE v.v > 0.3))::INT AS mask FROM l")
register("expand_labels", lambda s, d: regions.expand_labels(raster.embedding_labels(s, d), 1).select("y", "x", "label"), f"""WITH q AS MATERIALIZED ({LABELS}), o(dy, dx) AS (VALUES (0, 1), (1, 0), (0, -1), (-1, 0))
SELECT q.y, q.x, CASE WHEN any_value(q.label) <> 0 THEN any_value(q.label) ELSE coalesce(min(r.label), 0) END AS label FROM q CROSS JOIN o LEFT JOIN q r ON r.y = q.y + dy AND r.x = q.x + dx AND r.label <> 0 GROUP BY q.y, q.x""")

# -- metrics -----------------------------------------------------------------------

_PAIR = f"SELECT image_id, y, x, v / 1000 AS v, w AS w, label, other FROM ({FULL})"
_pair = lambda s, d: raster.full_part_grid(s, d).withColumn("v", F.col("v") / 1000)
register("simple_metrics", lambda s, d: metrics.simple_metrics(_pair(s, d), 2.0).drop("image_id"), f"""WITH p AS ({_PAIR}), s AS (SELECT avg(pow(v - w, 2)) AS mse, avg(v * v) AS q, max(v) - min(v) AS r, avg(v) AS m FROM p)
SELECT {_r('mse', 'mse')}, {_r('10 * log10(4 / mse)', 'psnr')}, {_r('sqrt(mse / q)', 'nrmse_euclidean')}, {_r('sqrt(mse) / r', 'nrmse_min_max')}, {_r('sqrt(mse) / m', 'nrmse_mean')} FROM s""")
_table_of = lambda s, d: metrics.contingency_table(raster.part_grid(s, d))
register("contingency_table", lambda s, d: _table_of(s, d).drop("image_id"), f"SELECT label, other, count(*) AS n FROM ({GRID}) GROUP BY ALL")
register("adapted_rand_error", lambda s, d: metrics.adapted_rand_error(_table_of(s, d)).drop("image_id"), f"""WITH g AS ({GRID}), f AS (SELECT (SELECT sum(n * n) - sum(n) FROM (SELECT count(*) AS n FROM g GROUP BY label, other)) AS p, (SELECT sum(n * n) - sum(n) FROM (SELECT count(*) AS n FROM g GROUP BY label)) AS a, (SELECT sum(n * n) - sum(n) FROM (SELECT count(*) AS n FROM g GROUP BY other)) AS b)
SELECT round(1 - 2 * p / (a + b), 6) + 0.0 AS error, round(p / b, 6) + 0.0 AS precision, round(p / a, 6) + 0.0 AS recall FROM f""")
register("variation_of_information", lambda s, d: metrics.variation_of_information(_table_of(s, d)).drop("image_id"), f"""WITH t AS (SELECT label, other, count(*) AS n FROM ({GRID}) GROUP BY ALL), m AS (SELECT n, sum(n) OVER (PARTITION BY label) AS a, sum(n) OVER (PARTITION BY other) AS b, sum(n) OVER () AS t FROM t)
SELECT round(-sum(n / t * log2(n / a)), 6) + 0.0 AS vi_split, round(-sum(n / t * log2(n / b)), 6) + 0.0 AS vi_merge FROM m""")
register("normalized_mutual_information", lambda s, d: metrics.normalized_mutual_information(_pair(s, d), 20).drop("image_id"), f"""WITH p AS ({_PAIR}), r AS (SELECT min(v) AS a, max(v) AS b, min(w) AS c, max(w) AS d FROM p), k AS (SELECT least(19, floor((v - a) / (b - a) * 20)) AS i, least(19, floor((w - c) / (d - c) * 20)) AS j FROM p, r),
hi AS (SELECT -sum(q * ln(q)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM k GROUP BY i)), hj AS (SELECT -sum(q * ln(q)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM k GROUP BY j)), hij AS (SELECT -sum(q * ln(q)) AS h FROM (SELECT count(*) / sum(count(*)) OVER () AS q FROM k GROUP BY i, j))
SELECT round((hi.h + hj.h) / hij.h, 6) + 0.0 AS nmi FROM hi, hj, hij""")
register("colocalization", lambda s, d: metrics.colocalization(_pair(s, d), F.col("v") > 0.3, F.col("w") > 0.5).drop("image_id"), f"""SELECT {_r('corr(v, w)', 'pearson')}, {_r('sum(CASE WHEN w > 0.5 THEN v ELSE 0 END) / sum(v)', 'manders_coloc_coeff')}, {_r('sum(v * w) / sqrt(sum(v * v) * sum(w * w))', 'manders_overlap_coeff')}, {_r('count(*) FILTER (WHERE v > 0.3 AND w > 0.5) / count(*) FILTER (WHERE v > 0.3)', 'intersection_coeff')} FROM ({_PAIR})""")
register("structural_similarity", lambda s, d: metrics.structural_similarity(_pair(s, d), 2.0).select("ssim"), f"""WITH p AS MATERIALIZED ({_PAIR}), c AS (SELECT y, x FROM p WHERE y BETWEEN 3 AND 60 AND x BETWEEN 3 AND 60), s AS (SELECT c.y, c.x, avg(v) AS a, avg(w) AS b, avg(v * v) AS aa, avg(w * w) AS bb, avg(v * w) AS ab FROM c JOIN p ON p.y BETWEEN c.y - 3 AND c.y + 3 AND p.x BETWEEN c.x - 3 AND c.x + 3 GROUP BY c.y, c.x)
SELECT round(avg((2 * a * b + 0.0004) * (2 * 49 / 48 * (ab - a * b) + 0.0036) / ((a * a + b * b + 0.0004) * (49 / 48 * (aa - a * a + bb - b * b) + 0.0036))), 6) + 0.0 AS ssim FROM s""")
register("hausdorff_distance", lambda s, d: metrics.hausdorff_distance(raster.part_grid(s, d).where("label = 1"), raster.part_grid(s, d).where("other = 7"), 1).select("hausdorff"), f"""WITH g AS ({GRID}), a AS (SELECT y, x FROM g WHERE label = 1), b AS (SELECT y, x FROM g WHERE other = 7), d AS (SELECT a.y AS ay, a.x AS ax, b.y AS by_, b.x AS bx, pow(a.y - b.y, 2) + pow(a.x - b.x, 2) AS d FROM a, b)
SELECT round(sqrt(greatest((SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY ay, ax)), (SELECT max(m) FROM (SELECT min(d) AS m FROM d GROUP BY by_, bx)))), 6) + 0.0 AS hausdorff""")
register("blur_effect", lambda s, d: metrics.blur_effect(raster.embedding_image(s, d)).select("blur"))

# -- geometry ------------------------------------------------------------------------

_image = raster.embedding_image
register("flip", lambda s, d: transform.flip(_image(s, d), "x").select("y", "x", "v"), f"SELECT y, 63 - x AS x, round(v, 6) + 0.0 AS v FROM ({EMBEDDING})")
register("rotate90", lambda s, d: transform.rotate90(_image(s, d)).select("y", "x", "v"), f"SELECT (63 - x)::INT AS y, y AS x, round(v, 6) + 0.0 AS v FROM ({EMBEDDING})")
register("crop", lambda s, d: transform.crop(_image(s, d), 10, 20, 3, 4).select("y", "x", "v"), f"SELECT y - 10 AS y, x - 3 AS x, round(v, 6) + 0.0 AS v FROM ({EMBEDDING}) WHERE y >= 10 AND y < (SELECT max(vec_id) + 1 FROM embeddings) - 20 AND x BETWEEN 3 AND 59")
register("downscale_local_mean", lambda s, d: transform.downscale_local_mean(_image(s, d), 3, 5).select("y", "x", "v"), f"SELECT (y // 3)::INT AS y, (x // 5)::INT AS x, round(sum(v) / 15, 6) + 0.0 AS v FROM ({EMBEDDING}) GROUP BY ALL")
register("block_reduce_max", lambda s, d: transform.block_reduce(raster.embedding_bytes(s, d), 4, 4, F.max).select("y", "x", "v"), f"SELECT (y // 4)::INT AS y, (x // 4)::INT AS x, max(v) AS v FROM ({BYTES}) GROUP BY ALL")
register("integral_image", lambda s, d: transform.integral_image(raster.embedding_bytes(s, d)).select("y", "x", "v"), f"SELECT y, x, sum(v) OVER (PARTITION BY y ORDER BY x) AS v FROM (SELECT y, x, sum(v) OVER (PARTITION BY x ORDER BY y) AS v FROM ({BYTES}))")


def _integrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = spark.createDataFrame([(0, b, 0, 0, 10 * b + 5, 3 * b + 2) for b in range(8)] + [(0, 100 + b, 7 * b, b, 9 * b + 3, 2 * b + 1) for b in range(8)], "image_id long, box long, y0 int, x0 int, y1 int, x1 int")
    return transform.integrate(transform.integral_image(raster.embedding_bytes(spark, sf_dir)), boxes).select("box", "v")


register("integrate", _integrate, f"""WITH b AS (SELECT i AS box, 0 AS y0, 0 AS x0, 10 * i + 5 AS y1, 3 * i + 2 AS x1 FROM range(8) t(i) UNION ALL SELECT 100 + i, 7 * i, i, 9 * i + 3, 2 * i + 1 FROM range(8) t(i))
SELECT box, sum(v) AS v FROM b JOIN ({BYTES}) ON y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1 GROUP BY box""")
register("mean_pyramid", lambda s, d: transform.mean_pyramid(raster.embedding_bytes(s, d), 3).select("level", "y", "x", "v"), f"WITH p AS ({BYTES}), q AS (SELECT (y // 2)::INT AS y, (x // 2)::INT AS x, avg(v) AS v FROM p GROUP BY ALL) SELECT 0 AS level, y, x, v FROM p UNION ALL SELECT 1, y, x, round(v, 6) FROM q UNION ALL SELECT 2, (y // 2)::INT, (x // 2)::INT, round(avg(v), 6) FROM q GROUP BY ALL")
register("resize", lambda s, d: transform.resize(raster.full_part_grid(s, d), (64, 64), 32, 48).select("y", "x", "v"), f"""WITH p AS ({FULL}), g AS (SELECT y, x, (y + 0.5) * 2 - 0.5 AS sy, (x + 0.5) * 64 / 48 - 0.5 AS sx FROM range(32) a(y), range(48) b(x)), c AS (SELECT *, floor(sy) AS y0, floor(sx) AS x0 FROM g),
e AS (SELECT y, x, y0 + dy AS py, x0 + dx AS px, (CASE dy WHEN 0 THEN 1 - (sy - y0) ELSE sy - y0 END) * (CASE dx WHEN 0 THEN 1 - (sx - x0) ELSE sx - x0 END) AS w FROM c, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
SELECT e.y::INT AS y, e.x::INT AS x, round(sum(e.w * p.v), 6) + 0.0 AS v FROM e JOIN p ON p.y = least(63, greatest(0, py)) AND p.x = least(63, greatest(0, px)) GROUP BY ALL""")
register("profile_line", lambda s, d: transform.profile_line(raster.full_part_grid(s, d), 2, 3, 50, 3).select("step", "v"), f"SELECT y - 2 AS step, v FROM ({FULL}) WHERE x = 3 AND y BETWEEN 2 AND 50")

# -- descriptors, regions of tiles ---------------------------------------------------------


def _match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raster.read(spark, sf_dir, "embeddings")
    queries = e.select(F.col("vec_id").alias("q"), F.col("embedding").alias("wanted"))
    return features.match_descriptors(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor")), one_table=True)


register("match_descriptors", _match, "SELECT q, arg_min(id, d) AS id, round(min(d), 6) + 0.0 AS distance FROM (SELECT a.vec_id AS q, b.vec_id AS id, array_distance(a.embedding::DOUBLE[64], b.embedding::DOUBLE[64]) AS d FROM embeddings a JOIN embeddings b ON b.vec_id <> a.vec_id) GROUP BY q")
REGIONS = [(k, 0, 0, y, x, h, w) for k, (y, x, h, w) in enumerate([(0, 0, 8, 8), (5, 10, 20, 30), (-4, -4, 10, 10), (490, 50, 20, 20), (100, 100, 5, 5)])]


def _read_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiles = region_query.to_tiles(raster.embedding_bytes(spark, sf_dir), 16, background=-1.0)
    wanted = spark.createDataFrame(REGIONS, "region int, image_id long, level int, y int, x int, height int, width int")
    return region_query.read_region(tiles, wanted, 16, background=-1.0).select("region", "y", "x", "v")


register("read_region", _read_region, f"""WITH r(region, y0, x0, h, w) AS (VALUES {', '.join(f'({k}, {y}, {x}, {h}, {w})' for k, _, _, y, x, h, w in REGIONS)}), g AS (SELECT region, y0, x0, unnest(range(h)) AS y, w FROM r), c AS (SELECT region, y0, x0, y, unnest(range(w)) AS x FROM g)
SELECT c.region, c.y::INT AS y, c.x::INT AS x, coalesce(p.v, -1) AS v FROM c LEFT JOIN ({BYTES}) p ON p.y = y0 + c.y AND p.x = x0 + c.x""")
register("region_batches", lambda s, d: region_query.batches(raster.read(s, d, "nation").select(F.col("n_nationkey").alias("region")), 4, True).select("region", "batch", "place"), "SELECT n_nationkey AS region, (n_nationkey // 4)::INT AS batch, (n_nationkey % 4)::INT AS place FROM nation WHERE n_nationkey < 24")
register("preferred_memory_capacity", lambda s, d: raster.read(s, d, "part").select("p_partkey", region_query.preferred_memory_capacity(F.col("p_size") * 1000, F.col("p_size") * 900, F.lit(256), F.lit(512), F.lit(3)).cast("long").alias("mib")), "SELECT p_partkey, ceil(((p_size * 1000 + 255) // 256) * 256 * 256 * ((least(p_size * 900, 512) + 255) // 256 + 1) * 3 / 1048576)::BIGINT AS mib FROM part")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of the embedding raster, then one row of properties for each region above it."""
    p = raster.embedding_labels(spark, sf_dir)
    t = histogram.threshold_otsu(histogram.histogram(p))
    mask = p.join(t, "image_id").withColumn("label", F.when(F.col("v") > F.col("threshold"), F.col("label")).otherwise(0))
    return regions.region_table(mask, ["num_pixels", "bbox_0", "bbox_1", "bbox_2", "bbox_3", "centroid_0", "centroid_1", "intensity_mean", "intensity_min", "intensity_max", "intensity_std"], True)


register("otsu_regions", lambda s, d: flagship(s, d).select("label", "num_pixels", "centroid_0", "centroid_1", "intensity_mean", "intensity_std"), f"""WITH {HIST}, o AS (SELECT arg_max(center, w1 * (t - w1) * pow(m1 / w1 - (m - m1) / (t - w1), 2)) AS th FROM c WHERE w1 > 0 AND w1 < t)
SELECT label, count(*) AS num_pixels, round(avg(y), 6) + 0.0 AS centroid_0, round(avg(x), 6) + 0.0 AS centroid_1, round(avg(v), 6) + 0.0 AS intensity_mean, round(stddev_pop(v), 6) + 0.0 AS intensity_std FROM ({LABELS}), o WHERE v > th AND label <> 0 GROUP BY label""")
