"""More registered queries: distances, outlines, ridges, overlays and warps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import raster
from ..operators import edges, filters, histogram, morphology, overlay, peaks, registration, stencil, transform
from .catalog import SQL, _BINARY, _CC, _D1, _G1, BYTES, COLOURS, EMBEDDING, FULL, LABELS, _binary, _outer, _r, _shift_sql, _sums, register

_MASK = f"SELECT image_id, y, x, (label > 1)::INT::DOUBLE AS v FROM ({FULL})"
_EDT = f"SELECT a.y, a.x, CASE WHEN any_value(a.v) = 0 THEN 0 ELSE sqrt(min(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) END AS d FROM ({_MASK}) a, ({_MASK}) b WHERE b.v = 0 GROUP BY a.y, a.x"


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.full_part_grid(spark, sf_dir).withColumn("v", (F.col("label") > 1).cast("double"))


register("distance_transform_edt", lambda s, d: morphology.distance_transform_edt(_mask(s, d)).select("y", "x", "v"), f"SELECT y, x, {_r('d', 'v')} FROM ({_EDT})")
register("isotropic_erosion", lambda s, d: morphology.isotropic(_mask(s, d), 1.5, "erosion").select("y", "x", "v"), f"SELECT y, x, (d > 1.5)::INT::DOUBLE AS v FROM ({_EDT})")
register("isotropic_dilation", lambda s, d: morphology.isotropic(_mask(s, d), 1.5, "dilation").select("y", "x", "v"), f"SELECT a.y, a.x, coalesce(min(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) <= 2.25, false)::INT::DOUBLE AS v FROM ({_MASK}) a LEFT JOIN ({_MASK}) b ON b.v = 1 GROUP BY a.y, a.x")
register("perimeter", lambda s, d: morphology.perimeter(_binary(s, d)).select("perimeter"), f"""WITH p AS MATERIALIZED ({_BINARY}), n AS (SELECT p.y, p.x, count(*) AS k, min(q.v) AS m FROM p, (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx), p q WHERE q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL),
b AS MATERIALIZED (SELECT p.y, p.x, (p.v = 1 AND (k < 5 OR m = 0))::INT AS e FROM p JOIN n USING (y, x)),
c AS (SELECT b.y, b.x, sum(q.e * CASE abs(q.y - b.y) + abs(q.x - b.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code FROM b JOIN b q ON q.y BETWEEN b.y - 1 AND b.y + 1 AND q.x BETWEEN b.x - 1 AND b.x + 1 GROUP BY ALL)
SELECT {_r('sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END)', 'perimeter')} FROM c""")
_BALL = [(dy, dx, math.sqrt(16 - dy * dy - dx * dx)) for dy, dx in stencil.rectangle(9, 9) if dy * dy + dx * dx <= 16]
register("rolling_ball", lambda s, d: morphology.rolling_ball(raster.embedding_bytes(s, d), 4).select("y", "x", "v"), _shift_sql(BYTES, _BALL, "min(n + (4 - k))", "ignore"))
register("gradient", lambda s, d: filters.gradient(raster.embedding_image(s, d), "x").select("y", "x", "v"), f"SELECT y, x, round(CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END, 6) + 0.0 AS v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM ({EMBEDDING}) WINDOW w AS (PARTITION BY y ORDER BY x))")
_GABOR = filters.gabor_kernel(0.2, 0.5, 1.0)
register("gabor", lambda s, d: filters.gabor(raster.embedding_image(s, d), 0.2, 0.5, 1.0).select("y", "x", "re", "im"), f"SELECT y, x, a.v AS re, b.v AS im FROM ({_shift_sql(EMBEDDING, [(-i, -j, w.real) for i, j, w in _GABOR], 'sum(n * k)')}) a JOIN ({_shift_sql(EMBEDDING, [(-i, -j, w.imag) for i, j, w in _GABOR], 'sum(n * k)')}) b USING (y, x)")


def _slope(table: str, axis: str) -> str:
    """Central differences, one-sided at the ends, by windows."""
    other = "x" if axis == "y" else "y"
    return f"SELECT y, x, CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END AS v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM {table} WINDOW w AS (PARTITION BY {other} ORDER BY {axis}))"


_HESSIAN = f"""WITH s AS MATERIALIZED ({_sums(EMBEDDING, _outer(_G1, _G1))}), gy AS MATERIALIZED ({_slope('s', 'y')}), gx AS MATERIALIZED ({_slope('s', 'x')}),
h AS (SELECT y, x, p.v AS a, q.v AS b, r.v AS c FROM ({_slope('gy', 'y')}) p JOIN ({_slope('gy', 'x')}) q USING (y, x) JOIN ({_slope('gx', 'x')}) r USING (y, x)),
e AS (SELECT *, (a + c) / 2 + sqrt(pow((a - c) / 2, 2) + b * b) AS l1, (a + c) / 2 - sqrt(pow((a - c) / 2, 2) + b * b) AS l2 FROM h)"""
register("hessian_matrix", lambda s, d: filters.hessian_matrix(raster.embedding_image(s, d)).select("y", "x", "hrr", "hrc", "hcc"), f"{_HESSIAN} SELECT y, x, {_r('a', 'hrr')}, {_r('b', 'hrc')}, {_r('c', 'hcc')} FROM e")
register("hessian_matrix_eigvals", lambda s, d: filters.hessian_eigenvalues(raster.embedding_image(s, d)).select("y", "x", "l1", "l2"), f"{_HESSIAN} SELECT y, x, {_r('l1', 'l1')}, {_r('l2', 'l2')} FROM e")
register("hessian_matrix_det", lambda s, d: filters.hessian_determinant(raster.embedding_image(s, d)).select("y", "x", "v"), f"{_HESSIAN} SELECT y, x, {_r('a * c - b * b', 'v')} FROM e")
register("shape_index", lambda s, d: filters.shape_index(raster.embedding_image(s, d)).select("y", "x", "v"), f"{_HESSIAN} SELECT y, x, {_r('CASE WHEN l1 <> l2 THEN 2 / pi() * atan((l2 + l1) / (l2 - l1)) END', 'v')} FROM e")
register("sato", lambda s, d: filters.sato(raster.embedding_image(s, d)).select("y", "x", "v"))
register("frangi", lambda s, d: filters.frangi(raster.embedding_image(s, d)).select("y", "x", "v"))
register("blob_log", lambda s, d: filters.blob_log(raster.embedding_image(s, d)).select("y", "x", "sigma", "v"))
register("richardson_lucy", lambda s, d: filters.richardson_lucy(raster.embedding_bytes(s, d).withColumn("v", F.col("v") / 255), [(dy, dx, 1 / 9) for dy, dx in stencil.rectangle(3, 3)], 3).select("y", "x", "v"))
register("reconstruction", lambda s, d: morphology.reconstruction(raster.full_part_grid(s, d).withColumn("v", F.when(F.col("x") == 0, F.col("v")).otherwise(0.0)), raster.full_part_grid(s, d)).select("y", "x", "v"))
register("h_maxima", lambda s, d: morphology.h_maxima(raster.full_part_grid(s, d), 300.0).select("y", "x", "v"))
_LEVELS = f"SELECT y, x, (v + 1)::BIGINT AS v FROM ({FULL})"
register("local_maxima", lambda s, d: morphology.local_maxima(raster.full_part_grid(s, d)).select("y", "x", "v"), f"""WITH p AS MATERIALIZED ({_LEVELS}), l AS MATERIALIZED ({_CC.format(table='SELECT * FROM p')}),
n AS (SELECT l.label, bool_or(q.v > p.v) AS lost FROM l JOIN p USING (y, x), (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dy, dx), p q WHERE q.y = l.y + dy AND q.x = l.x + dx GROUP BY l.label)
SELECT y, x, (NOT lost)::INT::DOUBLE AS v FROM l JOIN n USING (label)""")
register("remove_small_holes", lambda s, d: morphology.remove_small_holes(_mask(s, d), 2).select("y", "x", "v"), f"""WITH l AS MATERIALIZED ({_CC.format(table=f'SELECT y, x, (1 - v)::INT AS v FROM ({_MASK})')}), n AS (SELECT label FROM l WHERE label <> 0 GROUP BY label HAVING count(*) <= 2)
SELECT l.y, l.x, (label = 0 OR label IN (SELECT label FROM n))::INT::DOUBLE AS v FROM l""")


def _painted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.embedding_colours(spark, sf_dir).withColumn("label", (F.col("y") % 7).cast("long"))


register("label2rgb_avg", lambda s, d: overlay.label_means(_painted(s, d)).select("y", "x", "r", "g", "b"), f"WITH p AS ({COLOURS}) SELECT y, x, {', '.join(_r(f'CASE WHEN y % 7 = 0 THEN 0 ELSE avg({c}) OVER (PARTITION BY y % 7) END', c) for c in 'rgb')} FROM p")
_TURN = ["CASE (label - 1) % 10 " + " ".join(f"WHEN {i} THEN {float(c[k])!r}::DOUBLE" for i, c in enumerate(overlay.COLOURS)) + " END" for k in range(3)]
register("label2rgb_overlay", lambda s, d: overlay.label_overlay(raster.embedding_labels(s, d)).select("y", "x", "r", "g", "b"), f"WITH p AS ({LABELS}) SELECT y, x, {', '.join(_r(f'CASE WHEN label = 0 THEN v ELSE 0.3 * {t} + 0.7 * v END', c) for c, t in zip('rgb', _TURN, strict=True))} FROM p")
_B, _G = {c: f"least(1, 1.2 * {c})" for c in "rgb"}, "(0.299 * {r} + 0.587 * {g} + 0.114 * {b})"
register("color_jitter", lambda s, d: overlay.colour_jitter(raster.embedding_colours(s, d), 1.2, 0.8, 0.5).select("y", "x", "r", "g", "b"), f"""WITH p AS (SELECT y, x, {', '.join(f'{e} AS {c}' for c, e in _B.items())} FROM ({COLOURS})), m AS (SELECT avg({_G.format(r='r', g='g', b='b')}) AS m FROM p),
q AS (SELECT y, x, {', '.join(f'least(1, greatest(0, 0.8 * {c} + 0.2 * m)) AS {c}' for c in 'rgb')} FROM p, m)
SELECT y, x, {', '.join(_r(f"least(1, greatest(0, 0.5 * {c} + 0.5 * {_G.format(r='r', g='g', b='b')}))", c) for c in 'rgb')} FROM q""")


def _slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.embedding_colours(spark, sf_dir).select("image_id", "y", "x", *[(F.col(c) * 255).alias(c) for c in "rgb"])


def _stains(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlay.stain_table(_slides(spark, sf_dir))
    cells = F.explode(F.array(*[F.struct(F.lit("rgb".index(c[1])).alias("channel"), F.lit("pq".index(c[0])).alias("stain"), F.col(c).alias("v")) for c in overlay.STAINS])).alias("s")
    return found.select("image_id", cells).select("image_id", "s.*")


register("stain_extraction_pca", _stains)
_ROT = ("31.5 + (b.x - 31.5) * sin(radians(30)) + (a.y - 31.5) * cos(radians(30))", "31.5 + (b.x - 31.5) * cos(radians(30)) - (a.y - 31.5) * sin(radians(30))")
register("random_noise", lambda s, d: overlay.random_noise(raster.embedding_bytes(s, d).withColumn("v", F.col("v") / 255), "s&p", 0.1, seed=3).select("y", "x", "v"))


def _swirl(spark: SparkSession, sf_dir: str) -> DataFrame:
    strength, radius, c = 1.0, 40.0, 31.5

    def inverse(y, x):
        rho = F.sqrt((x - c) * (x - c) + (y - c) * (y - c))
        theta = strength * F.exp(-rho / (radius / 5 * math.log(2) * 5)) + F.atan2(y - c, x - c)
        return c + rho * F.sin(theta), c + rho * F.cos(theta)

    return transform.warp(raster.full_part_grid(spark, sf_dir), 64, 64, inverse).select("y", "x", "v")




def _warp_sql(table: str, height: int, width: int, sy: str, sx: str) -> str:
    """Bilinear look-ups at (sy, sx), zero outside."""
    return f"""WITH p AS MATERIALIZED ({table}), g AS (SELECT a.y, b.x, ({sy})::DOUBLE AS sy, ({sx})::DOUBLE AS sx FROM range({height}) a(y), range({width}) b(x)),
e AS (SELECT y, x, floor(sy) + dy AS py, floor(sx) + dx AS px, (CASE dy WHEN 0 THEN 1 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE dx WHEN 0 THEN 1 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w FROM g, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(dy, dx))
SELECT e.y::INT AS y, e.x::INT AS x, {_r('sum(e.w * coalesce(p.v, 0))', 'v')} FROM e LEFT JOIN p ON p.y = py AND p.x = px GROUP BY e.y, e.x"""


_RHO, _PHI = "sqrt(pow(b.x - 31.5, 2) + pow(a.y - 31.5, 2))", "atan2(a.y - 31.5, b.x - 31.5)"
_TURNED = f"(exp(-({_RHO}) / (40 * ln(2))) + {_PHI})"
register("swirl", _swirl, _warp_sql(FULL, 64, 64, f"31.5 + {_RHO} * sin({_TURNED})", f"31.5 + {_RHO} * cos({_TURNED})"))


def _polar(spark: SparkSession, sf_dir: str) -> DataFrame:
    step = 2 * math.pi / 90
    return transform.warp(raster.full_part_grid(spark, sf_dir), 90, 32, lambda y, x: (31.5 + x * F.sin(y * step), 31.5 + x * F.cos(y * step))).select("y", "x", "v")


register("warp_polar", _polar, _warp_sql(FULL, 90, 32, "31.5 + b.x * sin(a.y * pi() / 45)", "31.5 + b.x * cos(a.y * pi() / 45)"))
register("affine_nearest", lambda s, d: transform.warp(raster.full_part_grid(s, d), 64, 64, transform.affine([[1, 0, 3], [0, 1, -2], [0, 0, 1]]), 0).select("y", "x", "v"), f"SELECT o.y, o.x, coalesce(p.v, 0) AS v FROM ({FULL}) o LEFT JOIN ({FULL}) p ON p.y = o.y + 2 AND p.x = o.x - 3")
_G2 = stencil.gaussian_weights(4 / 6.0)
register("pyramid_reduce", lambda s, d: transform.pyramid_reduce(raster.full_part_grid(s, d), (64, 64)).select("y", "x", "v"), f"SELECT (y // 2)::INT AS y, (x // 2)::INT AS x, {_r('avg(v)', 'v')} FROM ({_sums(f'SELECT y, x, v FROM ({FULL})', _outer(_G2, _G2), 'reflect')}) GROUP BY ALL")
register("flip_rotate_batch", lambda s, d: transform.rotate90(transform.flip(raster.embedding_image(s, d), "y"), 3).select("y", "x", "v"), f"SELECT x AS y, y AS x, round(v, 6) + 0.0 AS v FROM ({EMBEDDING})")
def _montage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six images from the rows of the embeddings, dealt out in turn."""
    p = raster.embedding_image(spark, sf_dir)
    height = (p.agg(F.max("y")).first()[0] or 0) // 6 + 1
    pieces = p.select((F.col("y") % 6).cast("long").alias("image_id"), (F.col("y") / 6).cast("int").alias("y"), "x", "v")
    return transform.montage(pieces, 3, height, 64).select("y", "x", "v")


register("montage", _montage, f"""WITH p AS MATERIALIZED ({EMBEDDING}), h AS (SELECT max(y) // 6 + 1 AS h FROM p), g AS (SELECT i, y, x FROM range(6) a(i), (SELECT unnest(range(h)) AS y FROM h), range(64) b(x))
SELECT (g.i // 3 * h.h + g.y)::INT AS y, (g.i % 3 * 64 + g.x)::INT AS x, round(coalesce(p.v, (SELECT avg(v) FROM p)), 6) + 0.0 AS v FROM g CROSS JOIN h LEFT JOIN p ON p.y = g.y * 6 + g.i AND p.x = g.x""")
register("view_as_blocks", lambda s, d: raster.embedding_bytes(s, d).select((F.col("y") / 4).cast("int").alias("by"), (F.col("x") / 8).cast("int").alias("bx"), (F.col("y") % 4).alias("y"), (F.col("x") % 8).alias("x"), "v"), f"SELECT (y // 4)::INT AS by, (x // 8)::INT AS bx, y % 4 AS y, x % 8 AS x, v FROM ({BYTES})")
register("window_means", lambda s, d: stencil.gather(raster.full_part_grid(s, d), [(dy, dx) for dy in range(3) for dx in range(3)], [F.avg("n").alias("v"), F.count(F.lit(1)).alias("k")], "constant", None).where("k = 9").select("y", "x", "v"), f"SELECT a.y, a.x, round(avg(b.v), 6) + 0.0 AS v FROM ({FULL}) a JOIN ({FULL}) b ON b.y BETWEEN a.y AND a.y + 2 AND b.x BETWEEN a.x AND a.x + 2 GROUP BY a.y, a.x HAVING count(*) = 9")
register("binary_opening", lambda s, d: stencil.opening(_mask(s, d), _D1, "ignore").select("y", "x", "v"), f"WITH a AS MATERIALIZED ({_shift_sql(_MASK, _D1, 'min(n)', 'ignore')}) SELECT y, x, v FROM ({_shift_sql('SELECT * FROM a', _D1, 'max(n)', 'ignore')})")
register("binary_closing", lambda s, d: stencil.closing(_mask(s, d), _D1, "ignore").select("y", "x", "v"), f"WITH a AS MATERIALIZED ({_shift_sql(_MASK, _D1, 'max(n)', 'ignore')}) SELECT y, x, v FROM ({_shift_sql('SELECT * FROM a', _D1, 'min(n)', 'ignore')})")
register("rotate", lambda s, d: transform.rotate(raster.full_part_grid(s, d), (64, 64), 30.0).select("y", "x", "v"), _warp_sql(FULL, 64, 64, *_ROT))
register("canny", lambda s, d: edges.canny(raster.embedding_image(s, d), 1.0, 0.08, 0.2).select("y", "x", F.col("mask").cast("int").alias("mask")))
_BANDS = "((y % 7 = 0 AND y > 0) OR (y % 7 = 6 AND y < max(y) OVER ()))"
register("mark_boundaries", lambda s, d: edges.mark_boundaries(raster.embedding_colours(s, d).withColumn("label", F.floor(F.col("y") / 7))).select("y", "x", "r", "g", "b"), f"SELECT y, x, {', '.join(_r(f'CASE WHEN {_BANDS} THEN {v} ELSE {c} END', c) for c, v in zip('rgb', ('1', '1', '0'), strict=True))} FROM ({COLOURS})")
register("denoise_tv_chambolle", lambda s, d: edges.denoise_tv(raster.embedding_bytes(s, d).withColumn("v", F.col("v") / 255), 0.1).select("y", "x", "v"))
register("multiscale_basic_features", lambda s, d: edges.multiscale_basic_features(raster.full_part_grid(s, d)).drop("image_id"))


def _try_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = histogram.histogram(raster.embedding_image(spark, sf_dir))
    out = None
    for name in ("otsu", "yen", "isodata", "triangle"):
        t = getattr(histogram, f"threshold_{name}")(h).select(F.lit(name).alias("method"), "threshold")
        out = t if out is None else out.unionByName(t)
    return out


register("try_all_threshold", _try_all, " UNION ALL ".join(f"SELECT '{n}' AS method, threshold FROM ({SQL[f'threshold_{n}']})" for n in ("otsu", "yen", "isodata", "triangle")))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part sizes against prices, as if they were matched points."""
    p = raster.read(spark, sf_dir, "part")
    return p.select(F.col("p_size").alias("sx"), (F.col("p_partkey") % 100).alias("sy"), F.col("p_retailprice").alias("dx"), (F.col("p_partkey") % 37).alias("dy"))


def _affine_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = registration.estimate_affine(_points(spark, sf_dir))
    return spark.createDataFrame([(r, c, float(m[r, c])) for r in range(2) for c in range(3)], "r int, c int, v double")


_FIT = """WITH p AS (SELECT p_size::DOUBLE AS x, (p_partkey % 100)::DOUBLE AS y, {t}::DOUBLE AS t FROM part), s AS (SELECT covar_pop(x, x) AS xx, covar_pop(x, y) AS xy, covar_pop(y, y) AS yy, covar_pop(x, t) AS xt, covar_pop(y, t) AS yt, avg(x) AS mx, avg(y) AS my, avg(t) AS mt FROM p),
k AS (SELECT (xt * yy - yt * xy) / (xx * yy - xy * xy) AS a, (yt * xx - xt * xy) / (xx * yy - xy * xy) AS b, mx, my, mt FROM s)
SELECT {r} AS r, c, round(v, 6) + 0.0 AS v FROM (SELECT 0 AS c, a AS v FROM k UNION ALL SELECT 1, b FROM k UNION ALL SELECT 2, mt - a * mx - b * my FROM k)"""
register("estimate_affine", _affine_fit, f"SELECT * FROM ({_FIT.format(t='p_retailprice', r=0)}) UNION ALL SELECT * FROM ({_FIT.format(t='(p_partkey % 37)', r=1)})")
register("matrix_transform", lambda s, d: registration.matrix_transform(_points(s, d), transform.euclidean_matrix(0.3, (2.0, -1.0), 1.5)).select("sx", "sy", "tx", "ty"), "SELECT p_size AS sx, p_partkey % 100 AS sy, round(1.5 * (cos(0.3) * p_size - sin(0.3) * (p_partkey % 100)) + 2, 6) + 0.0 AS tx, round(1.5 * (sin(0.3) * p_size + cos(0.3) * (p_partkey % 100)) - 1, 6) + 0.0 AS ty FROM part")

_ERODED = f"SELECT y, x, (d > 1.5)::INT::DOUBLE AS v FROM ({_EDT})"
_AROUND = stencil.rectangle(3, 3)
register("isotropic_opening", lambda s, d: morphology.isotropic(_mask(s, d), 1.5, "opening").select("y", "x", "v"), f"WITH a AS MATERIALIZED ({_ERODED}) SELECT y, x, v FROM ({_shift_sql('SELECT * FROM a', _AROUND, 'max(n)', 'ignore')})")
register("isotropic_closing", lambda s, d: morphology.isotropic(_mask(s, d), 1.5, "closing").select("y", "x", "v"), f"WITH a AS MATERIALIZED ({_shift_sql(_MASK, _AROUND, 'max(n)', 'ignore')}) SELECT y, x, v FROM ({_shift_sql('SELECT * FROM a', _AROUND, 'min(n)', 'ignore')})")
register("local_minima", lambda s, d: morphology.local_minima(raster.full_part_grid(s, d)).select("y", "x", "v"), SQL["local_maxima"].replace("q.v > p.v", "q.v < p.v"))
register("h_minima", lambda s, d: morphology.h_minima(raster.full_part_grid(s, d), 300.0).select("y", "x", "v"))
_CODES = f"SELECT p.y + dy AS y, p.x + dx AS x, sum(k) AS code FROM ({_BINARY}) p, (VALUES {', '.join(map(str, morphology.CORNERS))}) o(dy, dx, k) WHERE p.v = 1 GROUP BY ALL"
for _n in (2, 4):
    register(f"perimeter_crofton_{_n}", lambda s, d, n=_n: morphology.perimeter_crofton(_binary(s, d), n).select("perimeter"), f"SELECT {_r('sum(CASE code ' + ' '.join(f'WHEN {i} THEN {float(w)!r}::DOUBLE' for i, w in enumerate(morphology.CROFTON[_n])) + ' END)', 'perimeter')} FROM ({_CODES})")
_DOWN, _RIGHT = _outer([-1, 0, 1], [1, 2, 1]), _outer([1, 2, 1], [-1, 0, 1])
register("corner_kitchen_rosenfeld", lambda s, d: stencil.corner_kitchen_rosenfeld(raster.embedding_bytes(s, d)).select("y", "x", "v"), f"""WITH gy AS MATERIALIZED ({_sums(BYTES, _DOWN)}), gx AS MATERIALIZED ({_sums(BYTES, _RIGHT)}),
d AS (SELECT y, x, gy.v AS dy, gx.v AS dx, a.v AS dxy, b.v AS dxx, c.v AS dyy FROM gy JOIN gx USING (y, x) JOIN ({_sums('SELECT * FROM gx', _DOWN)}) a USING (y, x) JOIN ({_sums('SELECT * FROM gx', _RIGHT)}) b USING (y, x) JOIN ({_sums('SELECT * FROM gy', _DOWN)}) c USING (y, x))
SELECT y, x, {_r('coalesce((dxx * dy * dy + dyy * dx * dx - 2 * dxy * dx * dy) / nullif(dx * dx + dy * dy, 0), 0)', 'v')} FROM d""")
_SMOOTH = _outer(_G2, _G2)
register("pyramid_laplacian", lambda s, d: transform.pyramid_laplacian(raster.full_part_grid(s, d).select("image_id", "y", "x", "v"), (64, 64), 2).select("level", "y", "x", "v"), f"""WITH a AS MATERIALIZED (SELECT y, x, v FROM ({FULL})), b AS MATERIALIZED ({_sums('SELECT * FROM a', _SMOOTH, 'reflect')}),
c AS MATERIALIZED (SELECT (y // 2)::INT AS y, (x // 2)::INT AS x, avg(v) AS v FROM b GROUP BY ALL)
SELECT 0 AS level, y, x, {_r('a.v - b.v', 'v')} FROM a JOIN b USING (y, x) UNION ALL SELECT 1, y, x, {_r('c.v - e.v', 'v')} FROM c JOIN ({_sums('SELECT * FROM c', _SMOOTH, 'reflect')}) e USING (y, x)""")

# Peaks that keep their distance: the best first, one after the other.
_BYTE_PEAKS = f"""SELECT p.y, p.x, p.v FROM i p JOIN ({_shift_sql('SELECT * FROM i', stencil.rectangle(7, 7), 'max(n)', 'ignore')}) m USING (y, x), (SELECT max(y) AS h, max(x) AS w FROM i) z
WHERE p.v = m.v AND p.v > 128 AND p.y BETWEEN 3 AND h - 3 AND p.x BETWEEN 3 AND w - 3"""


def _spaced_sql(near: str) -> str:
    """The peaks in falling order; one stays if none that stays is ``near`` (dy, dx)."""
    return f"""WITH RECURSIVE i AS MATERIALIZED ({BYTES}), p AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY v DESC, y, x) AS k FROM ({_BYTE_PEAKS})),
g AS (SELECT 0::BIGINT AS k, []::STRUCT(y INT, x INT)[] AS kept UNION ALL
  SELECT p.k, CASE WHEN len(list_filter(kept, lambda q: {near.format(dy='abs(q.y - p.y)', dx='abs(q.x - p.x)')})) = 0 THEN list_append(kept, struct_pack(y := p.y::INT, x := p.x::INT)) ELSE kept END FROM g JOIN p ON p.k = g.k + 1),
s AS (SELECT unnest(arg_max(kept, k)) AS q FROM g) SELECT p.y, p.x, p.v FROM p JOIN s ON s.q.y = p.y AND s.q.x = p.x"""


def _byte_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stencil.peak_local_max(raster.embedding_bytes(spark, sf_dir), 3, 128)


register("ensure_spacing", lambda s, d: peaks.ensure_spacing(_byte_peaks(s, d), 8, 2).select("y", "x", "v"), _spaced_sql("{dy} * {dy} + {dx} * {dx} < 64"))
register("corner_peaks", lambda s, d: peaks.corner_peaks(raster.embedding_bytes(s, d), 3, 128).select("y", "x", "v"), _spaced_sql("greatest({dy}, {dx}) <= 3"))
