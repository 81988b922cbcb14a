"""Registered queries in frequency space, of splines and of zooms, and their SQL: plain Fourier sums, one axis after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import raster
from ..operators import fourier, overlay, transform
from .catalog import BYTES, FULL, _r, register

_UNIT = f"SELECT image_id, y, x, v / 255 AS v FROM ({BYTES})"
_PSF = [[0.05, 0.1, 0.05], [0.1, 0.4, 0.1], [0.05, 0.1, 0.05]]


def _unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as an image of values from 0 to 1."""
    return raster.embedding_bytes(spark, sf_dir).withColumn("v", F.col("v") / 255)


def _dft_sql(rows: str, sign: int, half: str = "w") -> str:
    """y, x, re, im of the unitary transform of ``rows`` (y, x, re, im), for x below ``half``; sign 1 goes back."""
    return f"""WITH i AS MATERIALIZED ({rows}), n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM i),
k AS (SELECT unnest(range(({half})::BIGINT)) AS k FROM n), a AS MATERIALIZED (SELECT y, k, sum(re * cos(t) - im * sin(t)) AS re, sum(re * sin(t) + im * cos(t)) AS im
  FROM (SELECT y, k, re, im, {sign} * 2 * pi() * ((k * x) % w) / w AS t FROM i, k, n) GROUP BY ALL),
b AS (SELECT q.q AS y, k AS x, re, im, {sign} * 2 * pi() * ((q.q * a.y) % h) / h AS t, h, w FROM a, n, (SELECT unnest(range(h::BIGINT)) AS q FROM n) q)
SELECT y::INT AS y, x::INT AS x, sum(re * cos(t) - im * sin(t)) / sqrt(any_value(h * w)) AS re, sum(re * sin(t) + im * cos(t)) / sqrt(any_value(h * w)) AS im FROM b GROUP BY y, x"""


_IMAGE = f"SELECT y, x, v AS re, 0.0::DOUBLE AS im FROM ({_UNIT})"
_SPECTRUM = _dft_sql(_IMAGE, -1)
_PARTS = f"{_r('re', 're')}, {_r('im', 'im')}"

register("ufft2", lambda s, d: fourier.ufft2(fourier.complex_image(_unit(s, d))).select("y", "x", "re", "im"), f"SELECT y, x, {_PARTS} FROM ({_SPECTRUM})")
register("urfft2", lambda s, d: fourier.urfft2(_unit(s, d)).select("y", "x", "re", "im"), f"SELECT y, x, {_PARTS} FROM ({_dft_sql(_IMAGE, -1, 'w // 2 + 1')})")
register("uifft2", lambda s, d: fourier.uifft2(fourier.complex_image(_unit(s, d))).select("y", "x", "re", "im"), f"SELECT y, x, {_PARTS} FROM ({_dft_sql(_IMAGE, 1)})")
register(
    "uirfft2",  # half a spectrum without its highest rows, back to an image
    lambda s, d: fourier.uirfft2(fourier.urfft2(_unit(s, d)).withColumn("re", F.when((F.col("y") < 5) & (F.col("x") < 9), F.col("re")).otherwise(0.0)), fourier.shapes(_unit(s, d))).select("y", "x", "v"),
    f"SELECT y, x, {_r('re', 'v')} FROM (" + _dft_sql(f"""WITH s AS MATERIALIZED ({_dft_sql(_IMAGE, -1, 'w // 2 + 1')}), m AS (SELECT y, x, CASE WHEN y < 5 AND x < 9 THEN re ELSE 0 END AS re, im, max(y) OVER () + 1 AS h, 2 * max(x) OVER () AS w FROM s)
  SELECT y, x, re, CASE WHEN x = 0 OR 2 * x = w THEN im ELSE im END AS im FROM (
    SELECT y, x, CASE WHEN x = 0 OR 2 * x = w THEN (re + other) / 2 ELSE re END AS re, CASE WHEN x = 0 OR 2 * x = w THEN (im - o_im) / 2 ELSE im END AS im, w
    FROM (SELECT m.y, m.x, m.re, m.im, m.w, o.re AS other, o.im AS o_im FROM m JOIN m o ON o.x = m.x AND o.y = (m.h - m.y) % m.h))
  UNION ALL SELECT ((h - y) % h)::INT, (w - x)::INT, re, -im FROM m WHERE x > 0 AND 2 * x < w""", 1) + ")",
)
register("image_quad_norm", lambda s, d: fourier.image_quad_norm(fourier.ufft2(fourier.complex_image(_unit(s, d)))).select(F.round("norm", 4).alias("norm")), f"SELECT {_r('round(sum(v * v), 4)', 'norm')} FROM ({_UNIT})")


def _transfer_sql(kernel: list[list[float]], name: str) -> str:
    terms = [(k, i - len(kernel) // 2, j - len(kernel[0]) // 2) for i, line in enumerate(kernel) for j, k in enumerate(line) if k]
    part = lambda f: " + ".join(f"{k!r}::DOUBLE * {f}(-2 * pi() * (y * ({i}) / h::DOUBLE + x * ({j}) / w::DOUBLE))" for k, i, j in terms)
    return f"{part('cos')} AS {name}r, {part('sin')} AS {name}i"


_SIZED = f"SELECT y, x, re, im, (max(y) OVER () + 1)::INT AS h, (max(x) OVER () + 1)::INT AS w FROM ({_SPECTRUM})"


def _filtered_sql(re: str, im: str, extra: str = "0 AS e") -> str:
    """The real image of the spectrum that ``re`` and ``im`` make of the whole one."""
    return _dft_sql(f"WITH f AS MATERIALIZED (SELECT *, {extra} FROM ({_SIZED})) SELECT y, x, ({re})::DOUBLE AS re, ({im})::DOUBLE AS im FROM f", 1)


register("ir2tf", lambda s, d: fourier.urfft2(_unit(s, d)).join(fourier.shapes(_unit(s, d)), "image_id").select("y", "x", *[c.alias(n) for c, n in zip(fourier.transfer(_PSF, F.col("_h"), F.col("_w")), ("re", "im"), strict=True)]), f"SELECT y, x, {_r('kr', 're')}, {_r('ki', 'im')} FROM (SELECT y, x, w, {_transfer_sql(_PSF, 'k')} FROM ({_SIZED})) WHERE 2 * x <= w")
register("wiener", lambda s, d: fourier.wiener(_unit(s, d), _PSF, 0.1).select("y", "x", "v"), f"SELECT y, x, {_r('greatest(-1, least(1, re))', 'v')} FROM ({_filtered_sql('(kr * re + ki * im) / (kr * kr + ki * ki + 0.1 * (lr * lr + li * li))', '(kr * im - ki * re) / (kr * kr + ki * ki + 0.1 * (lr * lr + li * li))', _transfer_sql(_PSF, 'k') + ', ' + _transfer_sql(fourier.LAPLACIAN, 'l'))})")
_Q = "pow(pow((CASE WHEN 2 * y < h THEN y ELSE y - h END) / (h * 0.1), 2) + pow((CASE WHEN 2 * x < w THEN x ELSE x - w END) / (w * 0.1), 2), 2) AS q"
register("butterworth", lambda s, d: fourier.butterworth(_unit(s, d), 0.1, high_pass=False).select("y", "x", "v"), f"SELECT y, x, {_r('re', 'v')} FROM ({_filtered_sql('re / (1 + q)', 'im / (1 + q)', _Q)})")
register("butterworth_high", lambda s, d: fourier.butterworth(_unit(s, d), 0.1, squared=False).select("y", "x", "v"), f"SELECT y, x, {_r('re', 'v')} FROM ({_filtered_sql('re * sqrt(1 - 1 / (1 + q))', 'im * sqrt(1 - 1 / (1 + q))', _Q)})")


def _parts(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    return raster.full_part_grid(spark, sf_dir).select("image_id", "y", "x", F.col(column).cast("double").alias("v"))


register("fftconvolve", lambda s, d: fourier.fft_convolve(_parts(s, d, "v"), _parts(s, d, "label"), "same").select("y", "x", F.round("v", 3).alias("v")), f"""WITH g AS MATERIALIZED ({FULL})
SELECT y, x, round(v, 3) + 0.0 AS v FROM (SELECT (a.y + b.y - 31)::INT AS y, (a.x + b.x - 31)::INT AS x, sum(a.v * b.label)::DOUBLE AS v FROM g a, g b GROUP BY 1, 2) WHERE y BETWEEN 0 AND 63 AND x BETWEEN 0 AND 63""")
_EDGE = "greatest(0, least({n} - 1, {c} - 3))"
register("pad_edge", lambda s, d: fourier.pad(_unit(s, d), 3).select("y", "x", "v"), f"""WITH i AS MATERIALIZED ({_UNIT}), n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM i), g AS (SELECT y, unnest(range(w::BIGINT + 6)) AS x, h, w FROM (SELECT unnest(range(h::BIGINT + 6)) AS y, h, w FROM n))
SELECT g.y::INT AS y, g.x::INT AS x, {_r('v', 'v')} FROM g JOIN i ON i.y = {_EDGE.format(n='h', c='g.y')} AND i.x = {_EDGE.format(n='w', c='g.x')}""")
register("pad_reflect", lambda s, d: fourier.pad(_unit(s, d), 3, "reflect").select("y", "x", "v"), f"""WITH i AS MATERIALIZED ({_UNIT}), n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM i), g AS (SELECT y, unnest(range(w::BIGINT + 6)) AS x, h, w FROM (SELECT unnest(range(h::BIGINT + 6)) AS y, h, w FROM n)),
m AS (SELECT y, x, CASE WHEN y < 3 THEN 2 - y WHEN y >= h + 3 THEN 2 * h + 2 - y ELSE y - 3 END AS sy, CASE WHEN x < 3 THEN 2 - x WHEN x >= w + 3 THEN 2 * w + 2 - x ELSE x - 3 END AS sx FROM g)
SELECT m.y::INT AS y, m.x::INT AS x, {_r('v', 'v')} FROM m JOIN i ON i.y = m.sy AND i.x = m.sx""")


# The embeddings against themselves, moved by five rows and three columns, borders joined.
def _moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _unit(spark, sf_dir)
    p = u.join(fourier.shapes(u), "image_id")
    return p.select("image_id", F.pmod(F.col("y") - 5, F.col("_h")).cast("int").alias("y"), F.pmod(F.col("x") + 3, F.col("_w")).cast("int").alias("x"), "v")


_CC = f"""WITH i AS MATERIALIZED ({_UNIT}), n AS (SELECT max(y) + 1 AS h, max(x) + 1 AS w FROM i), a AS MATERIALIZED ({_dft_sql(_IMAGE, -1)}),
b AS MATERIALIZED ({_dft_sql(f'SELECT ((y - 5 + h) % h)::INT AS y, ((x + 3) % w)::INT AS x, v AS re, 0.0::DOUBLE AS im FROM (SELECT *, max(y) OVER () + 1 AS h, max(x) OVER () + 1 AS w FROM ({_UNIT}))', -1)}),
p AS MATERIALIZED (SELECT y, x, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im FROM a JOIN b USING (y, x)),
c AS ({_dft_sql('SELECT * FROM p', 1)}),
m AS (SELECT arg_max(struct_pack(y, x, re, im), re * re + im * im) AS m FROM c), t AS (SELECT sum(v * v) AS t FROM i)"""
register("phase_cross_correlation", lambda s, d: fourier.phase_cross_correlation(_unit(s, d), _moved(s, d), normalization=None).select("shift_y", "shift_x", F.round("error", 3).alias("error"), F.round("phasediff", 4).alias("phasediff")), f"""{_CC}
SELECT (CASE WHEN m.y > h // 2 THEN m.y - h ELSE m.y END)::DOUBLE AS shift_y, (CASE WHEN m.x > w // 2 THEN m.x - w ELSE m.x END)::DOUBLE AS shift_x, round(sqrt(abs(1 - (m.re * m.re + m.im * m.im) * h * w / (t * t))), 3) + 0.0 AS error, round(atan2(m.im, m.re), 4) + 0.0 AS phasediff FROM m, n, t""")


# -- zooms: images of 25 embeddings each --------------------------------------------------------


def _sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _unit(spark, sf_dir).select(F.floor(F.col("y") / 25).alias("image_id"), (F.col("y") % 25).alias("y"), "x", "v")


_SHEETS = f"SELECT (y // 25)::BIGINT AS image_id, (y % 25)::INT AS y, x, v FROM ({_UNIT})"


def _zoom_sql(factor: str) -> str:
    at = "CASE WHEN f{n} > {n} THEN t.{c} + (f{n} - {n}) // 2 ELSE greatest(0, least(f{n} - 1, t.{c} - ({n} - f{n}) // 2)) END"
    return f"""WITH i AS MATERIALIZED ({_SHEETS}), s AS (SELECT *, floor(h * f)::BIGINT AS fh, floor(w * f)::BIGINT AS fw FROM (SELECT image_id, max(y) + 1 AS h, max(x) + 1 AS w, {factor} AS f FROM i GROUP BY image_id)),
t AS (SELECT image_id, y, x, {at.format(n='h', c='y')} AS ty, {at.format(n='w', c='x')} AS tx, h, w, fh, fw FROM i t JOIN s USING (image_id))
SELECT image_id, t.y, t.x, {_r('avg(i.v)', 'v')} FROM t JOIN i USING (image_id) WHERE i.y >= floor(ty * h / fh) AND i.y < ceil((ty + 1) * h / fh) AND i.x >= floor(tx * w / fw) AND i.x < ceil((tx + 1) * w / fw) GROUP BY image_id, t.y, t.x"""


_DRAWN = "(('0x' || substr(md5(image_id || ':{seed}:{turn}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
register("zoom_in", lambda s, d: transform.zoom(_sheets(s, d), 1.3, 1.3), _zoom_sql("1.3::DOUBLE"))
register("zoom_out", lambda s, d: transform.zoom(_sheets(s, d), 0.7, 0.7), _zoom_sql("0.7::DOUBLE"))
register("get_zoom_factor", lambda s, d: _sheets(s, d).select("image_id").distinct().select("image_id", overlay.get_zoom_factor(0.8, 1.25, 3)[0].alias("factor")), f"SELECT DISTINCT image_id, {_r(_DRAWN.format(seed=3, turn=1) + ' * 0.45 + 0.8', 'factor')} FROM ({_SHEETS})")
register("rand_zoom", lambda s, d: overlay.rand_zoom(_sheets(s, d), 0.8, 1.25, 0.6, 3), _zoom_sql(f"CASE WHEN {_DRAWN.format(seed=3, turn=0)} < 0.6 THEN {_DRAWN.format(seed=3, turn=1)} * (1.25::DOUBLE - 0.8::DOUBLE) + 0.8::DOUBLE ELSE 1 END"))

# -- cubic splines: coefficients by a sum over the line, mirrored at its ends -----------------------

_FOLD = "CASE WHEN pmod_ < {n} THEN pmod_ ELSE 2 * ({n} - 1) - pmod_ END"


def _mirror(k: str, n: str) -> str:
    period = f"(2 * {n} - 2)"
    return _FOLD.replace("pmod_", f"((({k}) % {period} + {period}) % {period})").format(n=n)


def _cubic_sql(image: str, height: int, width: int, sy: str, sx: str) -> str:
    """Values of the cubic spline of a 64 x 64 ``image`` (y, x, v) at (sy, sx), expressions of y and x."""
    z = "(sqrt(3) - 2)"
    weight = f"(-6 * {z} / (1 - {z} * {z}) * pow({z}, abs(k)))"
    basis = lambda u: f"CASE WHEN abs({u}) < 1 THEN 2 / 3.0::DOUBLE - pow({u}, 2) + pow(abs({u}), 3) / 2 WHEN abs({u}) < 2 THEN pow(2 - abs({u}), 3) / 6 ELSE 0 END"
    return f"""WITH i AS MATERIALIZED ({image}), a AS MATERIALIZED (SELECT i.y, q.q AS x, sum(v * {weight}) AS v FROM (SELECT a.q, b.k, {_mirror('a.q + b.k', '64')} AS j FROM range(64) a(q), range(-30, 31) b(k)) q JOIN i ON i.x = q.j GROUP BY ALL),
c AS MATERIALIZED (SELECT q.q AS y, a.x, sum(v * {weight}) AS v FROM (SELECT a.q, b.k, {_mirror('a.q + b.k', '64')} AS j FROM range(64) a(q), range(-30, 31) b(k)) q JOIN a ON a.y = q.j GROUP BY ALL),
o AS (SELECT y, x, {sy} AS sy, {sx} AS sx FROM range({height}) a(y), range({width}) b(x)),
t AS (SELECT y, x, sy, sx, floor(sy)::BIGINT + m.m AS ky, floor(sx)::BIGINT + n.n AS kx FROM o, range(-1, 3) m(m), range(-1, 3) n(n))
SELECT t.y::INT AS y, t.x::INT AS x, {_r(f'sum(c.v * ({basis("(sy - ky)")}) * ({basis("(sx - kx)")}))', 'v')} FROM t JOIN c ON c.y = {_mirror('ky', '64')} AND c.x = {_mirror('kx', '64')} GROUP BY t.y, t.x"""


_TAX = f"SELECT y, x, w::DOUBLE AS v FROM ({FULL})"
register("resize_cubic", lambda s, d: transform.resize(_parts(s, d, "w"), (64, 64), 40, 90, 3, "mirror").select("y", "x", "v"), _cubic_sql(_TAX, 40, 90, "(y + 0.5::DOUBLE) * (64 / 40.0::DOUBLE) - 0.5", "(x + 0.5::DOUBLE) * (64 / 90.0::DOUBLE) - 0.5"))
