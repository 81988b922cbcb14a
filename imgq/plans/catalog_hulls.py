"""Registered queries over hulls, thinning and level sets, and SQL for ridges, blobs and deconvolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import raster
from ..operators import adaptive, filters, hulls, levelsets, overlay, polygons, stencil, thinning, walker
from . import catalog_regions, catalog_shapes  # noqa: F401  (they register what gets its SQL here)
from .catalog import BYTES, COLOURS, EMBEDDING, FULL, QUERIES, SQL, _r, _shift_sql, register


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.full_part_grid(spark, sf_dir)


def _describe(name: str, sql: str) -> None:
    """SQL for a query that another module registers."""
    if name not in QUERIES or name in SQL:
        raise ValueError(f"{name} is not there, or has its SQL already")
    SQL[name] = sql


# -- hulls: for each row the outermost of all lines between the points above and below it ------


def _spans_sql(places: str) -> str:
    """label, y, x0, x1 of the hulls of ``places`` (label, y, x); t counts half rows."""
    return f"""WITH l AS (SELECT label, y, min(x) AS lo, max(x) AS hi FROM ({places}) GROUP BY ALL),
p AS MATERIALIZED (SELECT label, t, min(a)::DOUBLE AS a, max(b)::DOUBLE AS b FROM (
  SELECT label, 2 * y AS t, 2 * lo - 1 AS a, 2 * hi + 1 AS b FROM l UNION ALL SELECT label, 2 * y - 1, 2 * lo, 2 * hi FROM l UNION ALL SELECT label, 2 * y + 1, 2 * lo, 2 * hi FROM l) GROUP BY ALL),
k AS (SELECT label, unnest(range(min(y)::BIGINT, max(y)::BIGINT + 1)) AS y FROM l GROUP BY label),
s AS (SELECT k.label, k.y, u.t AS t0, d.t AS t1, u.a AS a0, d.a AS a1, u.b AS b0, d.b AS b1 FROM k JOIN p u ON u.label = k.label AND u.t <= 2 * k.y JOIN p d ON d.label = k.label AND d.t >= 2 * k.y)
SELECT label, y, ceil(min(CASE WHEN t0 = t1 THEN a0 ELSE a0 + (a1 - a0) * (2 * y - t0) / (t1 - t0) END) / 2 - 1e-9)::INT AS x0,
  floor(max(CASE WHEN t0 = t1 THEN b0 ELSE b0 + (b1 - b0) * (2 * y - t0) / (t1 - t0) END) / 2 + 1e-9)::INT AS x1 FROM s GROUP BY label, y"""


_REGIONS = f"SELECT other AS label, y, x FROM ({FULL}) WHERE other <> 0 AND NOT (other = 7 AND x % 3 = 0)"
_HULLS = _spans_sql(_REGIONS)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).where("NOT (other = 7 AND x % 3 = 0)").select("image_id", "y", "x", F.col("other").alias("label"))


register("regionprops_area_convex", lambda s, d: hulls.region_convexity(_regions(s, d)).select("label", "area_convex"), f"SELECT label, sum(x1 - x0 + 1)::DOUBLE AS area_convex FROM ({_HULLS}) GROUP BY label")
register("regionprops_solidity", lambda s, d: hulls.region_convexity(_regions(s, d)).select("label", "solidity"), f"SELECT label, {_r('n / c', 'solidity')} FROM (SELECT label, sum(x1 - x0 + 1)::DOUBLE AS c FROM ({_HULLS}) GROUP BY label) JOIN (SELECT label, count(*)::DOUBLE AS n FROM ({_REGIONS}) GROUP BY label) USING (label)")
register("regionprops_feret_diameter_max", lambda s, d: hulls.region_convexity(_regions(s, d)).select("label", "feret_diameter_max"), f"""WITH e AS MATERIALIZED (SELECT label, y, unnest([x0, x1]) AS x FROM ({_HULLS}))
SELECT a.label, {_r('sqrt(max(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)))', 'feret_diameter_max')} FROM e a JOIN e b USING (label) GROUP BY a.label""")
register("regionprops_image_convex", lambda s, d: hulls.region_image_convex(_regions(s, d)).select("label", "y", "x", "inside"), f"""WITH h AS MATERIALIZED ({_HULLS}), b AS (SELECT label, min(y) AS y0, min(x) AS w0, max(x) AS w1 FROM ({_REGIONS}) GROUP BY label),
c AS (SELECT label, y, y0, w0, x0, x1, unnest(range(w0::BIGINT, w1::BIGINT + 1)) AS x FROM h JOIN b USING (label))
SELECT label, (y - y0)::INT AS y, (x - w0)::INT AS x, x BETWEEN x0 AND x1 AS inside FROM c""")
_SPOTS = f"SELECT image_id, y, x, (label > 1 AND y BETWEEN 9 AND 50 AND x + y BETWEEN 30 AND 80)::INT::DOUBLE AS v FROM ({FULL})"


def _spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = (F.col("label") > 1) & F.col("y").between(9, 50) & (F.col("x") + F.col("y")).between(30, 80)
    return _grid(spark, sf_dir).select("image_id", "y", "x", inside.cast("double").alias("v"))


def _painted_sql(places: str) -> str:
    return f"""WITH h AS MATERIALIZED ({_spans_sql(places)}), c AS (SELECT DISTINCT y, unnest(range(x0::BIGINT, x1::BIGINT + 1)) AS x FROM h)
SELECT f.y, f.x, (c.x IS NOT NULL)::INT::DOUBLE AS v FROM ({_SPOTS}) f LEFT JOIN c ON c.y = f.y AND c.x = f.x"""


register("convex_hull_image", lambda s, d: hulls.convex_hull_image(_spots(s, d)).select("y", "x", "v"), _painted_sql(f"SELECT 1 AS label, y, x FROM ({_SPOTS}) WHERE v = 1"))
_OBJECTS = f"""WITH RECURSIVE q AS MATERIALIZED ({_SPOTS}), e AS MATERIALIZED (SELECT a.y * 100 + a.x AS a, b.y * 100 + b.x AS b FROM q a JOIN q b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.v = 1 AND b.v = 1),
r(n, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.n WHERE r.root < e.b)
SELECT min(root) AS label, (n // 100)::INT AS y, (n % 100)::INT AS x FROM r GROUP BY n"""
register("convex_hull_object", lambda s, d: hulls.convex_hull_object(_spots(s, d)).select("y", "x", "v"), _painted_sql(_OBJECTS))

# -- thinning -------------------------------------------------------------------------------------

_BLOCKS = f"SELECT y, x, (coalesce(label, 0) <= 1 AND (x // 8 + y // 8) % 3 > 0)::INT AS v FROM ({FULL})"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = (F.col("label") <= 1) & ((F.floor(F.col("x") / 8) + F.floor(F.col("y") / 8)) % 3 > 0)
    return _grid(spark, sf_dir).select("image_id", "y", "x", on.cast("double").alias("v"))


def _thin_sql(rounds: int) -> str:
    """Half rounds as one table each; x1 to x8 go round a place from the east."""
    ring = ", ".join(f"coalesce(max(q.v) FILTER (WHERE q.y = p.y + ({dy}) AND q.x = p.x + ({dx})), 0) AS x{k + 1}" for k, (dy, dx) in enumerate(thinning.RING))
    crossings = " + ".join(f"(x{i} = 0 AND (x{i + 1} = 1 OR x{i % 8 + 2 if i < 7 else 1} = 1))::INT" for i in (1, 3, 5, 7))
    pairs = f"least({' + '.join(f'(x{i} | x{i + 1})' for i in (1, 3, 5, 7))}, {' + '.join(f'(x{i} | x{i % 8 + 1})' for i in (2, 4, 6, 8))})"
    sides = ["((x2 | x3 | (1 - x8)) & x1) = 0", "((x6 | x7 | (1 - x4)) & x5) = 0"]
    steps = [f"t0 AS MATERIALIZED ({_BLOCKS})"]
    for k in range(2 * rounds):
        steps.append(f"n{k} AS (SELECT p.y, p.x, any_value(p.v) AS v, {ring} FROM t{k} p JOIN (SELECT * FROM t{k}) q ON q.y BETWEEN p.y - 1 AND p.y + 1 AND q.x BETWEEN p.x - 1 AND p.x + 1 GROUP BY p.y, p.x)")
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT y, x, CASE WHEN {crossings} = 1 AND {pairs} BETWEEN 2 AND 3 AND {sides[k % 2]} THEN 0 ELSE v END AS v FROM n{k})")
    return f"WITH {', '.join(steps)} SELECT y, x, v::DOUBLE AS v FROM t{2 * rounds}"


register("thin", lambda s, d: thinning.thin(_blocks(s, d)).select("y", "x", "v"), _thin_sql(8))

# -- level sets ------------------------------------------------------------------------------------


def _chan_vese_sql(mu: float = 0.25, step: float = 0.5, tolerance: float = 1e-3, rounds: int = 500) -> str:
    """A round is a step of the recursion, which ends once the root mean square of the change is at most ``tolerance``."""
    root = lambda n, a, b: f"1 / sqrt(1e-16 + pow({n} - f, 2) + pow(({a} - {b}) / 2, 2))"
    return f"""WITH RECURSIVE b AS (SELECT min(v)::DOUBLE AS a, max(v)::DOUBLE AS b FROM ({FULL})),
t AS (SELECT 0 AS k, y, x, CASE WHEN b > a THEN (v::DOUBLE - a) / (b - a) ELSE 0 END AS i, label % 2 - 0.5::DOUBLE AS f, true AS going FROM ({FULL}), b
UNION ALL SELECT k + 1, y, x, i, n, sqrt(avg(pow(n - f, 2)) OVER ()) > {tolerance} FROM (
  SELECT k, y, x, i, f, (f + g * ({mu} * (r * kr + l * kl + d * kd + u * ku) - pow(i - c1, 2) + pow(i - c2, 2))) / (1 + {mu} * g * (kr + kl + kd + ku)) AS n FROM (
    SELECT *, {root('r', 'd', 'u')} AS kr, {root('l', 'd', 'u')} AS kl, {root('d', 'r', 'l')} AS kd, {root('u', 'r', 'l')} AS ku, {step} / (1 + f * f) AS g FROM (
      SELECT *, lag(f, 1, f) OVER v AS u, lead(f, 1, f) OVER v AS d, lag(f, 1, f) OVER h AS l, lead(f, 1, f) OVER h AS r,
        coalesce(avg(i) FILTER (WHERE f > 0) OVER (), 0) AS c1, coalesce(avg(i) FILTER (WHERE f <= 0) OVER (), 0) AS c2
      FROM t WHERE going AND k < {rounds} WINDOW v AS (PARTITION BY x ORDER BY y), h AS (PARTITION BY y ORDER BY x)))))
SELECT y, x, {_r('f', 'phi')}, f > 0 AS mask FROM t WHERE k = (SELECT max(k) FROM t)"""


def _parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("image_id", "y", "x", (F.col("label") % 2 - 0.5).alias("v"))


register("chan_vese", lambda s, d: levelsets.chan_vese(_grid(s, d).withColumn("v", F.col("v").cast("double")), _parity(s, d)).select("y", "x", "phi", "mask"), _chan_vese_sql())

# -- SQL for ridges, blobs and deconvolution ---------------------------------------------------------


def _line_sql(table: str, weights: list[float], axis: str, mode: str) -> str:
    half = len(weights) // 2
    return _shift_sql(table, [(k - half, 0, w) if axis == "y" else (0, k - half, w) for k, w in enumerate(weights)], "sum(n * k)", mode, 16)


def _blur_sql(wy: list[float], wx: list[float], mode: str, table: str = EMBEDDING) -> str:
    return _line_sql(_line_sql(table, wy, "y", mode), wx, "x", mode)


def _slope_sql(table: str, axis: str) -> str:
    other = "x" if axis == "y" else "y"
    return f"SELECT y, x, CASE WHEN a IS NULL THEN b - v WHEN b IS NULL THEN v - a ELSE (b - a) / 2 END AS v FROM (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b FROM ({table}) WINDOW w AS (PARTITION BY {other} ORDER BY {axis}))"


def _eigen_sql(a: str, b: str, c: str) -> str:
    """a, b, c with the eigenvalues l1 (larger) and l2, from three tables of second derivatives."""
    return f"SELECT *, (a + c) / 2 + sqrt(4 * b * b + (a - c) * (a - c)) / 2 AS l1, (a + c) / 2 - sqrt(4 * b * b + (a - c) * (a - c)) / 2 AS l2 FROM (SELECT y, x, p.v AS a, q.v AS b, r.v AS c FROM ({a}) p JOIN ({b}) q USING (y, x) JOIN ({c}) r USING (y, x))"


def _hessian_sql(sigma: float, mode: str) -> str:
    w = stencil.gaussian_weights(sigma)
    gy, gx = _slope_sql("s", "y"), _slope_sql("s", "x")
    return f"WITH s AS MATERIALIZED ({_blur_sql(w, w, mode)}) SELECT * FROM ({_eigen_sql(_slope_sql(gy, 'y'), _slope_sql(gy, 'x'), _slope_sql(gx, 'x'))})"


_describe("sato", "SELECT y, x, round(max(v), 6) + 0.0 AS v FROM (" + " UNION ALL ".join(f"SELECT y, x, {s * s} * greatest(l1, 0) AS v FROM ({_hessian_sql(s, 'reflect')})" for s in (1, 3)) + ") GROUP BY y, x")


def _frangi_sql(sigmas: tuple[float, ...], gamma: str) -> str:
    e = " UNION ALL ".join(f"SELECT {k} AS k, y, x, l1, l2 FROM ({_hessian_sql(s, 'reflect')})" for k, s in enumerate(sigmas))
    return f"""WITH e AS MATERIALIZED ({e}), g AS (SELECT {gamma} AS g FROM e WHERE k = 0),
o AS (SELECT *, l1 * l1 + l2 * l2 AS n, CASE WHEN abs(l1) < abs(l2) THEN l1 ELSE l2 END AS small, CASE WHEN abs(l1) < abs(l2) THEN l2 ELSE l1 END AS big FROM e)
SELECT y, x, max(CASE WHEN big > 0 THEN exp(-pow(small / greatest(big, 1e-10), 2) / 0.5) * (1 - exp(-n / (2 * g * g))) ELSE 0 END) AS v FROM o, g GROUP BY y, x"""


_describe("frangi", f"SELECT y, x, {_r('v', 'v')} FROM ({_frangi_sql((1, 3), 'sqrt(max(l1 * l1 + l2 * l2)) / 2')})")
_describe("hessian", f"SELECT y, x, round(CASE WHEN v <= 0 THEN 1 ELSE v END, 6) + 0.0 AS v FROM ({_frangi_sql((1.0,), 'max(15.0::DOUBLE)')})")
_HALF = 0.5**0.5
_D0, _D1 = stencil.gaussian_weights(_HALF), filters.gaussian_derivative_weights(_HALF, 1)
_GY, _GX = _blur_sql(_D1, _D0, "reflect"), _blur_sql(_D0, _D1, "reflect")
_describe("meijering", f"""WITH gy AS MATERIALIZED ({_GY}), gx AS MATERIALIZED ({_GX}), e AS ({_eigen_sql(_blur_sql(_D1, _D0, 'reflect', 'FROM gy'), _blur_sql(_D0, _D1, 'reflect', 'FROM gy'), _blur_sql(_D0, _D1, 'reflect', 'FROM gx'))}),
n AS (SELECT y, x, l1 + l2 / 3 AS p, l2 + l1 / 3 AS q FROM e), r AS (SELECT y, x, greatest(CASE WHEN abs(p) >= abs(q) THEN p ELSE q END, 0) AS v FROM n)
SELECT y, x, {_r('CASE WHEN max(v) OVER () > 0 THEN v / max(v) OVER () ELSE 0 END', 'v')} FROM r""")


def _peaks_sql(stack: list[str], sigmas: list[float], threshold: float, value: str = _r("v", "v")) -> str:
    """Places over the threshold that none of the 26 neighbours in place and scale exceeds."""
    scales = " ".join(f"WHEN {k} THEN {float(s)!r}::DOUBLE" for k, s in enumerate(sigmas))
    return f"""WITH t AS MATERIALIZED ({' UNION ALL '.join(f'SELECT {k} AS k, y, x, v FROM ({q})' for k, q in enumerate(stack))}),
o AS (SELECT * FROM range(-1, 2) a(dk), range(-1, 2) b(dy), range(-1, 2) c(dx)), m AS (SELECT t.k, t.y, t.x, any_value(t.v) AS v, max(q.v) AS top FROM (SELECT * FROM t WHERE v > {threshold}) t, o, t q WHERE q.k = t.k + dk AND q.y = t.y + dy AND q.x = t.x + dx GROUP BY ALL)
SELECT y, x, CASE k {scales} END AS sigma, {value} FROM m WHERE v = top"""


def _pruned_sql(blobs: str, overlap: float) -> str:
    """``blobs`` without those that share more than ``overlap`` of their area with a larger one (of one size: with a darker one, then a later one)."""
    pairs = "SELECT a.*, sqrt(pow(a.y - b.y, 2) + pow(a.x - b.x, 2)) / (sqrt(2) * b.sigma) AS d, a.sigma / b.sigma AS r FROM b a JOIN b ON (b.sigma, -b.v, b.y, b.x) > (a.sigma, -a.v, a.y, a.x)"
    lens = "(r * r * acos(least(1, greatest(-1, (d * d + r * r - 1) / (2 * d * r)))) + acos(least(1, greatest(-1, (d * d + 1 - r * r) / (2 * d)))) - sqrt(abs((1 + r - d) * (d - 1 + r) * (d + 1 - r) * (d + 1 + r))) / 2) / (pi() * r * r)"
    return f"""WITH b AS MATERIALIZED ({blobs}), p AS ({pairs}), g AS (SELECT DISTINCT y, x, sigma FROM p WHERE CASE WHEN d > 1 + r THEN 0 WHEN d <= 1 - r THEN 1 ELSE {lens} END > {overlap})
SELECT y, x, sigma, {_r('v', 'v')} FROM b ANTI JOIN g USING (y, x, sigma)"""


_describe("blob_log", _peaks_sql([f"SELECT y, x, -{s * s} * (a + c) AS v FROM ({_hessian_sql(s, 'nearest')})" for s in (1.0, 2.0, 3.0)], [1.0, 2.0, 3.0], 0.1))
_describe("blob_doh", _peaks_sql([f"SELECT y, x, {s**4} * (a * c - b * b) AS v FROM ({_hessian_sql(s, 'nearest')})" for s in (1.0, 2.0, 3.0)], [1.0, 2.0, 3.0], 0.001))
_SOFT = [(s, _blur_sql(stencil.gaussian_weights(s), stencil.gaussian_weights(s), "reflect")) for s in (1.0, 1.6, 2.56, 4.096)]
_describe("blob_dog", _pruned_sql(_peaks_sql([f"SELECT y, x, (a.v - b.v) * {1 / (t / s - 1)!r}::DOUBLE AS v FROM ({p}) a JOIN ({q}) b USING (y, x)" for (s, p), (t, q) in zip(_SOFT, _SOFT[1:], strict=False)], [s for s, _ in _SOFT[:-1]], 0.05, "v"), 0.5))


def _richardson_lucy_sql(rounds: int) -> str:
    spread = [(dy, dx, 1 / 9) for dy, dx in stencil.rectangle(3, 3)]
    steps = [f"i AS MATERIALIZED (SELECT y, x, v / 255 AS v FROM ({BYTES}))", "t0 AS (SELECT y, x, 0.5::DOUBLE AS v FROM i)"]
    for k in range(rounds):
        steps.append(f"s{k} AS ({_shift_sql(f'FROM t{k}', spread, 'sum(n * k)', 'ignore', 16)})")
        steps.append(f"r{k} AS (SELECT y, x, CASE WHEN s.v < 1e-12 THEN 0 ELSE i.v / s.v END AS v FROM i JOIN s{k} s USING (y, x))")
        steps.append(f"t{k + 1} AS MATERIALIZED (SELECT y, x, t.v * u.v AS v FROM t{k} t JOIN ({_shift_sql(f'FROM r{k}', spread, 'sum(n * k)', 'ignore', 16)}) u USING (y, x))")
    return f"WITH {', '.join(steps)} SELECT y, x, {_r('greatest(least(v, 1), -1)', 'v')} FROM t{rounds}"


_describe("richardson_lucy", _richardson_lucy_sql(3))

# -- reconstruction: geodesic steps of the whole image, more of them than any way here has ----------------


def _reconstruct_sql(seed: str, mask: str, rounds: int = 400) -> str:
    """Places with r, the seed spread under the mask; both are expressions of v, y and x."""
    return f"""WITH RECURSIVE m AS MATERIALIZED (SELECT y, x, v, least({seed}, {mask}) AS s, {mask} AS m FROM (SELECT y, x, v::DOUBLE AS v FROM ({FULL}))), o AS MATERIALIZED (SELECT * FROM range(-1, 2) a(dy), range(-1, 2) b(dx)),
g(i, y, x, r) AS (SELECT 0, y, x, s FROM m UNION ALL SELECT any_value(i) + 1, m.y, m.x, least(max(g.r), any_value(m.m)) FROM g, o, m WHERE i < {rounds} AND m.y = g.y + dy AND m.x = g.x + dx GROUP BY m.y, m.x)
SELECT m.y, m.x, m.v, r FROM g JOIN m USING (y, x) WHERE i = {rounds}"""


_describe("reconstruction", f"SELECT y, x, {_r('r', 'v')} FROM ({_reconstruct_sql('CASE WHEN x = 0 THEN v ELSE 0 END', 'v')})")
_describe("h_maxima", f"SELECT y, x, (v - r >= 300 - 1e-12)::INT::DOUBLE AS v FROM ({_reconstruct_sql('v - 300', 'v')})")
_describe("h_minima", f"SELECT y, x, (-v - r >= 300 - 1e-12)::INT::DOUBLE AS v FROM ({_reconstruct_sql('-v - 300', '-v')})")

# -- adaptive equalisation, colours by a filter of one channel, stains, random views ------------------------


def _doubles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grid(spark, sf_dir).select("image_id", "y", "x", F.col("v").cast("double").alias("v"))


def _adapthist_sql(ky: int, kx: int, clip: float) -> str:
    """The parts of 64 x 64 places equalised in tiles of ky x kx; counts above the limit are poured over the bins."""
    th, tw, size = -(-64 // ky), -(-64 // kx), ky * kx
    limit = max(int(clip * size), 1) if clip else size
    return f"""WITH p AS MATERIALIZED (SELECT y, x, floor(round_even((v::DOUBLE - a) / (b - a) * 16383, 0) / 65)::INT AS k FROM ({FULL}), (SELECT min(v)::DOUBLE AS a, max(v)::DOUBLE AS b FROM ({FULL}))),
f AS (SELECT r.i AS y, s.i AS x, k FROM range({th * ky}) r(i), range({tw * kx}) s(i), p WHERE p.y = CASE WHEN r.i < 64 THEN r.i ELSE 126 - r.i END AND p.x = CASE WHEN s.i < 64 THEN s.i ELSE 126 - s.i END),
c AS (SELECT y // {ky} AS ty, x // {kx} AS tx, k, count(*) AS n FROM f GROUP BY ALL),
h AS (SELECT ty, tx, k, coalesce(n, 0) AS n FROM (SELECT * FROM range({th}) a(ty), range({tw}) b(tx), range(256) d(k)) LEFT JOIN c USING (ty, tx, k)),
h0 AS (SELECT *, least(n, {limit}) AS low, {limit} - least(n, {limit}) AS room, sum(n - least(n, {limit})) OVER (PARTITION BY ty, tx) AS cut FROM h),
h1 AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY ty, tx ORDER BY room, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (257 - row_number() OVER (PARTITION BY ty, tx ORDER BY room, k)) * room <= cut AS is_full FROM h0),
h2 AS (SELECT *, cut - sum(CASE WHEN is_full THEN room ELSE 0 END) OVER (PARTITION BY ty, tx) AS rest, sum((NOT is_full)::INT) OVER (PARTITION BY ty, tx) AS open, sum((NOT is_full)::INT) OVER (PARTITION BY ty, tx ORDER BY k) AS turn FROM h1),
h3 AS (SELECT ty, tx, k, (low + CASE WHEN is_full THEN room ELSE rest // open + turn * (rest % open) // open - (turn - 1) * (rest % open) // open END)::BIGINT AS n FROM h2),
m AS MATERIALIZED (SELECT ty, tx, k, floor(least(16383, sum(n) OVER (PARTITION BY ty, tx ORDER BY k) * (16383 / {size}.0::DOUBLE))) AS v FROM h3),
a AS (SELECT y, x, k, greatest(0, least({th - 1}, (y + {ky // 2}) // {ky} - 1 + e)) AS ty, greatest(0, least({tw - 1}, (x + {kx // 2}) // {kx} - 1 + g)) AS tx, abs(1 - e - ((y + {ky // 2}) % {ky}) / {ky}.0::DOUBLE) * abs(1 - g - ((x + {kx // 2}) % {kx}) / {kx}.0::DOUBLE) AS w FROM p, range(2) s(e), range(2) t(g)),
z AS (SELECT y, x, floor(sum(w * v) + 1e-6) AS v FROM a JOIN m USING (ty, tx, k) GROUP BY y, x) SELECT y, x, {_r('(v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ())', 'v')} FROM z"""


register("equalize_adapthist", lambda s, d: adaptive.equalize_adapthist(_doubles(s, d)).select("y", "x", "v"), _adapthist_sql(8, 8, 0.01))
# 9 and 12 do not divide 64; the limit is 5 of 108 places.
register("equalize_adapthist_clipped", lambda s, d: adaptive.equalize_adapthist(_doubles(s, d), (9, 12), 0.05).select("y", "x", "v"), _adapthist_sql(9, 12, 0.05))
# Without a limit the tiles' histograms stay as they are; 9 and 8 do not both divide 64.
register("equalize_adapthist_unclipped", lambda s, d: adaptive.equalize_adapthist(_doubles(s, d), (9, 8), 0.0).select("y", "x", "v"), _adapthist_sql(9, 8, 0.0))
_SQUARE = stencil.rectangle(3, 3)
_lowest = lambda p: stencil.erosion(p, _SQUARE)
register("adapt_rgb_each_channel", lambda s, d: adaptive.adapt_rgb(raster.embedding_colours(s, d), _lowest).select("y", "x", "r", "g", "b"), f"SELECT y, x, r.v AS r, g.v AS g, b.v AS b FROM ({_shift_sql(f'SELECT y, x, r AS v FROM ({COLOURS})', _SQUARE, 'min(n)')}) r JOIN ({_shift_sql(f'SELECT y, x, g AS v FROM ({COLOURS})', _SQUARE, 'min(n)')}) g USING (y, x) JOIN ({_shift_sql(f'SELECT y, x, b AS v FROM ({COLOURS})', _SQUARE, 'min(n)')}) b USING (y, x)")
register("adapt_rgb_hsv_value", lambda s, d: adaptive.adapt_rgb(raster.embedding_colours(s, d), _lowest, adaptive.hsv_value).select("y", "x", "r", "g", "b"), f"""WITH c AS MATERIALIZED ({COLOURS})
SELECT y, x, {', '.join(_r(f"CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE {k} / greatest(r, g, b) * m.v END", k) for k in "rgb")} FROM c JOIN ({_shift_sql('SELECT y, x, greatest(r, g, b) AS v FROM c', _SQUARE, 'min(n)', digits=16)}) m USING (y, x)""")
_OD = {c: f"-ln(greatest(least({c} * 255, 240), 1) / 240)" for c in "rgb"}
_OWN = [0.65, 0.70, 0.29, 0.07, 0.99, 0.11]
_dot = lambda a, b: "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b, strict=True)) + ")"
_PV, _QV = _dot(_OWN[:3], "rgb"), _dot(_OWN[3:], "rgb")
_PP, _PQ, _QQ = (sum(x * y for x, y in zip(a, b, strict=True)) for a, b in ((_OWN[:3], _OWN[:3]), (_OWN[:3], _OWN[3:]), (_OWN[3:], _OWN[3:])))


def _own_stains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(0, *_OWN)], "image_id long, " + ", ".join(f"{c} double" for c in overlay.STAINS))


register("normalize_stains", lambda s, d: overlay.normalize_stains(catalog_shapes._slides(s, d), _own_stains(s, d)).select("y", "x", "r", "g", "b"), f"""WITH o AS (SELECT y, x, {', '.join(f'{e} AS {c}' for c, e in _OD.items())} FROM ({COLOURS})),
c AS MATERIALIZED (SELECT y, x, ({_QQ!r} * {_PV} - {_PQ!r} * {_QV}) / {_PP * _QQ - _PQ**2!r} AS c0, ({_PP!r} * {_QV} - {_PQ!r} * {_PV}) / {_PP * _QQ - _PQ**2!r} AS c1 FROM o),
t AS (SELECT quantile_cont(c0, 0.99::DOUBLE) AS t0, quantile_cont(c1, 0.99::DOUBLE) AS t1 FROM c)
SELECT y, x, {', '.join(f"round_even(least(255, greatest(0, exp(-({a} * c0 * 1.9705 / t0 + {b} * c1 * 1.0308 / t1)) * 240)), 0) + 0.0 AS {k}" for (a, b), k in zip(overlay.REFERENCE_STAINS, "rgb", strict=True))} FROM c, t""")
register("normalize_colors_pca", lambda s, d: overlay.normalize_colors_pca(catalog_shapes._slides(s, d)).select("y", "x", "r", "g", "b"))


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid in images of 16 x 16, so that draws differ."""
    p = _grid(spark, sf_dir)
    return p.select((F.floor(F.col("y") / 16) * 4 + F.floor(F.col("x") / 16)).cast("long").alias("image_id"), (F.col("y") % 16).alias("y"), (F.col("x") % 16).alias("x"), F.col("v").cast("double").alias("v"))


register("rand_image_flip", lambda s, d: overlay.rand_image_flip(_tiles(s, d), seed=5))
register("rand_image_rotate_90", lambda s, d: overlay.rand_image_rotate_90(_tiles(s, d), seed=5))
register("rand_color_jitter", lambda s, d: overlay.rand_colour_jitter(raster.embedding_colours(s, d), 0.2, 0.3, 0.4, seed=5).select("y", "x", "r", "g", "b"))

# -- random walks: seeds are the places of large and of small values -------------------------------


def _walk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    image = raster.embedding_image(spark, sf_dir)
    return image, image.select("image_id", "y", "x", F.when(F.col("v") > 0.16, 1).when(F.col("v") < -0.16, 2).otherwise(0).alias("label"))


register("random_walker", lambda s, d: walker.random_walker(*_walk(s, d)).select("y", "x", "label"))

# -- polygons: the values of each vector are a chain of points -------------------------------------

_CHAINS = f"SELECT y AS chain_id, x AS i, v::DOUBLE AS y, x::DOUBLE AS x FROM ({BYTES})"
_OFF = """round(CASE WHEN (p.y - a.y) * (b.y - a.y) + (p.x - a.x) * (b.x - a.x) > 0 AND (b.y - p.y) * (b.y - a.y) + (b.x - p.x) * (b.x - a.x) > 0
  THEN abs((p.y - a.y) * (b.x - a.x) - (p.x - a.x) * (b.y - a.y)) / sqrt(pow(b.y - a.y, 2) + pow(b.x - a.x, 2))
  ELSE least(sqrt(pow(p.y - a.y, 2) + pow(p.x - a.x, 2)), sqrt(pow(p.y - b.y, 2) + pow(p.x - b.x, 2))) END, 9)"""
register(
    "approximate_polygon",
    lambda s, d: polygons.approximate_polygon(raster.embedding_bytes(s, d).select(F.col("y").alias("chain_id"), F.col("x").alias("i"), F.col("v").alias("y"), F.col("x").alias("x")), 40.0),
    f"""WITH RECURSIVE p AS MATERIALIZED ({_CHAINS}), s AS (SELECT chain_id, min(i) AS a, max(i) AS b FROM p GROUP BY chain_id UNION ALL
  SELECT chain_id, unnest([a, m]), unnest([m, b]) FROM (SELECT chain_id, a, b, max(d) AS d, -max({{'d': d, 'i': -i}}).i AS m FROM (
    SELECT s.chain_id, s.a, s.b, p.i, {_OFF} AS d FROM s JOIN p ON p.chain_id = s.chain_id AND p.i > s.a AND p.i < s.b
      JOIN p a ON a.chain_id = s.chain_id AND a.i = s.a JOIN p b ON b.chain_id = s.chain_id AND b.i = s.b) GROUP BY chain_id, a, b) WHERE d > 40)
SELECT chain_id, i, y, x FROM p WHERE EXISTS (SELECT 1 FROM s WHERE s.chain_id = p.chain_id AND p.i IN (s.a, s.b))""",
)
