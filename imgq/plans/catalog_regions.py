"""Registered queries over regions, footprints, level sets, derivatives and pyramids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import raster
from ..operators import filters, footprints, levelsets, morphology, regions, stencil, transform
from .catalog import EMBEDDING, FULL, LABELS, _outer, _r, _shift_sql, _table, register


def _grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.full_part_grid(spark, sf_dir)


# -- regions: places, cut-outs, fillings, outlines -------------------------------------

_PLACES = f"SELECT label, y, x, v FROM ({FULL}) WHERE label <> 0"
_BOX = f"SELECT label, min(y) AS y0, min(x) AS x0, max(y) AS y1, max(x) AS x1 FROM ({_PLACES}) GROUP BY label"
_CUT = f"""SELECT b.label, (a.y - y0)::INT AS y, (a.x - x0)::INT AS x, a.label = b.label AS inside, CASE WHEN a.label = b.label THEN a.v ELSE 0 END::DOUBLE AS v, y1 - y0 AS h, x1 - x0 AS w
FROM ({_BOX}) b JOIN ({FULL}) a ON a.y BETWEEN y0 AND y1 AND a.x BETWEEN x0 AND x1"""
register("regionprops_coords", lambda s, d: regions.region_coords(_grid(s, d)).select("label", "y", "x"), f"SELECT label, y, x FROM ({_PLACES})")
register("regionprops_coords_scaled", lambda s, d: regions.region_coords(_grid(s, d), (0.5, 2.0)).select("label", "y", "x"), f"SELECT label, y * 0.5::DOUBLE AS y, x * 2.0::DOUBLE AS x FROM ({_PLACES})")
register("regionprops_image", lambda s, d: regions.region_images(_grid(s, d)).select("label", "y", "x", "inside"), f"SELECT label, y, x, inside FROM ({_CUT})")
register("regionprops_image_intensity", lambda s, d: regions.region_images(_grid(s, d).withColumn("v", F.col("v").cast("double"))).select("label", "y", "x", "v"), f"SELECT label, y, x, v FROM ({_CUT})")
_FILLED = f"""WITH RECURSIVE c AS MATERIALIZED ({_CUT}), o(label, y, x) AS (
  SELECT label, y, x FROM c WHERE NOT inside AND (y = 0 OR x = 0 OR y = h OR x = w)
  UNION SELECT c.label, c.y, c.x FROM o JOIN c ON c.label = o.label AND abs(c.y - o.y) + abs(c.x - o.x) = 1 AND NOT c.inside)
SELECT c.label, c.y, c.x, o.label IS NULL AS inside FROM c LEFT JOIN o USING (label, y, x)"""
register("regionprops_image_filled", lambda s, d: regions.region_filled(_grid(s, d)).select("label", "y", "x", "inside"), _FILLED)
register("regionprops_area_filled", lambda s, d: regions.region_filled(_grid(s, d)).groupBy("label").agg(F.count_if("inside").alias("area_filled")), f"SELECT label, count(*) FILTER (WHERE inside) AS area_filled FROM ({_FILLED}) GROUP BY label")
_OUTLINES = f"""WITH c AS MATERIALIZED (SELECT label, y, x, inside::INT AS e FROM ({_CUT})),
n AS (SELECT p.label, p.y, p.x, count(*) AS k, min(q.e) AS m FROM c p JOIN c q ON q.label = p.label AND abs(q.y - p.y) + abs(q.x - p.x) <= 1 GROUP BY ALL),
b AS MATERIALIZED (SELECT c.label, c.y, c.x, (c.e = 1 AND (k < 5 OR m = 0))::INT AS e FROM c JOIN n USING (label, y, x)),
z AS (SELECT b.label, b.y, b.x, sum(q.e * CASE abs(q.y - b.y) + abs(q.x - b.x) WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 10 END) AS code FROM b JOIN b q ON q.label = b.label AND q.y BETWEEN b.y - 1 AND b.y + 1 AND q.x BETWEEN b.x - 1 AND b.x + 1 GROUP BY ALL)
SELECT label, {_r('sum(CASE WHEN code IN (5, 7, 15, 17, 25, 27) THEN 1 WHEN code IN (21, 33) THEN sqrt(2) WHEN code IN (13, 23) THEN (1 + sqrt(2)) / 2 ELSE 0 END)', 'perimeter')} FROM z GROUP BY label"""
register("regionprops_perimeter", lambda s, d: regions.per_region(_grid(s, d), morphology.perimeter, "perimeter").drop("image_id"), _OUTLINES)
_CROFTON = f"""WITH k AS (SELECT label, y + dy AS y, x + dx AS x, sum(c) AS code FROM ({_PLACES}), (VALUES (0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8)) o(dy, dx, c) GROUP BY ALL)
SELECT label, {_r('sum(CASE code ' + ' '.join(f'WHEN {i} THEN {float(w)!r}::DOUBLE' for i, w in enumerate(morphology.CROFTON[4])) + ' END)', 'perimeter')} FROM k GROUP BY label"""
register("regionprops_perimeter_crofton", lambda s, d: regions.per_region(_grid(s, d), morphology.perimeter_crofton, "perimeter").drop("image_id"), _CROFTON)


def _border_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _grid(spark, sf_dir)
    both = regions.per_region(labels, morphology.perimeter, "perimeter").join(regions.boundary_counts(labels), ["image_id", "label"])
    return both.select("label", F.try_divide(F.col("num_boundary_pixels").cast("double"), F.col("perimeter")).alias("ratio"))


register("perimeter_on_border_ratio", _border_ratio, f"SELECT a.label, round(k / nullif(perimeter, 0), 6) + 0.0 AS ratio FROM ({_OUTLINES}) a JOIN (SELECT label, count(*) FILTER (WHERE y IN (0, 63) OR x IN (0, 63)) AS k FROM ({_PLACES}) GROUP BY label) USING (label)")

# -- moments ------------------------------------------------------------------------------

_PAIRS = [(p, q) for p in range(4) for q in range(4 - p)]


def _moments_sql(weight: str, columns: list[str]) -> str:
    """Over the label map: central moments mu_pq, normalised ones nu_pq, then ``columns``."""
    mu = ", ".join(f"sum(w * pow(y - cy, {p}) * pow(x - cx, {q})) AS mu_{p}{q}" for p, q in _PAIRS)
    nu = ", ".join(f"mu_{p}{q} / pow(mu_00, {(p + q) / 2 + 1}) AS nu_{p}{q}" for p, q in _PAIRS)
    return f"""WITH g AS (SELECT label, y::DOUBLE AS y, x::DOUBLE AS x, {weight}::DOUBLE AS w FROM ({LABELS}) WHERE label <> 0),
c AS (SELECT label, sum(w * y) / sum(w) AS cy, sum(w * x) / sum(w) AS cx, min(y) AS y0, min(x) AS x0 FROM g GROUP BY label),
m AS (SELECT label, any_value(cy) AS cy, any_value(cx) AS cx, any_value(y0) AS y0, any_value(x0) AS x0, {mu} FROM g JOIN c USING (label) GROUP BY label), n AS (SELECT *, {nu} FROM m)
SELECT label, {", ".join(columns)} FROM n"""


_A, _B, _C, _D = "(nu_30 + nu_12)", "(nu_21 + nu_03)", "(nu_30 - 3 * nu_12)", "(3 * nu_21 - nu_03)"
_HU = [
    "nu_20 + nu_02", "pow(nu_20 - nu_02, 2) + 4 * pow(nu_11, 2)", f"pow({_C}, 2) + pow({_D}, 2)", f"pow({_A}, 2) + pow({_B}, 2)",
    f"{_C} * {_A} * (pow({_A}, 2) - 3 * pow({_B}, 2)) + {_D} * {_B} * (3 * pow({_A}, 2) - pow({_B}, 2))",
    f"(nu_20 - nu_02) * (pow({_A}, 2) - pow({_B}, 2)) + 4 * nu_11 * {_A} * {_B}",
    f"{_D} * {_A} * (pow({_A}, 2) - 3 * pow({_B}, 2)) - {_C} * {_B} * (3 * pow({_A}, 2) - pow({_B}, 2))",
]
_SECOND = [(p, q) for p, q in _PAIRS if p + q == 2]
_HIGH = [(p, q) for p, q in _PAIRS if p + q >= 2]
# Third central moments reach 1e8; six places of them are beyond a double's sums, so they are divided.
for _kind, _weight in (("", "1"), ("weighted_", "abs(v) * 10 + 1")):
    _labels = (lambda s, d: raster.embedding_labels(s, d)) if not _kind else (lambda s, d: raster.embedding_labels(s, d).withColumn("v", F.abs("v") * 10 + 1))
    _wanted = lambda names, k=_kind, f=_labels: lambda s, d: regions.region_table(f(s, d), names, bool(k)).drop("image_id")
    register(f"regionprops_{_kind}moments_central", lambda s, d, f=_wanted([f"{_kind}moments_central_{p}_{q}" for p, q in _SECOND]), k=_kind: f(s, d).select("label", *[(F.col(f"{k}moments_central_{p}_{q}") / 1e4).alias(f"mu_{p}{q}") for p, q in _SECOND]), _moments_sql(_weight, [_r(f"mu_{p}{q} / 1e4", f"mu_{p}{q}") for p, q in _SECOND]))
    register(f"regionprops_{_kind}moments_normalized", _wanted([f"{_kind}moments_normalized_{p}_{q}" for p, q in _HIGH]), _moments_sql(_weight, [_r(f"nu_{p}{q}", f"{_kind}moments_normalized_{p}_{q}") for p, q in _HIGH]))
    register(f"regionprops_{_kind}moments_hu", _wanted([f"{_kind}moments_hu_{i}" for i in range(7)]), _moments_sql(_weight, [_r(h, f"{_kind}moments_hu_{i}") for i, h in enumerate(_HU)]))
register("regionprops_centroid_weighted_local", lambda s, d: regions.region_table(raster.embedding_labels(s, d).withColumn("v", F.abs("v") + 0.01), ["weighted_centroid_local_0", "weighted_centroid_local_1"], True).drop("image_id"), _moments_sql("abs(v) + 0.01", [_r("cy - y0", "weighted_centroid_local_0"), _r("cx - x0", "weighted_centroid_local_1")]))
_EIGEN = "0.5 * atan2(-2 * mu_11, mu_02 - mu_20)"
_VECTORS = [f"CASE WHEN cos({t}) > 1e-12 THEN 1 ELSE -1 END * {f}({t})" for t in (f"({_EIGEN})", f"({_EIGEN} + pi() / 2)") for f in ("cos", "sin")]
register("inertia_tensor_eigenvectors", _table([f"inertia_tensor_eigenvector_{i}_{k}" for i in (0, 1) for k in (0, 1)]), _moments_sql("1", [_r(v, f"inertia_tensor_eigenvector_{j // 2}_{j % 2}") for j, v in enumerate(_VECTORS)]))
_POINTS = f"SELECT (y % 7)::DOUBLE AS y, (x % 5)::DOUBLE AS x FROM ({_PLACES}) WHERE label = 1"
_points = lambda s, d: _grid(s, d).where("label = 1").select("image_id", (F.col("y") % 7).alias("y"), (F.col("x") % 5).alias("x"))
_ALL = [(p, q) for p in range(3) for q in range(3)]
register("moments_coords", lambda s, d: regions.moments_coords(_points(s, d), 2).drop("image_id"), f"SELECT {', '.join(_r(f'sum(pow(y, {p}) * pow(x, {q}))', f'm_{p}_{q}') for p, q in _ALL)} FROM ({_POINTS})")
register("moments_coords_central", lambda s, d: regions.moments_coords(_points(s, d), 2, True).drop("image_id"), f"SELECT {', '.join(_r(f'sum(pow(y - cy, {p}) * pow(x - cx, {q}))', f'm_{p}_{q}') for p, q in _ALL)} FROM ({_POINTS}), (SELECT avg(y) AS cy, avg(x) AS cx FROM ({_POINTS}))")

# -- footprints -----------------------------------------------------------------------------


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point for each item of two pieces: layers by line number, rows and columns by part and supplier."""
    li = raster.read(spark, sf_dir, "lineitem").where("l_quantity = 2")
    return li.select(F.lit(0).cast("long").alias("image_id"), F.col("l_linenumber").alias("z"), F.pmod("l_partkey", F.lit(1000)).cast("int").alias("y"), F.pmod("l_suppkey", F.lit(1000)).cast("int").alias("x"))


_PLACED = "SELECT l_linenumber AS z, (l_partkey % 1000)::INT AS y, (l_suppkey % 1000)::INT AS x FROM lineitem WHERE l_quantity = 2"


def _footprint(name: str, offsets: list[tuple[int, ...]], where: str, reach: int) -> None:
    """How many items' footprints cover each place; the SQL says by an inequality what belongs to the footprint."""
    axes = "zyx"[-len(offsets[0]) :]
    shape = f"SELECT * FROM {', '.join(f'range(-{reach}, {reach + 1}) {a}_({a})' for a in axes)} WHERE {where}"
    register(name, lambda s, d: footprints.coverage(_placed(s, d), offsets).drop("image_id"), f"SELECT {', '.join(f'(p.{a} + f.{a})::INT AS {a}' for a in axes)}, count(*) AS n FROM ({_PLACED}) p, ({shape}) f GROUP BY ALL")


_footprint("footprint_rectangle", stencil.rectangle(3, 5), "abs(y) <= 1 AND abs(x) <= 2", 3)
_footprint("footprint_diamond", stencil.diamond(3), "abs(y) + abs(x) <= 3", 4)
_footprint("footprint_disk", stencil.disk(4), "y * y + x * x <= 16", 5)
_footprint("footprint_ellipse", footprints.ellipse(5, 3), "abs(y) <= 3 AND abs(x) <= 5 AND y * y / 16.0 + x * x / 36.0 < 1", 6)
_footprint("footprint_octagon", footprints.octagon(3, 2), "greatest(abs(y), abs(x)) <= 3 AND abs(y) + abs(x) <= 4", 4)
_footprint("footprint_star", footprints.star(4), "greatest(abs(y), abs(x)) <= 4 OR abs(y) + abs(x) <= 6", 6)
_footprint("footprint_octahedron", footprints.octahedron(2), "abs(z) + abs(y) + abs(x) <= 2", 3)
_footprint("footprint_ball", footprints.ball(3), "z * z + y * y + x * x <= 9", 4)
_footprint("mirror_footprint", stencil.mirror(stencil.rectangle(2, 4)), "y BETWEEN 0 AND 1 AND x BETWEEN -1 AND 2", 3)
_footprint("pad_footprint", footprints.pad_footprint(stencil.rectangle(2, 3), (2, 3), False), "y BETWEEN 0 AND 1 AND abs(x) <= 1", 3)
_footprint("footprint_from_sequence", footprints.footprint_from_sequence([(stencil.rectangle(3, 3), 2), (stencil.diamond(1), 1)]), "greatest(abs(y), abs(x)) <= 3 AND NOT (abs(y) = 3 AND abs(x) = 3)", 4)

# -- level sets -------------------------------------------------------------------------------

register("disk_level_set", lambda s, d: levelsets.disk_level_set(_grid(s, d)).select("y", "x", "v"), f"SELECT y, x, (sqrt(pow(y - 32, 2) + pow(x - 32, 2)) < 24)::INT::DOUBLE AS v FROM ({FULL})")
_BOARD = f"SELECT image_id, y, x, ((y // 5 + x // 5) % 2)::DOUBLE AS v FROM ({FULL})"
register("checkerboard_level_set", lambda s, d: levelsets.checkerboard_level_set(_grid(s, d)).select("y", "x", "v"), f"SELECT y, x, v FROM ({_BOARD})")
_SET = f"SELECT image_id, y, x, (label % 2)::DOUBLE AS v FROM ({FULL})"
_set = lambda s, d: _grid(s, d).withColumn("v", (F.col("label") % 2).cast("double"))


def _segments_sql(within: str, among: str) -> str:
    """Places outside are 0: they count as the lacking rows of a segment."""
    o = ", ".join(f"({k}, {dy}, {dx})" for k, s in enumerate(levelsets.SEGMENTS) for dy, dx in s)
    inner = "CASE WHEN count(*) < 3 THEN 0 ELSE min(q.v) END" if within == "min" else "max(q.v)"
    return f"""WITH p AS MATERIALIZED ({_SET}), o(k, dy, dx) AS (VALUES {o}), g AS (SELECT p.y, p.x, k, {inner} AS v FROM p, o, p q WHERE q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)
SELECT y, x, {among}(v) AS v FROM g GROUP BY ALL"""


register("sup_inf", lambda s, d: levelsets.sup_inf(_set(s, d)).select("y", "x", "v"), _segments_sql("min", "max"))
register("inf_sup", lambda s, d: levelsets.inf_sup(_set(s, d)).select("y", "x", "v"), _segments_sql("max", "min"))
register("morphological_chan_vese", lambda s, d: levelsets.morphological_chan_vese(_grid(s, d).withColumn("v", F.col("v").cast("double")), 3, levelsets.checkerboard_level_set(_grid(s, d))).select("y", "x", "v"))
register("morphological_geodesic_active_contour", lambda s, d: levelsets.morphological_geodesic_active_contour(levelsets.inverse_gaussian_gradient(_grid(s, d).withColumn("v", F.col("v").cast("double") / 1000), 100.0, 2.0), 3, levelsets.disk_level_set(_grid(s, d)), 0.5, 1, -1.0).select("y", "x", "v"))

# -- Gaussian derivatives, ridges, templates, blobs ------------------------------------------------

_W0, _W1, _W2 = stencil.gaussian_weights(1.0), filters.gaussian_derivative_weights(1.0, 1), filters.gaussian_derivative_weights(1.0, 2)
_SLOPES = [_shift_sql(EMBEDDING, _outer(a, b), "sum(n * k)", digits=12) for a, b in ((_W1, _W0), (_W0, _W1))]
_BENDS = [_shift_sql(EMBEDDING, _outer(a, b), "sum(n * k)", digits=12) for a, b in ((_W2, _W0), (_W0, _W2))]
_SLOPES_NEAREST = [_shift_sql(EMBEDDING, _outer(a, b), "sum(n * k)", "nearest", 12) for a, b in ((_W1, _W0), (_W0, _W1))]
_image = raster.embedding_image
register("gaussian_gradient_magnitude", lambda s, d: filters.gaussian_gradient_magnitude(_image(s, d), 1.0).select("y", "x", "v"), f"SELECT y, x, {_r('sqrt(a.v * a.v + b.v * b.v)', 'v')} FROM ({_SLOPES[0]}) a JOIN ({_SLOPES[1]}) b USING (y, x)")
register("gaussian_laplace", lambda s, d: filters.gaussian_laplace(_image(s, d), 1.0).select("y", "x", "v"), f"SELECT y, x, {_r('a.v + b.v', 'v')} FROM ({_BENDS[0]}) a JOIN ({_BENDS[1]}) b USING (y, x)")
register("inverse_gaussian_gradient", lambda s, d: levelsets.inverse_gaussian_gradient(_image(s, d), 100.0, 1.0).select("y", "x", "v"), f"SELECT y, x, {_r('1 / sqrt(1 + 100 * sqrt(a.v * a.v + b.v * b.v))', 'v')} FROM ({_SLOPES_NEAREST[0]}) a JOIN ({_SLOPES_NEAREST[1]}) b USING (y, x)")
register("meijering", lambda s, d: filters.meijering(_image(s, d), (1.0,)).select("y", "x", "v"))
register("hessian", lambda s, d: filters.hessian(_image(s, d), (1.0,)).select("y", "x", "v"))
_TEMPLATE = [[0.0, 1.0, 0.0], [1.0, 3.0, 1.0], [0.0, 1.0, -1.0]]
_MEAN = sum(map(sum, _TEMPLATE)) / 9
_STEPS = [(y, x, t - _MEAN) for y, row in enumerate(_TEMPLATE) for x, t in enumerate(row)]
_SPREAD = sum(t * t for *_, t in _STEPS)
register("match_template", lambda s, d: filters.match_template(_image(s, d), _TEMPLATE).select("y", "x", "v"), f"""WITH p AS MATERIALIZED ({EMBEDDING}), o(dy, dx, k) AS (VALUES {', '.join(map(str, _STEPS))}),
g AS (SELECT p.y, p.x, count(*) AS c, sum(q.v) AS s, sum(q.v * q.v) AS q, sum(q.v * k) AS t FROM p, o, p q WHERE q.y = p.y + dy AND q.x = p.x + dx GROUP BY ALL)
SELECT y, x, {_r(f't / sqrt((q - s * s / 9) * {_SPREAD!r})', 'v')} FROM g WHERE c = 9""")
register("blob_dog", lambda s, d: filters.blob_dog(_image(s, d), threshold=0.05).drop("image_id"))
register("blob_doh", lambda s, d: filters.blob_doh(_image(s, d), threshold=0.001).drop("image_id"))

# -- sizes --------------------------------------------------------------------------------------

_MEANS = f"""WITH a AS (SELECT y, x, v::DOUBLE AS v FROM ({FULL})), o AS (SELECT i, greatest(0, least(y + 1, (i + 1) * 64 / 24.0::DOUBLE) - greatest(y, i * 64 / 24.0::DOUBLE)) / (64 / 24.0::DOUBLE) AS w, y FROM range(24) t(i), range(64) u(y))
SELECT r.i::INT AS y, c.i::INT AS x, {_r('sum(a.v * r.w * c.w)', 'v')} FROM a JOIN o r ON r.y = a.y AND r.w > 0 JOIN o c ON c.y = a.x AND c.w > 0 GROUP BY ALL"""
_double = lambda s, d: _grid(s, d).withColumn("v", F.col("v").cast("double"))
register("resize_local_mean", lambda s, d: transform.resize_local_mean(_double(s, d), (64, 64), 24, 24).select("y", "x", "v"), _MEANS)
register("rescale", lambda s, d: transform.rescale(_double(s, d), (64, 64), 0.5).select("y", "x", "v"), f"SELECT (y // 2)::INT AS y, (x // 2)::INT AS x, {_r('avg(v::DOUBLE)', 'v')} FROM ({FULL}) GROUP BY ALL")
register("pyramid_expand", lambda s, d: transform.pyramid_expand(_double(s, d), (64, 64)).select("y", "x", "v"))
register("pyramid_gaussian", lambda s, d: transform.pyramid_gaussian(_double(s, d), (64, 64), 2).select("level", "y", "x", "v"))
register("warp_coords", lambda s, d: transform.warp_coords(_grid(s, d), lambda y, x: (0.5 * y + x, x - 0.25 * y)).select("y", "x", "from_y", "from_x"), f"SELECT y, x, (0.5 * y + x)::DOUBLE AS from_y, (x - 0.25 * y)::DOUBLE AS from_x FROM ({FULL})")
