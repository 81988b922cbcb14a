"""Neighbourhoods across tiles: against plain arrays, and no group that grows with an image."""

import numpy as np
import pytest

from imgq.operators import features, filters, histogram, morphology, stencil
from imgq.operators.tiles import SIDE

TALL = np.random.default_rng(3).integers(0, 50, (2 * SIDE + 9, 5)) / 50


@pytest.fixture(scope="module")
def tall(spark):
    return spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(TALL)], "image_id long, y int, x int, v double")


def image(df, column="v"):
    out = np.full(TALL.shape, np.nan)
    for r in df.collect():
        out[r["y"], r["x"]] = r[column]
    return out


def windows(offsets, mode):
    wide = np.pad(TALL, 4, mode=mode)
    return np.stack([wide[4 + o[0] : 4 + o[0] + TALL.shape[0], 4 + o[1] : 4 + o[1] + TALL.shape[1]] for o in offsets])


def test_tall_image_against_arrays(tall):
    around = stencil.disk(2)
    assert np.array_equal(image(stencil.dilation(tall, around)), windows(around, "symmetric").max(0))
    assert np.array_equal(image(stencil.erosion(tall, around)), windows(around, "symmetric").min(0))
    assert np.allclose(image(stencil.median(tall, stencil.rectangle(3, 3))), np.median(windows(stencil.rectangle(3, 3), "edge"), 0))
    w = stencil.gaussian_weights(0.8)
    r = len(w) // 2
    kernel = [(i - r, j - r, a * b) for i, a in enumerate(w) for j, b in enumerate(w)]
    assert np.allclose(image(stencil.gaussian(tall, 0.8)), np.tensordot([k[2] for k in kernel], windows(kernel, "edge"), 1))
    assert np.allclose(image(filters.gabor(tall, 0.2, 0.5, 1.0), "re"), np.tensordot([k[2].real for k in filters.gabor_kernel(0.2, 0.5, 1.0)], windows([(-a, -b) for a, b, _ in filters.gabor_kernel(0.2, 0.5, 1.0)], "symmetric"), 1))


@pytest.mark.parametrize(
    "f",
    [lambda p: stencil.dilation(p, stencil.disk(2)), lambda p: stencil.median(p, stencil.rectangle(3, 3)), lambda p: stencil.peak_local_max(p, 2), lambda p: filters.gabor(p, 0.2),
     lambda p: filters.sato(p), lambda p: filters.blob_doh(p), lambda p: filters.match_template(p, [[1.0, 2.0]]), lambda p: morphology.rolling_ball(p, 2)],
)
def test_steps_run_in_tiles(tall, f):
    plan = f(tall)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapGroupsInArrow") == 1 and "_ty" in plan


def test_matches_are_measured_in_blocks(spark):
    x = np.round(np.random.default_rng(5).normal(size=(90, 6)), 1)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, descriptor array<double>")
    asked = rows.where("id % 9 = 0").selectExpr("id AS q", "descriptor AS wanted")
    for p in (1, 2, 3):
        found = features.match_descriptors(asked, rows, p, block_rows=20, one_table=True)
        assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().optimizedPlan().toString()
        d = (np.abs(x[::9, None] - x[None]) ** p).sum(2) ** (1 / p)
        d[np.arange(10), np.arange(0, 90, 9)] = np.inf
        got = {r["q"]: (r["id"], r["distance"]) for r in found.collect()}
        assert len(got) == 10 and all(np.isclose(got[q][1], d[k].min()) and np.isclose(d[k, got[q][0]], d[k].min()) for k, q in enumerate(range(0, 90, 9)))


def test_quantiles(spark):
    rows = [(1, float(v)) for v in TALL[:, 0]] + [(2, 7.0)] * 5 + [(3, None)]
    p = spark.createDataFrame(rows, "image_id long, v double")
    found = histogram.quantiles(p, {"a": 0.02, "b": 0.98})
    assert "percentile" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {r["image_id"]: (r["a"], r["b"]) for r in found.collect()}
    assert got.keys() == {1, 2} and got[2] == (7.0, 7.0) and np.allclose(got[1], np.quantile(TALL[:, 0], [0.02, 0.98]))


def test_denoising_writes_one_table_for_eight_rounds(tall, monkeypatch):
    from imgq.operators import edges

    names, write = [], edges.materialize
    monkeypatch.setattr(edges, "materialize", lambda df, name: names.append(name) or write(df, name))
    assert edges.denoise_tv(tall, 0.1, rounds=8, eps=0.0).count() == TALL.size and names == ["denoised", "energy"]


def test_components_broadcast_nothing(tall, monkeypatch):
    from imgq.operators import edges, regions

    plans, write = [], regions.materialize
    monkeypatch.setattr(regions, "materialize", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    edges.canny(tall, 1.0, 0.08, 0.2).count()
    joins = [line for name, plan in plans if name == "parents" for line in plan.splitlines() if "Join " in line]
    assert joins and all("strategy=merge" in line for line in joins)


def test_a_round_of_walks_is_one_step_in_tiles(spark):
    from imgq.operators import walker

    row = [(1, 1, y, 0, 2.0, float(y > 0), float(y < 2), 0.0, 0.0, 0.5, float(y + 1), 0.0, 0.0) for y in range(3)]
    state = spark.createDataFrame(row, "image_id long, label long, y int, x int, d double, f_n double, f_s double, f_w double, f_e double, z double, r double, q double, s double")
    out = walker._times_matrix(state)
    assert "FlatMapGroupsInArrow" in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["y"]: (r["a"], r["z"]) for r in out.collect()} == {0: (1 - 1.0, 0.5), 1: (2 - 0.5 - 1.5, 0.5), 2: (3 - 1.0, 0.5)}
