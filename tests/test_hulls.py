"""Hulls, thinning, adaptive equalisation, stains and random views against plain numpy on small images."""

import numpy as np
import pytest

from imgq.operators import adaptive, hulls, levelsets, overlay, thinning
from pyspark.sql import functions as F

from .test_operators import frame, grid


def hull_mask(a):
    """Places no line between two side middles of ``a`` has all of ``a`` on its other side from."""
    on = np.argwhere(a)
    points = np.concatenate([on + d for d in ([0.5, 0], [-0.5, 0], [0, 0.5], [0, -0.5])])
    out = np.ones(a.shape, bool)
    for p in points:
        for q in points:
            side = lambda r, p=p, q=q: (q[0] - p[0]) * (r[..., 1] - p[1]) - (q[1] - p[1]) * (r[..., 0] - p[0])
            if (p != q).any() and (side(points) <= 1e-9).all():
                out &= side(np.stack(np.indices(a.shape), -1)) <= 1e-9
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hulls(spark, seed):
    a = (np.random.default_rng(seed).random((9, 11)) < 0.12).astype(float)
    a[4, 5] = 1
    assert (grid(hulls.convex_hull_image(frame(spark, a))) == hull_mask(a)).all()


def test_hulls_of_points_lines_and_nothing(spark):
    a = np.zeros((6, 7))
    a[1, 1] = a[3, 2] = a[3, 5] = 1
    labels = frame(spark, a).withColumn("label", F.when(F.col("v") == 0, 0).when(F.col("y") == 1, 1).otherwise(2).cast("long"))
    got = {r["label"]: (r["area_convex"], r["solidity"], r["feret_diameter_max"]) for r in hulls.region_convexity(labels).collect()}
    assert got == {1: (1.0, 1.0, 0.0), 2: (4.0, 0.5, 3.0)}
    empty = frame(spark, np.zeros((3, 3)))
    assert (grid(hulls.convex_hull_image(empty)) == 0).all()
    assert hulls.convex_hull_object(empty.where("v > 0")).count() == 0


def test_thinning_keeps_lines_and_thins_bars(spark):
    a = np.zeros((9, 12))
    a[2:7, 1:11] = 1
    got = grid(thinning.thin(frame(spark, a)))
    assert 0 < got.sum() < 12 and (got <= a).all()
    line = np.eye(6)
    assert (grid(thinning.thin(frame(spark, line))) == line).all()
    # An image of 8-connected parts keeps their number.
    assert grid(thinning.thin(frame(spark, np.zeros((3, 4))))).sum() == 0


def poured(n, limit):
    """Counts cut at the limit; the water rises by one as long as all of it covers every bin that has room."""
    out = [min(int(x), limit) for x in n]
    cut = int(sum(n)) - sum(out)
    while cut > 0 and (room := [i for i, x in enumerate(out) if x < limit]):
        if cut >= len(room):
            for i in room:
                out[i] += 1
            cut -= len(room)
        else:
            for turn, i in enumerate(room):
                out[i] += (turn + 1) * cut // len(room) - turn * cut // len(room)
            cut = 0
    return out


def clahe(a, ky, kx, clip):
    """The same by whole arrays: mirrored last tiles, one map for each tile, bilinear between tiles."""
    level = np.rint((a - a.min()) / (a.max() - a.min()) * 16383).astype(int) // 65
    h, w = a.shape
    th, tw = -(-h // ky), -(-w // kx)
    wide = np.pad(level, [(0, th * ky - h), (0, tw * kx - w)], mode="reflect")
    maps = np.zeros((th, tw, 256))
    for i in range(th):
        for j in range(tw):
            n = np.bincount(wide[i * ky : (i + 1) * ky, j * kx : (j + 1) * kx].ravel(), minlength=256)
            limit = int(max(clip * ky * kx, 1))
            maps[i, j] = np.minimum(np.cumsum(poured(n, limit)) * (16383 / (ky * kx)), 16383).astype(int)
    out = np.zeros(a.shape)
    for y in range(h):
        for x in range(w):
            (b, f), (c, g) = divmod(y + ky // 2, ky), divmod(x + kx // 2, kx)
            for d, p in ((b - 1, 1 - f / ky), (b, f / ky)):
                for e, q in ((c - 1, 1 - g / kx), (c, g / kx)):
                    out[y, x] += p * q * maps[np.clip(d, 0, th - 1), np.clip(e, 0, tw - 1), level[y, x]]
    out = np.floor(out + 1e-6)
    return (out - out.min()) / (out.max() - out.min())


@pytest.mark.parametrize("clip", [0.01, 0.2])
def test_adaptive_equalisation(spark, clip):
    a = np.random.default_rng(2).random((11, 13)).round(3)
    assert np.allclose(grid(adaptive.equalize_adapthist(frame(spark, a), (4, 5), clip)), clahe(a, 4, 5, clip))
    flat = frame(spark, np.full((5, 5), 3.0))
    assert (grid(adaptive.equalize_adapthist(flat)) == 0).all()


def test_clipping_deals_out_what_is_cut_off(spark):
    rng = np.random.default_rng(6)
    tiles = [([9, 0, 1, 2], 4), ([100, 100, 100, 100], 5), ([0, 0, 0, 0], 3), ([7, 0, 0, 0], 2), ([30, 5, 5, 0], 10)] + [(rng.integers(0, 12, 16).tolist(), int(rng.integers(1, 12))) for _ in range(25)]
    rows = [(0, t, 0, b, n, limit) for t, (counts, limit) in enumerate(tiles) for b, n in enumerate(counts)]
    counts = spark.createDataFrame(rows, "image_id long, _ty int, _tx int, _bin int, _n long, _size long")
    got = {}
    for r in adaptive.clip_histograms(counts, F.col("_size")).orderBy("_ty", "_bin").collect():
        got.setdefault(r["_ty"], []).append(r["_n"])
    assert got == {t: poured(counts, limit) for t, (counts, limit) in enumerate(tiles)}
    assert got[0] == [4, 1, 3, 4] and got[1] == [5] * 4



def test_chan_vese_parts_a_square_from_its_ground(spark):
    a = np.zeros((12, 12))
    a[3:9, 4:10] = 1
    out = levelsets.chan_vese(frame(spark, a), mu=0.05, max_rounds=12)
    got = grid(out, "mask")
    assert (got == a).all() or (got == 1 - a).all()


def colours(spark, a, image_id=0):
    rows = [(image_id, y, x, *map(float, a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])]
    return spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")


def test_stain_normalisation(spark):
    rng = np.random.default_rng(4)
    stains = np.array([[0.65, 0.07], [0.70, 0.99], [0.29, 0.11]])
    a = 240 * np.exp(-(rng.random((20, 20, 2)) * [1.5, 1.0]) @ stains.T)
    pixels = colours(spark, a)
    m = overlay.stain_matrix(pixels)[0]
    od = -np.log(np.clip(a, 1, 240) / 240).reshape(-1, 3)
    amounts = np.linalg.lstsq(m, od.T, rcond=None)[0]
    amounts *= (np.array(overlay.REFERENCE_MOST) / np.percentile(amounts, 99, axis=1))[:, None]
    want = np.rint(np.clip(240 * np.exp(-np.array(overlay.REFERENCE_STAINS) @ amounts), 0, 255)).T.reshape(a.shape)
    out = overlay.normalize_colors_pca(pixels)
    assert np.abs(np.stack([grid(out, c) for c in "rgb"], -1) - want).max() <= 1
    assert overlay.stain_table(colours(spark, np.full((3, 3, 3), 240.0))).count() == 0


def test_random_views_are_drawn_for_each_image(spark):
    a = np.arange(12.0).reshape(3, 4)
    many = frame(spark, a)
    for i in range(1, 16):
        many = many.unionByName(frame(spark, a, i))
    flipped = overlay.rand_image_flip(many, "x", 0.5, 1).where("y = 0 AND x = 0").toPandas()["v"]
    assert set(flipped) == {0.0, 3.0}
    turned = overlay.rand_image_rotate_90(many, 0.8, 3, 1)
    for i in range(16):
        got = grid(turned.where(F.col("image_id") == i))
        assert any(got.shape == np.rot90(a, k).shape and (got == np.rot90(a, k)).all() for k in range(4))
    jitter = overlay.rand_colour_jitter(colours(spark, np.full((2, 2, 3), 0.5)), 0.2, 0.3, 0.4, 1, 0.0)
    assert jitter.where("abs(r - 0.5) > 1e-12").count() == 0
