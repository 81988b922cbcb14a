"""Operators that SQL cannot express, against plain numpy on small images."""

import struct
import zlib
from collections import deque

import numpy as np
import pytest

from imgq.functions import color
from imgq.operators import edges, filters, histogram, levelsets, metrics, morphology, overlay, regions, registration, stencil, transform
from imgq.sources import images
from imgq.streaming import events
from pyspark.sql import functions as F


def frame(spark, a, image_id=0):
    a = np.asarray(a, dtype=float)
    return spark.createDataFrame([(image_id, y, x, float(a[y, x])) for y in range(a.shape[0]) for x in range(a.shape[1])], "image_id long, y int, x int, v double")


def grid(df, column="v"):
    p = df.select("y", "x", column).toPandas()
    out = np.full((p["y"].max() + 1, p["x"].max() + 1), np.nan)
    out[p["y"], p["x"]] = p[column].astype(float)
    return out


@pytest.fixture(scope="module")
def image():
    return np.random.default_rng(1).random((12, 9)).round(3)


def pad(a, r, mode):
    return np.pad(a, r, mode={"reflect": "symmetric", "nearest": "edge", "mirror": "reflect", "wrap": "wrap", "constant": "constant"}[mode])


def correlate(a, k, mode):
    r = k.shape[0] // 2
    p = pad(a, r, mode)
    return sum(k[i, j] * p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(2 * r + 1) for j in range(2 * r + 1))


@pytest.mark.parametrize("mode", stencil.MODES)
def test_border_modes(spark, image, mode):
    w = np.array([0.1, 0.2, 0.4, 0.3, -0.5])
    want = correlate(image, np.outer(w, w[::-1]), mode)
    got = stencil.correlate1d(stencil.correlate1d(frame(spark, image), list(w), "y", mode), list(w[::-1]), "x", mode)
    assert np.allclose(grid(got), want)
    kernel = [(dy, dx, float(w[dy + 2] * w[::-1][dx + 2])) for dy, dx in stencil.rectangle(5, 5)]
    assert np.allclose(grid(stencil.correlate(frame(spark, image), kernel, mode)), want)


def gauss(a, s, mode):
    w = np.array(stencil.gaussian_weights(s))
    return correlate(a, np.outer(w, w), mode)


def test_structure_tensor_and_corners(spark, image):
    dy = correlate(image, np.outer([-1, 0, 1], [1, 2, 1]), "constant")
    dx = correlate(image, np.outer([1, 2, 1], [-1, 0, 1]), "constant")
    a, b, c = (gauss(p, 1.0, "constant") for p in (dy * dy, dy * dx, dx * dx))
    assert np.allclose(grid(stencil.corner_harris(frame(spark, image))), a * c - b * b - 0.05 * (a + c) ** 2)
    assert np.allclose(grid(stencil.corner_shi_tomasi(frame(spark, image))), (a + c) / 2 - np.sqrt(4 * b * b + (a - c) ** 2) / 2)
    assert np.allclose(grid(stencil.corner_foerstner(frame(spark, image)), "w"), (a * c - b * b) / (a + c))


def test_hessian_and_ridges(spark, image):
    g = gauss(image, 1.0, "reflect")
    gy, gx = np.gradient(g)
    hrr, hrc = np.gradient(gy)
    hcc = np.gradient(gx)[1]
    h = filters.hessian_matrix(frame(spark, image), 1.0, "reflect")
    for name, want in (("hrr", hrr), ("hrc", hrc), ("hcc", hcc)):
        assert np.allclose(grid(h, name), want)
    l1 = (hrr + hcc) / 2 + np.sqrt(4 * hrc**2 + (hrr - hcc) ** 2) / 2
    assert np.allclose(grid(filters.sato(frame(spark, image), (1.0,))), np.maximum(l1, 0))
    assert (grid(filters.frangi(frame(spark, image), (1.0,))) >= 0).all()


def flood(a, connectivity=1):
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if connectivity == 2 else [])
    out, n = np.zeros(a.shape, int), 0
    for y, x in np.ndindex(a.shape):
        if a[y, x] and not out[y, x]:
            n += 1
            out[y, x] = n
            todo = deque([(y, x)])
            while todo:
                i, j = todo.popleft()
                for di, dj in steps:
                    p = (i + di, j + dj)
                    if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and a[p] == a[y, x] and not out[p]:
                        out[p] = n
                        todo.append(p)
    return out


@pytest.mark.parametrize("connectivity", [1, 2])
def test_labels(spark, connectivity):
    a = np.random.default_rng(2).integers(0, 3, (15, 14))
    snake = np.zeros((15, 14))
    snake[::2] = 1
    snake[1::4, -1] = snake[3::4, 0] = 1
    for image in (a, snake, np.zeros((3, 3)), np.ones((3, 3))):
        assert (grid(regions.label(frame(spark, image), connectivity), "label") == flood(image, connectivity)).all()


def test_reconstruction_and_extrema(spark):
    rng = np.random.default_rng(3)
    mask = rng.integers(0, 6, (10, 11)).astype(float)
    seed = np.where(rng.random(mask.shape) < 0.1, mask, 0)
    want = np.minimum(seed, mask)
    while True:
        p = np.pad(want, 1, constant_values=-np.inf)
        new = np.minimum(np.max([p[i : i + 10, j : j + 11] for i in range(3) for j in range(3)], axis=0), mask)
        if (new == want).all():
            break
        want = new
    assert (grid(morphology.reconstruction(frame(spark, seed), frame(spark, mask))) == want).all()
    assert (grid(morphology.reconstruction(frame(spark, -seed), frame(spark, -mask), by_erosion=True)) == -want).all()
    plateaus, top = flood(mask + 1), np.zeros(mask.shape)
    for k in range(1, plateaus.max() + 1):
        on = plateaus == k
        p = np.pad(on, 1)
        around = (p[:-2, 1:-1] | p[2:, 1:-1] | p[1:-1, :-2] | p[1:-1, 2:]) & ~on
        top[on] = not (mask[around] > mask[on][0]).any()
    assert (grid(morphology.local_maxima(frame(spark, mask))) == top).all()
    m = (mask > 1).astype(float)
    holes = flood(1 - m)
    want = m + sum(((holes == k) for k in range(1, holes.max() + 1) if (holes == k).sum() <= 2), np.zeros(m.shape))
    assert (grid(morphology.remove_small_holes(frame(spark, m), 2)) == want).all()


def test_distance_without_background(spark):
    assert np.isinf(grid(morphology.distance_transform_edt(frame(spark, np.ones((2, 3)))))).all()
    a = np.ones((5, 5))
    a[2, 2] = 0
    y, x = np.indices(a.shape) - 2
    assert np.allclose(grid(morphology.distance_transform_edt(frame(spark, a), (2.0, 1.0))), np.hypot(2 * y, x))


def test_region_table_against_plain_moments(spark):
    labels = np.zeros((9, 10), int)
    labels[1:6, 2:9] = 1
    labels[2:4, 4:6] = 0
    labels[7:, :3] = 2
    v = np.random.default_rng(4).random(labels.shape)
    df = frame(spark, v).join(frame(spark, labels).select("image_id", "y", "x", F.col("v").cast("long").alias("label")), ["image_id", "y", "x"])
    names = list(regions.properties())
    got = {r["label"]: r for r in regions.region_table(df, names, True).collect()}
    for k in (1, 2):
        y, x = np.nonzero(labels == k)
        w, r = v[labels == k], got[k]
        ly, lx = y - y.min(), x - x.min()
        for p in range(4):
            for q in range(4 - p):
                assert np.isclose(r[f"moments_{p}_{q}"], (ly**p * lx**q).sum())
                assert np.isclose(r[f"weighted_moments_{p}_{q}"], (w * ly**p * lx**q).sum())
                assert np.isclose(r[f"moments_central_{p}_{q}"], ((y - y.mean()) ** p * (x - x.mean()) ** q).sum(), atol=1e-8)
        cov = np.cov(y, x, bias=True)
        assert np.allclose(sorted(np.linalg.eigvalsh(cov))[::-1], [r["inertia_tensor_eigvals_0"], r["inertia_tensor_eigvals_1"]])
        assert np.isclose(r["intensity_std"], w.std()) and np.isclose(r["intensity_median"], np.median(w))
    euler = {r["label"]: r["euler_number"] for r in regions.euler_number(df).collect()}
    assert euler == {1: 0, 2: 1}
    turned = df.select("image_id", F.col("x").alias("y"), (20 - F.col("y")).alias("x"), "v", "label")
    hu = [f"moments_hu_{i}" for i in range(7)]
    again = {r["label"]: r for r in regions.region_table(turned, hu).collect()}
    assert all(np.isclose(again[k][h], got[k][h], atol=1e-12) for k in (1, 2) for h in hu)


def test_thresholds_of_constant_and_bimodal_images(spark):
    flat = histogram.histogram(frame(spark, np.full((4, 4), 3.0)))
    assert flat.where("cnt > 0").count() == 1 and flat.count() == 256
    rng = np.random.default_rng(5)
    two = np.r_[rng.normal(0.2, 0.02, 60), rng.normal(0.8, 0.02, 60)].reshape(10, 12)
    h = histogram.histogram(frame(spark, two))
    for f in (histogram.threshold_otsu, histogram.threshold_isodata, histogram.threshold_yen):
        t = f(h).first()["threshold"]
        assert 0.2 < t < 0.8, f
    assert 0.3 < histogram.threshold_li(frame(spark, two)).first()["threshold"] < 0.7


def test_colour_round_trips(spark):
    rgb = np.random.default_rng(6).random((40, 3))
    df = spark.createDataFrame([(i, *map(float, c)) for i, c in enumerate(rgb)], "i int, r double, g double, b double")
    c = (F.col("r"), F.col("g"), F.col("b"))
    pairs = [(a, b) for a, b in color.SPACES.values()] + [(color.rgb2lab, color.lab2rgb), (color.rgb2luv, color.luv2rgb), (color.rgb2hed, color.hed2rgb)]
    for there, back in pairs[:-1]:
        out = df.select("i", *[x.alias(n) for x, n in zip(back(there(c)), "rgb", strict=True)]).orderBy("i").toPandas()
        assert np.allclose(out[list("rgb")].to_numpy(), rgb, atol=1e-6), there
    with pytest.raises(ValueError):
        color.convert_colorspace(c, "rgb", "nothing")


def test_identical_images(spark, image):
    df = frame(spark, image).withColumn("w", F.col("v"))
    assert metrics.structural_similarity(df, 1.0).first()["ssim"] == pytest.approx(1)
    r = metrics.simple_metrics(df, 1.0).first()
    assert r["mse"] == 0 and r["psnr"] is None


def test_geometry(spark, image):
    df = frame(spark, image)
    assert np.allclose(grid(transform.rotate90(df)), np.rot90(image))
    assert np.allclose(grid(transform.rotate90(df, 3)), np.rot90(image, 3))
    assert np.allclose(grid(transform.rotate(df, image.shape, 180.0)), np.rot90(image, 2))
    assert np.allclose(grid(transform.resize(df, image.shape, *image.shape)), image)
    assert np.allclose(grid(transform.integral_image(df)), image.cumsum(0).cumsum(1))


def test_deconvolution_sharpens(spark):
    a = np.zeros((9, 9))
    a[4, 4] = 0.9
    psf = [(dy, dx, 1 / 9) for dy, dx in stencil.rectangle(3, 3)]
    soft = stencil.correlate(frame(spark, a), psf, "constant")
    assert grid(filters.richardson_lucy(soft, psf, 5))[4, 4] > 2 * grid(soft)[4, 4]


def test_stains_and_noise(spark):
    rng = np.random.default_rng(7)
    stains = np.array([[0.65, 0.7, 0.29], [0.07, 0.99, 0.11]])
    stains /= np.linalg.norm(stains, axis=1, keepdims=True)
    od = np.r_[rng.random((200, 1)) * stains[0], rng.random((200, 1)) * stains[1]] + 0.35
    rows = [(0, i, 0, *map(float, 240 * np.exp(-o))) for i, o in enumerate(od)]
    m = overlay.stain_matrix(spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double"))[0]
    assert m.shape == (3, 2) and np.allclose(np.linalg.norm(m, axis=0), 1)
    noisy = grid(overlay.random_noise(frame(spark, np.full((40, 40), 0.5)), "s&p", 0.2, seed=1))
    assert 0.1 < (noisy != 0.5).mean() < 0.3 and set(np.unique(noisy)) <= {0.0, 0.5, 1.0}


def tiff(images_, tile=None, compression=1):
    """A little-endian TIFF of 8-bit arrays h x w x c."""
    out, body, directories = bytearray(b"II*\0\0\0\0\0"), bytearray(), []
    for a in images_:
        h, w, c = a.shape
        parts = [a[y : y + 4] for y in range(0, h, 4)]
        if tile:
            p = np.pad(a, ((0, -h % tile), (0, -w % tile), (0, 0)))
            parts = [p[y : y + tile, x : x + tile] for y in range(0, h, tile) for x in range(0, w, tile)]
        data = [zlib.compress(x.tobytes()) if compression == 8 else x.tobytes() for x in parts]
        at = []
        for d in data:
            at.append(8 + len(body))
            body += d
        tags = {256: [w], 257: [h], 258: [8], 259: [compression], 277: [c], **({322: [tile], 323: [tile], 324: at, 325: [len(d) for d in data]} if tile else {273: at, 278: [4], 279: [len(d) for d in data]})}
        directories.append(tags)
    out += body
    link = 4
    for tags in directories:
        arrays = {}
        for k, v in tags.items():
            if len(v) > 1:
                arrays[k] = len(out)
                out += struct.pack(f"<{len(v)}I", *v)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags))
        for k, v in sorted(tags.items()):
            out += struct.pack("<HHII", k, 4, len(v), arrays.get(k, v[0]))
        link = len(out)
        out += struct.pack("<I", 0)
    return bytes(out)


@pytest.mark.parametrize(("tile", "compression"), [(None, 1), (8, 1), (8, 8), (None, 8)])
def test_tiff(spark, tmp_path, tile, compression):
    rng = np.random.default_rng(8)
    a, b = (rng.integers(0, 256, s, dtype=np.uint8) for s in ((13, 18, 3), (6, 9, 3)))
    (tmp_path / "a.tif").write_bytes(tiff([b, a], tile, compression))
    p = images.read_pixels(spark, str(tmp_path)).toPandas()
    for level, want in enumerate((a, b)):
        q = p[p["level"] == level]
        got = np.zeros(want.shape)
        got[q["y"], q["x"], q["c"]] = q["v"]
        assert (got == want).all() and len(q) == want.size
    m = images.read_metadata(spark, str(tmp_path)).orderBy("level").collect()
    assert [(r["width"], r["height"], r["channels"]) for r in m] == [(18, 13, 3), (9, 6, 3)] and m[0]["downsample"] == 1.0


def test_ppm(spark):
    rows = [(5, y, x, float(x), 255.0, 300.0 * y) for y in range(2) for x in range(3)]
    [r] = images.to_ppm(spark.createDataFrame(rows, "image_id long, y int, x int, r double, g double, b double")).collect()
    assert bytes(r["content"]) == b"P6\n3 2\n255\n" + bytes(v for y in range(2) for x in range(3) for v in (x, 255, min(255, 300 * y)))


def test_event_stream(spark, tmp_path):
    import pandas as pd

    times = pd.date_range("2026-01-01", periods=300, freq="10min")
    pd.DataFrame({"ts": times, "user_id": range(300)}).to_parquet(tmp_path / "a.parquet", coerce_timestamps="us")
    q = events.hourly_counts(events.read_events(spark, str(tmp_path)), users=2).writeStream.format("memory").queryName("hours").outputMode("append").start()
    try:
        q.processAllAvailable()
        got = spark.sql("SELECT start, x, v FROM hours").collect()
    finally:
        q.stop()
    assert got and {r["v"] for r in got} == {3.0} and len(got) == len({(r["start"], r["x"]) for r in got})


def test_estimated_transforms(spark):
    rng = np.random.default_rng(9)
    src = rng.random((30, 2)) * 50
    similar = transform.euclidean_matrix(0.4, (3.0, -2.0), 1.7)
    general = np.array([[1.2, 0.1, 3.0], [-0.2, 0.9, 1.0], [0.001, -0.002, 1.0]])
    affine = np.array([[1.2, 0.3, 3.0], [-0.2, 0.9, 1.0], [0, 0, 1.0]])

    def points(m):
        h = np.c_[src, np.ones(30)] @ m.T
        dst = h[:, :2] / h[:, 2:]
        return spark.createDataFrame(np.c_[src, dst].tolist(), "sx double, sy double, dx double, dy double")

    assert np.allclose(registration.estimate_similarity(points(similar)), similar)
    assert np.allclose(registration.estimate_affine(points(affine)), affine)
    assert np.allclose(registration.estimate_projective(points(general)), general, atol=1e-6)
    got = registration.matrix_transform(points(general), general).select("dx", "dy", "tx", "ty").toPandas().to_numpy()
    assert np.allclose(got[:, :2], got[:, 2:])
    k = registration.estimate_polynomial(points(affine), 1)
    assert np.allclose(k, [[3.0, 1.2, 0.3], [1.0, -0.2, 0.9]])
    assert np.isnan(registration.estimate_similarity(points(affine).limit(0))).all()


def plain_canny(a, sigma, low, high):
    """The definition, place by place."""
    w = np.array(stencil.gaussian_weights(sigma))
    r = len(w) // 2

    def soft(x):
        for axis in (0, 1):
            x = np.apply_along_axis(lambda line: np.convolve(line, w, "full")[r : r + len(line)], axis, x)
        return x

    s = np.pad(soft(a) / soft(np.ones_like(a)), 1, mode="symmetric")
    d = lambda x, axis: np.take(x, range(2, x.shape[axis]), axis) - np.take(x, range(x.shape[axis] - 2), axis)
    m = lambda x, axis: sum(k * np.take(x, range(i, x.shape[axis] - 2 + i), axis) for i, k in enumerate((1, 2, 1)))
    gy, gx = m(d(s, 0), 1), m(d(s, 1), 0)
    g = np.hypot(gy, gx)
    thin = np.zeros_like(g)
    for y in range(1, a.shape[0] - 1):
        for x in range(1, a.shape[1] - 1):
            dy, dx = gy[y, x], gx[y, x]
            if g[y, x] < low or not g[y, x]:
                continue
            sy, sx = (1 if dy > 0 else -1), (1 if dx > 0 else -1)
            straight = (sy, 0) if abs(dy) >= abs(dx) else (0, sx)
            k = min(abs(dy), abs(dx)) / max(abs(dy), abs(dx))
            ends = [k * g[y + f * sy, x + f * sx] + (1 - k) * g[y + f * straight[0], x + f * straight[1]] for f in (1, -1)]
            thin[y, x] = g[y, x] if max(ends) <= g[y, x] else 0
    out, todo = np.zeros(a.shape, bool), list(zip(*np.nonzero(thin >= high), strict=True))
    while todo:
        y, x = todo.pop()
        if thin[y, x] and not out[y, x]:
            out[y, x] = True
            todo += [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return out


def test_canny_as_defined(spark, image):
    a = np.zeros((16, 16))
    a[:, 8:] = 1
    noisy = a + 0.01 * np.random.default_rng(0).normal(size=a.shape)
    found = grid(edges.canny(frame(spark, noisy), 1.0, 0.1, 0.4), "mask")
    assert np.array_equal(found, plain_canny(noisy, 1.0, 0.1, 0.4))
    assert found[1:-1, 7:9].any(axis=1).all() and not found[:, :6].any() and not found[:, 10:].any()
    scaled = image / np.abs(image).max()
    assert np.array_equal(grid(edges.canny(frame(spark, scaled), 1.2, 0.2, 0.6), "mask"), plain_canny(scaled, 1.2, 0.2, 0.6))


def test_denoising_lowers_variation(spark, image):
    got = grid(edges.denoise_tv(frame(spark, image), 0.2, 10))
    variation = lambda x: np.abs(np.diff(x, axis=0)).sum() + np.abs(np.diff(x, axis=1)).sum()
    assert variation(got) < 0.7 * variation(image) and np.isclose(got.mean(), image.mean(), atol=1e-6)


def chambolle(image, weight, eps=2e-4, most=200):
    """The image, and the round at which it stopped."""
    py, px = np.zeros_like(image), np.zeros_like(image)
    for k in range(most):
        d = -py - px
        d[1:] += py[:-1]
        d[:, 1:] += px[:, :-1]
        out = image + d
        gy, gx = np.zeros_like(image), np.zeros_like(image)
        gy[:-1], gx[:, :-1] = np.diff(out, axis=0), np.diff(out, axis=1)
        norm = np.sqrt(gy * gy + gx * gx)
        e = ((d * d).sum() + weight * norm.sum()) / image.size
        if k and abs(before - e) < eps * start:
            break
        start = start if k else e
        before = e
        py, px = (py - 0.25 * gy) / (1 + 0.25 / weight * norm), (px - 0.25 * gx) / (1 + 0.25 / weight * norm)
    return out, k


def test_denoising_stops_by_its_energy(spark, image):
    """Each image by itself, at a round that is not the other's."""
    step = np.where(np.arange(9) < 4, 0.2, 0.9) + 0.05 * image
    images = [image, step, np.full((4, 3), 0.5)]
    want = [chambolle(a, 0.2, 5e-3) for a in images]
    assert len({k for _, k in want}) == 3 and want[0][1] > 5
    pixels = frame(spark, images[0]).union(frame(spark, images[1], 1)).union(frame(spark, images[2], 2))
    got = edges.denoise_tv(pixels, 0.2, eps=5e-3).cache()
    for k, (a, _) in enumerate(want):
        assert np.allclose(grid(got.where(F.col("image_id") == k)), a, atol=1e-12)
    assert np.allclose(grid(edges.denoise_tv(frame(spark, image), 0.2, 3)), chambolle(image, 0.2, most=3)[0], atol=1e-12)


def test_minima_mirror_maxima(spark):
    rng = np.random.default_rng(5)
    image = rng.integers(0, 6, (9, 7)).astype(float)
    rows = [(0, y, x, float(v)) for (y, x), v in np.ndenumerate(image)]
    pixels = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    low = {(r.y, r.x): r.v for r in morphology.local_minima(pixels, 2).collect()}
    deep = {(r.y, r.x): r.v for r in morphology.h_minima(pixels, 2.0).collect()}

    def basin(y, x, level):
        """Places reached from here without rising above ``level``."""
        seen, todo = {(y, x)}, [(y, x)]
        while todo:
            a, b = todo.pop()
            for p in ((a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if p not in seen and 0 <= p[0] < 9 and 0 <= p[1] < 7 and image[p] <= level:
                    seen.add(p)
                    todo.append(p)
        return seen

    for (y, x), v in np.ndenumerate(image):
        assert low[y, x] == float(min(image[p] for p in basin(y, x, v)) == v)
        # Nothing lower is reached by climbing less than h.
        assert deep[y, x] == float(min(image[p] for p in basin(y, x, v + 1.0)) == v)


def test_crofton_of_nothing_and_of_one_place(spark):
    rows = [(i, y, x, float(i == 1 and (y, x) == (1, 1))) for i in (0, 1) for y in range(3) for x in range(3)]
    mask = spark.createDataFrame(rows, "image_id long, y int, x int, v double")
    got = {r.image_id: r.perimeter for r in morphology.perimeter_crofton(mask).collect()}
    assert got[0] == 0
    assert got[1] == pytest.approx(np.pi / 4 * (2 + np.sqrt(2)))


def slow_segments(u, within, among):
    padded = np.pad(u, 1)
    h, w = u.shape
    return among([within([padded[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w] for dy, dx in s], axis=0) for s in levelsets.SEGMENTS], axis=0)


def test_morphological_contours(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(14, 11)) + 3 * (np.arange(14)[:, None] > 6)
    u = want = np.fromfunction(lambda y, x: (y // 5 + x // 5) % 2, a.shape)
    is_, si = (lambda x: slow_segments(x, np.max, np.min)), (lambda x: slow_segments(x, np.min, np.max))
    for k in range(3):
        c0, c1 = (a * (1 - want)).sum() / ((1 - want).sum() + 1e-8), (a * want).sum() / (want.sum() + 1e-8)
        pull = sum(map(np.abs, np.gradient(want))) * ((a - c1) ** 2 - (a - c0) ** 2)
        want = np.where(pull < 0, 1.0, np.where(pull > 0, 0.0, want))
        want = si(is_(want)) if k % 2 == 0 else is_(si(want))
    got = levelsets.morphological_chan_vese(frame(spark, a), 3, levelsets.checkerboard_level_set(frame(spark, a)))
    assert np.array_equal(grid(got), want)
    g, want = 1 / (1 + np.abs(a)), u
    iy, ix = np.gradient(g)
    for k in range(2):
        padded = np.pad(want, 1)
        small = np.min([padded[i : i + 14, j : j + 11] for i in range(3) for j in range(3)], axis=0)
        want = np.where(g > 0.3, small, want)
        uy, ux = np.gradient(want)
        pull = iy * uy + ix * ux
        want = np.where(pull > 0, 1.0, np.where(pull < 0, 0.0, want))
        want = si(is_(want)) if k % 2 == 0 else is_(si(want))
    got = levelsets.morphological_geodesic_active_contour(frame(spark, g), 2, frame(spark, u), 0.3, 1, -1.0)
    assert np.array_equal(grid(got), want)


def test_components_of_images_with_large_ids_stay_apart(spark):
    a = np.array([[1, 1, 0], [0, 0, 0], [1, 0, 1]])
    both = frame(spark, a, 0).unionByName(frame(spark, a, 1 << 24)).unionByName(frame(spark, a, 1 << 40))
    got = {r["image_id"]: r["n"] for r in regions.label(both).groupBy("image_id").agg(F.count_distinct("label").alias("n")).collect()}
    assert got == {0: 4, 1 << 24: 4, 1 << 40: 4}
