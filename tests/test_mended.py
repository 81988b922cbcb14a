"""Thresholds without an answer and distances beyond the first radius."""

import numpy as np

from imgq.operators import features, filters, histogram, metrics
from imgq.plans import catalog, catalog_hulls


def test_minimum_threshold_is_null_without_two_maxima(spark):
    bins = [("flat", b, float(b), 1) for b in range(8)] + [("two", b, float(b), n) for b, n in enumerate([1, 9, 9, 1, 0, 1, 9, 9, 1])]
    hist = spark.createDataFrame([({"flat": 1, "two": 2}[i], b, c, n) for i, b, c, n in bins], "image_id long, bin int, center double, cnt long")
    assert {r["image_id"]: r["threshold"] for r in histogram.threshold_minimum(hist).collect()} == {1: None, 2: 4.0}


def test_hausdorff_distance_beyond_the_radius(spark):
    place = "image_id long, y int, x int"
    a = spark.createDataFrame([(1, 0, 0), (1, 3, 4), (2, 1, 1), (3, 0, 0)], place)
    b = spark.createDataFrame([(1, 300, 400), (1, 0, 1), (2, 1, 1), (4, 0, 0)], place)
    want = {1: ((300 - 3) ** 2 + (400 - 4) ** 2) ** 0.5, 2: 0.0, 3: None, 4: None}
    for radius in (1, 5):
        got = {r["image_id"]: r["hausdorff"] for r in metrics.hausdorff_distance(a, b, radius).collect()}
        assert got.keys() == want.keys() and all((got[k] is None) == (v is None) and (v is None or abs(got[k] - v) < 1e-9) for k, v in want.items())


def test_blobs_that_overlap_lose_the_smaller_one(spark):
    rows = [(1, 10, 10, 2.56, 1.0), (1, 11, 10, 1.0, 9.0), (1, 10, 17, 2.56, 1.0), (1, 30, 30, 1.6, 2.0), (1, 30, 31, 1.6, 1.0), (1, 50, 50, 1.0, 1.0), (1, 50, 53, 1.6, 1.0), (2, 11, 10, 1.0, 9.0)]
    rows += [(3, 0, 0, 1.0, 1.0), (3, 0, 1, 1.6, 1.0), (3, 0, 3, 2.56, 1.0)]  # a row: each overlaps the next
    blobs = spark.createDataFrame(rows, "image_id long, y int, x int, sigma double, v double")
    kept = {(r["image_id"], r["y"], r["x"]) for r in filters.prune_blobs(blobs, 0.5, 2.56).collect()}
    # Same size: the darker stays, as in the reference. 50, 50 shares too little of its area.

    def shared(p, q):  # by counting, of p, the smaller one
        g = np.stack(np.meshgrid(np.linspace(-9, 9, 1801), np.linspace(-9, 9, 1801), indexing="ij"))
        inside = [((g - np.array([b[1] - p[1], b[2] - p[2]])[:, None, None]) ** 2).sum(0) <= 2 * b[3] ** 2 for b in (p, q)]
        return (inside[0] & inside[1]).sum() / inside[0].sum()

    gone = {p[:3] for p in rows for q in rows if p[0] == q[0] and (p[3], -p[4], p[1:3]) < (q[3], -q[4], q[1:3]) and shared(p, q) > 0.5}
    assert gone == {(1, 11, 10), (1, 30, 30), (3, 0, 0), (3, 0, 1)} and kept == {r[:3] for r in rows} - gone


def test_differences_of_gaussians_are_pruned(spark):
    a = np.random.default_rng(2).random((20, 20))
    pixels = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "image_id long, y int, x int, v double")
    every, kept = (set(map(tuple, filters.blob_dog(pixels, threshold=0.01, overlap=o).select("y", "x", "sigma").collect())) for o in (1.0, 0.3))
    assert kept < every


def test_chan_vese_runs_until_it_stands_still(spark, monkeypatch):
    rng = np.random.default_rng(2)
    v, odd = rng.random((6, 7)), rng.integers(0, 2, (6, 7))
    rows = [(0, y, x, float(v[y, x]), int(odd[y, x])) for y, x in np.ndindex(v.shape)]
    monkeypatch.setattr(catalog_hulls, "_grid", lambda s, d: s.createDataFrame(rows, "image_id long, y int, x int, v double, label long"))
    i, f, changes = (v - v.min()) / (v.max() - v.min()), odd - 0.5, [1.0]
    while changes[-1] > 1e-3:
        p = np.pad(f, 1, mode="edge")
        u, d, l, r = p[:-2, 1:-1], p[2:, 1:-1], p[1:-1, :-2], p[1:-1, 2:]
        w = [1 / np.sqrt(1e-16 + (k - f) ** 2 + ((a - b) / 2) ** 2) for k, a, b in ((r, d, u), (l, d, u), (d, r, l), (u, r, l))]
        pace, pull = 0.5 / (1 + f * f), (i - i[f <= 0].mean()) ** 2 - (i - i[f > 0].mean()) ** 2
        new = (f + pace * (0.25 * sum(k * x for k, x in zip((r, l, d, u), w, strict=True)) + pull)) / (1 + 0.25 * pace * sum(w))
        changes, f = [*changes, np.sqrt(((new - f) ** 2).mean())], new
    assert 4 < len(changes) - 1 < 500
    got = {(r["y"], r["x"]): (r["phi"], r["mask"]) for r in catalog.QUERIES["chan_vese"](spark, "").collect()}
    assert len(got) == f.size and all(abs(got[k][0] - p) < 1e-5 and got[k][1] == (p > 0) for k, p in np.ndenumerate(f))


def test_every_vector_looks_for_its_nearest(spark):
    sf = "/root/testdata/sf0.001"
    vectors = {r["vec_id"]: np.array(r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = {r["q"]: (r["id"], r["distance"]) for r in catalog.QUERIES["match_descriptors"](spark, sf).collect()}
    assert got.keys() == vectors.keys()
    for q, (found, distance) in got.items():
        d = {k: np.sqrt(((v - vectors[q]) ** 2).sum()) for k, v in vectors.items() if k != q}
        assert abs(distance - min(d.values())) < 1e-6 and abs(d[found] - distance) < 1e-6


def test_rows_that_cannot_be_measured_hide_no_others(spark):
    x = {1: [0.0, 0.0], 2: [3.0, 4.0], 3: [float("nan"), 0.0], 4: [30.0, 40.0]}
    rows = spark.createDataFrame(list(x.items()), "id long, descriptor array<double>")
    asked = rows.selectExpr("id AS q", "descriptor AS wanted")
    for p, near in ((1, 7.0), (2, 5.0)):
        got = {r["q"]: (r["id"], r["distance"]) for r in features.match_descriptors(asked, rows, p, one_table=True).collect()}
        assert got == {1: (2, near), 2: (1, near), 4: (2, 9 * near)}
    alone = features.match_descriptors(asked.where("q = 1"), rows.where("id = 2")).collect()
    assert [(r["id"], r["distance"]) for r in alone] == [(2, 5.0)]
