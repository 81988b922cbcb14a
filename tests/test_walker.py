"""Random walks against a dense solve."""

import numpy as np
import pytest

import __spark_entry__ as driver
from imgq import raster
from imgq.operators import walker
from imgq.storage import materialize


def solved(values, labels, beta, spacing=(1.0, 1.0)):
    """{(y, x): {label: p}} of the open places by one dense system; values: h x w x channels."""
    h, w, c = values.shape
    sd = np.nanstd(values)
    rate = beta / (10 * sd) / np.sqrt(c) if sd else 0.0
    on = (labels >= 0) & ~np.isnan(values).any(axis=2)
    lap = np.zeros((h * w, h * w))
    for y in range(h):
        for x in range(w):
            for v, u, far in ((y + 1, x, spacing[0]), (y, x + 1, spacing[1])):
                if v < h and u < w and on[y, x] and on[v, u]:
                    weight = np.exp(-rate * (((values[y, x] - values[v, u]) / far) ** 2).sum()) + 1e-10
                    a, b = y * w + x, v * w + u
                    lap[a, b] = lap[b, a] = -weight
                    lap[a, a] += weight
                    lap[b, b] += weight
    flat, seen = labels.ravel(), set(np.flatnonzero((labels.ravel() > 0) & on.ravel()))
    grown = list(seen)
    while grown:
        a = grown.pop()
        for b in np.flatnonzero(lap[a] < 0):
            if b not in seen:
                seen.add(b)
                grown.append(b)
    free = [a for a in sorted(seen) if flat[a] == 0]
    seeds = [a for a in seen if flat[a] > 0]
    kinds = sorted({int(flat[a]) for a in seeds})
    right = -lap[np.ix_(free, seeds)] @ np.array([[float(flat[a] == k) for k in kinds] for a in seeds]) if free else np.zeros((0, len(kinds)))
    p = np.linalg.solve(lap[np.ix_(free, free)], right)
    return {(a // w, a % w): dict(zip(kinds, row, strict=True)) for a, row in zip(free, p, strict=True)}


def frames(spark, images):
    px = [(i, y, x, *[None if np.isnan(c) else float(c) for c in v[y, x]]) for i, (v, _) in images.items() for y in range(v.shape[0]) for x in range(v.shape[1])]
    lb = [(i, y, x, int(m[y, x])) for i, (_, m) in images.items() for y in range(m.shape[0]) for x in range(m.shape[1]) if m[y, x]]
    names = ["v", "w"][: next(iter(images.values()))[0].shape[2]]
    return spark.createDataFrame(px, "image_id long, y int, x int, " + ", ".join(f"{n} double" for n in names)), spark.createDataFrame(lb, "image_id long, y int, x int, label int"), tuple(names)


def check(spark, images, beta, spacing=(1.0, 1.0)):
    pixels, labels, channels = frames(spark, images)
    chances = materialize(walker.random_walker_probabilities(pixels, labels, beta, 1e-7, spacing, channels), "chances")
    got = {}
    for i, y, x, k, p in chances.collect():
        got.setdefault(i, {}).setdefault((y, x), {})[k] = p
    named = {(i, y, x): k for i, y, x, k in walker.likeliest(pixels, labels, chances).collect()}
    assert len(named) == sum(v.shape[0] * v.shape[1] for v, _ in images.values())
    for i, (values, seeds) in images.items():
        want = solved(values, seeds, beta, spacing)
        assert got.get(i, {}).keys() == want.keys()
        for place, chances in want.items():
            assert got[i][place] == pytest.approx(chances, abs=1e-4)
            assert sum(got[i][place].values()) == pytest.approx(1, abs=1e-4)
        for y, x in np.ndindex(seeds.shape):
            own = int(seeds[y, x])
            if own:
                assert named[i, y, x] == own
            elif (y, x) not in want:
                assert named[i, y, x] == -1
            else:
                assert want[y, x][named[i, y, x]] >= max(want[y, x].values()) - 2e-4


def test_like_a_dense_solve(spark):
    rng = np.random.default_rng(5)
    step = np.zeros((6, 7, 1))
    step[:, 4:] = 1
    noisy = step + 0.2 * rng.random(step.shape)
    seeds = np.zeros((6, 7), int)
    seeds[2, 1], seeds[1, 6], seeds[5, 5] = 3, 7, 40  # labels with gaps between them
    walls = seeds.copy()
    walls[:, 3] = -2  # a wall of places out of the graph, and a corner that no seed reaches
    walls[0, 1] = walls[1, 0] = -1
    hole = noisy.copy()
    hole[3, 3] = np.nan
    all_seeds = np.ones((2, 2), int)
    none = np.zeros((3, 3), int)
    check(spark, {1: (noisy, seeds), 2: (noisy, walls), 3: (hole, seeds), 4: (np.ones((3, 4, 1)), seeds[1:4, :4]), 5: (np.ones((2, 2, 1)), all_seeds), 6: (np.ones((3, 3, 1)), none)}, 30.0)


def test_channels_and_spacing(spark):
    values = np.random.default_rng(6).random((5, 6, 2))
    seeds = np.zeros((5, 6), int)
    seeds[0, 0], seeds[4, 5] = 1, 2
    check(spark, {9: (values, seeds)}, 50.0, (2.0, 0.5))


def test_no_rows_and_bad_tolerance(spark):
    pixels = spark.createDataFrame([], "image_id long, y int, x int, v double")
    labels = spark.createDataFrame([], "image_id long, y int, x int, label int")
    assert walker.random_walker(pixels, labels).count() == 0
    with pytest.raises(ValueError, match="tol"):
        walker.random_walker(pixels, labels, tol=0)


def test_query_against_a_plain_solver(spark):
    sf = "/root/testdata/sf0.001"
    image = raster.embedding_image(spark, sf).toPandas().pivot(index="y", columns="x", values="v").to_numpy()
    seeds = np.where(image > 0.16, 1, np.where(image < -0.16, 2, 0))
    rate = 130.0 / (10 * image.std())
    pad = np.pad(image, 1, constant_values=np.nan)
    near = [pad[:-2, 1:-1], pad[2:, 1:-1], pad[1:-1, :-2], pad[1:-1, 2:]]
    weights = [np.nan_to_num(np.exp(-rate * (image - n) ** 2) + 1e-10) for n in near]
    p = np.where(seeds == 1, 1.0, np.where(seeds == 2, 0.0, 0.5))
    for _ in range(4000):  # Jacobi rounds
        q = np.pad(p, 1)
        new = sum(w * n for w, n in zip(weights, [q[:-2, 1:-1], q[2:, 1:-1], q[1:-1, :-2], q[1:-1, 2:]], strict=True)) / sum(weights)
        p, old = np.where(seeds == 0, new, p), p
        if np.abs(p - old).max() < 1e-9:
            break
    rows = driver.queries()["random_walker"](spark, sf).collect()
    assert len(rows) == image.size
    clear = 0
    for r in rows:
        if seeds[r.y, r.x]:
            assert r.label == seeds[r.y, r.x]
        elif abs(p[r.y, r.x] - 0.5) > 0.01:
            clear += 1
            assert r.label == (1 if p[r.y, r.x] > 0.5 else 2)
    assert clear > 0.8 * (seeds == 0).sum()


def test_rounds_are_about_the_borders_of_tiles_only(spark, monkeypatch):
    """Many tiles against a dense solve; rounds keep one small table, whatever lies inside of the tiles."""
    shape = (9, 10)
    monkeypatch.setattr(walker, "SIDE", 4)
    sizes, dropped, write, drop = [], [], walker.materialize, walker.drop

    def written(df, name):
        out = write(df, name)
        sizes.append((name, out.count()))
        return out

    monkeypatch.setattr(walker, "materialize", written)
    monkeypatch.setattr(walker, "drop", lambda table: dropped.append(table) or drop(table))
    rng = np.random.default_rng(8)
    seeds = np.zeros(shape, int)
    seeds[0, 1], seeds[-1, -1], seeds[shape[0] // 2, shape[1] // 2] = 5, 2, 9
    gaps = seeds.copy()
    gaps[1, :2] = -1
    gaps[:, shape[1] - 2] = np.where(np.arange(shape[0]) % 4 == 3, -1, gaps[:, shape[1] - 2])
    check(spark, {1: (rng.random((*shape, 1)), seeds), 2: (rng.random((*shape, 1)), gaps), 3: (rng.random((2, 2, 1)), seeds[:2, :2])}, 20.0)
    y, x = np.indices(shape)
    border = ((y % 4 == 3) | (x % 4 == 3)).sum()
    rounds = [n for name, n in sizes if name == "walk"]
    assert rounds and max(rounds) <= 2 * 3 * border and len(dropped) >= 2 * len(rounds) - 3
