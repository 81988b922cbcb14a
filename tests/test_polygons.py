"""Polygons with fewer points against splitting them one segment at a time."""

import math

import duckdb
import numpy as np

import __spark_entry__ as driver
from imgq.operators import polygons

SCHEMA = "chain_id string, i int, y double, x double"


def split(chain, tolerance):
    def off(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        if (p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1] > 0 and (b[0] - p[0]) * d[0] + (b[1] - p[1]) * d[1] > 0:
            return round(abs((p[0] - a[0]) * d[1] - (p[1] - a[1]) * d[0]) / math.hypot(*d), 9)
        return round(min(math.dist(p, a), math.dist(p, b)), 9)

    kept, todo = {0, len(chain) - 1}, [(0, len(chain) - 1)]
    while todo:
        a, b = todo.pop()
        far = max(((off(chain[m], chain[a], chain[b]), -m) for m in range(a + 1, b)), default=(0, 0))
        if far[0] > tolerance:
            kept.add(-far[1])
            todo += [(a, -far[1]), (-far[1], b)]
    return kept


def test_like_one_segment_at_a_time(spark):
    rng = np.random.default_rng(3)
    turn = np.linspace(0, 2 * math.pi, 60)
    chains = {
        "walk": np.cumsum(rng.normal(size=(150, 2)), axis=0),
        "closed": np.c_[10 * np.sin(turn), 8 * np.cos(turn)],
        "square": np.array([[0, 0], [0, 1], [0, 2], [1, 2], [2, 2], [2, 1], [2, 0], [1, 0], [0, 0]], float),  # corners tie
        "line": np.c_[np.arange(9.0), np.arange(9.0)],
        "same": np.zeros((4, 2)), "two": np.ones((2, 2)), "one": np.ones((1, 2)), None: rng.normal(size=(20, 2)),
    }
    chains["closed"][-1] = chains["closed"][0]
    rows = [(c, i, float(y), float(x)) for c, points in chains.items() for i, (y, x) in enumerate(points)]
    frame = spark.createDataFrame([*rows, ("two", None, 1.0, 1.0), ("two", 7, None, 1.0)], SCHEMA)
    for tolerance in (0.5, 1.5):
        got = polygons.approximate_polygon(frame, tolerance).collect()
        want = {(c, i) for c, points in chains.items() for i in split([tuple(p) for p in points.tolist()], tolerance)}
        assert sorted((str(r.chain_id), r.i) for r in got) == sorted((str(c), i) for c, i in want)
        places = {(c, i): (y, x) for c, i, y, x in rows}
        assert all(places[r.chain_id, r.i] == (r.y, r.x) for r in got)
    assert polygons.approximate_polygon(frame, 0).count() == len(rows)
    assert polygons.approximate_polygon(spark.createDataFrame([], SCHEMA), 1).count() == 0


def test_query_against_its_sql(spark):
    sf = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = db.sql(driver.oracle_sql()["approximate_polygon"]).fetchall()
    got = driver.queries()["approximate_polygon"](spark, sf).select("chain_id", "i", "y", "x").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert 1000 < len(got) < 20000
