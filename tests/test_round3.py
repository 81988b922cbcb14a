"""Sizes and values on which queries stopped, or differed from their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from imgq.functions import color
from imgq.operators import transform
from imgq.plans import catalog, catalog_fourier, catalog_hulls, catalog_shapes  # noqa: F401

from .test_catalog import plain


def against_sql(spark, folder, name, **tables):
    """The query and its SQL on ``tables``, given as SQL."""
    c = duckdb.connect()
    for t, sql in tables.items():
        c.execute(f"COPY ({sql}) TO '{folder}/{t}.parquet'")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = catalog.QUERIES[name](spark, str(folder))
    names = sorted(df.columns)
    got = df.select(names).collect()
    want = c.execute(f"SELECT {', '.join(names)} FROM ({catalog.SQL[name]})").fetchall()
    assert plain(got) == plain(want) and got
    return got


def vectors(n):
    return f"SELECT i AS vec_id, [(hash(i * 64 + j) % 1000 / 1000.0 - 0.5)::FLOAT for j in range(64)] AS embedding, (i % 10)::INT AS label FROM range({n}) t(i)"


def lines(label):
    return f"SELECT i AS l_partkey, i // 64 AS l_suppkey, ({label})::INT AS l_linenumber, (i % 50)::DOUBLE AS l_quantity, 0.01::DOUBLE AS l_tax FROM range(4096) t(i)"


@pytest.mark.parametrize("name, n", [("rand_zoom", 501), ("zoom_in", 28), ("zoom_in", 26), ("zoom_out", 26)])
def test_zoom_of_images_with_one_side_that_keeps_its_size(spark, tmp_path, name, n):
    against_sql(spark, tmp_path, name, embeddings=vectors(n))


def test_zoom_that_leaves_nothing_has_no_rows(spark):
    p = spark.createDataFrame([(k, 0, x, float(x)) for k in (1, 2) for x in range(4)], "image_id long, y int, x int, v double")
    half = F.when(F.col("image_id") == 1, 0.5).otherwise(1.0)
    assert {(r["image_id"], r["x"]) for r in transform.zoom(p, half, half).collect()} == {(2, x) for x in range(4)}


def test_ciede2000_of_opposite_and_mirrored_hues(spark):
    # In the last bit the hues differ by more than 180 degrees, or add up to less than 360.
    e = 4e-15
    rows = [(10.0, 3.0, -10.0, -3.0 - e), (10.0, 3.0, -10.0, -3.0), (10.0, 3.0, -10.0, -3.0 + e), (10.0, 3.0, 10.0, -3.0 - e), (10.0, 3.0, 10.0, -3.0), (10.0, 3.0, 10.0, -3.0 + e)]
    rows += [(-b, a, -d, c) for a, b, c, d in rows[:3]]
    f = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r["e"] for r in f.select(color.delta_e_2000((F.lit(50.0), F.col("a"), F.col("b")), (F.lit(50.0), F.col("c"), F.col("d"))).alias("e")).collect()]
    for k in range(0, 9, 3):
        assert np.ptp(got[k : k + 3]) < 1e-9


@pytest.mark.parametrize("name", ["chan_vese", "isotropic_dilation"])
@pytest.mark.parametrize("label", ["1", "i % 4"])
def test_masks_without_a_place_inside_or_outside(spark, tmp_path, name, label):
    against_sql(spark, tmp_path, name, lineitem=lines(label))
