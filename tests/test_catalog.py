"""Every registered query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from imgq.plans import catalog, catalog_fourier, catalog_hulls, catalog_regions, catalog_shapes  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(repr(tuple(float(v) if isinstance(v, int | float) or type(v).__name__ == "Decimal" else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_against_sql(spark, oracle, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = plain(df.select(names).collect())
    want = oracle.execute(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({catalog.SQL[name]})").fetchall()
    assert got == plain(want)


def test_entry(spark):
    import __spark_entry__ as driver

    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert driver.entry(spark).count() > 0
