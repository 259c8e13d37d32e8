"""Every query of the engine against its DuckDB twin at sf0.001, as the driver compares them."""

import duckdb
import pytest

from tickloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(map(str, frame[columns].astype(object).where(frame[columns].notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = rows(catalog.queries()[name](spark, SF).toPandas())
    want = rows(duck.sql(catalog.oracle_sql()[name]).df())
    assert got == want


def test_every_query_has_an_oracle():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_workers_find_the_package_anywhere(spark):
    from tickloom.plans.shipping import _SHIPPED, ship

    ship(spark)
    ship(spark)
    assert spark.sparkContext.applicationId in _SHIPPED
    assert any(f.endswith("tickloom.zip") for f in spark.sparkContext.listFiles)
