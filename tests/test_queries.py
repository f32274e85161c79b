"""Every registered query of the core against its oracle SQL on the smallest tables, as the driver compares them."""

import glob
import math
import os

import pytest

from postmill.plans import registry

SF = os.environ.get("POSTMILL_TEST_TABLES", "/root/testdata/sf0.001")
QUERIES, SQL = registry.queries(), registry.oracle_sql()
pytestmark = pytest.mark.skipif(not glob.glob(f"{SF}/*.parquet"), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or str(value) in ("NaT", "<NA>") or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value if isinstance(value, str) else int(value) if hasattr(value, "__int__") else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_oracle(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_oracle_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
