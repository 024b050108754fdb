"""Every registered query beside its SQL, on the smallest scale."""

import duckdb
import pytest
from compare import connect, difference

from tidewatch.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con() -> duckdb.DuckDBPyConnection:
    with connect(SF) as connection:
        yield connection


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    q = REGISTRY[name]
    df = q.run(spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    if q.sql is None:
        assert df.count() > 0
    else:
        assert difference(df, con, q.sql) == ""
