"""Each query against its SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark import plans

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    clean = lambda x: None if x is None or x != x else float(x) if isinstance(x, (int, float)) else str(x)
    return sorted((tuple(clean(row[k]) for k in order) for row in rows), key=repr)


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, tables, name):
    made = plans.queries()[name](spark, str(DATA))
    rows = [tuple(r) for r in made.collect()]
    assert rows
    sql = plans.oracle_sql().get(name)
    if sql:
        found = tables.sql(sql)
        assert sorted(made.columns) == sorted(found.columns)
        assert _rows(made.columns, rows) == _rows(found.columns, found.fetchall())
