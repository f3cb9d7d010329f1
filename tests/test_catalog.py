import duckdb
import pytest

from tessella.plans.catalog import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("customer", "supplier", "part", "lineitem", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, con, name):
    got = QUERIES[name](spark, sf)
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    rows = [tuple(r) for r in got.select(*(f"`{n}`" for n in names)).collect()]
    assert sorted(rows, key=str) == sorted(want.fetchall(), key=str)
