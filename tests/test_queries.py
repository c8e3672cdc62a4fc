import os

import pytest

from quillspark.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem documents pages".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("test tables are not here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    told = duck.execute(ORACLES[name])
    names = [c[0] for c in told.description]
    assert sorted(got.columns) == sorted(names)
    order = lambda rows: sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])
    assert order(tuple(r) for r in got.select(*names).collect()) == order(told.fetchall())
