import os

import pytest

from quillspark.llm import queries

TABLES = "documents conversations embeddings".split()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_agrees(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    found = queries.QUERIES[name](spark, sf_dir).toPandas()
    columns = sorted(found.columns)
    want = con.execute(queries.ORACLES[name]).df()
    assert sorted(want.columns) == columns
    key = lambda r: tuple(map(str, r))
    assert sorted(found[columns].itertuples(index=False, name=None), key=key) == sorted(want[columns].itertuples(index=False, name=None), key=key)
