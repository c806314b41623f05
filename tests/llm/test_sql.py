"""The queries that SQL can say, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from inkwright.llm import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = con.execute(SQL[name]).df()
    got = QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    plain = lambda v: None if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) else str(v)
    rows = lambda f: sorted((tuple(map(plain, r)) for r in f[list(want.columns)].astype(object).itertuples(index=False)), key=str)
    assert rows(got) == rows(want)
