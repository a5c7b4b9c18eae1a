"""The corpus queries that SQL can express, against that SQL."""

import os

import duckdb
import pytest

from gleaner.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, expected = queries.QUERIES[name](spark, DATA).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    plain = lambda df: sorted(tuple(None if str(x) in ("nan", "<NA>", "None") else str(x).removesuffix(".0") for x in r) for r in df[sorted(df.columns)].itertuples(index=False))
    assert plain(got) == plain(expected)
