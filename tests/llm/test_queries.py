"""Registered queries against their SQL on a small table."""

import glob
import os

import duckdb
import pytest

from cinelake.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_is_its_sql(spark, name):
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    want = c.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    df = queries.QUERIES[name](spark, FOLDER)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(want.fetchall())


def test_each_operator_has_a_query():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{k}" for k in range(1, 11)]
