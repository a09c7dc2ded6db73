"""Each registered query of the store against its SQL on a small table."""

import glob
import os

import duckdb
import pytest

from cinelake.plans import registry, steps

FOLDER = "/root/testdata/sf0.001"
assert steps  # its queries are in the registry, too
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the tables are not here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr([float(r[k]) if isinstance(r[k], (int, float)) and not isinstance(r[k], bool) else r[k] for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_is_its_sql(spark, tables, name):
    df = registry.QUERIES[name](spark, FOLDER)
    want = tables.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(df.columns, [tuple(r) for r in df.collect()]) == plain(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_gives_rows(spark, name):
    assert registry.QUERIES[name](spark, FOLDER).count() > 0
