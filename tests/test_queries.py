"""Every registered query with SQL gives the rows DuckDB gives on the small tables."""

from collections import Counter

import duckdb
import pytest
from check import TABLES, plain
from tallyglass.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("values", ["nulls", "close"])
def test_sums_and_deviations_are_compared(spark, sf_dir, values):
    df = QUERIES[f"agg_tumbling_{values}_sums"](spark, sf_dir)
    assert {"sum", "avg", "std"} <= set(df.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, con, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(v) for v in r) for r in df.select(*columns).collect())
    result = con.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert columns == sorted(names)
    expected = Counter(tuple(plain(r[i]) for i in order) for r in result.fetchall())
    assert rows == expected
