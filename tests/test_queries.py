"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from crossgrain.plans import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def clean(v):
    return None if isinstance(v, float) and math.isnan(v) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(repr([clean(r[c]) for c in names]) for r in df.collect())
    cur = duck.execute(Q.oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == names
    want = sorted(repr([clean(r[columns.index(c)]) for c in names]) for r in cur.fetchall())
    assert got == want


def test_entry_lists_all(spark):
    assert set(Q.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
