"""Every named query against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from pathloom import queries as graph

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return con


def normal(rows, in_order=False):
    def value(x):
        if isinstance(x, float):
            return float(f"{x:.9g}") if math.isfinite(x) else x
        return str([value(y) for y in x]) if isinstance(x, (list, tuple)) else x

    out = [str(tuple(value(x) for x in r)) for r in rows]
    return out if in_order else sorted(out)


@pytest.mark.parametrize("name", list(graph.queries()))
def test_query(spark, duck, name):
    df = graph.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    got = [tuple(r) for r in df.select(*[f"`{n}`" for n in names]).collect()]
    result = duck.execute(graph.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == names
    want = [tuple(r[columns.index(n)] for n in names) for r in result.fetchall()]
    in_order = name in graph.QUERIES and "ORDER BY" in graph.QUERIES[name][0]
    assert normal(got, in_order) == normal(want, in_order)


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
