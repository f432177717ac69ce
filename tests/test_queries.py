"""Every registered query runs; those with SQL equal it on the smallest tables."""

import math
import os

import duckdb
import pytest

from lambdalake import queries as core

SF = "/root/testdata/sf0.001"
QUERIES, SQL = core.queries(), core.oracle_sql()


def canon(rows):
    def one(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 5) + 0.0
        return list(map(one, v)) if isinstance(v, list) else float(v) if isinstance(v, int) and not isinstance(v, bool) else v

    return sorted((tuple(repr(one(v)) for v in r) for r in rows))


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = [tuple(r[c] for c in columns) for r in got.collect()]
    if name not in SQL:
        assert rows
        return
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert canon(rows) == canon([tuple(r[i] for i in order) for r in want.fetchall()])
