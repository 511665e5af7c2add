"""Every query with a check in SQL gives the rows DuckDB gives."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    yield con
    con.close()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, bool):
        return int(value)
    return str(value) if hasattr(value, "isoformat") else value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(lines, key=repr)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got_cols, got = table(df.columns, [tuple(r) for r in df.collect()])
    cur = duck.execute(ORACLES[name])
    want_cols, want = table([d[0] for d in cur.description], cur.fetchall())
    assert got_cols == want_cols
    known, seen = set(want), set(got)
    extra = [r for r in got if r not in known][:3]
    missing = [r for r in want if r not in seen][:3]
    assert got == want, f"{len(got)} rows, expected {len(want)}; extra {extra}; missing {missing}"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
