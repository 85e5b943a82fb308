"""Every registered query with SQL against DuckDB, at the smallest size."""

import datetime
import decimal

import duckdb
import pytest

from tessera import queries as core

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in core.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return repr(round(float(v), 6))
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", core.oracle_sql())
def test_query(spark, con, name):
    df = core.queries()[name](spark, SF)
    got = con.execute(core.oracle_sql()[name])
    cols = [d[0] for d in got.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in sorted(cols)]
    wanted = sorted(tuple(norm(r[i]) for i in at) for r in got.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(cols)) for r in df.collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    assert core.queries()[name](spark, SF).count() > 0


def test_whole_graphs_reach_every_user(spark, con):
    users = {u for (u,) in con.execute("SELECT DISTINCT user_id FROM events").fetchall()}
    nexts = con.execute("SELECT user_id, lead(user_id) OVER (ORDER BY ts) FROM events ORDER BY ts").fetchall()
    step = {}
    for a, b in nexts:
        if b is not None and a != b:
            step.setdefault(a, b)
    wanted = set()
    for a in step:  # one edge leaves each user, so there is one walk
        at, w, seen = a, 0, set()
        while at in step and at not in seen:
            seen.add(at)
            w += 1 + at % 5
            at = step[at]
            if at not in seen:
                wanted.add((a, at, w))
    got = {(r.a, r.b, r.w) for r in core.queries()["trace"](spark, SF).collect()}
    assert {g for g in got if g[0] != g[1]} == wanted
    assert {r.a for r in core.queries()["closure"](spark, SF).collect()} == users
