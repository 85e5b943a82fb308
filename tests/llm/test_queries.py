"""The registered queries against their SQL at the smallest size."""

import duckdb
import pytest
from llm_cases import SF

from tessera.llm import queries


def test_there_is_one_query_for_each_operator():
    assert [k.split("_")[0] for k in queries.queries()] == [f"op{n}" for n in range(1, 11)]


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    got = con.execute(queries.oracle_sql()[name])
    cols = sorted(d[0] for d in got.description)
    assert cols == sorted(df.columns)
    at = [[d[0] for d in got.description].index(c) for c in cols]
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in got.fetchall())
