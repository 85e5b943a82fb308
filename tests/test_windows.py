"""Windows without PER in ranges and stretches against one task."""

import random

import pytest
from algebra_cases import rows

from tessera.operators import windows

FRAMES = {
    "sum": "ROLLING SUM(v) OVER 3 ROWS SORT t, i AS x (R)",
    "around": "ROLLING COUNT(v) OVER ROWS BETWEEN 2 PRECEDING AND 4 FOLLOWING SORT t, i AS x (R)",
    "after": "ROLLING MAX(v) OVER ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING SORT t DESC, i AS x (R)",
    "before": "ROLLING MIN(v) OVER ROWS BETWEEN 5 PRECEDING AND 2 PRECEDING SORT t, i AS x (R)",
    "mean": "ROLLING AVG(i) OVER 4 ROWS SORT t, i AS x (R)",
    "first": "WINDOW FIRST_VALUE(v) SORT t, i AS x (R)",
    "last": "WINDOW LAST_VALUE(i) SORT t, i AS x (R)",
    "peers": "WINDOW LAST_VALUE(t) SORT t AS x (R)",
}


@pytest.mark.parametrize("name", FRAMES)
def test_wide_frames(session, monkeypatch, name):
    rng = random.Random(3)
    session.source("R", [(i, rng.randint(0, 20), None if rng.random() < 0.2 else rng.randint(0, 99)) for i in range(60)], "i int, t int, v int")
    narrow = rows(session.relation(FRAMES[name]))
    monkeypatch.setattr(windows, "ONE_TASK", -1)
    monkeypatch.setattr(windows, "STRETCH", 7)
    df = session.relation(FRAMES[name]).df
    assert rows(df) == narrow
    assert "Exchange SinglePartition" not in df._jdf.queryExecution().executedPlan().toString() or name == "first"


def test_a_window_over_millions_of_rows_is_no_single_task(spark):
    from tessera.plans.scope import Scope

    assert windows.is_wide(Scope(spark.range(6_000_000), ()))  # 48 MB; in one task it held several times as much
    assert not windows.is_wide(Scope(spark.range(60_000), ()))
