"""Joins by plans of their own against the plain product."""

import random

import pytest
from algebra_cases import rows

from tessera.functions.scalar import jaro_winkler
from tessera.operators import joins, windows

#: The relations that meet in buckets, on the ends of two intervals.
MEET = {
    "INTERSECTS": lambda a, b, x, y: a < y and x < b,
    "OVERLAPS": lambda a, b, x, y: a < x < b < y,
    "OVERLAPPED_BY": lambda a, b, x, y: x < a < y < b,
    "DURING": lambda a, b, x, y: x < a and b < y,
    "CONTAINS": lambda a, b, x, y: a < x and y < b,
}


def intervals(seed, n):
    """Points, short and very long ones, some inverted, some NULL."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.choice((rng.uniform(-50, 50), float(rng.randint(-5, 5)), 0.0))
        b = a + rng.choice((0.0, rng.uniform(0, 1e-3), rng.uniform(0, 3), float(rng.randint(0, 4)), rng.uniform(0, 1e6), -rng.uniform(0, 2)))
        out.append((i, None if rng.random() < 0.05 else a, None if rng.random() < 0.05 else b))
    return out


@pytest.mark.parametrize("relation", MEET)
def test_intervals_of_all_lengths(session, relation):
    left, right = intervals(1, 70), intervals(2, 60)
    session.source("L", left, "i int, a double, b double").source("R", right, "j int, x double, y double")
    wanted = sorted((i, j) for i, a, b in left for j, x, y in right if None not in (a, b, x, y) and MEET[relation](a, b, x, y))
    got = sorted((r.i, r.j) for r in session.relation(f"π i, j (L IJOIN {relation} (a, b, x, y) R)").df.collect())
    assert got == wanted and wanted


def test_one_long_interval_is_few_rows(session):
    left = [(i, float(i), i + 0.5) for i in range(300)] + [(999, -1e9, 1e9)]
    session.source("L", left, "i int, a double, b double").source("R", [(i, float(i), i + 0.25) for i in range(300)], "j int, x double, y double")
    df = session.relation("π i, j (L IJOIN INTERSECTS (a, b, x, y) R)").df
    assert df.count() == 600


def test_intervals_of_points_alone(session):
    session.source("L", [(1, 2.0, 2.0), (2, 3.0, 3.0)], "i int, a double, b double").source("R", [(1, 1.0, 2.5)], "j int, x double, y double")
    assert rows(session.relation("π i, j (L IJOIN DURING (a, b, x, y) R)")) == [(1, 1)]
    assert rows(session.relation("π i, j (L IJOIN INTERSECTS (a, b, x, y) (σ j > 1 (R)))")) == []


@pytest.mark.parametrize("relation", MEET)
def test_intervals_with_the_larger_side_on_the_right(session, monkeypatch, relation):
    monkeypatch.setattr(joins, "LITTLE", 0)
    left, right = intervals(7, 40), intervals(8, 120)
    monkeypatch.setattr(joins, "_bytes", lambda df: df.count())
    session.source("L", left, "i int, a double, b double").source("R", right, "j int, x double, y double")
    wanted = sorted((i, j) for i, a, b in left for j, x, y in right if None not in (a, b, x, y) and MEET[relation](a, b, x, y))
    assert sorted((r.i, r.j) for r in session.relation(f"π i, j (L IJOIN {relation} (a, b, x, y) R)").df.collect()) == wanted and wanted


@pytest.fixture
def sent(spark, monkeypatch):
    """The rows of both sides of each join."""
    out, kind = [], type(spark.range(1))
    plain = kind.join
    monkeypatch.setattr(kind, "join", lambda l, r, *a: out.append((l.count(), r.count())) or plain(l, r, *a))
    return out


def test_the_shorter_intervals_go_to_one_bucket(session, sent):
    """As interval_join_during: minutes in half hours."""
    session.source("L", [(i, 10 * i, 10 * i + 60) for i in range(2000)], "i int, a int, b int").source("R", [(i, 10 * i, 10 * i + 1800) for i in range(2000)], "j int, x int, y int")
    df = session.relation("π i, j (L IJOIN DURING (a, b, x, y) R)").df
    assert df.count() == sum(10 * j < 10 * i and 10 * i + 60 < 10 * j + 1800 for i in range(2000) for j in range(2000))
    assert sent[0][0] == 2000 and sent[0][1] < 2 * 2000


def test_the_larger_side_of_intervals_is_sent_once(spark, session, sent, monkeypatch):
    """As interval_join: rows of the same day, the larger table on the right."""
    monkeypatch.setattr(joins, "LITTLE", 0)
    session.table("L", spark.range(300).selectExpr("id AS i", "24 * (id % 10) AS a", "24 * (id % 10) + 1 AS b"))
    session.table("R", spark.range(2000).selectExpr("id AS j", "24 * (id % 10) AS x", "24 * (id % 10) + 1 AS y"))
    df = session.relation("π i, j (L IJOIN INTERSECTS (a, b, x, y) R)").df
    assert df.count() == 300 * 2000 // 10 and df.columns == ["i", "j"]
    assert sent[0][0] == 2000 and sent[0][1] <= 3 * 300
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def names(seed, n):
    rng = random.Random(seed)
    first, last = ["maria", "jon", "jonathan", "li", "anna", "bob", ""], ["smith", "smyth", "schmidt", "o'neil", "lee", "de la cruz"]
    out = []
    for i in range(n):
        s = f"Person#{rng.choice(first)} {rng.choice(last)} {rng.randint(0, 40):04d}" if rng.random() < 0.8 else rng.choice(("", "a", "ab", "ba", "abc", None))
        if s and rng.random() < 0.5:
            k = rng.randrange(len(s))
            s = s[:k] + rng.choice("xyz") + s[k + 1 :]
        out.append((i, s))
    return out


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def grams(s):
    p = f"  {s.lower()} "
    return {p[i : i + 3] for i in range(len(p) - 2)}


TESTS = {
    "JaroWinkler(a, b) >= 0.9": lambda a, b: jaro_winkler(a, b) >= 0.9,
    "JaroWinkler(b, a) > 0.95": lambda a, b: jaro_winkler(b, a) > 0.95,
    "JaroWinkler(a, b) >= 0.5": lambda a, b: jaro_winkler(a, b) >= 0.5,
    "EditSimilarity(a, b) >= 0.9": lambda a, b: 1 - distance(a, b) / (max(len(a), len(b)) or 1) >= 0.9 - 1e-12,
    "EditSimilarity(a, b) >= 0.5": lambda a, b: 1 - distance(a, b) / (max(len(a), len(b)) or 1) >= 0.5,
    "Levenshtein(a, b) <= 2": lambda a, b: distance(a, b) <= 2,
    "Trigram(a, b) >= 0.6": lambda a, b: len(grams(a) & grams(b)) / len(grams(a) | grams(b)) >= 0.6,
}


@pytest.mark.parametrize("test", TESTS)
def test_similar_texts(session, test):
    left, right = names(3, 60), names(4, 60)
    session.source("L", left, "i int, a string").source("R", right, "j int, b string")
    wanted = sorted((i, j) for i, a in left for j, b in right if a is not None and b is not None and TESTS[test](a, b))
    assert sorted((r.i, r.j) for r in session.relation(f"π i, j (L ⨝ {test} R)").df.collect()) == wanted and wanted


def test_few_pairs_are_scored(session, monkeypatch):
    """Pairs that reach the score itself, of 600 times 600 names."""
    rng = random.Random(5)
    syllables = ["ka", "lo", "mi", "ru", "ten", "sho", "bar", "vel", "dor", "quin"]
    people = [(i, "".join(rng.choice(syllables) for _ in range(rng.randint(2, 4))).title()) for i in range(600)]
    session.source("L", people, "i int, a string").source("R", people, "j int, b string")
    counted = session.spark.sparkContext.accumulator(0)
    plain = joins._by_tokens

    def counting(left, right, a, b, tokens, many, cond, may=None, empty=False):
        from pyspark.sql import functions as F

        one = plain(left, right, a, b, tokens, many, F.lit(True), may, empty)
        counted.add(one.count())
        return plain(left, right, a, b, tokens, many, cond, may, empty)

    monkeypatch.setattr(joins, "_by_tokens", counting)
    got = session.relation("π i, j (L ⨝ JaroWinkler(a, b) >= 0.92 R)").df.count()
    assert got == sum(jaro_winkler(a, b) >= 0.92 for _, a in people for _, b in people)
    assert counted.value < 600 * 600 / 3


@pytest.mark.parametrize("op", [">=", ">", "<=", "<"])
def test_keyless_as_of_in_ranges(session, monkeypatch, op):
    rng = random.Random(6)
    left = [(i, rng.randint(0, 60) if rng.random() < 0.9 else None) for i in range(80)]
    right = [(i, rng.randint(10, 50) if rng.random() < 0.9 else None) for i in range(25)]
    session.source("L", left, "i int, t int").source("R", right, "j int, u int")
    text = f"π i, u (L ASOF L.t {op} R.u R)"
    narrow = rows(session.relation(text))
    monkeypatch.setattr(windows, "ONE_TASK", -1)
    df = session.relation(text).df
    assert rows(df) == narrow
    assert "RangePartitioning" in df._jdf.queryExecution().toString() or "__p" in df._jdf.queryExecution().toString()
    near = {">=": lambda t: max((u for _, u in right if u is not None and u <= t), default=None), ">": lambda t: max((u for _, u in right if u is not None and u < t), default=None), "<=": lambda t: min((u for _, u in right if u is not None and u >= t), default=None), "<": lambda t: min((u for _, u in right if u is not None and u > t), default=None)}[op]
    assert narrow == sorted(((i, None if t is None else near(t)) for i, t in left), key=repr)


def test_not_in_is_no_nested_loop_over_its_rows(spark, session):
    session.source("L", [(1, "x"), (2, "y"), (None, "z")], "k int, a string")
    session.source("R", [(1, 5), (3, 5), (None, 6)], "k int, v int")
    for where, wanted in (("v = 5", [(2, "y")]), ("v = 6", []), ("v > 4", []), ("v = 9", [(1, "x"), (2, "y"), (None, "z")])):
        rel = session.relation(f"σ k NOT IN (π k (σ {where} (R))) (L)")
        assert rows(rel) == sorted(wanted, key=repr), where
    assert rows(session.relation("π a (σ L.k NOT IN (π k (σ R.k = L.k (R))) (L))")) == [("y",), ("z",)]  # reads the row at hand
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = session.relation("σ k NOT IN (π k (R)) (L)").df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and not any("NestedLoop" in line and "LeftAnti" in line for line in plan.splitlines())


def test_a_small_table_of_repeated_keys_is_joined_by_many_tasks(spark, monkeypatch):
    from tessera import queries

    run = queries.queries()["join_using"]
    wanted = rows(run(spark, "/root/testdata/sf0.001"))
    monkeypatch.setattr(joins, "LITTLE", 0)
    df = run(spark, "/root/testdata/sf0.001")
    assert rows(df) == wanted and df.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_equal_texts_meet_others_once(session, monkeypatch):
    met, plain = [], joins._by_tokens
    monkeypatch.setattr(joins, "_by_tokens", lambda x, y, *a, **k: met.append((x.df.count(), y.df.count())) or plain(x, y, *a, **k))
    session.source("A", [(i, f"name number {i % 4:04d}") for i in range(12)] + [(99, None)], "i int, s string")
    got = rows(session.relation("π a.i, b.i → j ((ρ a (A)) ⨝ EditSimilarity(a.s, b.s) >= 0.9 ∧ a.i < b.i (ρ b (A)))"))
    assert got == sorted(((i, j) for i in range(12) for j in range(i + 1, 12)), key=repr) and met == [(4, 4)]
