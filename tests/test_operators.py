"""Operators over small literal tables, expected rows derived by hand."""

import pytest
from algebra_cases import rows

from tessera.plans.lexer import AlgebraError


@pytest.fixture
def s(session):
    session.script("""
        Sales := [
        | region | product | amount |
        |--------|---------|--------|
        | N      | pen     | 10     |
        | N      | ink     | 5      |
        | S      | pen     | 7      |
        | S      |         | 3      |
        |        | pen     |        |
        ];
        L := [
        | k | a |
        |---|---|
        | 1 | x |
        | 2 | y |
        |   | z |
        ];
        R := [
        | k | b |
        |---|---|
        | 1 | p |
        | 1 | q |
        | 3 | r |
        |   | t |
        ];
        Flights := [
        | origin | dest | cost |
        |--------|------|------|
        | A      | B    | 1    |
        | B      | C    | 2    |
        | C      | A    | 4    |
        | C      | D    | 1    |
        | A      | C    | 9    |
        |        | D    | 1    |
        ];
    """)
    return session


def q(s, text, **params):
    return rows(s.relation(text, **params))


def test_null_keys_never_join(s):
    assert q(s, "L ⋈ R") == [(1, "x", "p"), (1, "x", "q")]
    assert q(s, "L ▷ L.k = R.k (R)") == sorted([(2, "y"), (None, "z")], key=repr)
    assert q(s, "L ⋉ L.k = R.k (R)") == [(1, "x")]


def test_full_join_using_coalesces(s):
    assert len(q(s, "L FJOIN USING (k) (R)")) == 6
    assert s.relation("L ⨝ L.k = R.k (R)").df.columns == ["k", "a", "k_r", "b"]


def test_qualified_names_survive_the_suffix(s):
    assert q(s, "π R.k, b (L ⨝ L.k = R.k (R))") == [(1, "p"), (1, "q")]


def test_universal_semi_join(s):
    assert q(s, "L USEMI L.k < R.k (σ R.k IS NOT NULL ∧ R.k > 1 (R))") == [(1, "x"), (2, "y")]
    assert q(s, "L USEMI L.k < R.k (R)") == []  # unknown disqualifies
    assert len(q(s, "L USEMI L.k < R.k (σ b = 'none' (R))")) == 3


def test_natural_join_needs_a_common_column(s):
    with pytest.raises(AlgebraError):
        s.relation("L ⋈ (π origin (Flights))").df


def test_sets(s):
    assert q(s, "(π k (L)) ∪ (π k (R))") == sorted([(1,), (2,), (3,), (None,)], key=repr)
    assert q(s, "(π k (L)) ∩ (π k (R))") == sorted([(1,), (None,)], key=repr)
    assert q(s, "(π k (R)) − (π k (L))") == [(3,)]
    assert q(s, "(π k (L)) ∆ (π k (R))") == [(2,), (3,)]
    assert q(s, "(π k, a (L)) ⊔ (π k, b (σ k = 3 (R)))") == sorted([(1, "x", None), (2, "y", None), (None, "z", None), (3, None, "r")], key=repr)


def test_division(s):
    s.script("D := [\n| a | b |\n|---|---|\n| 1 | x |\n| 1 | y |\n| 2 | x |\n|   | x |\n|   | y |\n]; E := [\n| b |\n|---|\n| x |\n| y |\n];")
    assert q(s, "D ÷ E") == sorted([(1,), (None,)], key=repr)
    assert q(s, "D ÷ (σ b = 'q' (E))") == sorted([(1,), (2,), (None,)], key=repr)


def test_nulls_sort_as_the_largest(s):
    assert [r.amount for r in s.relation("τ amount (Sales)").to_list()] == [3, 5, 7, 10, None]
    assert [r.amount for r in s.relation("τ amount DESC (Sales)").to_list()] == [None, 10, 7, 5, 3]


def test_group_rules(s):
    assert q(s, "γ COUNT(*) → n, SUM(amount) → t (σ amount > 99 (Sales))") == [(0, None)]
    assert q(s, "γ region, COUNT(amount) → n, AVG(amount) → m (Sales)") == sorted([("N", 2, 7.5), ("S", 2, 5.0), (None, 0, None)], key=repr)
    assert q(s, "γ COLLECT(product ORDER BY amount) → p (Sales)") == [([None, "ink", "pen", "pen", "pen"],)]
    assert q(s, "γ STRING_AGG(product, '+' ORDER BY amount DESC) → p (σ amount IS NOT NULL (Sales))") == [("pen+pen+ink",)]


def test_grouping_tells_a_null_key_from_a_total(s):
    got = q(s, "γ ROLLUP(region), GROUPING(region) → g, COUNT(*) → n (Sales)")
    assert sorted(got, key=repr) == sorted([("N", 0, 2), ("S", 0, 2), (None, 0, 1), (None, 1, 5)], key=repr)


def test_forall(s):
    assert q(s, "∀ region : amount > 4 (Sales)") == [("N",)]
    assert s.relation("∀ : amount > 0 (σ amount > 0 (Sales))").count() == 1
    assert s.relation("∀ : amount > 0 (Sales)").count() == 0


def test_top_and_ties(s):
    s.script("P := [\n| c | u |\n|---|---|\n| a | 5 |\n| a | 5 |\n| a | 3 |\n| b | 1 |\n];")
    assert q(s, "TOP 1 u DESC PER c (P)") == [("a", 5), ("b", 1)]
    assert q(s, "TOP 1 WITH TIES u DESC PER c (P)") == [("a", 5), ("a", 5), ("b", 1)]
    assert len(q(s, "LIMIT 1 WITH TIES (SORT u DESC (P))")) == 2


def test_closure_on_a_cycle(s):
    got = q(s, "CLOSURE origin, dest (Flights)")
    assert len(got) == 12 and ("A", "A") in got and all(a != "D" for a, _ in got)
    assert len(q(s, "RCLOSURE origin, dest (Flights)")) == 13
    assert q(s, "σ origin = 'B' (CLOSURE origin, dest (Flights))") == [("B", d) for d in "ABCD"]


def test_path_has_shortest_hops(s):
    got = q(s, "PATH origin, dest HOPS 2 TO 3 AS d (Flights)")
    assert ("A", "D", 2) in got and ("A", "A", 2) in got and ("A", "C", 1) not in got


def test_trace_cheapest_way(s):
    got = {(a, b): (w, p) for a, b, w, p in q(s, "TRACE origin, dest VIA cost MINIMIZE AS p (Flights)")}
    assert got["A", "C"] == (3, ["A", "B", "C"]) and got["A", "D"] == (4, ["A", "B", "C", "D"])


def test_cluster_labels_are_dense(s):
    s.script("E := [\n| a | b |\n|---|---|\n| 5 | 6 |\n| 6 | 7 |\n| 1 | 2 |\n| 9 |   |\n];")
    assert q(s, "CLUSTER a, b AS g (E)") == [(1, 1), (2, 1), (5, 2), (6, 2), (7, 2)]


def test_fix_and_iterate(s):
    assert q(s, "FIX x (π origin → n (σ origin = 'B' (Flights)), π dest → n (x ⨝ x.n = origin (Flights)))") == [("A",), ("B",), ("C",), ("D",)]
    assert q(s, "ITERATE x (π 1 → v (UNIT), π v * 2 → v (x)) ROUNDS 5") == [(32,)]
    with pytest.raises(AlgebraError):  # a cycle of two
        s.relation("ITERATE x (π 1 → v (UNIT), π 0 - v → v (x)) UNTIL STABLE MAX 9 ROUNDS").df
    with pytest.raises(AlgebraError):  # not monotone
        s.relation("FIX x (π origin → n (Flights), (π dest → n (Flights)) − x)").df


def test_asof_matrix(s):
    s.script("""
        T := [
        | sym | t |
        |-----|---|
        | a   | 5 |
        | a   | 1 |
        | b   | 9 |
        |     | 5 |
        ];
        Q := [
        | sym | u | v |
        |-----|---|---|
        | a   | 5 | 1 |
        | a   | 5 | 2 |
        | a   | 2 | 3 |
        | b   | 1 | 4 |
        ];
    """)
    base = "π t, v (T ASOF {} (Q))"
    assert q(s, base.format("T.sym = Q.sym ∧ t >= u TIES(LAST)")) == sorted([(5, 2), (1, None), (9, 4), (5, None)], key=repr)
    assert q(s, base.format("T.sym = Q.sym ∧ t >= u TIES(FIRST)")) == sorted([(5, 1), (1, None), (9, 4), (5, None)], key=repr)
    assert q(s, base.format("INNER T.sym = Q.sym ∧ t > u")) == [(5, 3), (9, 4)]
    assert q(s, base.format("INNER T.sym = Q.sym ∧ t >= u WITHIN 3 TIES(LAST)")) == [(5, 2)]
    assert q(s, base.format("INNER T.sym = Q.sym ∧ t <= u TIES(FIRST)")) == [(1, 3), (5, 1)]


ALLEN = {
    "PRECEDES": (1, 2, 3, 4), "MEETS": (1, 3, 3, 4), "OVERLAPS": (1, 3, 2, 4), "STARTS": (1, 2, 1, 4), "DURING": (2, 3, 1, 4), "FINISHES": (3, 4, 1, 4), "EQUALS": (1, 4, 1, 4),
    "PRECEDED_BY": (3, 4, 1, 2), "MET_BY": (3, 4, 1, 3), "OVERLAPPED_BY": (2, 4, 1, 3), "STARTED_BY": (1, 4, 1, 2), "CONTAINS": (1, 4, 2, 3), "FINISHED_BY": (1, 4, 3, 4),
}


def test_interval_relations(s):
    s.source("A", [(n, a, b) for n, (a, b, _, _) in ALLEN.items()], "n string, ls int, le int")
    s.source("B", [(n, a, b) for n, (_, _, a, b) in ALLEN.items()], "n string, rs int, re int")
    for name in ALLEN:
        got = q(s, f"π A.n, B.n → m (A IJOIN {name} (ls, le, rs, re) (B))")
        assert (name, name) in got
        wanted = {(x, y) for x, (a, b, _, _) in ALLEN.items() for y, (_, _, c, d) in ALLEN.items() if _allen(name, a, b, c, d)}
        assert set(got) == wanted, name


def _allen(name, a, b, c, d):
    return {
        "PRECEDES": b < c, "MEETS": b == c, "OVERLAPS": a < c < b < d, "STARTS": a == c and b < d, "DURING": a > c and b < d, "FINISHES": b == d and a > c, "EQUALS": a == c and b == d,
        "PRECEDED_BY": d < a, "MET_BY": d == a, "OVERLAPPED_BY": c < a < d < b, "STARTED_BY": a == c and d < b, "CONTAINS": c > a and d < b, "FINISHED_BY": b == d and c > a,
    }[name]


def test_windows(s):
    got = q(s, "π product, r (WINDOW RANK() SORT amount DESC PER region AS r (σ region = 'N' (Sales)))")
    assert got == [("ink", 2), ("pen", 1)]
    assert q(s, "π amount, t (ROLLING SUM(amount) OVER 2 ROWS SORT amount AS t (σ amount IS NOT NULL (Sales)))") == sorted([(3, 3), (5, 8), (7, 12), (10, 17)], key=repr)
    assert q(s, "π amount, x (WINDOW LAG(amount, 1, 0) SORT amount AS x (σ amount IS NOT NULL (Sales)))") == sorted([(3, 0), (5, 3), (7, 5), (10, 7)], key=repr)


def test_sessionize_gap_is_strict(s):
    s.script("E := [\n| u | t |\n|---|---|\n| a | 1 |\n| a | 4 |\n| a | 8 |\n| b | 9 |\n];")
    assert q(s, "SESSIONIZE t GAP 3 PER u AS s (E)") == [("a", 1, 1), ("a", 4, 1), ("a", 8, 2), ("b", 9, 1)]


def test_pivot_and_unpivot(s):
    df = s.relation("PIVOT amount BY product PER region (σ product IS NOT NULL ∧ region IS NOT NULL (Sales))").df
    assert set(df.columns) == {"region", "pen", "ink"}
    assert {r.region: (r.pen, r.ink) for r in df.collect()} == {"N": (10, 5), "S": (7, None)}
    assert q(s, "UNPIVOT (k) AS (n, v) (L)") == sorted([("x", "k", 1), ("y", "k", 2), ("z", "k", None)], key=repr)


def test_unnest_and_tree(s):
    s.script("N := [\n| id | up |\n|---|---|\n| 1 |   |\n| 2 | 1 |\n| 3 | 1 |\n| 4 | 3 |\n];")
    assert q(s, "μ x WITH ORDINALITY i (π k, [k, 9] → x (σ k = 1 (L)))") == [(1, 1, 1), (1, 9, 2)]
    got = s.relation("TREE id BY up ORDER id DESC AS kids (N)").to_list()
    assert len(got) == 1 and [c.id for c in got[0].kids] == [3, 2]
    s.script("C := [\n| id | up |\n|---|---|\n| 1 | 2 |\n| 2 | 1 |\n];")
    with pytest.raises(AlgebraError):
        s.relation("TREE id BY up AS kids (C)").df


def test_lateral(s):
    s.script("def after(x: NUMBER): relation := { σ R.k > x (R) };")
    assert q(s, "π L.k, b (L LATERAL (λ 1 (τ b (σ R.k = L.k (R)))))") == [(1, "p")]
    assert q(s, "π b (after(1))") == [("r",)]


def test_quantifiers_with_nulls(s):
    assert q(s, "π a (σ k IN (π k (R)) (L))") == [("x",)]
    assert q(s, "π a (σ k NOT IN (π k (R)) (L))") == []
    assert q(s, "π a (σ k NOT IN (π k (σ R.k IS NOT NULL (R))) (L))") == [("y",)]
    assert q(s, "π a (σ k > ALL (π k (σ R.k = 99 (R))) (L))") == [("x",), ("y",), ("z",)]


def test_null_tests(s):
    assert q(s, "π a (σ k = NULL (L))") == [("z",)]
    assert q(s, "π a (σ (k > 1) IS UNKNOWN (L))") == [("z",)]
    assert q(s, "π a (σ k IS DISTINCT FROM 1 (L))") == [("y",), ("z",)]


def test_truth_relations(s):
    assert s.relation("UNIT").count() == 1 and s.relation("EMPTY").count() == 0
    assert s.relation("L × UNIT").count() == 3 and s.relation("L × EMPTY").count() == 0


def test_searches(s):
    s.script("""
        I := [
        | g | v | w |
        |---|---|---|
        | 1 | 6 | 5 |
        | 1 | 5 | 4 |
        | 1 | 4 | 3 |
        | 2 | 1 | 99 |
        ];
        X := [
        | a | b | c |
        |---|---|---|
        | 2 | 3 |   |
        | 2 |   | 10 |
        ];
        A := [\n| p |\n|---|\n| 1 |\n| 2 |\n]; B := [\n| q |\n|---|\n| 1 |\n| 2 |\n]; C := [\n| r |\n|---|\n| 1 |\n| 2 |\n];
    """)
    assert q(s, "OPTIMIZE MAXIMIZE SUM(v) SUBJECT TO SUM(w) <= 7 PER g (I)") == [(1, 4, 3), (1, 5, 4)]
    assert q(s, "SOLVE c = a * b (X)") == [(2, 3, 6), (2, 5, 10)]
    picked = q(s, "COVER 2 (A × B × C)")
    pairs = lambda rs: {(i, j, r[i], r[j]) for r in rs for i in range(3) for j in range(i)}
    assert pairs(picked) == pairs(q(s, "A × B × C"))
    assert len(q(s, "COVER EXACT 2 (A × B × C)")) == 4


def test_samples(s):
    assert s.relation("SAMPLE 2 ROWS SEED 1 (Sales)").count() == 2
    assert s.relation("SHUFFLE SEED 1 (Sales)").count() == 5
    assert s.relation("λ 20 (ROLL BY amount SEED 1 (Sales))").count() == 20
    with pytest.raises(AlgebraError):
        s.relation("ROLL (Sales)").df


def test_provenance(s):
    got = s.relation("WHY (π region (σ amount > 4 (Sales)))").to_list()
    n = next(r for r in got if r.region == "N")
    assert sorted(len(t.variables) for t in n.provenance) == [1, 1] and {t.coefficient for t in n.provenance} == {1}
    counted = {r.region: r.provenance for r in s.relation("π region (Sales)").provenance("counting").collect()}
    assert counted == {"N": 2, "S": 2, None: 1}
    cheap = {(r.a, r.b): r.provenance for r in s.relation("π a.origin → a, b.dest → b ((ρ a (Flights)) ⨝ a.dest = b.origin (ρ b (Flights)))").provenance("tropical").collect()}
    assert cheap["A", "C"] == 3.0


def test_endless_rows_need_a_bound(s):
    s.script('source Nat from generator { name: "Naturals" }; source P from generator { name: "Primes" };')
    assert q(s, "λ 3 (Nat)") == [(0,), (1,), (2,)]
    assert q(s, "λ 5 (P)") == sorted([(2,), (3,), (5,), (7,), (11,)], key=repr)
    assert q(s, "σ n < 12 ∧ n > 4 (P)") == sorted([(5,), (7,), (11,)], key=repr)
    with pytest.raises(AlgebraError):
        s.relation("γ COUNT(*) → n (Nat)").df


@pytest.mark.parametrize("call", ["ROW_NUMBER()", "RANK()", "DENSE_RANK()", "PERCENT_RANK()", "CUME_DIST()", "NTILE(7)"])
def test_ranks_over_all_rows_in_ranges(session, monkeypatch, call):
    from tessera.operators import windows

    session.source("T", [(i, None if i % 11 == 0 else (i * 37) % 20) for i in range(200)], "i int, v int")
    text = f"π i, x (WINDOW {call} SORT v DESC, i % {1 if 'RANK' in call or 'CUME' in call else 1000} AS x (T))"
    wanted = rows(session.relation(text))
    monkeypatch.setattr(windows, "ONE_TASK", -1)
    assert rows(session.relation(text)) == wanted


@pytest.mark.parametrize("agg", ["SUM", "COUNT", "MIN", "MAX"])
def test_running_aggregates_over_all_rows_in_ranges(session, monkeypatch, agg):
    from tessera.operators import windows

    session.source("T", [(i, None if i % 3 == 0 or i < 9 else (i * 37) % 20 - 5) for i in range(100)], "i int, v int")
    text = f"π i, x (ROLLING {agg}(v) OVER ALL ROWS SORT i AS x (T))"
    wanted = rows(session.relation(text))
    monkeypatch.setattr(windows, "ONE_TASK", -1)
    assert rows(session.relation(text)) == wanted


def test_a_large_cover_goes_by_rounds(session, monkeypatch):
    from tessera.operators import search

    session.source("T", [(i % 3, i % 2, (i * 7) % 5, None if i % 4 == 0 else 1) for i in range(60)], "a int, b int, c int, d int")
    wanted = rows(session.relation("COVER 2 (T)"))
    monkeypatch.setattr(search, "ONE_TASK", 0)
    got = rows(session.relation("COVER 2 (T)"))
    pairs = lambda rs: {(i, j, r[i], r[j]) for r in rs for i in range(4) for j in range(i)}
    assert len(got) == len(wanted) and pairs(got) == pairs(wanted) == pairs(rows(session.relation("T")))


@pytest.mark.parametrize("text", ["WINDOW LAG(v, 2, 0 - 1) SORT i AS x (T)", "WINDOW LEAD(v) SORT i DESC AS x (T)", "SESSIONIZE t GAP 3 AS x (T)", "SESSIONIZE v GAP 2 AS x (T)"])
def test_shifts_and_sessions_over_all_rows_in_ranges(session, monkeypatch, text):
    from tessera.operators import windows

    session.source("T", [(i, None if i % 11 == 0 else (i * 37) % 60, i * i // 9) for i in range(120)], "i int, v int, t int")
    wanted = rows(session.relation(text))
    monkeypatch.setattr(windows, "ONE_TASK", -1)
    assert rows(session.relation(text)) == wanted
