"""Choices of rows against enumeration and dynamic programming."""

import numpy as np
import pytest

from tessera.operators import search
from tessera.plans.lexer import AlgebraError


def enumerated(gain, a, b, kinds):
    best = None
    holds = {"<=": lambda v, q: v <= q + 1e-9, ">=": lambda v, q: v >= q - 1e-9, "=": lambda v, q: abs(v - q) < 1e-9}
    for mask in range(1 << len(gain)):
        x = np.array([mask >> i & 1 for i in range(len(gain))])
        if all(holds[k](row @ x, q) for row, q, k in zip(a, b, kinds)):
            key = -round(float(gain @ x), 9), int(x.sum()), tuple(np.flatnonzero(x))
            best = min(best or key, key)
    return best and best[2]


def test_choices_of_few_rows():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, m = rng.integers(0, 9), rng.integers(0, 3)
        gain, a, b = rng.integers(-3, 6, n) * rng.choice([1, 0.5]), rng.integers(-2, 6, (m, n)).astype(float), rng.integers(-2, 12, m).astype(float)
        kinds = [str(k) for k in rng.choice(["<=", ">=", "="], m, p=[0.6, 0.3, 0.1])]
        x = search.choose(gain, a, b, kinds)
        assert (None if x is None else tuple(np.flatnonzero(x))) == enumerated(gain, a, b, kinds)


@pytest.mark.parametrize("n", [23, 24, 25, 26, 40, 80])
def test_ties_of_many_rows(n):
    """The best sum, then the fewest rows, then the earliest, by weights."""
    rng = np.random.default_rng(n)
    for _ in range(3):
        v, w = rng.integers(1, 6, n).tolist(), rng.integers(1, 7, n).tolist()
        cap = sum(w) // 3
        best = {0: (0, 0, ())}
        for i in range(n):
            new = dict(best)
            for c, (sum_, count, at) in best.items():
                if c + w[i] <= cap:
                    one = (sum_ - v[i], count + 1, (*at, i))
                    new[c + w[i]] = min(one, new.get(c + w[i], one))
            best = new
        x = search.choose(np.array(v, float), np.array([w], float), np.array([float(cap)]), ["<="])
        assert tuple(np.flatnonzero(x)) == min(best.values())[2]


def test_too_many_steps_are_an_error(monkeypatch):
    monkeypatch.setattr(search, "PIVOTS", 2)
    with pytest.raises(AlgebraError, match="undecided"):
        search.choose(np.arange(1.0, 20), np.arange(1.0, 20)[None], np.array([30.0]), ["<="])
    monkeypatch.undo()
    with pytest.raises(AlgebraError, match="undecided"):
        search.choose(np.arange(1.0, 20), np.arange(1.5, 20)[None], np.array([30.0]), ["<="], nodes=1)


def test_bounds_of_weights():
    got = search.simplex(np.array([-1.0, -2.0]), np.array([[1.0, 1.0]]), np.array([10.0]), ["<="], np.array([0.0, 1.0]), np.array([np.inf, 4.0]))
    assert got[0] == -14 and got[1].tolist() == [6, 4]
    assert search.simplex(np.array([-1.0]), np.zeros((0, 1)), np.zeros(0), [], np.zeros(1), np.array([np.inf])) is None
    assert search.simplex(np.array([1.0]), np.array([[1.0]]), np.array([5.0]), [">="], np.zeros(1), np.ones(1)) is None


def test_an_exact_cover_counts_before_it_gathers(session, monkeypatch):
    session.source("R", [(i % 4, i % 3) for i in range(12)], "a int, b int")
    assert session.relation("COVER EXACT 2 (R)").count() == 12
    monkeypatch.setattr(search, "DEMANDS", 11)
    with pytest.raises(AlgebraError, match="at most 11"):
        session.relation("COVER EXACT 2 (R)").df
