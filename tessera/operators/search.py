"""Searches: filling blanks by equations, choosing rows under constraints,
covering combinations.

An equation that can be turned around for its one blank is a plain column
expression.  Systems and fits run in numpy, row by row in Arrow batches or
group by group; a choice is made per group, each in one task.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.components import cut
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Column, Scope, c, fresh


# Equations ----------------------------------------------------------------------
def _refs(e) -> list[str]:
    return [x.parts[-1] for x in ir.walk(e) if isinstance(x, ir.Ref)]


def invert(left: ir.Expr, right: ir.Expr, name: str) -> ir.Expr | None:
    """``name`` by itself, if it stands once and only in sums and products."""
    if _refs(left).count(name) + _refs(right).count(name) != 1:
        return None
    if name in _refs(right):
        left, right = right, left
    while not isinstance(left, ir.Ref):
        if isinstance(left, ir.Neg):
            left, right = left.operand, ir.Neg(right)
        elif isinstance(left, ir.Bin):
            here = name in _refs(left.left)
            a, b = left.left, left.right
            if left.op == "+":
                left, right = (a, ir.Bin("-", right, b)) if here else (b, ir.Bin("-", right, a))
            elif left.op == "-":
                left, right = (a, ir.Bin("+", right, b)) if here else (b, ir.Bin("-", a, right))
            elif left.op == "*":
                left, right = (a, ir.Bin("/", right, b)) if here else (b, ir.Bin("/", right, a))
            else:
                left, right = (a, ir.Bin("*", right, b)) if here else (b, ir.Bin("/", a, right))
        else:
            return None
    return right


_MATH = {"SIN": np.sin, "COS": np.cos, "TAN": np.tan, "EXP": np.exp, "SQR": np.sqrt, "SQRT": np.sqrt, "ABS": np.abs, "LOG": np.log, "LN": np.log, "POWER": np.power, "ATN": np.arctan, "LOG10": np.log10}


def compiled(e: ir.Expr):
    """A function from a dict of numbers (or arrays) to the value."""
    if isinstance(e, ir.Lit) and e.kind == "number":
        v = float(e.value)
        return lambda _: v
    if isinstance(e, ir.Ref):
        n = e.parts[-1]
        return lambda row: row[n]
    if isinstance(e, ir.Neg):
        f = compiled(e.operand)
        return lambda row: -f(row)
    if isinstance(e, ir.Bin):
        f, g = compiled(e.left), compiled(e.right)
        op = {"+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide}[e.op]
        return lambda row: op(f(row), g(row))
    if isinstance(e, ir.Call) and e.name in _MATH:
        fs, op = [compiled(a) for a in e.args], _MATH[e.name]
        return lambda row: op(*[f(row) for f in fs])
    raise AlgebraError("SOLVE takes arithmetic")


def fit(residual, start: np.ndarray, within: float, rounds: int) -> np.ndarray | None:
    """Levenberg-Marquardt; None if the residuals do not settle."""
    x, damp = start.astype(float), 1e-3
    with np.errstate(all="ignore"):
        r = residual(x)
        for _ in range(rounds):
            if not np.isfinite(r).all():
                return None
            h = 1e-6 * np.maximum(np.abs(x), 1)
            jac = np.stack([(residual(x + np.where(np.arange(len(x)) == i, h, 0)) - residual(x - np.where(np.arange(len(x)) == i, h, 0))) / (2 * h[i]) for i in range(len(x))], axis=1)
            a, g = jac.T @ jac, jac.T @ r
            moved = False
            for _ in range(12):
                try:
                    step = np.linalg.solve(a + damp * np.diag(np.maximum(np.diag(a), 1e-12)), -g)
                except np.linalg.LinAlgError:
                    return None
                new = residual(x + step)
                if np.isfinite(new).all() and (new @ new) <= (r @ r):
                    moved = (np.abs(step) > 1e-13 * np.maximum(np.abs(x), 1)).any()
                    x, r, damp = x + step, new, max(damp / 10, 1e-15)
                    break
                damp *= 10
            if not moved:
                break
    return x


@handles(ir.Solve)
def _solve(lo: Lowering, n: ir.Solve, outer) -> Scope:
    """Blanks that the equations determine.  Without PER each row is solved
    by itself; with PER columns blank throughout a group are its unknowns,
    fitted by least squares over its rows."""
    s = lo.finite(n.input, outer)
    names = list(dict.fromkeys(x for l, r in n.equations for x in _refs(l) + _refs(r)))
    cols = {x: s.column(x) for x in names}
    if not n.per and len(n.equations) == 1:
        left, right = n.equations[0]
        turned = {x: invert(left, right, x) for x in names}
        if all(v is not None for v in turned.values()):
            fills = {}
            for x, e in turned.items():
                known = F.lit(True)
                for y in _refs(e):
                    known = known & c(cols[y]).isNotNull()
                value = lo.value(e, s, outer)
                t = s.type(cols[x])
                fills[cols[x].id] = F.coalesce(c(cols[x]), F.when(known, value.cast(t) if not isinstance(t, T.NullType) else value))
            return s.with_df(s.df.select(*[fills.get(x.id, c(x)).alias(x.id) for x in s.cols]))
    ids = {x: k.id for x, k in cols.items()}
    sides = [(compiled(l), compiled(r)) for l, r in n.equations]
    start = {x: float(e.value) for x, e in n.start if isinstance(e, ir.Lit)}
    start |= {x: -float(e.operand.value) for x, e in n.start if isinstance(e, ir.Neg)}
    within, rounds = n.within, n.rounds
    solved = [k.id for k in cols.values()]
    work = s.df.select(*[c(x).cast("double").alias(x.id) if x.id in solved else c(x) for x in s.cols])
    schema = work.schema

    def one(row: dict) -> dict:
        blank = [x for x in names if row[x] is None or row[x] != row[x]]
        if not blank:
            return {}
        used = [(f, g) for (f, g), (l, r) in zip(sides, n.equations) if set(_refs(l) + _refs(r)) & set(blank)]
        if len(used) < len(blank):
            return {}

        def residual(v):
            at = {**row, **dict(zip(blank, v))}
            return np.array([f(at) - g(at) for f, g in used], float)

        got = fit(residual, np.array([start.get(x, 1.0) for x in blank]), within, rounds)
        if got is None or np.abs(residual(got)).max() > max(within, 1e-6):
            return {}
        return {x: round(float(v), 10) for x, v in zip(blank, got)}

    def rows(batches):
        for pdf in batches:
            values = {x: pdf[i].to_numpy(float, na_value=np.nan).copy() for x, i in ids.items()}
            for k in np.flatnonzero(np.isnan(np.stack(list(values.values()))).any(axis=0)):
                for x, v in one({x: None if np.isnan(a[k]) else float(a[k]) for x, a in values.items()}).items():
                    values[x][k] = v
            for x, i in ids.items():
                pdf[i] = values[x]
            yield pdf

    def group(pdf):
        values = {x: pdf[i].to_numpy(float, na_value=np.nan).copy() for x, i in ids.items()}
        blank = [x for x, a in values.items() if np.isnan(a).all()]
        if blank:
            good = ~np.isnan(np.stack([a for x, a in values.items() if x not in blank] or [np.zeros(len(pdf))])).any(axis=0)

            def residual(v):
                at = {x: a[good] for x, a in values.items()} | {x: np.full(good.sum(), q) for x, q in zip(blank, v)}
                return np.concatenate([np.broadcast_to(f(at) - g(at), good.sum()) for f, g in sides])

            if good.sum():
                got = fit(residual, np.array([start.get(x, 1.0) for x in blank]), within, rounds)
                if got is not None:
                    for x, v in zip(blank, got):
                        pdf[ids[x]] = round(float(v), 10)
        return pdf

    df = work.groupBy(*[k.id for k in s.columns(n.per)]).applyInPandas(group, schema) if n.per else work.mapInPandas(rows, schema)
    return s.with_df(df)


# Choices --------------------------------------------------------------------------
#: Pivots of one linear program, and programs of one choice, at most: beyond
#: them there is an error, never a wrong or a missing answer.
PIVOTS, NODES = 50_000, 200_000


def simplex(cost: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: list[str], lo: np.ndarray, hi: np.ndarray) -> tuple[float, np.ndarray] | None:
    """Minimises cost x under rows of ``a`` and bounds; None if infeasible or
    without a bound.  The bounds are no rows: a variable stands at either of
    its ends (``turned``: it is counted down from the upper one)."""
    n, m = len(cost), len(kinds)
    if (hi < lo).any():
        return None
    size = n + 2 * m  # variables, slacks, artificial ones
    table, upper = np.zeros((m, size + 1)), np.full(size, np.inf)
    upper[:n] = hi - lo
    basis, art = np.zeros(m, int), []
    for i, k in enumerate(kinds):
        r, q = np.array(a[i], float), float(b[i] - a[i] @ lo)
        if q < 0:
            r, q, k = -r, -q, {"<=": ">=", ">=": "<=", "=": "="}[k]
        table[i, :n], table[i, -1] = r, q
        if k != "=":
            table[i, n + i] = 1 if k == "<=" else -1
        basis[i] = n + i if k == "<=" else n + m + i
        if k != "<=":
            table[i, n + m + i] = 1
            art.append(n + m + i)
    turned = np.zeros(size, bool)

    def run(obj: np.ndarray, allowed: int) -> bool:
        z = np.append(np.where(turned, -obj, obj), 0.0)
        for i, v in enumerate(basis):
            if z[v]:
                z -= z[v] * table[i]
        for step in range(PIVOTS):
            free = np.flatnonzero((z[:allowed] < -1e-9) & (upper[:allowed] > 0))
            if not len(free):
                return True
            j = int(free[0] if step > 2000 else free[z[free].argmin()])  # the first in order cannot go in circles
            col = table[:, j]
            with np.errstate(divide="ignore", invalid="ignore"):
                down = np.where(col > 1e-9, table[:, -1] / col, np.inf)
                up = np.where(col < -1e-9, (upper[basis] - table[:, -1]) / -col, np.inf)
            room = np.minimum(down, up)
            least = room.min() if m else np.inf
            if upper[j] <= least:
                if not np.isfinite(upper[j]):
                    return False
                table[:, -1] -= col * upper[j]
                table[:, j] = -col
                z[-1] -= z[j] * upper[j]
                z[j] = -z[j]
                turned[j] ^= True
                continue
            rows = np.flatnonzero(room <= least + 1e-12)
            i = int(rows[basis[rows].argmin()])
            if up[i] < down[i]:  # leaves at its upper end
                v = basis[i]
                table[i] = -table[i]
                table[i, v], table[i, -1] = 1, upper[v] + table[i, -1]
                turned[v] ^= True
            table[i] /= table[i, j]
            others = table[:, j].copy()
            others[i] = 0
            table[:] -= np.outer(others, table[i])
            z -= z[j] * table[i]
            basis[i] = j
        raise AlgebraError("OPTIMIZE is undecided: too many steps")

    def values() -> np.ndarray:
        x = np.zeros(size)
        x[basis] = table[:, -1]
        x[turned] = upper[turned] - x[turned]
        return x

    if art:
        first = np.zeros(size)
        first[art] = 1
        if not run(first, n + m) or values()[art].sum() > 1e-7:
            return None
        upper[art] = 0
    last = np.zeros(size)
    last[:n] = cost
    if not run(last, n + m):
        return None
    x = values()[:n] + lo
    return float(cost @ x), x


def choose(gain: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: list[str], nodes: int = NODES) -> np.ndarray | None:
    """The rows with the largest sum of gains; of equal ones the fewest, then
    the earliest, at any number of rows.  Branch and bound on the linear
    relaxation: for the sum, for the count under that sum, and for each row in
    order whether it can be taken under both."""
    n = len(gain)
    left = [nodes]

    def best(gain: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: list[str], lo: np.ndarray, hi: np.ndarray, any_: bool = False) -> np.ndarray | None:
        found, value, open_ = None, -np.inf, [(lo, hi)]
        while open_:
            lo, hi = open_.pop()
            left[0] -= 1
            if left[0] < 0:
                raise AlgebraError("OPTIMIZE is undecided: too many choices")
            got = simplex(-gain, a, b, kinds, lo, hi)
            if got is None or -got[0] <= value + 1e-9 * max(1.0, abs(value)) and found is not None:
                continue
            x = got[1]
            part = np.flatnonzero(np.abs(x - np.rint(x)) > 1e-7)
            if not len(part):
                found = np.rint(x).astype(int)
                value = float(gain @ found)
                if any_:
                    return found
                continue
            i = int(part[np.argmax(np.abs(x[part] - 0.5) * -1 + 1e-9 * np.abs(gain[part]))])
            for v in (0, 1):  # the last is tried first
                l, h = lo.copy(), hi.copy()
                l[i] = h[i] = v
                open_.append((l, h))
        return found

    lo, hi = np.zeros(n), np.ones(n)
    x = best(gain, a, b, kinds, lo, hi)
    if x is None:
        return None
    sum_ = float(gain @ x)
    a, b, kinds = np.vstack([a.reshape(len(kinds), n), gain]), np.append(b, sum_ - 1e-9 * max(1.0, abs(sum_))), [*kinds, ">="]
    fewest = best(-np.ones(n), a, b, kinds, lo, hi)
    x = x if fewest is None else fewest
    a, b, kinds = np.vstack([a, np.ones(n)]), np.append(b, x.sum()), [*kinds, "<="]
    for i in range(n):
        if lo.sum() == x.sum():
            break
        if not x[i]:
            lo[i] = 1
            other = best(np.zeros(n), a, b, kinds, lo, hi, any_=True)
            lo[i] = 0
            if other is None:
                hi[i] = 0
                continue
            x = other
        lo[i] = 1
    return x


class Solver:
    """What OPTIMIZE asks for each group.  A session's ``solver`` may be any
    object with these two methods that Python workers can unpickle."""

    def choose(self, gain: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: list[str]) -> np.ndarray | None:
        """0 or 1 for each row: the best sum of gains under rows of ``a``
        (``a x`` is ``kinds`` than ``b``), or None."""
        return choose(gain, a, b, kinds)

    def weights(self, cost: np.ndarray, a: np.ndarray, b: np.ndarray, kinds: list[str], lo: np.ndarray, hi: np.ndarray) -> np.ndarray | None:
        """The weights within bounds that cost least, or None."""
        got = simplex(cost, a, b, kinds, lo, hi)
        return None if got is None else got[1]


@handles(ir.Optimize)
def _optimize(lo: Lowering, n: ir.Optimize, outer) -> Scope:
    """Per group the subset of rows (or the weight of each) that is best
    under the constraints; groups without an answer have no rows.  Rows with
    a NULL coefficient are no candidates."""
    s = lo.finite(n.input, outer)
    work = s.df.withColumn("__seq", F.monotonically_increasing_id()).withColumn("__g", lo.value(n.objective, s, outer).cast("double"))
    for i, (e, _, _) in enumerate(n.constraints):
        work = work.withColumn(f"__a{i}", lo.value(e, s, outer).cast("double"))
    kinds, limits = [op for _, op, _ in n.constraints], np.array([v for _, _, v in n.constraints])
    names = ["__g", *[f"__a{i}" for i in range(len(kinds))]]
    per = [k.id for k in s.columns(n.per)]
    weight = Column(fresh(n.name), n.name) if n.name else None
    cols = (*s.cols, weight) if weight else s.cols
    schema = T.StructType([*[work.schema[x.id] for x in s.cols], *([T.StructField(weight.id, T.DoubleType())] if weight else [])])
    solver = lo.session.solver
    bounds, maximize, ids, added = n.bounds, n.maximize, [x.id for x in s.cols], weight.id if weight else None

    def group(pdf):
        pdf = pdf.sort_values("__seq")
        fit_ = pdf[names].notna().all(axis=1).to_numpy()
        some = pdf[fit_]
        g = some["__g"].to_numpy() * (1 if maximize else -1)
        a = some[names[1:]].to_numpy().T.reshape(len(kinds), -1)
        if bounds is None:
            x = solver.choose(g, a, limits, kinds)
            return (some[x == 1] if x is not None else some[:0])[ids]
        got = solver.weights(-g, a, limits, kinds, np.full(len(g), bounds[0], float), np.full(len(g), bounds[1], float))
        out = pdf[ids].copy()
        out[added] = np.nan
        if got is None:
            return out[:0]
        out.loc[fit_, added] = np.round(got, 10)
        return out

    return Scope(work.groupBy(*per).applyInPandas(group, schema), cols)


# Covers ------------------------------------------------------------------------------
#: Combinations that an exact cover takes at most.
DEMANDS = 10_000


def cover(rows: np.ndarray, strength: int, exact: bool) -> list[int]:
    """Numbers of rows that hold every combination of values of every
    ``strength`` columns: the row with most new ones, the earliest of equals."""
    n, k = rows.shape
    demand: dict[tuple, int] = {}
    holds = []
    for row in rows:
        mine = []
        for at in combinations(range(k), min(strength, k)):
            t = (at, tuple(row[list(at)]))
            mine.append(demand.setdefault(t, len(demand)))
        holds.append(np.array(mine))
    covered, chosen = np.zeros(len(demand), bool), []
    while not covered.all():
        new = [int((~covered[h]).sum()) for h in holds]
        i = int(np.argmax(new))
        chosen.append(i)
        covered[holds[i]] = True
    if not exact:
        return chosen
    sets = [frozenset(h.tolist()) for h in holds]
    by = [[i for i, s in enumerate(sets) if d in s] for d in range(len(demand))]
    best, widest, left = sorted(chosen), max(map(len, sets)), [2_000_000]

    def search(got: list[int], open_: frozenset):
        nonlocal best
        left[0] -= 1
        if left[0] < 0:
            raise AlgebraError("COVER EXACT is undecided")
        if not open_:
            if len(got) < len(best):
                best = sorted(got)
            return
        if len(got) + -(-len(open_) // widest) >= len(best):
            return
        d = min(open_, key=lambda q: len(by[q]))
        for i in sorted(by[d], key=lambda i: -len(sets[i] & open_)):
            search([*got, i], open_ - sets[i])

    search([], frozenset(range(len(demand))))
    return best


#: Cells of distinct rows up to which one task covers; beyond, every pick is
#: a round over all rows.
ONE_TASK = 2_000_000


def _wide_cover(work, ids: list[str], strength: int):
    """The greedy choice in rounds: each counts the open combinations of
    every row and takes the row with most, the earliest of equals."""
    sets = [F.struct(F.lit(i).alias("i"), F.xxhash64(*at).alias("h"), F.to_json(F.struct(*at)).alias("v")) for i, at in enumerate(combinations(ids, min(strength, len(ids))))]
    open_ = cut(work.select("__seq", F.explode(F.array(*sets)).alias("t")))
    chosen: list[int] = []  # a number for each row of the cover
    while True:
        best = open_.groupBy("__seq").count().orderBy(F.desc("count"), "__seq").first()
        if best is None:
            return work.where(F.col("__seq").isin(chosen)) if chosen else work.limit(0)
        chosen.append(best["__seq"])
        open_ = cut(open_.join(open_.where(F.col("__seq") == best["__seq"]).select("t"), "t", "left_anti"))


@handles(ir.Cover)
def _cover(lo: Lowering, n: ir.Cover, outer) -> Scope:
    """A small set of rows in which every combination that occurs occurs.
    The rows are made distinct first.  A small choice runs in one task; a
    large one in rounds, one for each row taken (EXACT is small always)."""
    s = lo.finite(n.input, outer)
    if n.strength > len(s.cols):
        raise AlgebraError("COVER is stronger than there are columns")
    ids = [x.id for x in s.cols]
    work = s.df.withColumn("__seq", F.monotonically_increasing_id()).groupBy(*ids).agg(F.min("__seq").alias("__seq"))
    strength, exact = n.strength, n.exact
    if not exact:
        work = cut(work)  # the numbers of rows must not change between rounds
        if work.count() * len(ids) > ONE_TASK:
            return s.with_df(_wide_cover(work, ids, strength).select(*ids))
    else:  # counted before the rows are gathered
        counts = work.agg(*[F.count_distinct(F.struct(*at)) for at in combinations(ids, min(strength, len(ids)))]).first()
        if sum(counts) > DEMANDS:
            raise AlgebraError(f"COVER EXACT takes at most {DEMANDS:,} combinations")

    def group(pdf):
        pdf = pdf.sort_values("__seq").reset_index(drop=True)
        codes = np.stack([pdf[i].astype(str).where(pdf[i].notna(), "\0").factorize()[0] for i in ids], axis=1)
        return pdf.loc[cover(codes, strength, exact), ids]

    return s.with_df(work.groupBy().applyInPandas(group, s.df.select(*ids).schema))
