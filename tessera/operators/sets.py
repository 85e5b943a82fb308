"""Set operations: positional, with the left heading, and sets but for ⊎."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators.joins import common
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Column, Scope, c, fresh


@handles(ir.SetOp)
def _set(lo: Lowering, n: ir.SetOp, outer) -> Scope:
    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    if n.kind == "ounion":
        return _outer_union(left, right)
    if len(left.cols) != len(right.cols):
        raise AlgebraError(f"{len(left.cols)} columns against {len(right.cols)}")
    l = left.df.select(*[x.id for x in left.cols])
    r = right.df.select(*[c(y).alias(x.id) for x, y in zip(left.cols, right.cols)])
    if n.kind == "uall":
        return left.with_df(l.union(r))
    if not left.cols:
        return _truths(lo, n.kind, l, r)
    made = {"union": lambda: l.union(r).distinct(), "inter": lambda: l.intersect(r), "diff": lambda: l.subtract(r), "symdiff": lambda: _symmetric(l, r, [x.id for x in left.cols])}[n.kind]()
    return left.with_df(made)


def _symmetric(l, r, ids):
    """Rows on one side only, from one pass over each: no input twice."""
    both = l.select("*", F.lit(1).alias("__side")).union(r.select("*", F.lit(2).alias("__side")))
    return both.groupBy(*ids).agg(F.min("__side").alias("__lo"), F.max("__side").alias("__hi")).filter("__lo = __hi").select(*ids)


def _truths(lo: Lowering, kind: str, l, r) -> Scope:
    """Relations without columns: true (a row) or false."""
    a, b = l.limit(1), r.limit(1)
    one = lo.spark.range(1)
    have, had = one.join(a, how="left_semi"), one.join(b, how="left_semi")
    made = {"union": lambda: have.union(had).limit(1), "inter": lambda: have.join(b, how="left_semi"), "diff": lambda: have.join(b, how="left_anti"), "symdiff": lambda: have.join(b, how="left_anti").union(had.join(a, how="left_anti")).limit(1)}[kind]()
    return Scope(made.select(), ())


def _outer_union(left: Scope, right: Scope) -> Scope:
    pairs = {id(a): b for a, b in common(left, right)}
    extra = [x for x in right.cols if all(x is not b for b in pairs.values())]
    cols, l, r = [], [], []
    for x in left.cols:
        y = pairs.get(id(x))
        new = Column(fresh(x.name), x.name, x.quals)
        ta, tb = left.type(x), right.type(y) if y else None
        clash = tb is not None and ta != tb and not (isinstance(ta, T.NumericType) and isinstance(tb, T.NumericType))
        l.append((c(x).cast("string") if clash else c(x)).alias(new.id))
        r.append((c(y).cast("string") if clash else c(y) if y else F.lit(None)).alias(new.id))
        cols.append(new)
    for x in extra:
        new = Column(fresh(x.name), x.name, x.quals)
        l.append(F.lit(None).alias(new.id))
        r.append(c(x).alias(new.id))
        cols.append(new)
    return Scope(left.df.select(*l).union(right.df.select(*r)).distinct(), tuple(cols))


@handles(ir.Divide)
def _divide(lo: Lowering, n: ir.Divide, outer) -> Scope:
    """The A-values that stand with every B: those whose number of distinct
    matches is the divisor's size.  NULLs are values here; an empty divisor
    keeps every A."""
    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    pairs = common(left, right)
    if len(pairs) != len(right.cols):
        raise AlgebraError("a divisor's columns must all be in the dividend")
    keep = [x for x in left.cols if all(x is not a for a, _ in pairs)]
    if not keep:
        raise AlgebraError("a division leaves no column")
    ids = [x.id for x in keep]
    whole = right.df.distinct()
    need = whole.agg(F.count(F.lit(1)).alias("__need"))
    on = None
    for a, b in pairs:
        e = c(a).eqNullSafe(c(b))
        on = e if on is None else on & e
    hits = left.df.distinct().join(whole.withColumn("__in", F.lit(1)), on, "left").groupBy(*ids).agg(F.count("__in").alias("__have"))
    # one row: safe to send everywhere
    return Scope(hits.join(F.broadcast(need), F.col("__have") == F.col("__need")).select(*ids), tuple(keep))

