"""Provenance: queries over relations whose rows carry semiring values.

Selection filters, projection and union add, joins multiply; any other
operator's result counts as a relation of its own.  A semiring gives the
value of a base row, a product of two columns and a sum as an aggregate.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Protocol

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F

from tessera.operators.joins import _equal, _pair, common
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Column, Scope, c, merged

#: Monomials of a lineage polynomial; what is beyond is cut, and marked.
CAP = 256
_P = "__prov"


class Semiring(Protocol):
    def base(self, s: Scope, name: str) -> SparkColumn: ...
    def times(self, a: SparkColumn, b: SparkColumn) -> SparkColumn: ...
    def plus(self, a: SparkColumn) -> SparkColumn: ...


@dataclass(frozen=True)
class Boolean:
    def base(self, s, name):
        return F.lit(True)

    def times(self, a, b):
        return a & b

    def plus(self, a):
        return F.bool_or(a)


@dataclass(frozen=True)
class Counting:
    def base(self, s, name):
        return F.lit(1).cast("bigint")

    def times(self, a, b):
        return a * b

    def plus(self, a):
        return F.sum(a)


@dataclass(frozen=True)
class Tropical:
    """The cheapest way: costs add along it.  ``cost`` names the column of
    base rows that holds theirs (others cost nothing)."""

    cost: str = "cost"

    def base(self, s, name):
        return c(s.column(self.cost)).cast("double") if any(x.name.lower() == self.cost.lower() for x in s.cols) else F.lit(0.0)

    def times(self, a, b):
        return a + b

    def plus(self, a):
        return F.min(a)


@dataclass(frozen=True)
class Security:
    """The clearance that a row needs: levels from the lowest up, in the
    column ``level`` of base rows."""

    levels: tuple[str, ...] = ("public", "internal", "confidential", "secret")
    level: str = "level"

    def base(self, s, name):
        if not any(x.name.lower() == self.level.lower() for x in s.cols):
            return F.lit(0)
        out = F.lit(len(self.levels) - 1)
        for i, name_ in enumerate(self.levels):
            out = F.when(c(s.column(self.level)) == name_, F.lit(i)).otherwise(out)
        return out

    def times(self, a, b):
        return F.greatest(a, b)

    def plus(self, a):
        return F.min(a)


@dataclass(frozen=True)
class Routes:
    """The least cost and every way that has it."""

    cost: str = "cost"

    def base(self, s, name):
        cost = Tropical(self.cost).base(s, name)
        return F.struct(cost.alias("cost"), F.array(F.array(F.concat_ws("|", *[c(x).cast("string") for x in s.cols]))).alias("routes"))

    def times(self, a, b):
        ways = F.flatten(F.transform(a["routes"], lambda x: F.transform(b["routes"], lambda y: F.concat(x, y))))
        return F.struct((a["cost"] + b["cost"]).alias("cost"), ways.alias("routes"))

    def plus(self, a):
        all_ = F.collect_list(a)
        least = F.array_min(F.transform(all_, lambda x: x["cost"]))
        return F.struct(least.alias("cost"), F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(all_, lambda x: x["cost"] == least), lambda x: x["routes"])))).alias("routes"))


@dataclass(frozen=True)
class Lineage:
    """Polynomials over base rows: arrays of coefficient and variables."""

    def base(self, s, name):
        values = F.to_json(F.struct(*[c(x).alias(x.name) for x in s.cols]))
        var = F.struct(F.lit(name).alias("relation"), (F.monotonically_increasing_id() + 1).alias("ordinal"), values.alias("columns"))
        return F.array(F.struct(F.lit(1).cast("bigint").alias("coefficient"), F.array(var).alias("variables"), F.lit(False).alias("truncated")))

    def times(self, a, b):
        pair = lambda x: lambda y: F.struct((x["coefficient"] * y["coefficient"]).alias("coefficient"), F.array_sort(F.concat(x["variables"], y["variables"])).alias("variables"), (x["truncated"] | y["truncated"]).alias("truncated"))
        return _collected(F.flatten(F.transform(a, lambda x: F.transform(b, pair(x)))))

    def plus(self, a):
        return _collected(F.flatten(F.collect_list(a)))


def _collected(terms: SparkColumn) -> SparkColumn:
    """Like monomials put together, in order, at most CAP of them."""
    vars_ = F.array_sort(F.array_distinct(F.transform(terms, lambda t: t["variables"])))
    cut = F.size(vars_) > CAP
    return F.transform(
        F.slice(vars_, 1, CAP),
        lambda v: F.struct(
            F.aggregate(F.filter(terms, lambda t: t["variables"] == v), F.lit(0).cast("bigint"), lambda n, t: n + t["coefficient"]).alias("coefficient"),
            v.alias("variables"),
            (cut | F.exists(F.filter(terms, lambda t: t["variables"] == v), lambda t: t["truncated"])).alias("truncated"),
        ),
    )


SEMIRINGS = {"boolean": Boolean, "counting": Counting, "tropical": Tropical, "security": Security, "routes": Routes, "lineage": Lineage}


def annotated(lo: Lowering, n: ir.Node, k: Semiring, outer=()) -> Scope:
    """The relation, with a column ``__prov`` beside its own."""
    if isinstance(n, ir.Relation):
        view = lo.session.view(".".join(n.name)) if ".".join(n.name) not in lo.bound else None
        if view is not None:
            s = annotated(lo, view, k, outer)
            return replace(s, cols=tuple(replace(x, quals=frozenset({".".join(n.name).lower(), n.name[-1].lower()})) for x in s.cols))
    if isinstance(n, ir.Select):
        s = annotated(lo, n.input, k, outer)
        return lo.filter(s, n.pred, outer)
    if isinstance(n, ir.Rename):
        s = annotated(lo, n.input, k, outer)
        bare = Scope(s.df, s.cols)
        cols = list(bare.cols)
        if n.columns:
            cols = [replace(x, name=new, origin=None) for x, new in zip(cols, n.columns)]
        for old, new in n.pairs or ():
            at = cols.index(Scope(s.df, tuple(cols)).column(old))
            cols[at] = replace(cols[at], name=new, origin=None)
        if n.name:
            cols = [replace(x, quals=frozenset({n.name.lower()}), origin=None) for x in cols]
        return Scope(s.df, tuple(cols))
    if isinstance(n, (ir.Project, ir.Distinct)):
        s = annotated(lo, n.input, k, outer)
        if isinstance(n, ir.Project):
            from tessera.plans.lower import output_name
            from tessera.plans.scope import fresh

            made = [(Column(fresh("p"), output_name(e, given, i), s.find(e.parts)[0].quals if isinstance(e, ir.Ref) and s.find(e.parts) else frozenset()), lo.value(e, s, outer)) for i, (e, given) in enumerate(n.items)]
            s = Scope(s.df.select(*[v.alias(x.id) for x, v in made], _P), tuple(x for x, _ in made))
        return _merged(s, k)
    if isinstance(n, (ir.Product, ir.Join)) and (isinstance(n, ir.Product) or n.kind == "inner"):
        left, right = annotated(lo, n.left, k, outer), annotated(lo, n.right, k, outer)
        l, r = left.df.withColumnRenamed(_P, "__pl"), right.df.withColumnRenamed(_P, "__pr")
        a, b = Scope(l, left.cols), Scope(r, right.cols)
        if isinstance(n, ir.Product):
            df, cols = l.crossJoin(r), merged(a, b)
        elif n.pred is not None:
            df, cols = l.join(r, lo.value(n.pred, _pair(a, b), outer)), merged(a, b)
        else:
            pairs = common(a, b) if n.using is None else [(a.column(u), b.column(u)) for u in n.using]
            if not pairs:
                raise AlgebraError("a natural join needs a common column")
            df = l.join(r, _equal(pairs))
            cols = merged(a, Scope(r, tuple(x for x in b.cols if all(x is not q for _, q in pairs))))
        return Scope(df.select(*[x.id for x in cols], k.times(F.col("__pl"), F.col("__pr")).alias(_P)), cols)
    if isinstance(n, ir.SetOp) and n.kind in ("union", "uall"):
        left, right = annotated(lo, n.left, k, outer), annotated(lo, n.right, k, outer)
        both = left.df.select(*[x.id for x in left.cols], _P).union(right.df.select(*[x.id for x in right.cols], _P))
        return _merged(Scope(both, left.cols), k)
    s = lo.finite(n, outer)
    name = ".".join(n.name) if isinstance(n, ir.Relation) else type(n).__name__.lower()
    return Scope(s.df.select(*[x.id for x in s.cols], k.base(s, name).alias(_P)), s.cols)


def _merged(s: Scope, k: Semiring) -> Scope:
    return Scope(s.df.groupBy(*[x.id for x in s.cols]).agg(k.plus(F.col(_P)).alias(_P)), s.cols)


@handles(ir.Why)
def _why(lo: Lowering, n: ir.Why, outer) -> Scope:
    s = annotated(lo, n.input, Lineage(), outer)
    return Scope(s.df, (*s.cols, Column(_P, "provenance")))
