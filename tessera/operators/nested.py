"""Nested values: unnesting arrays, building forests."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators.components import cut
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Column, Scope, c, fresh

#: Levels of a forest, at most.
DEPTH = 100


@handles(ir.Unnest)
def _unnest(lo: Lowering, n: ir.Unnest, outer) -> Scope:
    """A row for each element, which takes the array's place; NULL and empty
    arrays give no row (outer: one, with NULLs)."""
    s = lo.finite(n.input, outer)
    array = s.column(n.column)
    item = Column(fresh(array.name), array.name, array.quals)
    at = Column(fresh(n.ordinal or "ordinal"), n.ordinal or "ordinal")
    f = F.posexplode_outer if n.outer else F.posexplode
    df = s.df.select("*", f(c(array)).alias("__p", item.id)).withColumn(at.id, F.col("__p") + 1)
    cols = tuple(item if x is array else x for x in s.cols) + ((at,) if n.ordinal else ())
    return Scope(df.select(*[x.id for x in cols]), cols)


@handles(ir.Tree)
def _tree(lo: Lowering, n: ir.Tree, outer) -> Scope:
    """One row per root with its descendants nested in an array column.

    The levels are found from the roots down (a join a level), then folded
    from the leaves up.  A key twice, or rows that no root reaches (a cycle),
    are errors.  A level's array holds one node's children, which must fit
    in a row.
    """
    s = lo.finite(n.input, outer)
    key, parent = s.column(n.id), s.column(n.parent)
    ids = [x.id for x in s.cols]
    order = [(lo.value(k.expr, s, outer), k.desc) for k in n.keys]
    work = cut(s.df.withColumn("__seq", F.monotonically_increasing_id()).withColumns({f"__o{i}": v for i, (v, _) in enumerate(order)}))
    if work.groupBy(key.id).count().filter("count > 1").limit(1).count():
        raise AlgebraError("a key stands twice in the tree")
    keys = work.select(c(key).alias("__pk"))
    roots = work.join(keys, c(parent) == F.col("__pk"), "left_anti")
    levels, total, all_ = [cut(roots)], 0, work.count()
    total = levels[0].count()
    while total < all_:
        above = levels[-1].select(c(key).alias("__pk"))
        below = cut(work.join(above, c(parent) == F.col("__pk"), "left_semi"))
        n_below = below.count()
        if not n_below or len(levels) >= DEPTH:
            raise AlgebraError("the tree has a cycle" if not n_below else f"the tree is more than {DEPTH} deep")
        levels.append(below)
        total += n_below
    folded = None
    kids = Column(fresh(n.name), n.name)
    fields = [c(x).alias(x.name) for x in s.cols]
    for level in reversed(levels):
        if folded is None:
            df = level.withColumn(kids.id, F.lit(None))
            node = F.struct(*fields)
        else:
            up = folded.groupBy(F.col("__up")).agg(F.collect_list("__e").alias("__es"))
            df = level.join(up, c(key) == F.col("__up"), "left").withColumn(kids.id, F.transform(_sorted(F.coalesce("__es", F.expr("filter(__es, x -> false)"), F.array()), order), lambda e: e["node"])).drop("__up", "__es")
            node = F.struct(*fields, c(kids).alias(n.name))
        folded = df.select(c(parent).alias("__up"), F.struct(*[F.col(f"__o{i}") for i in range(len(order))], F.col("__seq").alias("q"), node.alias("node")).alias("__e"))
        last = df
    if len(levels) == 1:
        last = last.withColumn(kids.id, F.array())
    cols = (*s.cols, kids)
    return Scope(last.select(*ids, kids.id), cols)


def _sorted(es, order):
    def before(x, y):
        out = F.when(x["q"] < y["q"], -1).when(x["q"] > y["q"], 1).otherwise(0)
        for i in range(len(order) - 1, -1, -1):
            p, q = x[f"__o{i}"], y[f"__o{i}"]
            up = (1, -1) if order[i][1] else (-1, 1)
            out = F.when(p < q, up[0]).when(p > q, up[1]).otherwise(out)
        return out

    return F.array_sort(es, before)
