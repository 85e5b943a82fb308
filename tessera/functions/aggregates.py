"""Aggregates: partial and final steps are Spark's."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.scope import Scope

_SIMPLE = {"SUM": (F.sum, F.sum_distinct), "MIN": (F.min, F.min), "MAX": (F.max, F.max), "BOOL_AND": (F.bool_and, F.bool_and), "BOOL_OR": (F.bool_or, F.bool_or), "STDDEV_SAMP": (F.stddev_samp, None), "STDDEV_POP": (F.stddev_pop, None), "VAR_SAMP": (F.var_samp, None), "VAR_POP": (F.var_pop, None), "MEDIAN": (F.median, None)}


def build(lo, a: ir.Agg, s: Scope, outer=()) -> Column:
    args = [lo.value(x, s, outer) if isinstance(x, ir.Expr) else x for x in a.args]
    keep = lo.value(a.filter, s, outer) if a.filter is not None else None
    if keep is not None:
        args = [F.when(keep, x) if isinstance(x, Column) and i == 0 else x for i, x in enumerate(args)]
    if a.func == "COUNT":
        if not args:
            return F.count(F.lit(1) if keep is None else F.when(keep, 1))
        return F.count_distinct(args[0]) if a.distinct else F.count(args[0])
    if a.func == "AVG":
        return average(args[0], lo.type(args[0], s), a.distinct)
    if a.func in _SIMPLE:
        f, distinct = _SIMPLE[a.func]
        if a.distinct and distinct is None:
            # over the set of values, through its exact list
            values = F.collect_set(args[0])
            return _over_list(a.func, values)
        return (distinct if a.distinct else f)(args[0])
    if a.func in ("ARGMAX", "ARGMIN"):
        # the first row in arrival order wins a tie; a NULL rank never wins
        rank, value = args
        first = F.when(rank.isNotNull(), F.struct(rank.alias("r"), (-F.col("__seq") if a.func == "ARGMAX" else F.col("__seq")).alias("s")))
        return F.max_by(value, first) if a.func == "ARGMAX" else F.min_by(value, first)
    if a.func == "MODE":
        if a.order and a.order[0].desc:
            raise AlgebraError("MODE takes its ties in ascending order")
        return F.mode(args[0], True)
    if a.func in ("PERCENTILE_CONT", "PERCENTILE_DISC"):
        value, p, desc = args
        fraction = getattr(p, "_tessera_literal", None)
        if fraction is None or not 0 <= fraction <= 1:
            raise AlgebraError("a percentile is a number from 0 to 1")
        if a.func == "PERCENTILE_CONT":
            return F.percentile(value, float(1 - fraction if desc else fraction))
        if desc:
            raise AlgebraError("PERCENTILE_DISC takes ascending order only")
        sorted_ = F.array_sort(F.collect_list(value))
        return F.get(sorted_, F.greatest(F.ceil(F.size(sorted_) * F.lit(float(fraction))).cast("int") - 1, F.lit(0)))
    if a.func in ("COLLECT", "STRING_AGG"):
        return _collected(lo, a, args, s, outer, keep)
    own = lo.session.aggregates.get(a.func.lower())
    if own is not None:
        return own(*args)
    raise AlgebraError(f"no aggregate {a.func}")


def folded(create, accumulate, finish, returns: str):
    """An aggregate from Python: ``create()`` a state, ``accumulate(state,
    *values)`` each row to the next state, ``finish(state)`` to the value of
    type ``returns``.  Rows come in no order; NULLs are None.

    A group's values meet in one row, as with COLLECT.  What built-in
    aggregates can express should be a builder of columns instead: that has
    partial sums before the shuffle.
    """

    def build_(*args: Column) -> Column:
        import pandas as pd

        def run(rows):
            out = []
            for group in rows:
                state = create()
                for r in group:
                    state = accumulate(state, *r.values()) if isinstance(r, dict) else accumulate(state, *r)
                out.append(finish(state))
            return pd.Series(out, dtype="object")

        run.__annotations__ = {"rows": pd.Series, "return": pd.Series}  # how Spark tells the kind
        return F.pandas_udf(run, returns)(F.collect_list(F.struct(*[x.alias(f"v{i}") for i, x in enumerate(args)])))

    return build_


def average(x: Column, t: T.DataType, distinct: bool = False) -> Column:
    """Exact numbers to ten places, halves away from zero; doubles as they are."""
    if isinstance(t, (T.DoubleType, T.FloatType)):
        return F.sum_distinct(x) / F.count_distinct(x) if distinct else F.avg(x)
    total, n = (F.sum_distinct(x), F.count_distinct(x)) if distinct else (F.sum(x), F.count(x))
    return F.when(n > 0, F.round(total.cast("decimal(38,10)") / n, 10))


def _over_list(func: str, values: Column) -> Column:
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda p, v: p + v) / n
    square = F.aggregate(values, F.lit(0.0), lambda p, v: p + (v - mean) * (v - mean))
    if func == "MEDIAN":
        s = F.array_sort(values)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)
    var = F.when(n > 1, square / (n - 1)) if func.endswith("SAMP") else F.when(n > 0, square / n)
    return F.sqrt(var) if func.startswith("STD") else var


def _collected(lo, a: ir.Agg, args: list[Column], s: Scope, outer, keep) -> Column:
    """Values in order (arrival order if none is given).  COLLECT keeps
    NULLs, a string aggregate passes them over."""
    value = args[0]
    keys = []
    for k in a.order:
        x = lo.value(k.expr, s, outer)
        keys.append((x, k.desc, k.nulls_first))
    fields = [x.alias(f"k{i}") for i, (x, _, _) in enumerate(keys)]
    row = F.struct(*fields, F.col("__seq").alias("q"), F.struct(value.alias("v")).alias("w"))
    rows = F.collect_list(F.when(keep, row) if keep is not None else row)

    def before(x, y):
        out = F.when(x["q"] < y["q"], -1).when(x["q"] > y["q"], 1).otherwise(0)
        for i in range(len(keys) - 1, -1, -1):
            _, desc, first = keys[i]
            p, q = x[f"k{i}"], y[f"k{i}"]
            up, null = (1, -1) if desc else (-1, 1), -1 if first else 1
            out = F.when(p.isNull() & q.isNull(), out).when(p.isNull(), null).when(q.isNull(), -null).when(p < q, up[0]).when(p > q, up[1]).otherwise(out)
        return out

    values = F.transform(F.array_sort(rows, before), lambda r: r["w"]["v"])
    if a.func == "COLLECT":
        return F.array_distinct(values) if a.distinct else values
    text = F.array_compact(values.cast("array<string>"))
    if a.distinct:
        text = F.array_distinct(text)
    return F.when(F.size(text) > 0, F.call_function("array_join", text, args[1]))
