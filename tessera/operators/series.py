"""Time series: sessions, down-sampling, pivots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import aggregates, durations, scalar
from tessera.operators import windows
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Column, Scope, c, fresh


@handles(ir.Sessionize)
def _sessionize(lo: Lowering, n: ir.Sessionize, outer) -> Scope:
    """Sessions from 1 in each group; only a gap strictly longer than the
    given opens one, and a NULL on either side does not."""
    s = lo.finite(n.input, outer)
    x = c(s.column(n.column))
    t = s.type(s.column(n.column))
    gap = lo.value(n.gap, s, outer)
    if isinstance(t, (T.StringType, T.DateType)):
        x = x.cast("timestamp")
    if not n.per and windows.is_wide(s):
        return windows.wide_sessions(s, x, gap, n.name)
    w = Window.partitionBy(*[k.id for k in s.columns(n.per)]).orderBy(x.asc_nulls_last())
    opens = F.coalesce((x > F.lag(x).over(w) + gap).cast("int"), F.lit(0))
    df = s.df.withColumn("__open", opens)
    value = F.sum("__open").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    new = Column(fresh(n.name), n.name)
    return Scope(df.withColumn(new.id, value).drop("__open"), (*s.cols, new)) if all(k.name.lower() != n.name.lower() for k in s.cols) else s.add(value, n.name)


@handles(ir.Downsample)
def _downsample(lo: Lowering, n: ir.Downsample, outer) -> Scope:
    s = lo.finite(n.input, outer)
    ts, per = s.column(n.column), s.columns(n.per)
    width = durations.width(n.width)
    at = F.unix_micros(c(ts).cast("timestamp"))
    bucket = Column(fresh("bucket"), "bucket")
    df = s.df.filter(c(ts).isNotNull()).withColumn(bucket.id, F.timestamp_micros(at - F.pmod(at, F.lit(width))))
    keys = [*per, bucket]
    made, cols = [], []
    if n.func == "COUNT":
        cols.append(Column(fresh("count"), "count"))
        made.append(F.count(F.lit(1)).alias(cols[0].id))
    else:
        for x in s.cols:
            if x is ts or any(x is k for k in per):
                continue
            t = s.type(x)
            number = isinstance(t, T.NumericType)
            if n.func in ("AVG", "SUM") and not number or not isinstance(t, (T.NumericType, T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
                continue
            k = Column(fresh(x.name), f"{n.func.lower()}_{x.name}")
            f = {"AVG": lambda v, t=t: aggregates.average(v, t), "SUM": F.sum, "MIN": F.min, "MAX": F.max}[n.func]
            cols.append(k)
            made.append(f(c(x)).alias(k.id))
        if not made:
            raise AlgebraError(f"nothing to take the {n.func} of")
    out = df.groupBy(*[k.id for k in keys]).agg(*made)
    if n.latest is not None:
        w = Window.partitionBy(*[k.id for k in per]).orderBy(F.col(bucket.id).desc())
        out = out.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n.latest).drop("__rn")
    return Scope(out, (*keys, *cols))


@handles(ir.Pivot)
def _pivot(lo: Lowering, n: ir.Pivot, outer) -> Scope:
    """A column for each value of BY, in the order first met; of several
    rows for one cell the last to arrive counts.  NULL makes no column but
    keeps its group.  The headers are one small aggregation up front."""
    s = lo.finite(n.input, outer)
    value, by = s.column(n.value), s.column(n.by)
    per = s.columns(n.per) if n.per else [x for x in s.cols if x is not value and x is not by]
    work = s.df.withColumn("__seq", F.monotonically_increasing_id())
    shown = scalar.plain(c(by), s.type(by))
    heads = [r.h for r in work.filter(c(by).isNotNull()).groupBy(shown.alias("h")).agg(F.min("__seq").alias("q")).orderBy("q").limit(10_001).collect()]
    if len(heads) > 10_000:
        raise AlgebraError("a pivot into more than 10,000 columns")
    cols = [Column(fresh("p"), h) for h in heads]
    cells = [F.max_by(F.when(shown == h, F.struct(c(value).alias("v"))), F.when(shown == h, F.col("__seq"))).getField("v").alias(k.id) for h, k in zip(heads, cols)]
    ids = [k.id for k in per]
    if not cells:
        return Scope(work.select(*ids).distinct(), tuple(per))
    if ids:
        out = work.groupBy(*ids).agg(*cells)
    else:
        out = work.agg(*cells, F.count(F.lit(1)).alias("__n")).filter("__n > 0").drop("__n")
    return Scope(out, (*per, *cols))


@handles(ir.Unpivot)
def _unpivot(lo: Lowering, n: ir.Unpivot, outer) -> Scope:
    """A row for each named column; NULLs are kept."""
    s = lo.finite(n.input, outer)
    picked = s.columns(n.columns)
    keep = [x for x in s.cols if all(x is not p for p in picked)]
    name, value = Column(fresh(n.name), n.name), Column(fresh(n.value), n.value)
    types = {s.type(x).simpleString() for x in picked}
    cast = (lambda v: v) if len(types) == 1 or all(isinstance(s.type(x), T.NumericType) for x in picked) else (lambda v: v.cast("string"))
    rows = F.array(*[F.struct(F.lit(x.name).alias("n"), cast(c(x)).alias("v")) for x in picked])
    df = s.df.select(*[x.id for x in keep], F.explode(rows).alias("__e"))
    return Scope(df.select(*[x.id for x in keep], F.col("__e.n").alias(name.id), F.col("__e.v").alias(value.id)), (*keep, name, value))
