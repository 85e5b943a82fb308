"""Windows, top-k and ranking."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import aggregates
from tessera.operators.components import cut
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import Lowering, handles
from tessera.plans.scope import Column, Scope, fresh

_RANKS = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist}


@handles(ir.Top)
def _top(lo: Lowering, n: ir.Top, outer) -> Scope:
    """Per group a rank (Spark keeps only the group's first rows before the
    shuffle); over all rows an order with a limit."""
    s = lo.finite(n.input, outer)
    per, keys = s.columns(n.per), lo.sort_columns(n.keys, s, outer)
    if not per and not n.ties:
        df = s.df.orderBy(*keys)
        return s.with_df((df.offset(n.offset) if n.offset else df).limit(n.count))
    if not per:
        # The last row that counts is the bar; the rows at or before it are
        # found by an order with a limit and one broadcast row, not a window.
        names = [f"__t{i}" for i in range(len(n.keys))]
        work = s.df.withColumns({k: lo.value(x.expr, s, outer) for k, x in zip(names, n.keys)})
        order = [_ordered(F.col(k), x) for k, x in zip(names, n.keys)]
        first = work.orderBy(*order).limit(n.offset + n.count)
        bar = first.select(*names).orderBy(*[_ordered(F.col(k), ir.SortKey(None, not x.desc, not x.nulls_first)) for k, x in zip(names, n.keys)]).limit(1)
        tied = work.join(F.broadcast(bar.toDF(*[f"{k}b" for k in names])), _all([F.col(k).eqNullSafe(F.col(f"{k}b")) for k in names])).select(*[x.id for x in s.cols])
        before = first.join(F.broadcast(bar.toDF(*[f"{k}b" for k in names])), ~_all([F.col(k).eqNullSafe(F.col(f"{k}b")) for k in names]))
        ahead = before.orderBy(*order).offset(n.offset) if n.offset else before
        if n.offset:  # rows of the tie that the offset passes over
            skipped = work.orderBy(*order).limit(n.offset).join(F.broadcast(bar.toDF(*[f"{k}b" for k in names])), _all([F.col(k).eqNullSafe(F.col(f"{k}b")) for k in names])).count()
            tied = tied.offset(skipped) if skipped else tied
        return s.with_df(ahead.select(*[x.id for x in s.cols]).union(tied))
    w = Window.partitionBy(*[x.id for x in per]).orderBy(*keys)
    df = s.df.withColumn("__rn", F.row_number().over(w))
    if n.ties:
        df = df.withColumn("__rk", F.rank().over(w)).filter((F.col("__rn") > n.offset) & (F.col("__rk") <= n.offset + n.count))
    else:
        df = df.filter((F.col("__rn") > n.offset) & (F.col("__rn") <= n.offset + n.count)) if n.offset else df.filter(F.col("__rn") <= n.count)
    return s.with_df(df.select(*[x.id for x in s.cols]))


def _all(tests):
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _ordered(x, k: ir.SortKey):
    if k.desc:
        return x.desc_nulls_first() if k.nulls_first else x.desc_nulls_last()
    return x.asc_nulls_first() if k.nulls_first else x.asc_nulls_last()


def _spec(lo: Lowering, s: Scope, per, keys, frame: ir.WinFrame | None, outer, default=None):
    w = Window.partitionBy(*[x.id for x in s.columns(per)])
    order = lo.sort_columns(keys, s, outer)
    if order:
        w = w.orderBy(*order)
    frame = frame or default
    if frame is None:
        return w
    if frame.unit == "partition":
        return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    if frame.unit == "rows":
        return w.rowsBetween(_rows(frame.lo), _rows(frame.hi))
    if len(keys) != 1:
        raise AlgebraError("a RANGE frame has one sort key")
    return w, frame


def _rows(b: ir.Bound):
    if b.kind in ("first", "last", "current"):
        return {"first": Window.unboundedPreceding, "last": Window.unboundedFollowing, "current": Window.currentRow}[b.kind]
    if not isinstance(b.value, ir.Lit) or b.value.kind != "number":
        raise AlgebraError("a ROWS frame counts rows")
    return -int(b.value.value) if b.kind == "preceding" else int(b.value.value)


def over(lo: Lowering, s: Scope, value, per, keys, frame, outer):
    """``value`` over a window; RANGE offsets are expressed on a number."""
    spec = _spec(lo, s, per, keys, frame, outer)
    if not isinstance(spec, tuple):
        return value.over(spec)
    w, f = spec
    exact = all(b.kind in ("first", "last", "current") for b in (f.lo, f.hi))
    names = {"first": Window.unboundedPreceding, "last": Window.unboundedFollowing, "current": Window.currentRow}
    if exact:
        return value.over(w.rangeBetween(names[f.lo.kind], names[f.hi.kind]))
    key = lo.value(keys[0].expr, s, outer)
    t = lo.type(key, s)
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)):
        from tessera.functions import durations

        number = F.unix_micros(key.cast("timestamp"))

        def size(b):
            months, micros = durations.parse(b.value.value)
            if months:
                raise AlgebraError("a RANGE of months has no one length")
            return micros
    else:
        number = key

        def size(b):
            v = b.value.value
            return int(v) if v == int(v) else float(v)

    def bound(b):
        if b.kind in names:
            return names[b.kind]
        return -size(b) if b.kind == "preceding" else size(b)

    k = keys[0]
    w = Window.partitionBy(*[x.id for x in s.columns(per)]).orderBy(_ordered(number, k))
    return value.over(w.rangeBetween(bound(f.lo), bound(f.hi)))


#: Bytes, by Catalyst's estimate, beyond which a window without PER is dealt
#: out in ranges of its order instead of going to one task.
ONE_TASK = 32 << 20


def is_wide(s: Scope) -> bool:
    stats = s.df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes())) > ONE_TASK


def _new(s: Scope, name: str) -> Column:
    if any(x.name.lower() == name.lower() for x in s.cols):
        raise AlgebraError(f"there is a column {name} already")
    return Column(fresh(name), name)


class Ranges:
    """A relation in ranges of an order.  Equal keys share a range, so what
    stands before a range is known from one row for each (broadcast)."""

    def __init__(self, s: Scope, order: list, **sums):
        self.df = cut(s.df.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
        self.local = Window.partitionBy("__p").orderBy(*order)
        self.sums = {"__rows": F.count(F.lit(1)), **sums}

    def joined(self, **before):
        """With the totals of all rows and, for each of ``before``, an
        aggregate of a sum's column over the ranges before the row's own."""
        parts = self.df.groupBy("__p").agg(*[v.alias(k) for k, v in self.sums.items()])
        ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        parts = parts.select("__p", F.sum("__rows").over(everything).alias("__total"), F.coalesce(F.sum("__rows").over(ahead), F.lit(0)).alias("__ahead"), *[v.over(ahead).alias(k) for k, v in before.items()])
        return self.df.join(F.broadcast(parts), "__p")


def _wide_rank(lo: Lowering, s: Scope, n: ir.Window, outer) -> Scope:
    """Ranks over all rows, without one task that reads them all."""
    order = lo.sort_columns(n.keys, s, outer)
    r = Ranges(s, order, __kinds=F.count_distinct(F.struct(*[lo.value(k.expr, s, outer) for k in n.keys])))
    df = r.joined(__before=F.sum("__kinds"))
    row, rank = F.col("__ahead") + F.row_number().over(r.local), F.col("__ahead") + F.rank().over(r.local)
    total = F.col("__total")
    if n.func == "ROW_NUMBER":
        value = row
    elif n.func == "RANK":
        value = rank
    elif n.func == "DENSE_RANK":
        value = F.coalesce("__before", F.lit(0)) + F.dense_rank().over(r.local)
    elif n.func == "PERCENT_RANK":
        value = F.when(total == 1, 0.0).otherwise((rank - 1) / (total - 1))
    elif n.func == "CUME_DIST":
        value = (F.col("__ahead") + F.count(F.lit(1)).over(r.local.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / total
    else:
        k = int(n.args[0].value)
        small, large = F.floor(total / k), total % k
        edge = (small + 1) * large
        value = F.when(row <= edge, F.ceil(row / (small + 1))).otherwise(large + F.ceil((row - edge) / small))
    new = _new(s, n.name)
    kind = "double" if n.func in ("PERCENT_RANK", "CUME_DIST") else "bigint"
    return Scope(df.select(*[x.id for x in s.cols], value.cast(kind).alias(new.id)), (*s.cols, new))


def _wide_shift(lo: Lowering, s: Scope, n: ir.Window, args: list, by: int, outer) -> Scope:
    """LAG and LEAD over all rows: rows meet on their number in the order."""
    r = Ranges(s, lo.sort_columns(n.keys, s, outer))
    df = cut(r.joined().withColumn("__n", F.col("__ahead") + F.row_number().over(r.local)))  # ties stay as numbered
    step, there = (by, F.col("__n") > by) if n.func == "LAG" else (-by, F.col("__n") <= F.col("__total") - by)
    moved = df.select((F.col("__n") + step).alias("__n"), args[0].alias("__v"))
    value = F.when(there, F.col("__v"))
    if len(args) > 2:
        value = value.otherwise(args[2])
    new = _new(s, n.name)
    return Scope(df.join(moved, "__n", "left").select(*[x.id for x in s.cols], value.alias(new.id)), (*s.cols, new))


def wide_sessions(s: Scope, x, gap, name: str) -> Scope:
    """Sessions over all rows.  A range begins with the largest value before
    it as its predecessor, and with the sessions opened before it."""
    r = Ranges(s, [x.asc_nulls_last()], __most=F.max(x))
    df = r.joined(__last=F.max("__most"))
    opens = F.coalesce((x > F.coalesce(F.lag(x).over(r.local), F.col("__last")) + gap).cast("int"), F.lit(0))
    r.df, r.sums = df.withColumn("__open", opens).drop("__total", "__ahead", "__last"), {"__rows": F.count(F.lit(1)), "__opened": F.sum("__open")}
    df = r.joined(__before=F.sum("__opened"))
    value = F.coalesce("__before", F.lit(0)) + F.sum("__open").over(r.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + 1
    new = _new(s, name)
    return Scope(df.select(*[k.id for k in s.cols], value.cast("bigint").alias(new.id)), (*s.cols, new))


def _wide_running(lo: Lowering, s: Scope, n: ir.Rolling, outer) -> Scope:
    """A running aggregate over all rows: within ranges, and of the ranges
    before."""
    x = lo.value(n.arg, s, outer)
    part, up = {"SUM": (F.sum, F.sum), "COUNT": (F.count, F.sum), "MIN": (F.min, F.min), "MAX": (F.max, F.max)}[n.func]
    r = Ranges(s, lo.sort_columns(n.keys, s, outer), __part=part(x))
    df = r.joined(__before=up("__part"))
    own, before = part(x).over(r.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__before")
    if n.func in ("SUM", "COUNT"):
        value = F.when(own.isNull(), before).when(before.isNull(), own).otherwise(own + before)
    else:
        value = F.least(own, before) if n.func == "MIN" else F.greatest(own, before)
    new = _new(s, n.name)
    return Scope(df.select(*[k.id for k in s.cols], value.alias(new.id)), (*s.cols, new))


#: Rows of a stretch that one task frames, about.
STRETCH = 200_000


def _wide_rows(lo: Lowering, s: Scope, keys, frame: ir.WinFrame, value, name: str, outer) -> Scope:
    """A frame of so many rows before and after, over all rows: stretches of
    the order, each with the rows of its neighbours that its frames reach."""
    first, last = _rows(frame.lo), _rows(frame.hi)
    r = Ranges(s, lo.sort_columns(keys, s, outer))
    df = cut(r.joined().select(*[x.id for x in s.cols], (F.col("__ahead") + F.row_number().over(r.local) - 1).cast("bigint").alias("__n")))  # ties stay as numbered
    size = max(STRETCH, abs(first), abs(last))
    stretch = lambda n: F.floor(n / size).cast("bigint")
    own = stretch(F.col("__n"))
    seen = F.sequence(F.least(own, F.greatest(stretch(F.col("__n") - last), F.lit(0))), F.greatest(own, stretch(F.col("__n") - first)))
    df = df.withColumn("__own", own).withColumn("__w", F.explode(seen))
    new = _new(s, name)
    w = Window.partitionBy("__w").orderBy("__n").rowsBetween(first, last)
    df = df.withColumn(new.id, value(lambda f: f.over(w))).filter(F.col("__w") == F.col("__own"))
    return Scope(df.select(*[x.id for x in s.cols], new.id), (*s.cols, new))


def _is_bounded(frame: ir.WinFrame | None) -> bool:
    return frame is not None and frame.unit == "rows" and all(b.kind not in ("first", "last") for b in (frame.lo, frame.hi))


def _wide_value(lo: Lowering, s: Scope, n: ir.Window, args: list, frame: ir.WinFrame, f, outer) -> Scope | None:
    """FIRST_VALUE from the first row on (one broadcast row), LAST_VALUE up
    to the peers of a row (which share a range), and bounded frames."""
    if _is_bounded(frame):
        return _wide_rows(lo, s, n.keys, frame, lambda run: run(f), n.name, outer)
    order = lo.sort_columns(n.keys, s, outer)
    if n.func == "FIRST_VALUE" and frame.lo.kind == "first" and frame.hi.kind in ("current", "last"):
        new = _new(s, n.name)
        one = s.df.orderBy(*order).limit(1).select(args[0].alias(new.id))
        return Scope(s.df.join(F.broadcast(one), how="cross"), (*s.cols, new))
    if n.func == "LAST_VALUE" and frame.unit == "range" and (frame.lo.kind, frame.hi.kind) == ("first", "current"):
        r = Ranges(s, order)
        new = _new(s, n.name)
        value = F.last(args[0]).over(r.local.rangeBetween(Window.currentRow, Window.currentRow))
        return Scope(r.df.select(*[x.id for x in s.cols], value.alias(new.id)), (*s.cols, new))
    return None


@handles(ir.Rolling)
def _rolling(lo: Lowering, n: ir.Rolling, outer) -> Scope:
    s = lo.finite(n.input, outer)
    if n.frame.unit == "range" and len(n.keys) != 1:
        raise AlgebraError("a RANGE frame has one sort key")
    if not n.per and n.keys and n.func in ("SUM", "COUNT", "MIN", "MAX") and (n.frame.unit, n.frame.lo.kind, n.frame.hi.kind) == ("rows", "first", "current") and is_wide(s):
        return _wide_running(lo, s, n, outer)
    x = lo.value(n.arg, s, outer)

    def value(run):
        if n.func == "AVG" and not isinstance(lo.type(x, s), (T.DoubleType, T.FloatType)):
            total, count = run(F.sum(x)), run(F.count(x))
            return F.when(count > 0, F.round(total.cast("decimal(38,10)") / count, 10))
        return run(aggregates.build(lo, ir.Agg(n.func, (n.arg,), False, (), None, None), s, outer))

    if not n.per and n.keys and _is_bounded(n.frame) and is_wide(s):
        return _wide_rows(lo, s, n.keys, n.frame, value, n.name, outer)
    return s.add(value(lambda f: over(lo, s, f, n.per, n.keys, n.frame, outer)), n.name)


@handles(ir.Window)
def _window(lo: Lowering, n: ir.Window, outer) -> Scope:
    s = lo.finite(n.input, outer)
    args = [lo.value(a, s, outer) for a in n.args]
    lits = [a.value if isinstance(a, ir.Lit) else None for a in n.args]
    plain = _spec(lo, s, n.per, n.keys, None, outer)
    if n.func == "NTILE" and (not isinstance(lits[0], int) or lits[0] < 1):
        raise AlgebraError("NTILE takes a whole number from 1")
    if not n.per and (n.func in _RANKS or n.func == "NTILE") and is_wide(s):
        return _wide_rank(lo, s, n, outer)
    if n.func in _RANKS:
        value = _RANKS[n.func]().over(plain)
    elif n.func == "NTILE":
        value = F.ntile(lits[0]).over(plain)
    elif n.func in ("LAG", "LEAD"):
        by = lits[1] if len(args) > 1 else 1
        if not isinstance(by, int) or by < 1:
            raise AlgebraError(f"{n.func} takes a whole number from 1")
        if not n.per and is_wide(s):
            return _wide_shift(lo, s, n, args, by, outer)
        moved = (F.lag if n.func == "LAG" else F.lead)(args[0], by).over(plain)
        if len(args) > 2:
            there = (F.lag if n.func == "LAG" else F.lead)(F.lit(True), by).over(plain)
            moved = F.when(there.isNull(), args[2]).otherwise(moved)
        value = moved
    elif n.func in ("FIRST_VALUE", "LAST_VALUE", "NTH_VALUE"):
        if n.func == "NTH_VALUE" and (not isinstance(lits[1], int) or lits[1] < 1):
            raise AlgebraError("NTH_VALUE takes a whole number from 1")
        f = {"FIRST_VALUE": lambda: F.first(args[0]), "LAST_VALUE": lambda: F.last(args[0]), "NTH_VALUE": lambda: F.nth_value(args[0], lits[1])}[n.func]()
        frame = n.frame or ir.WinFrame("range", ir.Bound("first", None), ir.Bound("current", None))
        if not n.per and n.keys and is_wide(s):
            wide = _wide_value(lo, s, n, args, frame, f, outer)
            if wide is not None:
                return wide
        if frame.unit == "range" and all(b.kind in ("first", "last", "current") for b in (frame.lo, frame.hi)):
            names = {"first": Window.unboundedPreceding, "last": Window.unboundedFollowing, "current": Window.currentRow}
            value = f.over(plain.rangeBetween(names[frame.lo.kind], names[frame.hi.kind]))
        else:
            value = over(lo, s, f, n.per, n.keys, frame, outer)
    else:
        raise AlgebraError(f"no window function {n.func}")
    return s.add(value, n.name)

