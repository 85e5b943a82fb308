"""From the algebra to DataFrames.

One handler for each operator builds a lazy plan; Catalyst, adaptive
execution and Tungsten choose how it runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from decimal import Decimal

from pyspark.sql import Column as SparkColumn
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import aggregates, durations, scalar
from tessera.plans import ir, rules
from tessera.plans.lexer import AlgebraError
from tessera.plans.scope import Column, Scope, c, fresh

HANDLERS: dict[type, Callable] = {}
#: Operators that cannot run over a stream.
NEEDS_ALL = (ir.Sort, ir.Limit, ir.Top, ir.Window, ir.Rolling, ir.Sessionize, ir.Pivot, ir.Tree, ir.Closure, ir.Cluster, ir.Path, ir.Trace, ir.Fix, ir.Iterate, ir.Shuffle, ir.Solve, ir.Optimize, ir.Cover, ir.Divide, ir.AsOf)
_TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
_EXACT = (T.IntegerType, T.LongType, T.ShortType, T.ByteType, T.DecimalType)
_CASTS = {"NUMBER": "decimal(38,10)", "STRING": "string", "BOOLEAN": "boolean", "DATE": "date", "TIMESTAMP": "timestamp", "TIME": "string"}


def handles(kind: type):
    def add(f):
        HANDLERS[kind] = f
        return f

    return add


class Lowering:
    """One query being lowered: the catalog, parameters, and the names that
    loops have bound."""

    def __init__(self, session, params: dict | None = None):
        self.session, self.spark, self.params = session, session.spark, params or {}
        self.bound: dict[str, Scope] = {}
        #: What queries next to a relation ask of it: a limit, columns, values.
        self.around: tuple[Scope, ...] = ()  # whose columns a value may also name
        self.asked: dict[str, dict] = {}
        self.views: list[str] = []

    # Relations -------------------------------------------------------------
    def rel(self, node: ir.Node, outer: tuple[Scope, ...] = ()) -> Scope:
        if type(node) not in HANDLERS:
            raise AlgebraError(f"{type(node).__name__} cannot be run")
        if isinstance(node, (ir.Limit, ir.Project, ir.Select)):
            self._ask(node)
        s = HANDLERS[type(node)](self, node, outer)
        if isinstance(node, NEEDS_ALL) and s.df.isStreaming:
            raise AlgebraError(f"{type(node).__name__} needs all rows, and a stream has no last one")
        return s

    def _ask(self, n: ir.Node) -> None:
        """Notes what may go into a request: a limit next to the relation, the
        columns of a projection, equalities with values."""
        want: dict = {}
        if isinstance(n, ir.Limit) and n.count is not None and not n.offset and not n.ties:
            want["limit"], n = n.count, n.input
        if isinstance(n, ir.Project):
            want["columns"] = {p.lower() for x in ir.walk(n.items) if isinstance(x, ir.Ref) for p in x.parts}
            n = n.input
        if isinstance(n, ir.Select):
            want.pop("limit", None)
            if "columns" in want:
                want["columns"] |= {p.lower() for x in ir.walk(n.pred) if isinstance(x, ir.Ref) for p in x.parts}
            tests = [q for q in rules.conjuncts(n.pred) if isinstance(q, ir.Cmp) and q.op == "=" and isinstance(q.left, ir.Ref)]
            want["inputs"] = {q.left.parts[-1].lower(): q.right.value if isinstance(q.right, ir.Lit) else self.params.get(q.right.name) for q in tests if isinstance(q.right, (ir.Lit, ir.Param))}
            n = n.input
        if isinstance(n, ir.Relation):
            self.asked.setdefault(".".join(n.name), want)

    def finite(self, node: ir.Node, outer: tuple[Scope, ...] = ()) -> Scope:
        """A relation with an end: operators that need all rows take this."""
        s = self.rel(node, outer)
        if s.endless is not None:
            raise AlgebraError(f"{type(node).__name__} has no end here: limit it first")
        return s

    # Expressions -----------------------------------------------------------
    def value(self, e: ir.Expr, scope: Scope, outer: tuple[Scope, ...] = ()) -> SparkColumn:
        before, self.around = self.around, outer
        try:
            got = self._value(e, scope, outer)
        finally:
            self.around = before
        if isinstance(e, ir.Lit):
            got._tessera_literal = e.value
        return got

    def type(self, col: SparkColumn, scope: Scope) -> T.DataType | None:
        """The type Spark gives a column, or None where it cannot tell yet
        (a value of the row around a subquery)."""
        if self.around:  # Spark logs an error for what it is asked in vain
            text = col._jc.toString()
            if any(x.id in text for s in self.around for x in s.cols):
                return None
        try:
            return scope.df.select(col).schema[0].dataType
        except Exception as e:
            if "UNRESOLVED" in str(e) or "outer" in str(e).lower():
                return None
            raise

    def _value(self, e: ir.Expr, s: Scope, outer: tuple[Scope, ...]) -> SparkColumn:
        v = lambda x: self.value(x, s, outer)
        if isinstance(e, ir.Lit):
            return literal(e)
        if isinstance(e, ir.Ref):
            return self._ref(e.parts, s, outer)
        if isinstance(e, ir.Param):
            if e.name not in self.params:
                raise AlgebraError(f"no value for ${e.name}")
            got = F.lit(self.params[e.name])
            got._tessera_literal = self.params[e.name]
            return got
        if isinstance(e, ir.Bin):
            return self._arithmetic(e, s, outer)
        if isinstance(e, ir.Neg):
            return -v(e.operand)
        if isinstance(e, ir.Call):
            return self._call(e, s, outer)
        if isinstance(e, ir.Cast):
            return self._cast(e, s, outer)
        if isinstance(e, ir.Struct):
            return F.struct(*[v(x).alias(n) for n, x in e.items])
        if isinstance(e, ir.Array):
            return F.array(*map(v, e.items))
        if isinstance(e, ir.Collate):
            return self._collate(v(e.operand), e.collation)
        if isinstance(e, ir.Scalar):
            inner = self.finite(e.rel, (s, *outer))
            if len(inner.cols) != 1:
                raise AlgebraError("a value's subquery has one column")
            return inner.df.select(inner.cols[0].id).scalar()
        if isinstance(e, ir.Cmp):
            return self._compare(e.op, v(e.left), v(e.right), s)
        if isinstance(e, ir.And):
            return v(e.left) & v(e.right)
        if isinstance(e, ir.Or):
            return v(e.left) | v(e.right)
        if isinstance(e, ir.Not):
            if isinstance(e.operand, ir.Quant):
                q = e.operand
                flipped = {"=": "!=", "!=": "=", "<": ">=", ">": "<=", "<=": ">", ">=": "<"}[q.op]
                return self._quantified(ir.Quant(flipped, not q.every, q.operand, q.rel), s, outer)
            return ~v(e.operand)
        if isinstance(e, ir.IsNull):
            return v(e.operand).isNull()
        if isinstance(e, ir.Same):
            a, b = self._alike(v(e.left), v(e.right), s)
            return a.eqNullSafe(b)
        if isinstance(e, ir.Truth):
            p = v(e.operand)
            return p.isNull() if e.value is None else p.eqNullSafe(F.lit(e.value))
        if isinstance(e, ir.InList):
            if not e.items:
                return F.lit(False)
            a = v(e.operand)
            items = [self._alike(a, v(x), s)[1] for x in e.items]
            return a.isin(*items) if all(isinstance(x, ir.Lit) and x.value is not None for x in e.items) else self._any(a, items)
        if isinstance(e, ir.InArray):
            return F.array_contains(v(e.array), v(e.operand))
        if isinstance(e, ir.Like):
            return self._like(e, v)
        if isinstance(e, ir.Regex):
            return F.regexp_like(v(e.operand), F.concat(F.lit("(?si)" if e.fold else "(?s)"), v(e.pattern)))
        if isinstance(e, ir.Exists):
            return self.finite(e.rel, (s, *outer)).df.exists()
        if isinstance(e, ir.Quant):
            return self._quantified(e, s, outer)
        raise AlgebraError(f"{type(e).__name__} is no value")

    @staticmethod
    def _any(a: SparkColumn, items: list[SparkColumn]) -> SparkColumn:
        out = a == items[0]
        for x in items[1:]:
            out = out | (a == x)
        return out

    def _ref(self, parts: tuple[str, ...], s: Scope, outer: tuple[Scope, ...]) -> SparkColumn:
        for depth, scope in enumerate((s, *outer)):
            got = scope.find(parts)
            if got is not None and (depth == 0 or len(parts) > 1):
                col = c(got[0])
                if depth:
                    col = col.outer()
                for field in got[1]:
                    col = col.getField(field)
                return col
        raise AlgebraError(f"no column {'.'.join(parts)}; there are {', '.join(x.name for x in s.cols)}")

    def _alike(self, a: SparkColumn, b: SparkColumn, s: Scope) -> tuple[SparkColumn, SparkColumn]:
        """Text that meets a date, time or boolean is read as one."""
        ta, tb = self.type(a, s), self.type(b, s)
        if isinstance(ta, T.StringType) and isinstance(tb, (*_TEMPORAL, T.BooleanType)):
            return a.cast("timestamp" if isinstance(tb, T.DateType) else tb), b
        if isinstance(tb, T.StringType) and isinstance(ta, (*_TEMPORAL, T.BooleanType)):
            return a, b.cast("timestamp" if isinstance(ta, T.DateType) else ta)
        return a, b

    def _compare(self, op: str, a: SparkColumn, b: SparkColumn, s: Scope) -> SparkColumn:
        a, b = self._alike(a, b, s)
        return {"=": a == b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]

    def _arithmetic(self, e: ir.Bin, s: Scope, outer) -> SparkColumn:
        a, b = self.value(e.left, s, outer), self.value(e.right, s, outer)
        ta, tb = self.type(a, s), self.type(b, s)
        interval = (T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType)
        if e.op in "+-":
            if isinstance(ta, T.StringType) or isinstance(tb, T.StringType):
                if e.op == "-":
                    raise AlgebraError("text cannot be subtracted")
                return F.concat(scalar.plain(a, ta), scalar.plain(b, tb))
            if isinstance(ta, T.DateType) and (isinstance(tb, interval) or isinstance(tb, _TEMPORAL)):
                a = a.cast("timestamp")  # DATE ± DURATION is a TIMESTAMP
            if isinstance(tb, T.DateType) and isinstance(ta, (*interval, *_TEMPORAL)):
                b = b.cast("timestamp")
            return a + b if e.op == "+" else a - b
        if e.op == "*":
            return a * b
        if isinstance(ta, interval):
            if isinstance(tb, interval):
                return scalar._seconds(a) / scalar._seconds(b)
            return a / b
        if isinstance(ta, _EXACT) and isinstance(tb, _EXACT):
            # ten places, halves away from zero; never truncated
            return F.round(a.cast("decimal(38,10)") / (b.cast("decimal(20,0)") if not isinstance(tb, T.DecimalType) else b), 10)
        return a / b

    def _call(self, e: ir.Call, s: Scope, outer) -> SparkColumn:
        own = self.session.functions.get(e.name.lower())
        if own is not None:
            params, body = own
            if len(params) != len(e.args):
                raise AlgebraError(f"{e.name} takes {len(params)} arguments, not {len(e.args)}")
            inputs = {p: a for (p, _), a in zip(params, e.args)}
            return self.value(ir.rewrite(body, lambda x: inputs.get(x.parts[0]) if isinstance(x, ir.Ref) and len(x.parts) == 1 else None), s, outer)
        registered = self.session.builders.get(e.name.lower())
        args = [self.value(a, s, outer) for a in e.args]
        if registered is not None:
            return registered(*args)
        return scalar.build(e.name, args, [self.type(a, s) for a in args])

    def _cast(self, e: ir.Cast, s: Scope, outer) -> SparkColumn:
        a = self.value(e.operand, s, outer)
        t = self.type(a, s)
        if e.type == "TIMESTAMPTZ":
            return scalar.build("TO_TIMESTAMPTZ", [a], [t])
        if e.type not in _CASTS:
            raise AlgebraError(f"no type {e.type}")
        if e.type == "STRING":
            return scalar.plain(a, t)
        if e.type == "NUMBER":
            if isinstance(t, T.NumericType):
                return a
            if isinstance(t, T.BooleanType):
                return a.cast("bigint")
        if e.type == "BOOLEAN":
            return scalar.build("CBOOL", [a], [t])
        return a.cast(_CASTS[e.type])

    @staticmethod
    def _collate(a: SparkColumn, name: str) -> SparkColumn:
        known = {"NOCASE": "UTF8_LCASE", "BINARY": "UTF8_BINARY"}
        return F.collate(a, known.get(name.upper(), name.replace("-", "_")))

    @staticmethod
    def _like(e: ir.Like, v) -> SparkColumn:
        a, p = v(e.operand), v(e.pattern)
        if e.fold:
            a, p = F.lower(a), F.lower(p)
        if e.escape:
            return F.like(a, p, F.lit(e.escape))
        # no escape character: Spark's backslash stands for itself
        return F.like(a, F.replace(p, F.lit("\\"), F.lit("\\\\")))

    def _quantified(self, e: ir.Quant, s: Scope, outer) -> SparkColumn:
        """``x op ANY/ALL (rel)`` with three truth values."""
        inner = self.finite(e.rel, (s, *outer))
        if len(inner.cols) != 1:
            raise AlgebraError("ANY, ALL and IN take one column")
        x = self.value(e.operand, inner, (s, *outer)) if not isinstance(e.operand, ir.Ref) else self._outer_ref(e.operand, s, outer)
        test = self._compare(e.op, x, c(inner.cols[0]), inner)
        test = ~test if e.every else test
        sure, maybe = inner.df.filter(test).exists(), inner.df.filter(F.coalesce(test, F.lit(True))).exists()
        return F.when(sure, F.lit(not e.every)).when(maybe, F.lit(None)).otherwise(F.lit(e.every))

    def _outer_ref(self, e: ir.Ref, s: Scope, outer) -> SparkColumn:
        got = s.find(e.parts)
        if got is None:
            return self._ref(e.parts, s, outer)
        col = c(got[0]).outer()
        for f in got[1]:
            col = col.getField(f)
        return col

    def filter(self, s: Scope, p: ir.Expr, outer) -> Scope:
        """Rows where a predicate is TRUE.  Conjuncts that are subqueries
        become semi and anti joins."""
        if isinstance(p, ir.And):
            return self.filter(self.filter(s, p.left, outer), p.right, outer)
        q, negated = (p.operand, True) if isinstance(p, ir.Not) else (p, False)
        if isinstance(q, ir.Quant):
            if negated:
                q = ir.Quant({"=": "!=", "!=": "=", "<": ">=", ">": "<=", "<=": ">", ">=": "<"}[q.op], not q.every, q.operand, q.rel)
            if q.every and q.op == "!=" and not outer and (got := self._not_in(s, q)) is not None:
                return got
            inner = self.finite(q.rel, (s, *outer))
            if len(inner.cols) != 1:
                raise AlgebraError("ANY, ALL and IN take one column")
            x = self._outer_ref(q.operand, s, outer) if isinstance(q.operand, ir.Ref) else self.value(q.operand, inner, (s, *outer))
            test = self._compare(q.op, x, c(inner.cols[0]), inner)
            # ALL: no row for which the test is not TRUE
            return s.with_df(s.df.filter(~inner.df.filter(~F.coalesce(test, F.lit(False))).exists() if q.every else inner.df.filter(test).exists()))
        return s.with_df(s.df.filter(self.value(p, s, outer)))

    def _not_in(self, s: Scope, q: ir.Quant) -> Scope | None:
        """NOT IN a relation that reads nothing of ``s``, as an anti join on
        equality; what nulls decide is told by two counts (one broadcast row)."""
        try:
            inner = self.finite(q.rel, ())
        except AlgebraError:  # it reads the row at hand
            return None
        if len(inner.cols) != 1:
            return None
        v = c(inner.cols[0])
        x = self.value(q.operand, s, ())
        counts = F.broadcast(inner.df.agg(F.count(F.lit(1)).alias("__all"), F.count(v).alias("__some")))
        test = self._compare("=", x, v, Scope(s.df.join(inner.df, how="cross"), (*s.cols, *inner.cols)))
        kept = s.df.join(inner.df.where(v.isNotNull()), test, "left_anti").crossJoin(counts)
        return s.with_df(kept.where((F.col("__all") == 0) | (F.col("__all") == F.col("__some")) & x.isNotNull()).select(*[k.id for k in s.cols]))

    def sort_columns(self, keys, s: Scope, outer=()) -> list[SparkColumn]:
        out = []
        for k in keys:
            x = self.value(k.expr, s, outer)
            if k.desc:
                out.append(x.desc_nulls_first() if k.nulls_first else x.desc_nulls_last())
            else:
                out.append(x.asc_nulls_first() if k.nulls_first else x.asc_nulls_last())
        return out


def literal(e: ir.Lit) -> SparkColumn:
    v = e.value
    if e.kind == "number":
        if isinstance(v, Decimal):
            return F.lit(v)
        return F.lit(v) if -(1 << 63) <= v < 1 << 63 else F.lit(Decimal(v))
    if e.kind in ("string", "boolean", "null"):
        return F.lit(v)
    try:
        if e.kind == "date":
            import datetime

            return F.lit(datetime.date.fromisoformat(v))
        if e.kind == "timestamp":
            import datetime

            at = datetime.datetime.fromisoformat(v)
            return F.lit(at.replace(tzinfo=at.tzinfo or datetime.timezone.utc))
        if e.kind == "time":
            import datetime

            return F.lit(datetime.time.fromisoformat(v).strftime("%H:%M:%S.%f"))
    except ValueError as bad:
        raise AlgebraError(f"{v!r} is no {e.kind}") from bad
    if e.kind == "duration":
        return durations.literal(v)
    return scalar.build("TO_TIMESTAMPTZ", [F.lit(v)], [T.StringType()])


def output_name(e: ir.Expr, given: str | None, i: int) -> str:
    if given:
        return given
    if isinstance(e, ir.Ref):
        return e.parts[-1]
    if isinstance(e, ir.Agg):
        arg = e.args[0].parts[-1] if e.args and isinstance(e.args[0], ir.Ref) else ""
        return f"{e.func.lower()}_{arg}" if arg else e.func.lower()
    if isinstance(e, ir.Call):
        return e.name.lower()
    return f"expr{i + 1}"


# Leaves and the unary core ---------------------------------------------------
@handles(ir.Relation)
def _relation(lo: Lowering, n: ir.Relation, outer) -> Scope:
    key = ".".join(n.name)
    if key in lo.bound:
        return lo.bound[key].again()
    s = lo.session.resolve(key, lo)
    quals = frozenset({key.lower(), n.name[-1].lower()})
    s = s if s.endless is not None else s.again()
    return replace(s, cols=tuple(replace(x, quals=quals) for x in s.cols))


@handles(ir.Frame)
def _frame(lo: Lowering, n: ir.Frame, outer) -> Scope:
    return Scope.of(n.df, n.name or "")


@handles(ir.TruthRel)
def _truth(lo: Lowering, n: ir.TruthRel, outer) -> Scope:
    df = lo.spark.range(1 if n.full else 0).select()
    return Scope(df, ())


@handles(ir.TableCall)
def _table_call(lo: Lowering, n: ir.TableCall, outer) -> Scope:
    name = ".".join(n.name)
    found = lo.session.tables.get(name.lower())
    if found is None:
        raise AlgebraError(f"no table-valued function {name}")
    params, body = found
    if callable(body):
        args = [lo.rel(ir.Relation(a.parts), outer).named() if isinstance(a, ir.Ref) and lo.session.known(".".join(a.parts)) else a.value if isinstance(a, ir.Lit) else lo.value(a, Scope(lo.spark.range(1), ()), outer) for a in n.args]
        return Scope.of(body(*args), name)
    if len(params) != len(n.args):
        raise AlgebraError(f"{name} takes {len(params)} arguments, not {len(n.args)}")
    values = {p: a for (p, kind), a in zip(params, n.args) if not isinstance(kind, tuple)}
    rels = {p: a for (p, kind), a in zip(params, n.args) if isinstance(kind, tuple)}

    def put(x):
        if isinstance(x, ir.Ref) and len(x.parts) == 1:
            return values.get(x.parts[0])
        if isinstance(x, ir.Relation) and len(x.name) == 1 and x.name[0] in rels:
            a = rels[x.name[0]]
            if isinstance(a, ir.Ref):
                return ir.Rename(x.name[0], None, None, ir.Relation(a.parts))
            if isinstance(a, ir.Scalar):
                return ir.Rename(x.name[0], None, None, a.rel)
            raise AlgebraError(f"{name} takes a relation for {x.name[0]}")
        return None

    return lo.rel(ir.rewrite(body, put), outer)


@handles(ir.Project)
def _project(lo: Lowering, n: ir.Project, outer) -> Scope:
    s = lo.rel(n.input, outer)
    cols, values = [], []
    for i, (e, given) in enumerate(n.items):
        name = output_name(e, given, i)
        if any(x.name.lower() == name.lower() for x in cols):
            raise AlgebraError(f"the projection has two columns {name}")
        kept = s.find(e.parts) if isinstance(e, ir.Ref) else None
        new = Column(fresh(name), name, kept[0].quals if kept and not kept[1] and not given else frozenset())
        cols.append(new)
        values.append(lo.value(e, s, outer).alias(new.id))
    return Scope(s.df.select(*values), tuple(cols))


@handles(ir.Rename)
def _rename(lo: Lowering, n: ir.Rename, outer) -> Scope:
    s = lo.rel(n.input, outer)
    cols = list(s.cols)
    if n.columns:
        if len(n.columns) != len(cols):
            raise AlgebraError(f"{len(n.columns)} names for {len(cols)} columns")
        cols = [replace(x, name=new, origin=None) for x, new in zip(cols, n.columns)]
    for old, new in n.pairs or ():
        at = cols.index(Scope(s.df, tuple(cols)).column(old))
        cols[at] = replace(cols[at], name=new, origin=None)
    if len({x.name.lower() for x in cols}) < len(cols):
        raise AlgebraError("a rename gives two columns one name")
    if n.name:
        cols = [replace(x, quals=frozenset({n.name.lower()}), origin=None) for x in cols]
    return replace(s, cols=tuple(cols)).again() if s.endless is None else replace(s, cols=tuple(cols))


@handles(ir.Distinct)
def _distinct(lo: Lowering, n: ir.Distinct, outer) -> Scope:
    s = lo.finite(n.input, outer)
    return s.with_df(s.df.distinct())


@handles(ir.Sort)
def _sort(lo: Lowering, n: ir.Sort, outer) -> Scope:
    s = lo.finite(n.input, outer)
    return s.with_df(s.df.orderBy(*lo.sort_columns(n.keys, s, outer)))


@handles(ir.Limit)
def _limit(lo: Lowering, n: ir.Limit, outer) -> Scope:
    if n.ties:
        return HANDLERS[ir.Top](lo, ir.Top(n.count, n.offset, True, n.input.keys, (), n.input.input), outer)
    s = lo.rel(n.input, outer)
    if s.endless is not None:
        if n.count is None:
            raise AlgebraError("endless rows need a count")
        return s.endless(n.count, n.offset)
    df = s.df.offset(n.offset) if n.offset else s.df
    return s.with_df(df if n.count is None else df.limit(n.count))


@handles(ir.Group)
def _group(lo: Lowering, n: ir.Group, outer) -> Scope:
    s = lo.finite(n.input, outer)
    # Calls of aggregates that the host registered read like keys; their
    # columns come before those of built-in ones.
    own = [k for k in n.keys if isinstance(k[0], ir.Call) and k[0].name.lower() in lo.session.aggregates]
    if own and n.sets is not None:
        raise AlgebraError("an aggregate of the host's own takes one set of keys")
    if not own and not n.aggs:
        raise AlgebraError("expected an aggregate")
    if own:
        n = replace(n, keys=tuple(k for k in n.keys if k not in own), aggs=(*[ir.Agg(e.name, e.args, False, (), None, given) for e, given in own], *n.aggs))
    keys = [(lo.value(e, s, outer), output_name(e, given, i), e) for i, (e, given) in enumerate(n.keys)]
    cols = [Column(fresh(name), name, s.find(e.parts)[0].quals if isinstance(e, ir.Ref) and s.find(e.parts) else frozenset()) for _, name, e in keys]
    work = s.df.withColumns({k.id: v for k, (v, _, _) in zip(cols, keys)}) if keys else s.df
    inner = Scope(work, s.cols)
    if any(a.func in ("COLLECT", "ARGMAX", "ARGMIN", "STRING_AGG") for a in n.aggs):
        inner = Scope(work.withColumn("__seq", F.monotonically_increasing_id()), s.cols)
    made = []
    for i, a in enumerate(n.aggs):
        name = output_name(a, a.name, i)
        if any(x.name.lower() == name.lower() for x in cols + [m[0] for m in made]):
            raise AlgebraError(f"the grouping has two columns {name}")
        made.append((Column(fresh(name), name), a))
    plain = [(k, a) for k, a in made if a.func != "GROUPING"]
    values = [aggregates.build(lo, a, inner, outer).alias(k.id) for k, a in plain]
    if n.sets is None:
        if len(plain) < len(made):
            raise AlgebraError("GROUPING needs several sets of keys")
        grouped = inner.df.groupBy(*[k.id for k in cols]).agg(*values)
    else:
        ids = [k.id for k in cols]
        marks = []
        for k, a in made:
            if a.func == "GROUPING":
                at = [ids[[e for e, _ in n.keys].index(x)] for x in a.args]
                bits = F.lit(0)
                for j, key in enumerate(at):
                    bits = bits + F.grouping(key).cast("bigint") * (1 << (len(at) - 1 - j))
                marks.append(bits.alias(k.id))
        sets = [[F.col(ids[k]) for k in one] for one in n.sets]
        grouped = inner.df.groupingSets(sets, *[F.col(i) for i in ids]).agg(*values, *marks)
    out = (*cols, *[k for k, _ in made])
    return Scope(grouped.select(*[x.id for x in out]), out)


@handles(ir.ForAll)
def _forall(lo: Lowering, n: ir.ForAll, outer) -> Scope:
    s = lo.finite(n.input, outer)
    holds = F.coalesce(lo.value(n.pred, s, outer), F.lit(False))
    keys = s.columns(n.keys)
    if not keys:
        broken = s.df.filter(~holds).limit(1)
        return Scope(lo.spark.range(1).join(broken, how="left_anti").select(), ())
    out = s.df.groupBy(*[k.id for k in keys]).agg(F.bool_and(holds).alias("__all")).filter("__all").drop("__all")
    return Scope(out, tuple(keys))


def load() -> None:
    """Registers the handlers of all operator families."""
    from tessera.operators import graph, joins, nested, provenance, random, search, series, sets, windows  # noqa: F401
