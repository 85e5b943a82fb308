"""Joins.  Conditions go to Spark whole, which picks broadcast, sort-merge
or hash joins; as-of, interval and similarity joins are rewritten first so
that they, too, are equi-joins or windows."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators.packed import spread
from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.lower import HANDLERS, Lowering, handles
from tessera.plans.scope import Column, Scope, c, fresh, merged


def common(left: Scope, right: Scope) -> list[tuple[Column, Column]]:
    names = {x.name.lower(): x for x in right.cols}
    return [(x, names[x.name.lower()]) for x in left.cols if x.name.lower() in names]


def conjuncts(p: ir.Expr) -> list[ir.Expr]:
    return conjuncts(p.left) + conjuncts(p.right) if isinstance(p, ir.And) else [p]


@handles(ir.Join)
def _join(lo: Lowering, n: ir.Join, outer) -> Scope:
    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    if n.using is not None:
        if n.kind == "inner" and not outer:
            left, right = _dealt(left, right)
        return _using(n.kind, left, right, [(left.column(u), right.column(u)) for u in n.using])
    if n.pred is None:
        pairs = common(left, right)
        if not pairs:
            raise AlgebraError("a natural join needs a common column")
        on = _equal(pairs)
        if not outer:
            left, right = _dealt(left, right)
        out = (*[replace(x, quals=x.quals | next((r.quals for q, r in pairs if q is x), frozenset())) for x in left.cols], *[x for x in right.cols if all(x is not r for _, r in pairs)])
        return Scope(left.df.join(right.df, on).select(*[x.id for x in out]), out)
    both = Scope(left.df, merged(left, right))
    if n.kind in ("semi", "anti", "universal"):
        p = lo.value(n.pred, _pair(left, right), outer)
        if n.kind == "universal":
            p = ~F.coalesce(p, F.lit(False))
        return left.with_df(left.df.join(right.df, p, "left_semi" if n.kind == "semi" else "left_anti"))
    similar = _similarity(n.pred, left, right, lambda q: lo.value(q, _pair(left, right), outer)) if n.kind == "inner" else None
    p = lo.value(n.pred, _pair(left, right), outer)
    if similar is not None:
        return Scope(similar(p).select(*[x.id for x in both.cols]), both.cols)
    return Scope(left.df.join(right.df, p, n.kind), both.cols)


#: Bytes, by Catalyst's estimate, of tables that few tasks read: below the
#: first there is little to join, beyond the second there are tasks enough.
LITTLE, MUCH = 1 << 20, 128 << 20


def _bytes(df) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(left: Scope, right: Scope) -> tuple[Scope, Scope]:
    """The two sides of a join on equal columns.  Where keys repeat on both,
    a small table can give any number of rows: the larger side, which Spark
    would stream from as few tasks as its file has parts, is dealt out."""
    sizes = [_bytes(s.df) for s in (left, right)]
    if not LITTLE < max(sizes) <= MUCH:
        return left, right
    if sizes[0] >= sizes[1]:
        return left.with_df(spread(left.df)), right
    return left, right.with_df(spread(right.df))


class _Both(Scope):
    """The columns of two relations; types are looked up in their product."""


def _pair(left: Scope, right: Scope) -> Scope:
    return _Both(left.df.join(right.df, how="cross"), (*left.cols, *[replace(x, name=m.name) if not x.quals else x for x, m in zip(right.cols, merged(left, right)[len(left.cols) :])]))


def _equal(pairs: list[tuple[Column, Column]]):
    out = None
    for a, b in pairs:
        e = c(a) == c(b)
        out = e if out is None else out & e
    return out


def _using(kind: str, left: Scope, right: Scope, pairs) -> Scope:
    df = left.df.join(right.df, _equal(pairs), kind)
    keys = []
    for a, b in pairs:
        k = Column(fresh(a.name), a.name, a.quals | b.quals)
        df = df.withColumn(k.id, F.coalesce(c(a), c(b)) if kind == "full" else c(b) if kind == "right" else c(a))
        keys.append(k)
    rest = merged(Scope(df, (*keys, *[x for x in left.cols if all(x is not a for a, _ in pairs)])), Scope(df, tuple(x for x in right.cols if all(x is not b for _, b in pairs))))
    return Scope(df.select(*[x.id for x in rest]), rest)


@handles(ir.Product)
def _product(lo: Lowering, n: ir.Product, outer) -> Scope:
    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    cols = merged(left, right)
    return Scope(left.df.crossJoin(right.df), cols)


@handles(ir.Compose)
def _compose(lo: Lowering, n: ir.Compose, outer) -> Scope:
    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    pairs = common(left, right)
    out = (*[x for x in left.cols if all(x is not a for a, _ in pairs)], *[x for x in right.cols if all(x is not b for _, b in pairs)])
    if not pairs or not out:
        raise AlgebraError("a composition needs shared columns, and others")
    return Scope(left.df.join(right.df, _equal(pairs)).select(*[x.id for x in out]), out)


@handles(ir.Lateral)
def _lateral(lo: Lowering, n: ir.Lateral, outer) -> Scope:
    left = lo.finite(n.left, outer)
    right = lo.finite(n.right, (left, *outer))
    cols = merged(left, right)
    if n.outer:
        return Scope(left.df.lateralJoin(right.df, F.lit(True), "left"), cols)
    return Scope(left.df.lateralJoin(right.df), cols)


# Similarity --------------------------------------------------------------------
#: Share of rows from which a token counts as common.
COMMON = 0.01


def _tokens(x, of):
    """The pieces of a text, each with how often it stood before: a set."""
    pieces = of(x)
    return F.transform(pieces, lambda g, i: F.concat(g, F.lit("\x01"), F.size(F.filter(F.slice(pieces, F.lit(1), i), lambda h: h == g)).cast("string")))


def _trigrams(x):
    padded = F.concat(F.lit("  "), F.lower(x), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.char_length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))


def _letters(x):
    return F.filter(F.split(x, ""), lambda ch: ch != "")


def _similarity(p: ir.Expr, left: Scope, right: Scope, value):
    """A plan for joins on a similarity of two columns: rows meet on what any
    pair that passes must share, and the whole condition is checked there.

    The pieces of a text are put in one order, the common ones last; a pair
    that passes shares one of the first of each, as many as cannot all be
    missed.  Trigram(a, b) >= t: sets of trigrams.  EditSimilarity(a, b) >= t
    and Levenshtein(a, b) <= k: an edit changes three trigrams at most; texts
    too short for that meet on lengths.  JaroWinkler(a, b) >= t, t > 0.8: so
    many letters match, and what they allow is checked before the score is.
    """
    for q in conjuncts(p):
        if not (isinstance(q, ir.Cmp) and isinstance(q.left, ir.Call) and isinstance(q.right, ir.Lit) and len(q.left.args) == 2 and all(isinstance(a, ir.Ref) for a in q.left.args)):
            continue
        name, t = q.left.name, q.right.value
        ends = [(left.find(a.parts), right.find(a.parts)) for a in q.left.args]
        if ends[0][0] and ends[1][1] and not ends[0][0][1] and not ends[1][1][1]:
            a, b = ends[0][0][0], ends[1][1][0]
        elif ends[1][0] and ends[0][1] and not ends[1][0][1] and not ends[0][1][1]:
            a, b = ends[1][0][0], ends[0][1][0]
        else:
            continue
        size = lambda x: F.char_length(c(x))
        if name == "EDITSIMILARITY" and q.op in (">=", ">") and 0 < t <= 1:
            t = float(t)
            edits = lambda x: F.floor(size(x) * ((1 - t) / t) + 1e-9).cast("int")
            band = F.sequence(F.ceil(size(b) * t - 1e-9).cast("int"), F.floor(size(b) / t + 1e-9).cast("int"))
            return _by_texts(left, right, a, b, edits, band, value(q))
        if name == "LEVENSHTEIN" and q.op in ("<=", "<"):
            return _by_texts(left, right, a, b, lambda x: F.lit(int(t)), F.sequence(F.greatest(size(b) - int(t), F.lit(0)), size(b) + int(t)), value(q))
        if name == "TRIGRAM" and q.op in (">=", ">") and 0 < t <= 1:
            t = float(t)
            # |A n B| >= t |A u B| >= t |A|
            return lambda cond: _by_tokens(left, right, a, b, lambda x: scalar.trigrams(c(x)), lambda g, x: F.size(g) - F.ceil(F.size(g) * t - 1e-9).cast("int") + 1, cond)
        if name == "JAROWINKLER" and q.op in (">=", ">") and 0.8 < t <= 1:
            t = float(t)
            jaro = (t - 0.4) / 0.6  # a common start adds 0.4 of what lacks, at most
            share = 3 * jaro - 2  # of a text's letters, that match
            tokens = lambda x: _tokens(c(x), _letters)
            match = F.size(F.array_intersect(tokens(a), tokens(b)))
            most = (match / F.greatest(size(a), F.lit(1)) + match / F.greatest(size(b), F.lit(1)) + 1) / 3
            start = F.lit(0)
            for i in range(4, 0, -1):
                start = F.when(F.substr(c(a), F.lit(i), F.lit(1)).eqNullSafe(F.substr(c(b), F.lit(i), F.lit(1))) & (size(a) >= i), 1 + start).otherwise(0)
            may = ((size(a) == 0) & (size(b) == 0)) | (most + F.when(most >= 0.7, 0.1 * start * (1 - most)).otherwise(0) >= t - 1e-9)
            return lambda cond: _by_tokens(left, right, a, b, tokens, lambda g, x: F.size(g) - F.ceil(F.size(g) * share - 1e-9).cast("int") + 1, cond, may, empty=True)
    return None


def _by_tokens(left: Scope, right: Scope, a: Column, b: Column, tokens, many, cond, may=None, empty: bool = False):
    """Joins rows that share one of the first ``many`` of their tokens, each
    pair once; with ``empty`` texts without tokens meet each other too."""
    x, y = left.df.withColumn("__g", tokens(a)), right.df.withColumn("__h", tokens(b))
    n = y.count()
    often = y.select(F.explode("__h").alias("t")).groupBy("t").count().where(F.col("count") > max(2, n * COMMON)).collect()  # tokens of a row / COMMON at most
    rank = F.from_json(F.lit(_json({r.t: r["count"] for r in often})), "map<string,int>") if often else None

    def first(g, x):
        ordered = F.transform(F.array_sort(F.transform(g, lambda k: F.struct((F.coalesce(F.try_element_at(rank, k), F.lit(0)) if rank is not None else F.lit(0)).alias("n"), k.alias("k")))), lambda e: e["k"])
        return F.slice(ordered, F.lit(1), F.greatest(many(g, x), F.lit(0)))

    x, y = x.withColumn("__f", first(F.col("__g"), a)), y.withColumn("__e", first(F.col("__h"), b))
    if empty:
        none = F.array(F.lit(""))
        x, y = x.withColumn("__f", F.when(F.size("__g") == 0, none).otherwise(F.col("__f"))), y.withColumn("__e", F.when(F.size("__h") == 0, none).otherwise(F.col("__e")))
    x, y = x.withColumn("__k", F.explode("__f")), y.withColumn("__l", F.explode("__e"))
    once = F.col("__k") == F.get(F.array_intersect("__f", "__e"), F.lit(0))
    on = (F.col("__k") == F.col("__l")) & once
    met = x.join(y, on & may if may is not None else on)
    return met.filter(cond).drop("__g", "__f", "__k", "__h", "__e", "__l")


def _json(d: dict) -> str:
    import json

    return json.dumps(d)


def _by_texts(left: Scope, right: Scope, a: Column, b: Column, edits, band, test):
    """Different texts meet once, however many rows hold them; rows join the
    pairs of texts that pass, and the whole condition is checked there."""

    def plan(cond):
        x, y = Scope(left.df.select(c(a)).distinct(), (a,)), Scope(right.df.select(c(b)).distinct(), (b,))
        met = _by_edits(x, y, a, b, edits, band)(test).select(c(a).alias("__s"), c(b).alias("__t"))
        return spread(left.df.join(met, c(a) == F.col("__s"))).join(right.df, c(b) == F.col("__t")).filter(cond).drop("__s", "__t")

    return plan


def _by_edits(left: Scope, right: Scope, a: Column, b: Column, edits, band):
    # Texts have one trigram more than letters; three are lost by an edit.
    long = lambda x: F.char_length(c(x)) + 1 > 3 * edits(x)

    def plan(cond):
        x, y = Scope(left.df.filter(long(a)), left.cols), Scope(right.df.filter(long(b)), right.cols)
        out = _by_tokens(x, y, a, b, lambda k: _tokens(c(k), _trigrams), lambda g, k: 3 * edits(k) + 1, cond)
        z = right.df.withColumn("__n", F.explode(band))
        short = left.df.withColumn("__m", F.char_length(c(a))).join(z, (F.col("__m") == F.col("__n")) & ~(long(a) & long(b)) & cond)
        return out.unionByName(short.drop("__m", "__n"))

    return plan


# As-of ----------------------------------------------------------------------------
@handles(ir.AsOf)
def _asof(lo: Lowering, n: ir.AsOf, outer) -> Scope:
    """The nearest right row: one window over both sides in order, not a
    range join.  Left rows and right rows share partitions by the equality
    keys (without keys and with much data, ranges of the order); the last
    right row seen so far is carried along."""
    from tessera.operators.windows import Ranges, is_wide

    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    both = _pair(left, right)
    keys, at = [], None
    for q in conjuncts(n.pred):
        if not isinstance(q, ir.Cmp):
            raise AlgebraError("an as-of condition is equalities and one inequality")
        op, a, b = q.op, q.left, q.right
        if _reads(a, right, left) and _reads(b, left, right):
            op, a, b = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op), b, a
        x, y = lo.value(a, left, outer), lo.value(b, right, outer)
        if op == "=":
            keys.append((x, y))
        elif op in ("<", ">", "<=", ">="):
            if at is not None:
                raise AlgebraError("an as-of condition has one inequality")
            at = op, x, y
        else:
            raise AlgebraError("an as-of condition is equalities and one inequality")
    if at is None:
        raise AlgebraError("an as-of condition needs an inequality")
    op, lv, rv = at
    lv, rv = lo._alike(lv, rv, both)
    ks = [f"__k{i}" for i in range(len(keys))]
    rid = [x.id for x in right.cols]
    r = right.df.withColumns({"__v": rv, **{k: y for k, (_, y) in zip(ks, keys)}}).filter("__v is not null")
    for k in ks:
        r = r.filter(F.col(k).isNotNull())
    # Of right rows with one value the tie keeps the first or the last to arrive.
    tie = F.monotonically_increasing_id()
    row = F.struct(*rid)
    r = r.select(*ks, "__v", tie.alias("__q"), row.alias("__r"))
    pick = F.min_by if n.ties == "FIRST" else F.max_by
    r = r.groupBy(*ks, "__v").agg(pick("__r", "__q").alias("__r"))
    el = left.df.withColumns({"__v": lv, **{k: x for k, (x, _) in zip(ks, keys)}})
    backward = op in (">", ">=")
    # On a tie between sides: equal right rows count for >= and <=, not for > and <.
    side_left = 1 if (op in (">=",)) or op == "<=" else 0
    el = el.select(*ks, "__v", F.lit(side_left).alias("__s"), F.lit(True).alias("__is"), F.struct(*[x.id for x in left.cols]).alias("__l"), F.lit(None).cast(r.schema["__r"].dataType).alias("__r"))
    rr = r.select(*ks, "__v", F.lit(1 - side_left).alias("__s"), F.lit(False).alias("__is"), F.lit(None).cast(el.schema["__l"].dataType).alias("__l"), "__r")
    w = Window.partitionBy(*ks) if ks else Window.partitionBy(F.lit(0))
    order = F.col("__v").asc() if backward else F.col("__v").desc()
    w = w.orderBy(order, "__s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = F.last(F.when(~F.col("__is"), F.struct(F.col("__v").alias("v"), F.col("__r").alias("r"))), ignorenulls=True).over(w)
    good = F.col("__v").isNotNull()
    for k in ks:
        good = good & F.col(k).isNotNull()
    out = el.union(rr)
    if not ks and (is_wide(left) or is_wide(right)):
        # In ranges of the order; what stands before a range is its row's.
        pair = F.when(~F.col("__is"), F.struct(F.col("__v").alias("v"), F.col("__r").alias("r")))
        at = F.when(~F.col("__is"), F.col("__v"))
        ranges = Ranges(Scope(out, ()), [order, F.col("__s").asc()], __last=F.max_by(pair, at) if backward else F.min_by(pair, at))
        out = ranges.joined(__past=F.last("__last", ignorenulls=True))
        seen = F.coalesce(F.last(pair, ignorenulls=True).over(ranges.local.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("__past"))
    out = out.withColumn("__m", seen).filter("__is").withColumn("__m", F.when(good, F.col("__m")))
    if n.within is not None:
        d = lo.value(n.within, left, outer)
        gap = (F.col("__v") - F.col("__m.v")) if backward else (F.col("__m.v") - F.col("__v"))
        out = out.withColumn("__m", F.when(gap <= d, F.col("__m")))
    if n.inner:
        out = out.filter("__m is not null")
    df = out.select(*[F.col("__l").getField(x.id).alias(x.id) for x in left.cols], *[F.col("__m").getField("r").getField(x).alias(x) for x in rid])
    return Scope(df, merged(left, right))


def _reads(e: ir.Expr, own: Scope, other: Scope) -> bool:
    refs = [x.parts for x in ir.walk(e) if isinstance(x, ir.Ref)]
    return bool(refs) and all(own.find(p) for p in refs) and not (all(other.find(p) for p in refs) and all(len(p) == 1 for p in refs))


# Intervals ----------------------------------------------------------------------
def _allen(relation: str, a, b, x, y):
    return {
        "INTERSECTS": (a < y) & (x < b),
        "OVERLAPS": (a < x) & (x < b) & (b < y),
        "OVERLAPPED_BY": (x < a) & (a < y) & (y < b),
        "DURING": (x < a) & (b < y),
        "CONTAINS": (a < x) & (y < b),
        "STARTS": (a == x) & (b < y),
        "STARTED_BY": (a == x) & (y < b),
        "FINISHES": (b == y) & (x < a),
        "FINISHED_BY": (b == y) & (a < x),
        "EQUALS": (a == x) & (b == y),
        "MEETS": b == x,
        "MET_BY": a == y,
        "PRECEDES": b < x,
        "PRECEDED_BY": y < a,
    }[relation]


#: What a relation is from the other side.
_CONVERSE = {"INTERSECTS": "INTERSECTS", "OVERLAPS": "OVERLAPPED_BY", "OVERLAPPED_BY": "OVERLAPS", "DURING": "CONTAINS", "CONTAINS": "DURING"}


def _begins(relation: str, x, y, longest, shortest):
    """Between which numbers ``a`` lies if ``a, b`` is in the relation to
    ``x, y`` and ``shortest <= b - a <= longest``."""
    return {
        "INTERSECTS": (x - longest, y),
        "OVERLAPS": (x - longest, F.least(x, y - shortest)),
        "OVERLAPPED_BY": (F.greatest(x, y - longest), y),
        "DURING": (x, y - shortest),
        "CONTAINS": (y - longest, x),
    }[relation]


@handles(ir.IntervalJoin)
def _interval(lo: Lowering, n: ir.IntervalJoin, outer) -> Scope:
    """Pairs of intervals in one of Allen's relations.

    Relations with an equality are equi-joins.  Those in which the intervals
    share points meet in buckets: an interval's level is the power of two that
    its length fits in, and two intervals meet at the higher of their levels.
    There an interval of the larger side goes to one bucket, that of its begin,
    and one of the smaller side to those in which such begins can lie, four at
    most; so each pair meets once, and a row is sent a few times a
    level that occurs, however long others are.  PRECEDES and PRECEDED_BY have
    no bound and stay range joins.
    """
    left, right = lo.finite(n.left, outer), lo.finite(n.right, outer)
    ends = [lo.value(r, s, outer) for r, s in zip(n.columns, (left, left, right, right))]
    types = [lo.type(e, s) for e, s in zip(ends, (left, left, right, right))]
    from pyspark.sql import types as T

    number = all(isinstance(t, T.NumericType) for t in types)
    if any(isinstance(t, T.StringType) for t in types):
        ends = [e.cast("timestamp") if isinstance(t, T.StringType) else e for e, t in zip(ends, types)]
    a, b, x, y = ends
    cols = merged(left, right)
    l, r = left.df.filter(a.isNotNull() & b.isNotNull()), right.df.filter(x.isNotNull() & y.isNotNull())
    test = _allen(n.relation, a, b, x, y)
    if n.relation not in _CONVERSE:
        return Scope(l.join(r, test), cols)
    sizes, relation = [_bytes(d) for d in (l, r)], n.relation
    if sizes[0] < sizes[1]:
        l, r, a, b, x, y, relation = r, l, x, y, a, b, _CONVERSE[relation]
    axis = (lambda e: e.cast("double")) if number else (lambda e: F.unix_micros(e.cast("timestamp")).cast("double"))
    level = lambda p, q: F.ceil(F.log2(F.abs(axis(q) - axis(p)))).cast("int")  # noqa: E731  (null for points)
    far = lambda p, q: F.greatest(F.abs(axis(p)), F.abs(axis(q)))
    # A row for each level.
    sides = [d.groupBy(level(p, q).alias("k")).agg(F.max(far(p, q)).alias("far"), F.max(axis(q) - axis(p)).alias("longest"), F.min(axis(q) - axis(p)).alias("shortest")).collect() for d, p, q in ((l, a, b), (r, x, y))]
    # Buckets of an interval are numbers that a double holds exactly.
    top = max([g.far for side in sides for g in side if g.far] or [1.0])
    least = max(math.ceil(math.log2(top)) - 50, min([g.k for side in sides for g in side if g.k is not None] or [0]))
    put = lambda k: least if k is None else max(k, least)
    levels = [sorted({put(g.k) for g in side}) for side in sides]
    if not all(levels):
        return Scope(l.join(r, F.lit(False)).select(*[k.id for k in cols]), cols)
    # Levels at which rows of both sides can meet, and the lengths of the larger side that do.
    ks = [k for k in sorted({*levels[0], *levels[1]}) if k >= max(levels[0][0], levels[1][0])]
    lengths = {k: [(g.longest, g.shortest) for g in sides[0] if put(g.k) <= k] for k in ks}
    many = len(ks) > 1

    def dealt(d, p, q, others, mark):
        """A row for each level at which the interval can meet others."""
        if not many:
            return d, F.lit(ks[0])
        own = F.greatest(F.coalesce(level(p, q), F.lit(least)), F.lit(least))
        its = F.filter(F.array(*[F.lit(k) for k in ks]), lambda k: (k == own) | (k > own) & k.isin(others))
        d = d.withColumn(f"__k{mark}", F.explode(its))
        return d.withColumn(f"__own{mark}", F.col(f"__k{mark}") == own), F.col(f"__k{mark}")

    def of(k, values):
        return F.lit(values[ks[0]]) if not many else F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), k)

    at = lambda e, k: F.floor(e / of(k, {k: 2.0**k for k in ks})).cast("bigint")
    l, k = dealt(l, a, b, levels[1], 0)
    l = l.withColumn("__b0", at(axis(a), k))
    r, k = dealt(r, x, y, levels[0], 1)
    low, high = _begins(relation, axis(x), axis(y), of(k, {k: max(v for v, _ in lengths[k]) for k in ks}), of(k, {k: min(v for _, v in lengths[k]) for k in ks}))
    # The bounds are no begins themselves: of whole numbers the next is one off.
    exact = top < 2.0**51 and (not number or all(isinstance(t, T.IntegralType) for t in types))
    off = 1.0 if exact else -top * 2.0**-50
    low, high = at(low + off, k), at(high - off, k)
    r = r.withColumn("__b1", F.explode(F.when(low <= high, F.sequence(low, high))))
    met = (F.col("__b0") == F.col("__b1")) & test
    if many:
        met = (F.col("__k0") == F.col("__k1")) & (F.col("__own0") | F.col("__own1")) & met
    if max(sizes) > LITTLE:  # pairs are many more than rows: by all cores, and not by chains of a hash table
        r = r.hint("merge")
    return Scope(l.join(r, met).select(*[k.id for k in cols]), cols)
