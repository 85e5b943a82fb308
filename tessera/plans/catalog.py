"""What a session holds, as relations: ``sys.relations`` and its kin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.plans import ir
from tessera.plans.lexer import AlgebraError
from tessera.plans.render import label

NAMESPACE = "sys"
SCHEMAS = {
    "relations": "name string, kind string, namespace string, materialization string, row_count bigint, boundedness string",
    "columns": "relation string, column string, type string, ordinal int, distinct_count bigint, null_count bigint",
    "keys": "relation string, key int, ordinal int, column string",
    "functions": "name string, category string, arity int, return_type string, purity string",
    "plan": "query string, node_id int, parent_id int, ordinal int, op string, label string, relation string, schema_code string, materialization string, depth int",
    "dependencies": "dependent string, depends_on string",
    "connections": "name string, dialect string",
    "relationships": "name string, inverse string, source string, source_columns array<string>, target string, target_columns array<string>, source_min int, source_max int, target_min int, target_max int, symmetric boolean",
    "version": "component string, kind string, version string",
    "events": "seq int, stage string, code string, description string, target string, rows bigint, elapsed interval day to second",
    "rules": "seq int, code string, description string, target string",
    "cycles": "name string",
    "unused": "name string",
    "catalog": "name string, kind string, arity int, schema_code string",
}
#: Table-valued functions over the catalog, in the algebra itself.
FUNCTIONS = {
    "deps": ("name", "π depends_on → name (σ dependent = name (CLOSURE dependent, depends_on (sys.dependencies)))"),
    "impact": ("name", "π dependent → name (σ depends_on = name (CLOSURE dependent, depends_on (sys.dependencies)))"),
    "find": ("name", "π relation, type (σ column = name (sys.columns))"),
    "schema": ("name", "π column, type, ordinal (σ relation = name (sys.columns))"),
    "funcs": ("name", "π name → function, arity, return_type (σ category = name (sys.functions))"),
}


def code(t: T.DataType) -> str:
    """A type's short code."""
    if isinstance(t, T.ArrayType):
        return f"[{code(t.elementType)}]"
    if isinstance(t, T.StructType):
        if t.fieldNames() == ["at", "offset_s"]:
            return "TSZ"
        return "{" + ",".join(f"{f.name}:{code(f.dataType)}" for f in t.fields) + "}"
    if isinstance(t, T.NumericType):
        return "N"
    for kind, text in ((T.StringType, "S"), (T.BooleanType, "B"), (T.DateType, "D"), ((T.TimestampType, T.TimestampNTZType), "TS"), ((T.DayTimeIntervalType, T.YearMonthIntervalType), "DUR")):
        if isinstance(t, kind):
            return text
    return "?"


def heading(schema: T.StructType) -> str:
    return "{" + ",".join(f"{f.name}:{code(f.dataType)}" for f in schema.fields) + "}"


def delivery(n: ir.Node) -> str:
    """How much of a relation an operator holds for a row."""
    if isinstance(n, (ir.Sort, ir.Shuffle)):
        return "sort"
    if isinstance(n, (ir.Distinct, ir.Closure, ir.Cluster, ir.Path, ir.Fix, ir.Iterate, ir.ForAll, ir.Divide)) or isinstance(n, ir.SetOp) and n.kind != "uall":
        return "set"
    if isinstance(n, (ir.Group, ir.Top, ir.Window, ir.Rolling, ir.Sessionize, ir.Pivot, ir.Tree, ir.Trace, ir.Solve, ir.Optimize, ir.Cover, ir.Downsample, ir.AsOf, ir.IntervalJoin)):
        return "bag"
    return "stream"


def build(session, name: str) -> DataFrame:
    if name not in SCHEMAS:
        raise AlgebraError(f"no relation {NAMESPACE}.{name}")
    rows = {"relations": _relations, "columns": _columns, "keys": _keys, "functions": _functions, "plan": _plan, "dependencies": _dependencies, "unused": _unused, "cycles": lambda s: [], "catalog": _catalog}.get(name)
    if rows is None:
        rows = {
            "connections": lambda s: [(n, o["from"]) for n, o in s.connections.items()],
            "version": _version,
            "events": lambda s: s.feed,
            "rules": lambda s: [(i, c, d, t) for i, stage, c, d, t, _, _ in s.feed if stage == "OPTIMIZE"],
            "relationships": lambda s: [(n, o["inverse"], a[0], list(a[1]), b[0], list(b[1]), an[0], an[1], bn[0], bn[1], bool(o["symmetric"])) for n, (a, an, b, bn), o in s.edges],
        }[name]
    return session.spark.createDataFrame(rows(session), SCHEMAS[name])


def _relations(s):
    return [(r.name, r.kind, s.namespace, delivery(r.body) if r.kind == "QR" else "stream", r.rows, _bounded(s, r)) for r in s.relations.values()]


def _bounded(s, r) -> str:
    if r.kind == "QR":
        try:
            return "unbounded" if s.scope(r.name).endless is not None else "bounded"
        except AlgebraError:
            return "unbounded"
    return "unbounded" if r.endless else "bounded"


def _columns(s):
    out = []
    for r in s.relations.values():
        try:
            fields = s.scope(r.name).named().schema.fields
        except AlgebraError:
            continue
        stats = s.statistics(r)
        out += [(r.name, f.name, code(f.dataType), i, *stats.get(f.name, (None, None))) for i, f in enumerate(fields)]
    return out


def _keys(s):
    out = []
    for r in s.relations.values():
        if r.rows is None:
            continue
        unique = [c for c, (distinct, nulls) in s.statistics(r).items() if distinct == r.rows and not nulls]
        out += [(r.name, i, 0, c) for i, c in enumerate(unique)]
    return out


def _functions(s):
    from tessera.functions import scalar

    out = [(n.lower(), scalar.category(n), least if most == least else None, None, "VOLATILE" if n in scalar.VOLATILE else "PURE_DETERMINISTIC") for n, (least, most, _) in sorted(scalar.REGISTRY.items())]
    return out + [(n, "user", len(ps), None, "PURE_DETERMINISTIC") for n, (ps, _) in s.functions.items()]


def _nodes(n: ir.Node, parent=None, ordinal=0, depth=0, out=None):
    out = [] if out is None else out
    me = len(out)
    out.append((me, parent, ordinal, depth, n))
    children = [v for f in n.__dataclass_fields__ if isinstance(v := getattr(n, f), ir.Node)]
    for i, child in enumerate(children):
        _nodes(child, me, i, depth + 1, out)
    return out


def _plan(s):
    out = []
    for r in s.relations.values():
        if r.kind != "QR":
            continue
        for k, parent, ordinal, depth, n in _nodes(r.body):
            try:
                schema = heading(s.lower(n).named().schema)
            except Exception:  # a node inside a loop or subquery has no heading by itself
                schema = None
            out.append((r.name, k, parent, ordinal, type(n).__name__, label(n), ".".join(n.name) if isinstance(n, ir.Relation) else None, schema, delivery(n), depth))
    return out


def _dependencies(s):
    found = {(r.name, ".".join(n.name)) for r in s.relations.values() if r.kind == "QR" for n in ir.walk(r.body) if isinstance(n, ir.Relation)}
    return sorted(found)


def _unused(s):
    used = {b.lower() for _, b in _dependencies(s)}
    return [(r.name,) for r in s.relations.values() if r.name.lower() not in used]


def _version(s):
    import pyspark

    import tessera

    return [("tessera", "engine", tessera.__version__), ("pyspark", "engine", pyspark.__version__), ("built-in", "function-library", tessera.__version__)] + [(k, "connector", tessera.__version__) for k in ("csv", "json", "http", "jdbc", "log", "gedcom", "generator", "mongodb")]


def _catalog(s):
    schema = lambda ddl: heading(T.StructType.fromDDL(ddl))
    return [(f"{NAMESPACE}.{n}", "QR" if n in ("rules", "unused", "cycles", "dependencies") else "SYS", None, schema(d)) for n, d in SCHEMAS.items()] + [(f"{NAMESPACE}.{n}", "TVF", 1, None) for n in FUNCTIONS]
