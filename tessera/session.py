"""A session: the names a query can use, and what they stand for."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import components  # noqa: F401
from tessera.plans import catalog, ir, lower, rules
from tessera.plans.lexer import AlgebraError, tokens
from tessera.plans.parser import parse
from tessera.plans.render import rel as render
from tessera.plans.scope import Scope
from tessera.plans.script import Statement, parse_script
from tessera.sources import files, gedcom, generators, http, jdbc, logs, mongodb

lower.load()


@dataclass
class Limits:
    """Bounds on what a session's queries may do; None: no bound."""

    input_chars: int | None = None
    output_rows: int | None = None
    rounds: int | None = None
    seconds: float | None = None
    #: Refuses sources, connections, imports and env, but for those (and no
    #: others) that ``declarations``, a script, makes.
    sealed: bool = False
    declarations: str = ""


@dataclass
class Named:
    """A relation by name.  kind: SRC, INL, DB, QR (a view)."""

    name: str
    kind: str
    body: ir.Node | None = None
    make: Callable[[], DataFrame | Scope] | None = None
    rows: int | None = None
    endless: bool = False
    private: str | None = None
    text: str = ""
    #: Of a source that takes what a query asks into its request.
    asks: Callable[[dict], DataFrame] | None = None
    made: Scope | None = field(default=None, repr=False)


class Session:
    """Parses, binds and runs algebra over Spark.  Nothing runs before an
    action on a result, but for the rounds of loops."""

    def __init__(self, spark: SparkSession | None = None, *, limits: Limits | None = None, placeholders: Callable[[str], str | None] | None = None, base: str = "."):
        self.spark = spark or SparkSession.builder.getOrCreate()
        self.spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.limits, self.base = limits or Limits(), base
        self.placeholder = placeholders or os.environ.get
        self.relations: dict[str, Named] = {}
        self.functions: dict[str, tuple] = {}  # scalar definitions
        self.builders: dict[str, Callable] = {}  # columns from columns
        self.aggregates: dict[str, Callable] = {}  # aggregates from columns
        self.connectors: dict[str, Callable] = {}  # kinds of connection
        self.generators: dict[str, Callable] = {}  # names of generators
        from tessera.operators import search  # which needs the handlers that come with lowering

        self.solver = search.Solver()
        self.tables: dict[str, tuple] = {}  # table-valued functions
        self.connections: dict[str, dict] = {}
        self.edges: list[tuple] = []
        self.namespace = "default"
        self.params: dict = {}
        self.feed: list[tuple] = []
        self._opening: list[str] = []
        self.offered = parse_script(self.limits.declarations)
        for name, (param, body) in catalog.FUNCTIONS.items():
            self.tables[f"{catalog.NAMESPACE}.{name}"] = (((param, "STRING"),), parse(body))
        for st in self.offered:
            self._run(st, base)

    # Binding -----------------------------------------------------------------
    def table(self, name: str, df: DataFrame) -> Session:
        """Binds a DataFrame (any source that Spark reads, streams too)."""
        self._put(Named(name, "SRC", make=lambda: df))
        return self

    def source(self, name: str, rows, schema=None) -> Session:
        """Binds rows (or a DataFrame)."""
        return self.table(name, rows if isinstance(rows, DataFrame) else self.spark.createDataFrame(rows, schema))

    def input(self, name: str, path: str, kind: str | None = None, **options) -> Session:
        """Binds a file: csv, tsv, json, jsonl, parquet or orc."""
        kind = kind or re.sub(r"\.gz$", "", path).rsplit(".", 1)[-1].lower()
        readers = {
            "csv": lambda: files.read_csv(self.spark, path, options),
            "tsv": lambda: files.read_csv(self.spark, path, options, sep="\t"),
            "json": lambda: files.read_json(self.spark, path, options.get("records")),
            "jsonl": lambda: files.read_json(self.spark, path, lines=True),
            "parquet": lambda: self.spark.read.parquet(path),
            "orc": lambda: self.spark.read.orc(path),
        }
        if kind not in readers:
            raise AlgebraError(f"no kind of file {kind!r}")
        self._put(Named(name, "SRC", make=readers[kind]))
        return self

    def define(self, name: str, text: str) -> Session:
        """A view."""
        return self._view(Statement("view", name, self.parse(text)), text)

    def function(self, name: str, builder: Callable) -> Session:
        """A scalar function that makes a column from columns (for instance
        a pandas UDF)."""
        self.builders[name.lower()] = builder
        return self

    def aggregate(self, name: str, builder: Callable) -> Session:
        """An aggregate that makes a column from columns: of built-in
        aggregates, or ``aggregates.folded`` of Python functions.  GROUP calls
        it as ``γ key, name(x) → y (R)``."""
        self.aggregates[name.lower()] = builder
        return self

    def library(self, functions: dict[str, Callable] | None = None, aggregates: dict[str, Callable] | None = None) -> Session:
        """Many functions and aggregates at once."""
        for name, builder in (functions or {}).items():
            self.function(name, builder)
        for name, builder in (aggregates or {}).items():
            self.aggregate(name, builder)
        return self

    def connector(self, kind: str, read: Callable[..., DataFrame]) -> Session:
        """A kind of connection for scripts: ``read(spark, options, table,
        schema)`` makes a DataFrame (of a Python data source, say, whose
        filters and columns Spark then pushes)."""
        self.connectors[kind.lower()] = read
        return self

    def generator(self, name: str, make: Callable[..., DataFrame]) -> Session:
        """A generator for scripts: ``make(spark, options)``."""
        self.generators[name.lower()] = make
        return self

    def table_function(self, name: str, make: Callable[..., DataFrame]) -> Session:
        self.tables[name.lower()] = ((), make)
        return self

    def materialize(self, name: str) -> Session:
        """Computes a view once; later uses read what is kept."""
        s = self.scope(name)
        self._find(name).made = s.with_df(s.df.persist())
        return self

    def _put(self, r: Named) -> None:
        self.relations[r.name.lower()] = r

    def _find(self, name: str) -> Named | None:
        return self.relations.get(name.lower())

    def _view(self, st: Statement, text: str = "", where: str | None = None) -> Session:
        used = {".".join(n.name).lower() for n in ir.walk(st.body) if isinstance(n, ir.Relation)}
        if st.name.lower() in used and not any(isinstance(n, (ir.Fix, ir.Iterate)) and n.name == st.name for n in ir.walk(st.body)):
            raise AlgebraError(f"the view {st.name} refers to itself")
        self._put(Named(st.name, "QR", body=st.body, private=where if st.private else None, text=text))
        return self

    # Names -------------------------------------------------------------------
    def known(self, name: str) -> bool:
        return self._find(name) is not None or name.lower().startswith(catalog.NAMESPACE + ".") or name.split(".")[0] in self.connections

    def view(self, name: str) -> ir.Node | None:
        r = self._find(name)
        return r.body if r is not None and r.kind == "QR" and r.made is None else None

    def resolve(self, name: str, lo) -> Scope:
        r = self._find(name)
        if r is None:
            head, _, rest = name.partition(".")
            if head == catalog.NAMESPACE:
                return Scope.of(catalog.build(self, rest))
            if head in self.connections:
                return Scope.of(self._connected(self.connections[head], rest, None))
            raise AlgebraError(f"no relation {name}; there are {', '.join(sorted(x.name for x in self.relations.values())) or 'none'}")
        want = lo.asked.pop(name, {})
        if r.made is not None:
            return r.made
        if r.asks is not None:
            return Scope.of(r.asks(want))
        if r.kind != "QR":
            got = r.make()
            s = got if isinstance(got, Scope) else Scope.of(got)
            r.endless = s.endless is not None
            r.made = s
            return s
        if name.lower() in lo.views:
            raise AlgebraError(f"the view {name} refers to itself")
        lo.views.append(name.lower())
        bound, lo.bound = lo.bound, {}
        try:
            return lo.rel(r.body)
        finally:
            lo.bound = bound
            lo.views.pop()

    def scope(self, name: str) -> Scope:
        return lower.Lowering(self, self.params).rel(ir.Relation(tuple(name.split("."))))

    def statistics(self, r: Named) -> dict[str, tuple[int, int]]:
        """Distinct values and NULLs of an inline table's columns."""
        if r.kind != "INL":
            return {}
        df = self.scope(r.name).named()
        got = df.agg(*[F.struct(F.count_distinct(f"`{c}`").alias("d"), F.count_if(F.col(f"`{c}`").isNull()).alias("n")).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
        return {c: (got[i]["d"], got[i]["n"]) for i, c in enumerate(df.columns)}

    # Queries -----------------------------------------------------------------
    def parse(self, text: str) -> ir.Node:
        if self.limits.input_chars is not None and len(text) > self.limits.input_chars:
            raise AlgebraError(f"a query of more than {self.limits.input_chars} characters")
        return parse(text)

    def relation(self, text: str, **params):
        """One expression as a lazy relation."""
        from tessera.rel import Rel

        return Rel(self, self.parse(text), params)

    def lower(self, node: ir.Node, params: dict | None = None) -> Scope:
        began, log = time.monotonic(), []
        if self.limits.rounds is not None:
            for n in ir.walk(node):
                if isinstance(n, ir.Iterate) and n.rounds > self.limits.rounds:
                    raise AlgebraError(f"more than {self.limits.rounds} rounds")
        s = lower.Lowering(self, {**self.params, **(params or {})}).rel(rules.optimize(node, log))
        if s.endless is not None:
            raise AlgebraError("the result has no end: limit it")
        import datetime

        spent = datetime.timedelta(seconds=time.monotonic() - began)
        self.last = [(i, "OPTIMIZE", c, d, None, None, None) for i, (c, d) in enumerate(log, 1)] + [(len(log) + 1, "PLAN", "LOWER", "lowered to a DataFrame", None, None, spent)]
        return s

    def script(self, text: str, base: str | None = None) -> list[tuple[str, object]]:
        """Runs the statements of a script in order: (label, relation) of
        each query, lazy."""
        from tessera.rel import Rel

        if self.limits.input_chars is not None and len(text) > self.limits.input_chars:
            raise AlgebraError(f"a script of more than {self.limits.input_chars} characters")
        out: list = []
        for st in parse_script(text):
            if self.limits.sealed and st.kind in ("source", "connection", "import", "env") and st.options.get("from") != "generator" and st not in self.offered:
                raise AlgebraError(f"a sealed session takes no {st.kind} {st.name}".rstrip())
            if st.kind == "query":
                label = st.name or f"query[{len(out)}]"
                if st.name and not self.known(st.name):
                    raise AlgebraError(f"no relation {st.name}")
                out.append((label, Rel(self, st.body, {})))
            else:
                self._run(st, base or self.base)
        return out

    def script_file(self, path: str) -> list[tuple[str, object]]:
        return self.script(self._text(path), os.path.dirname(path) or ".")

    @staticmethod
    def _text(path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def _run(self, st: Statement, base: str) -> None:
        if st.kind == "namespace":
            self.namespace = st.name
        elif st.kind == "env":
            pass  # recorded by the script alone: the host resolves placeholders
        elif st.kind == "import":
            self._import(st, base)
        elif st.kind == "view":
            self._view(st, where=base)
        elif st.kind == "inline":
            header, rows = st.body
            schema = st.options.get("schema")
            df = files.inline(self.spark, st.name, header, rows, schema)
            self._put(Named(st.name, "INL", make=lambda: df, rows=len(rows), private=base if st.private else None))
            self._references(st)
        elif st.kind == "scalar":
            self.functions[st.name.lower()] = st.body
        elif st.kind == "table":
            self.tables[st.name.lower()] = (st.body[0], self._narrowed(*st.body))
        elif st.kind == "connection":
            if st.options["from"] == "jdbc":
                jdbc.checked(st.options)
            self.connections[st.name] = st.options | {"base": base}
        elif st.kind == "source":
            self._source(st, base)
            self._references(st)
        elif st.kind == "relate":
            self._relate(st)

    @staticmethod
    def _narrowed(params, body: ir.Node) -> ir.Node:
        """A relation parameter has its declared columns and no others."""
        heads = {n: cols for n, cols in params if isinstance(cols, tuple)}
        change = lambda x: ir.Rename(x.name[0], None, None, ir.Project(tuple((ir.Ref((c,)), c) for c, _ in heads[x.name[0]]), x)) if isinstance(x, ir.Relation) and len(x.name) == 1 and x.name[0] in heads else None
        return ir.rewrite(body, change)

    def _references(self, st: Statement) -> None:
        for cols, (target, there) in st.options.get("references", []):
            self.edges.append((", ".join(cols), ((st.name, cols), (0, None), (target, there), (0, 1)), {"inverse": None, "symmetric": False}))

    def _relate(self, st: Statement) -> None:
        a, _, b, _ = st.body
        for name, cols in (a, b):
            if not self.known(name):
                raise AlgebraError(f"{st.name}: no relation {name}")
            have = {c.name.lower() for c in self.scope(name).cols}
            for c in cols:
                if c.lower() not in have:
                    raise AlgebraError(f"{st.name}: {name} has no column {c}")
        self.edges.append((st.name, st.body, st.options))

    def join_path(self, start: str, end: str) -> list[str]:
        """Names of the declared relationships on a shortest way between two
        relations."""
        seen, level = {start.lower(): []}, [start.lower()]
        while level and end.lower() not in seen:
            after = []
            for at in level:
                for name, (a, _, b, _), _ in self.edges:
                    for x, y in ((a[0].lower(), b[0].lower()), (b[0].lower(), a[0].lower())):
                        if x == at and y not in seen:
                            seen[y] = [*seen[at], name]
                            after.append(y)
            level = after
        if end.lower() not in seen:
            raise AlgebraError(f"no relationships lead from {start} to {end}")
        return seen[end.lower()]

    def _import(self, st: Statement, base: str) -> None:
        path = os.path.normpath(os.path.join(base, st.name))
        if path in self._opening:
            raise AlgebraError(f"{path} imports itself")
        self._opening.append(path)
        try:
            before = set(self.relations)
            inner = parse_script(self._text(path))
            hidden = {s.name.lower() for s in inner if s.private}
            for name in st.body or ():
                if name.lower() in hidden:
                    raise AlgebraError(f"{name} is private to {st.name}")
                if not any(s.name.lower() == name.lower() and s.kind in {"source": ("source",), "relation": ("view", "inline"), "function": ("scalar", "table")}.get(st.options["kind"], (s.kind,)) for s in inner):
                    raise AlgebraError(f"{st.name} declares no {name}")
            for s in inner:
                if s.kind == "query":
                    continue
                if s.name and s.kind in ("view", "inline", "source") and s.name.lower() in before:
                    raise AlgebraError(f"{s.name} is declared in two files")
                self._run(s, os.path.dirname(path) or ".")
            # what is private stays usable by its own file's views alone
            for s in inner:
                if s.private and s.name.lower() in self.relations:
                    own = self.relations.pop(s.name.lower())
                    alias = f"{s.name}@{path}"
                    self._put(Named(alias, own.kind, own.body, own.make, own.rows, own.endless))
                    for r in self.relations.values():
                        if r.body is not None and r.name.lower() not in before:
                            r.body = ir.rewrite(r.body, lambda x, n=s.name, a=alias: ir.Rename(n, None, None, ir.Relation((a,))) if isinstance(x, ir.Relation) and x.name == (n,) else None)
        finally:
            self._opening.pop()

    # Sources -----------------------------------------------------------------
    def fill(self, text: str) -> str:
        """``${NAME}`` by its value."""

        def value(m):
            got = self.placeholder(m[1])
            if got is None:
                raise AlgebraError(f"no value for ${{{m[1]}}}")
            return got

        return re.sub(r"\$\{(\w+)\}", value, text)

    def _filled(self, x):
        if isinstance(x, str):
            return self.fill(x)
        if isinstance(x, dict):
            return {k: self._filled(v) for k, v in x.items()}
        return type(x)(map(self._filled, x)) if isinstance(x, (list, tuple)) else x

    @staticmethod
    def _at(base: str, path: str) -> str:
        return path if os.path.isabs(path) or "://" in path or path.startswith("file:") else os.path.join(base, path)

    def _source(self, st: Statement, base: str) -> None:
        o = st.options
        kind = o["from"].lower()
        local = lambda: self._at(base, self.fill(o["path"]))
        if kind == "csv":
            make = lambda: files.read_csv(self.spark, local(), o)
        elif kind == "json":
            make = lambda: files.read_json(self.spark, local(), o.get("records"))
        elif kind == "http":
            http.checked(o)
            own = {n.lower(): n for n, c in (o.get("schema") or {}).items() if c["way"] == "in"}
            asks = lambda want: http.read(self.spark, self._filled(o), {own[k]: v for k, v in want.get("inputs", {}).items() if k in own and v is not None}, limit=want.get("limit"), columns=want.get("columns"))
            self._put(Named(st.name, "SRC", asks=asks, private=base if st.private else None))
            return
        elif kind == "database":
            for k in ("url", "table", "schema"):
                if k not in o:
                    raise AlgebraError(f"the source {st.name} has a {k}")
            make = lambda: jdbc.read(self.spark, {"url": self.fill(o["url"]), **{k: o[k] for k in jdbc.SPLIT if k in o}}, o["table"], o["schema"])
        elif kind == "generator":
            own = self.generators.get(str(next((v for k, v in o.items() if k.lower() == "name"), "")).lower())
            options = {k: v for k, v in o.items() if k != "from"}
            made = Scope.of(own(self.spark, options)) if own else generators.make(self.spark, options)
            self._put(Named(st.name, "SRC", make=lambda: made, endless=made.endless is not None, private=base if st.private else None))
            return
        elif o["from"] in self.connections:
            if "table" not in o:
                raise AlgebraError(f"the source {st.name} has a table")
            make = lambda: self._connected(self.connections[o["from"]], o["table"], o.get("schema"))
        else:
            raise AlgebraError(f"no kind of source and no connection {o['from']}")
        self._put(Named(st.name, "DB" if kind == "database" else "SRC", make=make, private=base if st.private else None))

    def _connected(self, options: dict, table: str, schema: dict | None) -> DataFrame:
        o = self._filled({k: v for k, v in options.items() if k != "base"})
        if "path" in o:
            o["path"] = self._at(options["base"], o["path"])
        readers = {"jdbc": jdbc.read, "log": logs.read, "gedcom": gedcom.read, "mongodb": mongodb.read, **self.connectors}
        if o["from"] == "csv":
            path = o["path"] if o["path"].endswith(table) else os.path.join(o["path"], table)
            return files.read_csv(self.spark, path, {"schema": schema})
        if o["from"] not in readers:
            raise AlgebraError(f"no kind of connection {o['from']}")
        return readers[o["from"]](self.spark, o, table, schema)

    # Reports -----------------------------------------------------------------
    def definitions(self) -> dict[str, str]:
        return {r.name: render(r.body) for r in self.relations.values() if r.kind == "QR"}

    def validate(self, text: str) -> list[str]:
        """What is wrong with an expression; empty if nothing is."""
        try:
            self.lower(self.parse(text))
        except (AlgebraError, RecursionError) as e:
            return [str(e)]
        return []

    @staticmethod
    def tokens(text: str):
        return tokens(text)

    def close(self) -> None:
        for r in self.relations.values():
            if r.made is not None:
                r.made.df.unpersist()
