"""The fluent API: every combinator builds algebra, nothing runs before a
terminal.  Conditions, keys and the like are text of the query language."""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Iterator
from dataclasses import fields, is_dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.operators.provenance import SEMIRINGS, annotated
from tessera.plans import ir, lower, rules
from tessera.plans.lexer import AlgebraError
from tessera.plans.render import label, rel
from tessera.plans.scope import Column

_HOLES = ("__it__", "__other__")


class Rows(list):
    """A result; ``truncated`` if the session's limit cut it."""

    truncated = False


class Rel:
    def __init__(self, session, node: ir.Node, params: dict | None = None):
        self.session, self.ir, self.params = session, node, params or {}

    # Building -------------------------------------------------------------------
    def _read(self, text: str, *others: Rel) -> Rel:
        put = dict(zip(_HOLES, (self.ir, *[o.ir for o in others])))
        node = ir.rewrite(self.session.parse(text), lambda x: put.get(x.name[0]) if isinstance(x, ir.Relation) and len(x.name) == 1 else None)
        return Rel(self.session, node, {**self.params, **{k: v for o in others for k, v in o.params.items()}})

    def _over(self, text: str) -> Rel:
        return self._read(f"{text} (__it__)")

    def _with(self, text: str, other: Rel) -> Rel:
        return self._read(f"__it__ {text} (__other__)", other)

    def select(self, condition: str) -> Rel:
        return self._over(f"SELECT {condition}")

    def project(self, *items: str) -> Rel:
        return self._over(f"PROJECT {', '.join(items)}")

    def rename(self, name: str = "", columns: list[str] | dict[str, str] | None = None) -> Rel:
        inside = ", ".join(f"{a} -> {b}" for a, b in columns.items()) if isinstance(columns, dict) else ", ".join(columns or ())
        return self._over(f"RENAME {name}{f'({inside})' if inside else ''}")

    def aggregate(self, keys: str | list[str], *aggs: str) -> Rel:
        keys = [keys] if isinstance(keys, str) and keys else list(keys or ())
        return self._over(f"GROUP {', '.join([*keys, *aggs])}")

    aggregate_by = aggregate

    def sort(self, *keys: str) -> Rel:
        return self._over(f"SORT {', '.join(keys)}")

    def limit(self, count: int, offset: int = 0, ties: bool = False) -> Rel:
        got = self._over(f"LIMIT {offset}, {count}")
        if not ties:
            return got
        if not isinstance(self.ir, ir.Sort):
            raise AlgebraError("WITH TIES needs a sort as its input")
        return Rel(self.session, ir.Limit(count, offset, True, self.ir), self.params)

    def distinct(self) -> Rel:
        return self._over("DISTINCT")

    def unnest(self, column: str, ordinal: str | None = None, outer: bool = False) -> Rel:
        return self._over(f"UNNEST {'OUTER ' if outer else ''}{column}{f' WITH ORDINALITY {ordinal}' if ordinal else ''}")

    def why(self) -> Rel:
        return self._over("WHY")

    def forall(self, keys: str | Rel, condition: str) -> Rel:
        """Groups that satisfy a condition throughout; with a relation, rows
        that satisfy it with all of its rows."""
        return self._with(f"USEMI {condition}", keys) if isinstance(keys, Rel) else self._over(f"FORALL {keys} : {condition}")

    def join(self, other: Rel, condition: str | None = None) -> Rel:
        return self._with(f">< {condition}" if condition else "JOIN", other)

    def left_join(self, other: Rel, condition: str) -> Rel:
        return self._with(f"LJOIN {condition}", other)

    def right_join(self, other: Rel, condition: str) -> Rel:
        return self._with(f"RJOIN {condition}", other)

    def full_join(self, other: Rel, condition: str) -> Rel:
        return self._with(f"FJOIN {condition}", other)

    def join_using(self, other: Rel, *columns: str) -> Rel:
        return self._with(f"JOIN USING ({', '.join(columns)})", other)

    def left_join_using(self, other: Rel, *columns: str) -> Rel:
        return self._with(f"LJOIN USING ({', '.join(columns)})", other)

    def right_join_using(self, other: Rel, *columns: str) -> Rel:
        return self._with(f"RJOIN USING ({', '.join(columns)})", other)

    def full_join_using(self, other: Rel, *columns: str) -> Rel:
        return self._with(f"FJOIN USING ({', '.join(columns)})", other)

    def semi_join(self, other: Rel, condition: str) -> Rel:
        return self._with(f"SEMI {condition}", other)

    def anti_join(self, other: Rel, condition: str) -> Rel:
        return self._with(f"ANTI {condition}", other)

    def as_of_join(self, other: Rel, condition: str, within: str | None = None, ties: str | None = None, inner: bool = False) -> Rel:
        return self._with(f"ASOF {'INNER ' if inner else ''}{condition}{f' WITHIN {within}' if within else ''}{f' TIES({ties})' if ties else ''}", other)

    def interval_join(self, other: Rel, relation: str, *columns: str) -> Rel:
        return self._with(f"IJOIN {relation} ({', '.join(columns)})", other)

    def lateral(self, call: str | Rel, outer: bool = False) -> Rel:
        word = f"{'OUTER ' if outer else ''}LATERAL"
        return self._with(word, call) if isinstance(call, Rel) else self._read(f"__it__ {word} {call}")

    def cross(self, other: Rel) -> Rel:
        return self._with("CROSS", other)

    def union(self, other: Rel) -> Rel:
        return self._with("UNION", other)

    def union_all(self, other: Rel) -> Rel:
        return self._with("UALL", other)

    def outer_union(self, other: Rel) -> Rel:
        return self._with("OUNION", other)

    def difference(self, other: Rel) -> Rel:
        return self._with("DIFF", other)

    def intersect(self, other: Rel) -> Rel:
        return self._with("INTER", other)

    def divide(self, other: Rel) -> Rel:
        return self._with("DIV", other)

    def symmetric_difference(self, other: Rel) -> Rel:
        return self._with("SYMDIFF", other)

    def compose(self, other: Rel) -> Rel:
        return self._with("COMPOSE", other)

    def closure(self, a: str, b: str, reflexive: bool = False, both: bool = False) -> Rel:
        return self._over(f"{'RCLOSURE' if reflexive else 'CLOSURE'} {a} {'<->' if both else ','} {b}")

    def cluster(self, a: str, b: str, name: str) -> Rel:
        return self._over(f"CLUSTER {a}, {b} AS {name}")

    def path(self, a: str, b: str, hops: int, to: int | None = None, name: str = "depth", both: bool = False) -> Rel:
        return self._over(f"PATH {a} {'<->' if both else ','} {b} HOPS {hops}{f' TO {to}' if to else ''} AS {name}")

    def trace(self, a: str, b: str, via: str, maximize: bool = False, name: str = "path", both: bool = False) -> Rel:
        return self._over(f"TRACE {a} {'<->' if both else ','} {b} VIA {via} {'MAXIMIZE' if maximize else 'MINIMIZE'} AS {name}")

    def fix(self, name: str, step: str) -> Rel:
        return self._read(f"FIX {name} (__it__, {step})")

    def iterate(self, name: str, step: str, until: str) -> Rel:
        """``until``: ``ROUNDS 3``, ``UNTIL STABLE MAX 9 ROUNDS`` and so on."""
        return self._read(f"ITERATE {name} (__it__, {step}) {until}")

    def rolling(self, agg: str, over: str, name: str, sort: str = "", per: str = "") -> Rel:
        return self._over(f"ROLLING {agg} OVER {over}{f' SORT {sort}' if sort else ''}{f' PER {per}' if per else ''} AS {name}")

    def window(self, call: str, sort: str, name: str, per: str = "", over: str = "") -> Rel:
        return self._over(f"WINDOW {call}{f' OVER {over}' if over else ''} SORT {sort}{f' PER {per}' if per else ''} AS {name}")

    def top(self, count: int, sort: str, per: str = "", offset: int = 0, ties: bool = False) -> Rel:
        return self._over(f"TOP {offset}, {count}{' WITH TIES' if ties else ''} {sort}{f' PER {per}' if per else ''}")

    def sessionize(self, column: str, gap: str, name: str, per: str = "") -> Rel:
        return self._over(f"SESSIONIZE {column} GAP {gap}{f' PER {per}' if per else ''} AS {name}")

    def downsample(self, column: str, width: str, using: str, per: str = "", latest: int | None = None) -> Rel:
        return self._over(f"DOWNSAMPLE {column} BY '{width}' USING {using}{f' PER {per}' if per else ''}{f' FOR {latest} ROWS' if latest else ''}")

    def pivot(self, value: str, by: str, per: str = "") -> Rel:
        return self._over(f"PIVOT {value} BY {by}{f' PER {per}' if per else ''}")

    def unpivot(self, columns: list[str], name: str, value: str) -> Rel:
        return self._over(f"UNPIVOT ({', '.join(columns)}) AS ({name}, {value})")

    def tree(self, key: str, parent: str, name: str, order: str = "") -> Rel:
        return self._over(f"TREE {key} BY {parent}{f' ORDER {order}' if order else ''} AS {name}")

    @staticmethod
    def _seeded(seed: int | None) -> str:
        return f" SEED {seed}" if seed is not None else ""

    def sample(self, fraction: float, seed: int | None = None) -> Rel:
        return self._over(f"SAMPLE {fraction}{self._seeded(seed)}")

    def sample_reservoir(self, rows: int, seed: int | None = None) -> Rel:
        return self._over(f"SAMPLE {rows} ROWS{self._seeded(seed)}")

    def shuffle(self, seed: int | None = None) -> Rel:
        return self._over(f"SHUFFLE{self._seeded(seed)}")

    def roll(self, weight: str | None = None, seed: int | None = None) -> Rel:
        return self._over(f"ROLL{f' BY {weight}' if weight else ''}{self._seeded(seed)}")

    def solve(self, *equations: str, per: str = "", within: float | None = None, rounds: int | None = None, start: str = "") -> Rel:
        eq = "{" + ", ".join(equations) + "}"
        return self._over(f"SOLVE {eq}{f' PER {per}' if per else ''}{f' WITHIN {within:.20f}' if within else ''}{f' MAX {rounds} ROUNDS' if rounds else ''}{f' START {start}' if start else ''}")

    def optimize(self, goal: str, subject_to: str, per: str = "", allocate: tuple[float, float] | None = None, name: str = "") -> Rel:
        return self._over(f"OPTIMIZE {f'ALLOCATE ({allocate[0]}, {allocate[1]}) ' if allocate else ''}{goal} SUBJECT TO {subject_to}{f' -> {name}' if name else ''}{f' PER {per}' if per else ''}")

    def cover(self, strength: int, exact: bool = False) -> Rel:
        return self._over(f"COVER {'EXACT ' if exact else ''}{strength}")

    def bind(self, **params) -> Rel:
        """Values for ``$name`` parameters."""
        return Rel(self.session, self.ir, {**self.params, **params})

    # Looking --------------------------------------------------------------------
    def render(self) -> str:
        return rel(self.ir)

    as_written = render

    def render_json(self) -> str:
        return json.dumps(_plain(self.ir), ensure_ascii=False, default=str)

    def optimized(self) -> Rel:
        return Rel(self.session, rules.optimize(self.ir), self.params)

    def rewrites(self) -> list[tuple[str, str]]:
        log: list = []
        rules.optimize(self.ir, log)
        return log

    @property
    def df(self) -> DataFrame:
        """The lazy DataFrame (loops run their rounds now)."""
        return self.session.lower(self.ir, self.params).named()

    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    def explain(self, mode: str = "formatted") -> str:
        got = self.df
        return got.sparkSession._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), mode)

    def explain_json(self) -> str:
        return json.dumps({"algebra": _plain(rules.optimize(self.ir)), "plan": self.explain()}, ensure_ascii=False, default=str)

    def plan(self) -> list[str]:
        """The algebra as an indented list of operators."""
        out = []

        def go(n, depth):
            out.append("  " * depth + label(n))
            for f in fields(n):
                if isinstance(getattr(n, f.name), ir.Node):
                    go(getattr(n, f.name), depth + 1)

        go(rules.optimize(self.ir), 0)
        return out

    def events(self) -> list[tuple]:
        return list(self.session.feed)

    # Running --------------------------------------------------------------------
    def _run(self, action):
        """An action under the session's limits; feeds ``sys.events``."""
        import datetime
        import time

        df, limits, sc = self.df, self.session.limits, self.session.spark.sparkContext
        planned, began = list(self.session.last), time.monotonic()
        timer, tag = None, f"tessera-{uuid.uuid4().hex}"
        if limits.seconds is not None:
            sc.addJobTag(tag)
            timer = threading.Timer(limits.seconds, lambda: sc.cancelJobsWithTag(tag))
            timer.start()
        try:
            got, n = action(df)
        except Exception as e:
            if timer is not None and not timer.is_alive():
                raise AlgebraError(f"stopped after {limits.seconds} s") from e
            raise
        finally:
            if timer is not None:
                timer.cancel()
                sc.removeJobTag(tag)
        self.session.feed = [*planned, (len(planned) + 1, "EXECUTE", "ROWS", "rows of the result", None, n, datetime.timedelta(seconds=time.monotonic() - began))]
        return got

    def to_list(self) -> Rows:
        most = self.session.limits.output_rows

        def action(df):
            rows = Rows((df if most is None else df.limit(most + 1)).collect())
            if most is not None and len(rows) > most:
                rows.pop()
                rows.truncated = True
            return rows, len(rows)

        return self._run(action)

    run = to_list

    def count(self) -> int:
        def action(df):
            n = df.count()
            return n, n

        return self._run(action)

    def stream(self) -> Iterator:
        """Rows one partition at a time."""
        most = self.session.limits.output_rows
        return (self.df if most is None else self.df.limit(most)).toLocalIterator()

    def provenance(self, semiring="lineage") -> DataFrame:
        """The rows with a semiring's value beside each, in ``provenance``."""
        k = SEMIRINGS[semiring]() if isinstance(semiring, str) else semiring
        s = annotated(lower.Lowering(self.session, {**self.session.params, **self.params}), self.ir, k)
        from tessera.plans.scope import Scope

        return Scope(s.df, (*s.cols, Column("__prov", "provenance"))).named()


def _plain(x):
    if is_dataclass(x):
        return {"op": type(x).__name__} | {f.name: _plain(getattr(x, f.name)) for f in fields(x)}
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    return x
