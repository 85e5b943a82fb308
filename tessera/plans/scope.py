"""What a lowered relation is: a DataFrame whose columns have unique names,
and the names and qualifiers a query knows them by."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lexer import AlgebraError

_ids = count()


def fresh(name: str = "c") -> str:
    """A column name that no other relation has, so that self-joins and
    subqueries never meet an ambiguous reference."""
    return f"{name}__{next(_ids)}"


@dataclass(frozen=True)
class Column:
    id: str
    name: str
    quals: frozenset[str] = frozenset()
    #: What it was called before a join gave it another name; a qualified
    #: reference still finds it so.
    origin: str | None = None


@dataclass(frozen=True)
class Endless:
    """Rows without end: the first ``count`` after an offset, and, where the
    one column ascends, all up to a number."""

    first: Callable
    below: Callable | None = None

    def __call__(self, count: int, offset: int = 0) -> Scope:
        return self.first(count, offset)


@dataclass(frozen=True)
class Scope:
    df: DataFrame
    cols: tuple[Column, ...]
    #: Keys of a sort just below, for WITH TIES.
    order: tuple = field(default=(), compare=False)
    #: Of a generator or a draw without a limit.
    endless: Endless | None = field(default=None, compare=False)

    @staticmethod
    def of(df: DataFrame, *quals: str) -> Scope:
        """A DataFrame bound under a name."""
        cols = tuple(Column(fresh(c), c, frozenset(q.lower() for q in quals if q)) for c in df.columns)
        return Scope(df.toDF(*[c.id for c in cols]), cols)

    def find(self, parts: tuple[str, ...]) -> tuple[Column, tuple[str, ...]] | None:
        """The column that a dotted name means, and the path inside it."""
        for n in range(len(parts) - 1, -1, -1):  # as long a qualifier as will do
            qual, name = ".".join(parts[:n]).lower(), parts[n]
            near = [c for c in self.cols if not qual or qual in c.quals]
            called = lambda c: c.origin or c.name if qual else c.name
            hits = [c for c in near if called(c) == name] or [c for c in near if called(c).lower() == name.lower()] or [c for c in near if c.name.lower() == name.lower()]
            if len(hits) > 1:
                raise AlgebraError(f"{'.'.join(parts)} is ambiguous")
            if hits:
                return hits[0], parts[n + 1 :]
        return None

    def column(self, name: str) -> Column:
        got = self.find(tuple(name.split("."))) if "." in name else self.find((name,))
        if got is None or got[1]:
            raise AlgebraError(f"no column {name}; there are {', '.join(c.name for c in self.cols)}")
        return got[0]

    def columns(self, names) -> list[Column]:
        return [self.column(n) for n in names]

    def type(self, c: Column):
        return self.df.schema[c.id].dataType

    def named(self) -> DataFrame:
        """The relation as a caller sees it."""
        return self.df.select(*[F.col(f"`{c.id}`").alias(c.name) for c in self.cols])

    def with_df(self, df: DataFrame) -> Scope:
        return replace(self, df=df, order=(), endless=None)

    def add(self, value, name: str) -> Scope:
        """With one more column; a name twice is an error."""
        if any(c.name.lower() == name.lower() for c in self.cols):
            raise AlgebraError(f"there is a column {name} already")
        new = Column(fresh(name), name)
        return Scope(self.df.withColumn(new.id, value), (*self.cols, new))

    def only(self, cols) -> Scope:
        return Scope(self.df.select(*[c.id for c in cols]), tuple(cols))

    def again(self) -> Scope:
        """The same rows under new column names, to meet themselves."""
        cols = tuple(replace(c, id=fresh(c.name)) for c in self.cols)
        return Scope(self.df.toDF(*[c.id for c in cols]), cols)


def c(col: Column | str):
    return F.col(f"`{col if isinstance(col, str) else col.id}`")


def merged(left: Scope, right: Scope) -> tuple[Column, ...]:
    """Headings side by side; a right column whose name is taken becomes
    ``name_r``, then ``name_r2`` and so on."""
    taken = {x.name.lower() for x in left.cols}
    out = list(left.cols)
    for x in right.cols:
        name, n = x.name, 1
        while name.lower() in taken:
            name = f"{x.name}_r" if n == 1 else f"{x.name}_r{n}"
            n += 1
        taken.add(name.lower())
        out.append(replace(x, name=name, origin=None if name == x.name else x.origin or x.name))
    return tuple(out)
