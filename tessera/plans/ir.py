"""The algebra: immutable relational and scalar expression nodes."""

from __future__ import annotations

from dataclasses import dataclass, fields, is_dataclass
from typing import Any


class Node:
    """A relational expression."""

    def inputs(self) -> list[Node]:
        return [v for f in fields(self) if isinstance(v := getattr(self, f.name), Node)]


class Expr:
    """A scalar expression or predicate (a BOOLEAN with unknown as NULL)."""


def _node(name: str, spec: str, base: type = Node) -> type:
    cls = dataclass(frozen=True)(type(name, (base,), {"__annotations__": {x: Any for x in spec.split()}, "__module__": __name__}))
    return cls


# Scalars -------------------------------------------------------------------
Lit = _node("Lit", "value kind", Expr)  # kind: number string boolean null date time timestamp duration timestamptz
Ref = _node("Ref", "parts", Expr)
Param = _node("Param", "name", Expr)
Call = _node("Call", "name args", Expr)
Bin = _node("Bin", "op left right", Expr)
Neg = _node("Neg", "operand", Expr)
Cast = _node("Cast", "operand type", Expr)
Struct = _node("Struct", "items", Expr)  # (name, expr) pairs
Array = _node("Array", "items", Expr)
Collate = _node("Collate", "operand collation", Expr)
Scalar = _node("Scalar", "rel", Expr)
# Predicates
Cmp = _node("Cmp", "op left right", Expr)
And = _node("And", "left right", Expr)
Or = _node("Or", "left right", Expr)
Not = _node("Not", "operand", Expr)
IsNull = _node("IsNull", "operand", Expr)
Same = _node("Same", "left right", Expr)  # IS NOT DISTINCT FROM
Truth = _node("Truth", "operand value", Expr)  # value: True, False or None (unknown)
InList = _node("InList", "operand items", Expr)
InArray = _node("InArray", "operand array", Expr)
Like = _node("Like", "operand pattern escape fold", Expr)
Regex = _node("Regex", "operand pattern fold", Expr)
Exists = _node("Exists", "rel", Expr)
Quant = _node("Quant", "op every operand rel", Expr)  # operand op ANY/ALL (rel)

# Leaves --------------------------------------------------------------------
Relation = _node("Relation", "name")
TruthRel = _node("TruthRel", "full")
TableCall = _node("TableCall", "name args")
Frame = _node("Frame", "df name")  # a bound DataFrame

# One input -----------------------------------------------------------------
Select = _node("Select", "pred input")
Project = _node("Project", "items input")  # (expr, name or None)
Rename = _node("Rename", "name columns pairs input")
Group = _node("Group", "keys aggs sets input")  # keys: (expr, name); aggs: Agg; sets: None or tuples of key numbers
Agg = _node("Agg", "func args distinct order filter name", Expr)
SortKey = _node("SortKey", "expr desc nulls_first", Expr)
Sort = _node("Sort", "keys input")
Limit = _node("Limit", "count offset ties input")
Distinct = _node("Distinct", "input")
Why = _node("Why", "input")
Unnest = _node("Unnest", "column ordinal outer input")
Closure = _node("Closure", "a b reflexive both input")
Cluster = _node("Cluster", "a b name input")
Path = _node("Path", "a b both lo hi name input")
Trace = _node("Trace", "a b both weight maximize name input")
Fix = _node("Fix", "name base step")
Iterate = _node("Iterate", "name base step rounds stable columns within per")
ForAll = _node("ForAll", "keys pred input")
Sample = _node("Sample", "fraction rows seed input")
Shuffle = _node("Shuffle", "seed input")
Roll = _node("Roll", "weight seed input")
Solve = _node("Solve", "equations per within rounds start input")
Optimize = _node("Optimize", "maximize objective constraints bounds name per input")
Top = _node("Top", "count offset ties keys per input")
Cover = _node("Cover", "exact strength input")
Downsample = _node("Downsample", "column width func per latest input")
Rolling = _node("Rolling", "func arg frame keys per name input")
Window = _node("Window", "func args frame keys per name input")
Bound = _node("Bound", "kind value", Expr)  # preceding following current first last
WinFrame = _node("WinFrame", "unit lo hi", Expr)  # unit: rows range partition
Sessionize = _node("Sessionize", "column gap per name input")
Tree = _node("Tree", "id parent keys name input")
Pivot = _node("Pivot", "value by per input")
Unpivot = _node("Unpivot", "columns name value input")

# Two inputs ----------------------------------------------------------------
Join = _node("Join", "kind pred using left right")  # inner left right full semi anti universal; pred None: natural
Product = _node("Product", "left right")
AsOf = _node("AsOf", "inner pred within ties left right")
IntervalJoin = _node("IntervalJoin", "relation columns left right")
Lateral = _node("Lateral", "outer left right")
SetOp = _node("SetOp", "kind left right")  # union uall ounion inter diff symdiff
Compose = _node("Compose", "left right")
Divide = _node("Divide", "left right")


def walk(x: Any):
    """Every node and expression in a tree, outermost first."""
    if isinstance(x, (list, tuple)):
        for y in x:
            yield from walk(y)
    elif is_dataclass(x):
        yield x
        for f in fields(x):
            yield from walk(getattr(x, f.name))


def rewrite(x: Any, change) -> Any:
    """The tree with ``change`` applied from the leaves up (None: as it is)."""
    if isinstance(x, (list, tuple)):
        return type(x)(rewrite(y, change) for y in x)
    if not is_dataclass(x):
        return x
    new = {f.name: rewrite(getattr(x, f.name), change) for f in fields(x)}
    if any(new[f.name] is not getattr(x, f.name) for f in fields(x)):
        x = type(x)(**new)
    got = change(x)
    return x if got is None else got
