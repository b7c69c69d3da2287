"""Conditions: an immutable tree that compiles to one boolean Column.

Comparisons are typed as in Python: values of different families are unequal
and unordered, numbers and booleans are one family. Stores compare present
values only; lists treat a missing value as unequal to anything.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPS = ("eq", "ne", "lt", "le", "gt", "ge")


class Node:
    def __and__(self, other: Node) -> Node:
        return Bool("and", self, other)

    def __or__(self, other: Node) -> Node:
        return Bool("or", self, other)

    def __invert__(self) -> Node:
        return Not(self)


@dataclass(frozen=True)
class Condition(Node):
    field: str
    op: str
    value: Any

    def __post_init__(self):
        if self.op not in OPS:
            raise ValueError(f"unknown operator {self.op!r}")
        if not isinstance(self.value, str | int | float | None):
            raise TypeError("a condition compares with a string, a number or None")


@dataclass(frozen=True)
class Bool(Node):
    op: str
    left: Node
    right: Node

    def __post_init__(self):
        if self.op not in ("and", "or"):
            raise ValueError(f"unknown boolean operator {self.op!r}")


@dataclass(frozen=True)
class Not(Node):
    of: Node


@dataclass(frozen=True, eq=False)
class Field:
    """What an entity class hands out for a field: comparing it makes a Condition."""

    name: str

    def __eq__(self, v: Any) -> Condition:  # type: ignore[override]
        return Condition(self.name, "eq", v)

    def __ne__(self, v: Any) -> Condition:  # type: ignore[override]
        return Condition(self.name, "ne", v)

    def __lt__(self, v: Any) -> Condition:
        return Condition(self.name, "lt", v)

    def __le__(self, v: Any) -> Condition:
        return Condition(self.name, "le", v)

    def __gt__(self, v: Any) -> Condition:
        return Condition(self.name, "gt", v)

    def __ge__(self, v: Any) -> Condition:
        return Condition(self.name, "ge", v)

    __hash__ = None  # type: ignore[assignment]


def parse_mini(query: str) -> Condition:
    """``@name=='x'``: split at the first ``==``; the name is trimmed, quotes around the value go."""
    m = re.fullmatch(r"@(.*?)==(.*)", query, re.S)
    if not m:
        raise ValueError(f"not a mini-query: {query!r}")
    return Condition(m[1].strip(), "eq", m[2].strip("'\""))


def _compare(c: Column, op: str, v: Any) -> Column:
    return {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[op]


def _family(t: T.DataType) -> str:
    if isinstance(t, T.StringType):
        return "string"
    return "number" if isinstance(t, T.NumericType | T.BooleanType) else "other"


def _strict(c: Column, ordering: bool, strict: bool) -> Column:
    return F.when(c.isNotNull(), F.raise_error(F.lit("values of these types have no order")).cast("boolean")).otherwise(F.lit(False)) if ordering and strict else F.lit(False)


def _leaf(n: Condition, schema: T.StructType, mode: str, strict: bool) -> Column:
    if n.field not in schema.names:
        return F.lit(False) if mode == "store" else F.lit((n.op == "eq") == (n.value is None) and n.op in ("eq", "ne"))
    t, c = schema[n.field].dataType, F.col(n.field)
    if isinstance(t, T.VariantType):
        return _variant_leaf(n, c, mode)
    if n.value is None:
        out = {"eq": c.isNull(), "ne": c.isNotNull()}.get(n.op, F.lit(False))
        return out & F.lit(mode == "list") if n.op == "eq" else out
    family = "string" if isinstance(n.value, str) else "number"
    if _family(t) == family:
        out = _compare(c.cast("int") if isinstance(t, T.BooleanType) else c, n.op, int(n.value) if isinstance(n.value, bool) else n.value)
    else:
        out = c.isNotNull() if n.op == "ne" else _strict(c, n.op not in ("eq", "ne"), strict)
    if mode == "list" and n.op == "ne":
        return out | c.isNull()
    return c.isNotNull() & out


def _variant_leaf(n: Condition, v: Column, mode: str) -> Column:
    """v: the value of the field in a document; SQL null: no such key."""
    kind = F.schema_of_variant(v)
    numeric, string = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|BOOLEAN)"), kind.startswith("STRING")
    if n.value is None:
        out = {"eq": F.is_variant_null(v), "ne": ~F.is_variant_null(v)}.get(n.op, F.lit(False))
    elif isinstance(n.value, str):
        out = F.when(string, _compare(F.try_variant_get(v, "$", "string"), n.op, n.value)).otherwise(F.lit(n.op == "ne"))
    else:
        x = F.when(kind.startswith("BOOLEAN"), F.try_variant_get(v, "$", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get(v, "$", "double"))
        out = F.when(numeric, _compare(x, n.op, float(n.value))).otherwise(F.lit(n.op == "ne"))
    out = v.isNotNull() & out
    return out | v.isNull() if mode == "list" and n.op == "ne" else out


def compile_condition(n: Node, schema: T.StructType, mode: str = "store", strict: bool = False) -> Column:
    """Two-valued: what can't be compared is false."""
    if isinstance(n, Bool):
        a, b = compile_condition(n.left, schema, mode, strict), compile_condition(n.right, schema, mode, strict)
        return a & b if n.op == "and" else a | b
    if isinstance(n, Not):
        return ~compile_condition(n.of, schema, mode, strict)
    if not isinstance(n, Condition):
        raise TypeError(f"not a condition: {n!r}")
    return F.coalesce(_leaf(n, schema, mode, strict), F.lit(False))


def fields(n: Node) -> set[str]:
    return {n.field} if isinstance(n, Condition) else fields(n.of) if isinstance(n, Not) else fields(n.left) | fields(n.right)


def all_of(conditions: list[Node]) -> Node:
    return reduce(lambda a, b: a & b, conditions)
