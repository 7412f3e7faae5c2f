"""Attribute filters as a closed tree, compiled to two-valued boolean Columns or evaluated on one row.

A comparison is numeric if the value is a number and the literal reads as one; else it compares strings if the
value is a string; else it is false, so a missing value never matches, not even <>. Nothing is ever null.
"""

from __future__ import annotations

import functools
import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = {"=": operator.eq, "<>": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}
_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?|inf(?:inity)?|nan)", re.I)


def number(text: str) -> float | None:
    """The number that a literal reads as (no blanks, no suffix), else None."""
    return float(text) if _NUMBER.fullmatch(text) else None


@dataclass(frozen=True)
class Compare:
    field: str
    op: str
    literal: str


@dataclass(frozen=True)
class Between:
    field: str
    low: str
    high: str


@dataclass(frozen=True)
class Like:
    """% any run, _ any character, a backslash before a character takes it literally; strings only, with case."""

    field: str
    pattern: str


@dataclass(frozen=True)
class IsNull:
    field: str


@dataclass(frozen=True)
class And:
    parts: tuple = ()


@dataclass(frozen=True)
class Or:
    parts: tuple = ()


@dataclass(frozen=True)
class Not:
    part: object


def like_regex(pattern: str) -> str:
    """The pattern as an anchored regular expression (a last lone backslash stands for itself)."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(".*" if c == "%" else "." if c == "_" else re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


class Fields:
    """How a table's attributes are reached: typed columns, or a map of struct<n double, s string>."""

    def __init__(self, numbers: dict[str, Column] | None = None, strings: dict[str, Column] | None = None, props: str | None = None) -> None:
        self.numbers, self.strings, self.props = numbers or {}, strings or {}, props

    def num(self, name: str) -> Column:
        if self.props:
            return F.try_element_at(F.col(self.props), F.lit(name))["n"]
        return self.numbers.get(name, F.lit(None).cast("double")).cast("double")

    def str(self, name: str) -> Column:
        if self.props:
            return F.try_element_at(F.col(self.props), F.lit(name))["s"]
        return self.strings.get(name, F.lit(None).cast("string"))


def column(tree, fields: Fields) -> Column:
    """The filter as a Column that is true or false, under either setting of ANSI mode."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    if isinstance(tree, Compare):
        s = sure(OPERATORS[tree.op](fields.str(tree.field), F.lit(tree.literal)))
        x = number(tree.literal)
        if x is None:
            return s
        n, op = fields.num(tree.field), OPERATORS[tree.op]
        plain = op(n, F.lit(x)) if x == x else F.lit(tree.op == "<>")
        return sure(F.when(n.isNull(), s).when(F.isnan(n), F.lit(tree.op == "<>")).otherwise(plain))
    if isinstance(tree, Between):
        s = fields.str(tree.field)
        s = sure((s >= tree.low) & (s <= tree.high))
        lo, hi = number(tree.low), number(tree.high)
        if lo is None or hi is None:
            return s
        n = fields.num(tree.field)
        return sure(F.when(n.isNull(), s).when(F.isnan(n) | F.lit(lo != lo or hi != hi), False).otherwise((n >= lo) & (n <= hi)))
    if isinstance(tree, Like):
        return sure(fields.str(tree.field).rlike(like_regex(tree.pattern)))
    if isinstance(tree, IsNull):
        return fields.num(tree.field).isNull() & fields.str(tree.field).isNull()
    if isinstance(tree, Not):
        return ~column(tree.part, fields)
    start, join = (F.lit(True), operator.and_) if isinstance(tree, And) else (F.lit(False), operator.or_)
    return functools.reduce(join, [column(p, fields) for p in tree.parts], start)


def holds(tree, props: dict) -> bool:
    """The filter on one row of attributes (str, float or None)."""
    if isinstance(tree, Compare):
        v, x = props.get(tree.field), number(tree.literal)
        if isinstance(v, float) and x is not None:
            return OPERATORS[tree.op](v, x)
        return isinstance(v, str) and OPERATORS[tree.op](v, tree.literal)
    if isinstance(tree, Between):
        v, lo, hi = props.get(tree.field), number(tree.low), number(tree.high)
        if isinstance(v, float) and lo is not None and hi is not None:
            return lo <= v <= hi
        return isinstance(v, str) and tree.low <= v <= tree.high
    if isinstance(tree, Like):
        v = props.get(tree.field)
        return isinstance(v, str) and re.fullmatch(like_regex(tree.pattern)[6:-2], v, re.S) is not None
    if isinstance(tree, IsNull):
        return props.get(tree.field) is None
    if isinstance(tree, Not):
        return not holds(tree.part, props)
    return all(holds(p, props) for p in tree.parts) if isinstance(tree, And) else any(holds(p, props) for p in tree.parts)


def fields_of(tree) -> list[str]:
    """Attributes that a filter reads, in order."""
    if hasattr(tree, "field"):
        return [tree.field]
    parts = [tree.part] if isinstance(tree, Not) else tree.parts
    return list(dict.fromkeys(f for p in parts for f in fields_of(p)))
