"""Band mathematics: text to a small tree, and the tree to Columns or numpy planes.

Grammar: sums of terms of factors; a factor may have minus signs before it; primaries are numbers, band names
(B1, b2, ... or given aliases), calls of abs, sqrt, min, max, clamp, and parentheses. Arithmetic is in 32-bit floats, each step
rounded; x / 0 is an infinity or NaN; min and max pass over NaN; clamp takes the greater of the low bound first.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKENS = re.compile(r"\s*(?:(\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|([A-Za-z_][A-Za-z_0-9]*)|(.))", re.S)
ARITY = {"abs": 1, "sqrt": 1, "min": 2, "max": 2, "clamp": 3}


class BandMathError(ValueError):
    """The text is not a valid expression."""


@dataclass(frozen=True)
class Term:
    """A node: kind is num, band, neg, + - * / or a function's name."""

    kind: str
    args: tuple = ()
    value: object = None


def parse(text: str, bands: dict[str, str] | None = None) -> Term:
    """The tree of an expression; bands: names (any case) to columns. Without it, B<n> means the column b<n>."""
    known = {k.lower(): v for k, v in bands.items()} if bands is not None else None
    found = [(m[1], m[2], m[3]) for m in _TOKENS.finditer(text.rstrip())]
    at = 0

    def peek() -> str:
        return (found[at][2] or "") if at < len(found) else ""

    def take(mark: str) -> None:
        nonlocal at
        if peek() != mark:
            raise BandMathError(f"expected {mark!r}")
        at += 1

    def level(marks: str, below) -> Term:
        nonlocal at
        left = below()
        while peek() and peek() in marks:
            mark = peek()
            at += 1
            left = Term(mark, (left, below()))
        return left

    def factor() -> Term:
        nonlocal at
        if peek() == "-":
            at += 1
            return Term("neg", (factor(),))
        if at >= len(found):
            raise BandMathError("the expression ends too early")
        number, name, _ = found[at]
        if number is not None:
            at += 1
            return Term("num", value=float(np.float32(number)))
        if name is not None:
            at += 1
            if peek() == "(":
                if name.lower() not in ARITY:
                    raise BandMathError(f"unknown function {name!r}")
                take("(")
                args = [total()]
                while peek() == ",":
                    take(",")
                    args.append(total())
                take(")")
                if len(args) != ARITY[name.lower()]:
                    raise BandMathError(f"{name} takes {ARITY[name.lower()]} arguments")
                return Term(name.lower(), tuple(args))
            column = known.get(name.lower()) if known is not None else name.lower() if re.fullmatch(r"[bB][1-9]\d*", name) else None
            if column is None:
                raise BandMathError(f"unknown band {name!r}")
            return Term("band", value=column)
        take("(")
        inner = total()
        take(")")
        return inner

    def total() -> Term:
        return level("+-", lambda: level("*/", factor))

    out = total()
    if at != len(found):
        raise BandMathError("text after the end of the expression")
    return out


def used(tree: Term) -> list[str]:
    """The columns of the bands, in order of first use."""
    out = [tree.value] if tree.kind == "band" else []
    for a in tree.args:
        out += [b for b in used(a) if b not in out]
    return out


def column(tree: Term) -> Column:
    """The expression as a float Column; the same under either setting of ANSI mode."""
    f = lambda c: c.cast("float")
    if tree.kind == "num":
        return f(F.lit(tree.value))
    if tree.kind == "band":
        return f(F.col(tree.value))
    args = [column(a) for a in tree.args]
    a, b = args[0], args[1] if len(args) > 1 else None
    nan, inf = f(F.lit(float("nan"))), f(F.lit(float("inf")))
    if tree.kind == "neg":
        return f(-a)
    if tree.kind in "+-*":
        return f(a + b if tree.kind == "+" else a - b if tree.kind == "-" else a * b)
    if tree.kind == "/":
        by_zero = F.when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(f(-inf))
        return F.when(b == 0, by_zero).otherwise(f(a / F.when(b == 0, f(F.lit(1))).otherwise(b)))
    if tree.kind == "abs":
        return f(F.abs(a))
    if tree.kind == "sqrt":
        return F.when(a < 0, nan).otherwise(f(F.sqrt(a)))
    if tree.kind in ("min", "max"):
        return _extreme(tree.kind, a, b)
    return _extreme("min", _extreme("max", a, args[1]), args[2])


def _extreme(kind: str, a: Column, b: Column) -> Column:
    pick = a <= b if kind == "min" else a >= b
    return F.when(F.isnan(a), b).when(F.isnan(b), a).when(pick, a).otherwise(b)


def planes(tree: Term, of: dict[str, np.ndarray]) -> np.ndarray:
    """The expression over 32-bit planes."""
    with np.errstate(all="ignore"):
        if tree.kind == "num":
            return np.float32(tree.value)
        if tree.kind == "band":
            return of[tree.value].astype(np.float32)
        args = [planes(a, of) for a in tree.args]
        ops = {"neg": np.negative, "+": np.add, "-": np.subtract, "*": np.multiply, "/": np.divide, "abs": np.abs, "sqrt": np.sqrt, "min": np.fmin, "max": np.fmax, "clamp": lambda x, lo, hi: np.fmin(np.fmax(x, lo), hi)}
        return np.asarray(ops[tree.kind](*args), dtype=np.float32)


def valid(tree: Term, nodata: float | None) -> Column:
    """Whether no band of the expression is within 0.5 of the nodata value."""
    out = F.lit(True)
    for b in used(tree) if nodata is not None else []:
        out = out & ~(F.abs(F.col(b).cast("double") - F.lit(float(nodata))) < 0.5)
    return out
