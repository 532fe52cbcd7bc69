"""Arithmetic over columns: + - * / with parentheses and a leading minus.

Without further parentheses, operators are not ranked and group from the right:
``a - b - c`` is ``a - (b - c)`` and ``a * b + c`` is ``a * (b + c)``; a minus
negates all that follows it.  ``precedence="standard"`` ranks them as usual.
Int with Int stays Int, and ``/`` then drops the fraction; anything with a
Double is Double; a String is refused.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cedarflow.errors import SyntaxProblem, TypeMismatch, UnknownColumn
from cedarflow.functions import DOUBLE, INT, STRING, kind_of

TOKEN = re.compile(r"\s*(?:(?P<dec>-?[0-9]+\.[0-9]*)|(?P<int>-?[0-9]+)|(?P<name>[A-Za-z][A-Za-z0-9_-]*)|(?P<mark>[()+*/-]))")
RANKS = {"+": 1, "-": 1, "*": 2, "/": 2}


@dataclass(frozen=True)
class Leaf:
    kind: str
    value: str


@dataclass(frozen=True)
class Negated:
    of: object


@dataclass(frozen=True)
class Operation:
    op: str
    left: object
    right: object


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character at {at} of {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def parse(text: str, precedence: str = "right"):
    """The expression's tree."""
    if precedence not in ("right", "standard"):
        raise ValueError(f"no such precedence: {precedence}")
    rest = tokens(text)[::-1]

    def mark() -> str | None:
        return rest[-1][1] if rest and rest[-1][0] == "mark" else None

    def single():
        if not rest:
            raise SyntaxProblem(f"{text!r} ends too early")
        kind, value = rest.pop()
        if (kind, value) == ("mark", "("):
            inner = whole(0)
            if not rest or rest.pop() != ("mark", ")"):
                raise SyntaxProblem(f"expected ) in {text!r}")
            return inner
        if (kind, value) == ("mark", "-"):
            return Negated(whole(0) if precedence == "right" else single())
        if kind == "mark":
            raise SyntaxProblem(f"unexpected {value} in {text!r}")
        return Leaf({"int": INT, "dec": DOUBLE, "name": "Name"}[kind], value)

    def whole(least: int):
        left = single()
        while (op := mark()) in RANKS and RANKS[op] >= least:
            rest.pop()
            if precedence == "right":
                return Operation(op, left, whole(0))
            left = Operation(op, left, whole(RANKS[op] + 1))
        return left

    tree = whole(0)
    if rest:
        raise SyntaxProblem(f"unexpected {rest[-1][1]} in {text!r}")
    return tree


def compile_tree(tree, df: DataFrame) -> tuple[Column, str]:
    if isinstance(tree, Leaf):
        if tree.kind == INT:
            return F.lit(int(tree.value)), INT
        if tree.kind == DOUBLE:
            return F.lit(float(tree.value)), DOUBLE
        if tree.value not in df.columns:
            raise UnknownColumn(f"{tree.value} is none of {', '.join(df.columns)}")
        kind = kind_of(df.schema[tree.value].dataType)
        if kind == STRING:
            raise TypeMismatch(f"{tree.value} is a String")
        return F.col(f"`{tree.value}`"), kind
    if isinstance(tree, Negated):
        column, kind = compile_tree(tree.of, df)
        return -column, kind
    (a, x), (b, y) = compile_tree(tree.left, df), compile_tree(tree.right, df)
    if x == y == INT:
        if tree.op == "/":
            return F.call_function("div", a, b), INT
    else:
        a, b = a.cast("double"), b.cast("double")
    out = a + b if tree.op == "+" else a - b if tree.op == "-" else a * b if tree.op == "*" else a / b
    return out, INT if x == y == INT else DOUBLE


def bind(text: str, df: DataFrame, precedence: str = "right") -> tuple[Column, str]:
    """The column that ``text`` spells over ``df``, and Int or Double."""
    return compile_tree(parse(text, precedence), df)
