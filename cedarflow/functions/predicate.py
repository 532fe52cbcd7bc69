"""Predicates: a conjunction of disjunctions of comparisons.

    predicate   := clause { AND clause }
    clause      := '(' condition { OR condition } ')'
    condition   := operand [ ('<' | '>' | '=') operand ]
    operand     := integer | decimal | 'text' | name

A condition that is a bare operand equals itself: it is true in a filter, and
names a key in a sort order.  A predicate compiles to one boolean column, so
that Catalyst pushes it into scans and picks the join.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cedarflow.errors import AmbiguousColumn, SyntaxProblem, TypeMismatch, UnknownColumn
from cedarflow.functions import DOUBLE, INT, STRING, kind_of

TOKEN = re.compile(
    r"\s*(?:(?P<dec>-?[0-9]+\.[0-9]*)|(?P<int>-?[0-9]+)|'(?P<text>(?:[^'\\\n]|\\.)*)'|(?P<name>[A-Za-z][.A-Za-z0-9_-]*)|(?P<mark>[()<>=]))"
)


@dataclass(frozen=True)
class Operand:
    kind: str  # Int, Double, String or Name
    value: str

    def __str__(self) -> str:
        return f"'{self.value}'" if self.kind == STRING else self.value

    @property
    def is_name(self) -> bool:
        return self.kind == "Name"


@dataclass(frozen=True)
class Condition:
    left: Operand
    op: str | None = None
    right: Operand | None = None

    def __str__(self) -> str:
        return str(self.left) if self.op is None else f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True)
class Predicate:
    clauses: tuple[tuple[Condition, ...], ...]

    def __str__(self) -> str:
        return " AND ".join("(" + " OR ".join(map(str, c)) + ")" for c in self.clauses)


def tokens(text: str) -> list[tuple[str, str]]:
    out, at, text = [], 0, text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"unexpected character at {at} of {text!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "name" and value in ("AND", "OR"):
            kind = "mark"
        out.append((kind, re.sub(r"\\(.)", r"\1", value) if kind == "text" else value))
        at = m.end()
    return out


def parse(text: str) -> Predicate:
    """The predicate that ``text`` spells."""
    rest = tokens(text)[::-1]

    def take(mark: str) -> None:
        if not rest or rest.pop() != ("mark", mark):
            raise SyntaxProblem(f"expected {mark} in {text!r}")

    def seen(*marks: str) -> bool:
        return bool(rest) and rest[-1][0] == "mark" and rest[-1][1] in marks

    def operand() -> Operand:
        if not rest or rest[-1][0] == "mark":
            raise SyntaxProblem(f"expected a value or a name in {text!r}")
        kind, value = rest.pop()
        return Operand({"int": INT, "dec": DOUBLE, "text": STRING, "name": "Name"}[kind], value)

    def condition() -> Condition:
        left = operand()
        if seen("<", ">", "="):
            op = rest.pop()[1]
            return Condition(left, op, operand())
        return Condition(left)

    clauses = []
    while True:
        take("(")
        clause = [condition()]
        while seen("OR"):
            rest.pop()
            clause.append(condition())
        take(")")
        clauses.append(tuple(clause))
        if not rest:
            return Predicate(tuple(clauses))
        take("AND")


def as_predicate(given: str | Predicate) -> Predicate:
    return parse(given) if isinstance(given, str) else given


#: name -> (column, Spark type)
Resolver = Callable[[str], tuple[Column, T.DataType]]


def unary_resolver(df: DataFrame) -> Resolver:
    fields = {f.name: f.dataType for f in reversed(df.schema.fields)}

    def find(name: str) -> tuple[Column, T.DataType]:
        if name not in fields:
            raise UnknownColumn(f"{name} is none of {', '.join(df.columns)}")
        return F.col(f"`{name}`"), fields[name]

    return find


def literal(operand: Operand, other: T.DataType | None) -> Column:
    if operand.kind == INT:
        n = int(operand.value)
        return F.lit(float(n)) if other is not None and kind_of(other) == DOUBLE else F.lit(n)
    if operand.kind == DOUBLE:
        return F.lit(float(operand.value))
    value = F.lit(operand.value)
    return value if other is None or isinstance(other, T.StringType) else value.cast(other)


def compile_condition(c: Condition, find: Resolver, strict: bool) -> Column:
    sides = [find(o.value) if o is not None and o.is_name else None for o in (c.left, c.right)]
    if c.op is None:
        return F.lit(True)
    kinds = [kind_of(s[1]) if s else o.kind for s, o in zip(sides, (c.left, c.right), strict=True)]
    if kinds[0] != kinds[1] and (strict or STRING in kinds):
        raise TypeMismatch(f"{c}: {kinds[0]} and {kinds[1]}")
    types = [s[1] if s else None for s in sides]
    a, b = (s[0] if s else literal(o, t) for s, o, t in zip(sides, (c.left, c.right), types[::-1], strict=True))
    return a < b if c.op == "<" else a > b if c.op == ">" else a == b


def compile_with(predicate: str | Predicate, find: Resolver, strict: bool = False) -> Column:
    """The boolean column; ``strict`` refuses an Int against a Double as well."""
    return reduce(and_, (reduce(or_, (compile_condition(c, find, strict) for c in clause)) for clause in as_predicate(predicate).clauses))


def bind(predicate: str | Predicate, df: DataFrame, strict: bool = False) -> Column:
    return compile_with(predicate, unary_resolver(df), strict)


def resolve_side(name: str, sides: tuple[tuple[str | None, list[str]], ...]) -> tuple[int, str]:
    """Which input has the name, and the name there.  ``alias.name`` names a side."""
    found = [(k, name) for k, (_, columns) in enumerate(sides) if name in columns]
    if not found and "." in name:
        alias, _, rest = name.partition(".")
        found = [(k, rest) for k, (own, columns) in enumerate(sides) if own == alias and rest in columns]
    if len(found) > 1:
        raise AmbiguousColumn(f"both inputs have {name}")
    if not found:
        raise UnknownColumn(f"no input has {name}")
    return found[0]


def sort_keys(predicate: str | Predicate) -> list[str]:
    """The names of the bare or self-equal conditions, in their order."""
    keys = []
    for clause in as_predicate(predicate).clauses:
        c = clause[0]
        if len(clause) > 1 or not c.left.is_name or c.op not in (None, "=") or c.op == "=" and c.right != c.left:
            raise SyntaxProblem("a sort order has one name in each clause")
        keys.append(c.left.value)
    return keys


def equi_keys(predicate: str | Predicate, sides: tuple[tuple[str | None, list[str]], ...]) -> list[tuple[str, str]]:
    """Pairs of columns that single-condition clauses set equal across both inputs."""
    keys = []
    for clause in as_predicate(predicate).clauses:
        c = clause[0]
        if len(clause) == 1 and c.op == "=" and c.left.is_name and c.right.is_name:
            (i, a), (j, b) = resolve_side(c.left.value, sides), resolve_side(c.right.value, sides)
            if i != j:
                keys.append((a, b) if i == 0 else (b, a))
    return keys
