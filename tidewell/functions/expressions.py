"""The expression language of computed columns, compiled to Columns.

    comparison := sum (('=' | '!=' | '>' | '>=' | '<' | '<=') sum)*
    sum        := product (('+' | '-') product)*
    product    := unary (('*' | '/') unary)*
    unary      := '-' unary | primary
    primary    := number | name | IF '(' comparison ',' comparison ',' comparison ')' | '(' comparison ')'

All operators are left-associative. Values are doubles: a missing or non-numeric
field is 0, a division by 0 gives 0, comparisons give 1 or 0, equality is within
2^-52, and IF takes its second part where the first is above 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.errors import SpecError

EPSILON = 2.0**-52
_token = re.compile(r"\s*(?:(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?![\w.]))|(?P<name>[^\W\d][\w.]*)|(?P<op>!=|>=|<=|[-+*/=<>(),]))")


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Binary:
    op: str
    left: Node
    right: Node


@dataclass(frozen=True)
class If:
    condition: Node
    then: Node
    otherwise: Node


Node = Number | Name | Binary | If
_LEVELS = (("=", "!=", ">", ">=", "<", "<="), ("+", "-"), ("*", "/"))


class _Parser:
    def __init__(self, text: str):
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip()
        while at < len(text):
            m = _token.match(text, at)
            if not m:
                raise SpecError(f"can't read '{text[at:]}' in expression '{text}'")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.text, self.at = text, 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, *ops: str) -> str | None:
        kind, value = self.peek()
        if kind == "op" and value in ops:
            self.at += 1
            return value
        return None

    def need(self, op: str) -> None:
        if not self.take(op):
            raise SpecError(f"'{op}' is missing in expression '{self.text}'")

    def level(self, k: int = 0) -> Node:
        if k == len(_LEVELS):
            return self.unary()
        node = self.level(k + 1)
        while op := self.take(*_LEVELS[k]):
            node = Binary(op, node, self.level(k + 1))
        return node

    def unary(self) -> Node:
        if self.take("-"):
            return Binary("-", Number(0.0), self.unary())
        return self.primary()

    def primary(self) -> Node:
        if self.take("("):
            node = self.level()
            self.need(")")
            return node
        kind, value = self.peek()
        if kind == "number":
            self.at += 1
            return Number(float(value))
        if kind != "name":
            raise SpecError(f"expression '{self.text}' ends early or has '{value}' out of place")
        self.at += 1
        if value.lower() == "if" and self.take("("):
            parts = [self.level()]
            for _ in range(2):
                self.need(",")
                parts.append(self.level())
            self.need(")")
            return If(*parts)
        if value.lower() in ("inf", "infinity", "nan"):
            return Number(float(value))
        return Name(value)


def parse(text: str) -> Node:
    p = _Parser(text)
    if not p.tokens:
        raise SpecError("the expression is empty")
    node = p.level()
    if p.at < len(p.tokens):
        raise SpecError(f"expression '{text}' goes on after its end")
    return node


def names(node: Node) -> set[str]:
    if isinstance(node, Name):
        return {node.name}
    if isinstance(node, Binary):
        return names(node.left) | names(node.right)
    if isinstance(node, If):
        return names(node.condition) | names(node.then) | names(node.otherwise)
    return set()


def to_column(node: Node, value_of: Callable[[str], Column]) -> Column:
    """value_of gives a name's value as a double, null where it is missing or no number."""
    if isinstance(node, Number):
        return F.lit(node.value)
    if isinstance(node, Name):
        return value_of(node.name)
    if isinstance(node, If):
        return F.when(to_column(node.condition, value_of) > 0, to_column(node.then, value_of)).otherwise(to_column(node.otherwise, value_of))
    left, right = to_column(node.left, value_of), to_column(node.right, value_of)
    if node.op == "+":
        return left + right
    if node.op == "-":
        return left - right
    if node.op == "*":
        return left * right
    if node.op == "/":
        return F.when(right == 0, F.lit(0.0)).otherwise(F.try_divide(left, right))
    apart = F.abs(left - right)
    test = {"=": apart < EPSILON, "!=": apart > EPSILON, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right}[node.op]
    return F.when(test, F.lit(1.0)).otherwise(F.lit(0.0))
