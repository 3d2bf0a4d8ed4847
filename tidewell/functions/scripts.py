"""The wider expression language of batches: numbers, texts and truth values over scalars, compiled to Columns.

Binding from loose to tight: `||`, `&&`, comparisons, `+ -`, `* / %`, `- !` in front, `^` (to the right).
Numbers are doubles and a division by zero gives 0, as in the expressions of columns;
`+` joins two texts. What doesn't fit an operator or a function is a SpecError.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.errors import SpecError

NUMBER, TEXT, TRUTH = "number", "text", "truth"
_lexer = re.compile(r'\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<text>"(?:[^"\\]|\\.)*")|(?P<name>[^\W\d]\w*(?:::\w+)*)|(?P<op>\|\||&&|[=!<>]=|[-+*/%^!<>(),]))')
_BINDING = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "^": 7}
_PREFIX = 6


@dataclass(frozen=True)
class Typed:
    kind: str
    column: Column


def _number(f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *xs: Typed(NUMBER, f(*[x.column for x in xs]).cast("double"))


def _of(kind: str, f: Callable[..., Column]) -> Callable[..., Typed]:
    return lambda *xs: Typed(kind, f(*[x.column for x in xs]))


def _choice(test: Typed, then: Typed, otherwise: Typed) -> Typed:
    if then.kind != otherwise.kind:
        raise SpecError("both parts of 'if' must be of one type")
    return Typed(then.kind, F.when(test.column, then.column).otherwise(otherwise.column))


#: Functions: the types of their arguments (None: any; a single type in a list: one or more of it) and what they make.
FUNCTIONS: dict[str, tuple[list, Callable[..., Typed]]] = {
    "if": ([TRUTH, None, None], _choice),
    "min": ([[NUMBER]], _number(lambda *xs: F.least(*xs) if len(xs) > 1 else xs[0])), "max": ([[NUMBER]], _number(lambda *xs: F.greatest(*xs) if len(xs) > 1 else xs[0])),
    "floor": ([NUMBER], _number(F.floor)), "ceil": ([NUMBER], _number(F.ceil)), "round": ([NUMBER], _number(lambda x: F.round(x, 0))),
    "math::abs": ([NUMBER], _number(F.abs)), "math::sqrt": ([NUMBER], _number(F.sqrt)), "math::pow": ([NUMBER, NUMBER], _number(F.pow)), "math::ln": ([NUMBER], _number(F.ln)), "math::is_nan": ([NUMBER], _of(TRUTH, F.isnan)),
    "len": ([TEXT], _number(F.length)), "str::to_lowercase": ([TEXT], _of(TEXT, F.lower)), "str::to_uppercase": ([TEXT], _of(TEXT, F.upper)), "str::trim": ([TEXT], _of(TEXT, F.trim)),
    "str::from": ([None], _of(TEXT, lambda x: x.cast("string"))), "str::contains": ([TEXT, TEXT], _of(TRUTH, F.contains)), "str::regex_matches": ([TEXT, TEXT], _of(TRUTH, F.regexp_like)),
}


class _Reader:
    def __init__(self, text: str, value_of: Callable[[str], Typed]):
        self.text, self.value_of, self.tokens, self.at = text, value_of, [], 0
        at, end = 0, len(text.rstrip())
        while at < end:
            m = _lexer.match(text, at)
            if not m:
                raise SpecError(f"can't read '{text[at:]}' in expression '{text}'")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise SpecError(f"expression '{self.text}' ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def take(self, op: str) -> bool:
        hit = self.at < len(self.tokens) and self.tokens[self.at] == ("op", op)
        self.at += hit
        return hit

    def expression(self, least: int = 0) -> Typed:
        left = self.operand()
        while self.at < len(self.tokens) and (op := self.tokens[self.at])[0] == "op" and _BINDING.get(op[1], -1) > least:
            self.at += 1
            power = _BINDING[op[1]]
            left = self.combined(op[1], left, self.expression(power - 1 if op[1] == "^" else power))
        return left

    def operand(self) -> Typed:
        kind, value = self.next()
        if kind == "number":
            return Typed(NUMBER, F.lit(float(value)))
        if kind == "text":
            return Typed(TEXT, F.lit(re.sub(r"\\(.)", r"\1", value[1:-1])))
        if kind == "name":
            if value in ("true", "false"):
                return Typed(TRUTH, F.lit(value == "true"))
            return self.call(value) if self.take("(") else self.value_of(value)
        if value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if value in "-!":
            x = self.expression(_PREFIX)
            self.want(value, x, NUMBER if value == "-" else TRUTH)
            return Typed(x.kind, -x.column if value == "-" else ~x.column)
        raise SpecError(f"'{value}' is out of place in expression '{self.text}'")

    def need(self, op: str) -> None:
        if not self.take(op):
            raise SpecError(f"'{op}' is missing in expression '{self.text}'")

    def want(self, where: str, x: Typed, kind: str | None) -> None:
        if kind and x.kind != kind:
            raise SpecError(f"'{where}' takes a {kind}, not a {x.kind}, in expression '{self.text}'")

    def call(self, name: str) -> Typed:
        if name not in FUNCTIONS:
            raise SpecError(f"unknown function '{name}'")
        args: list[Typed] = []
        while not self.take(")"):
            if args:
                self.need(",")
            args.append(self.expression())
        kinds, make = FUNCTIONS[name]
        kinds = kinds[0] * max(1, len(args)) if isinstance(kinds[0], list) else kinds
        if len(args) != len(kinds):
            raise SpecError(f"'{name}' takes {len(kinds)} arguments, not {len(args)}")
        for x, kind in zip(args, kinds):
            self.want(name, x, kind)
        return make(*args)

    def combined(self, op: str, a: Typed, b: Typed) -> Typed:
        x, y = a.column, b.column
        if op in ("||", "&&"):
            self.want(op, a, TRUTH), self.want(op, b, TRUTH)
            return Typed(TRUTH, x | y if op == "||" else x & y)
        if op == "+" and a.kind == b.kind == TEXT:
            return Typed(TEXT, F.concat(x, y))
        if _BINDING[op] == 3:
            self.want(op, b, a.kind)
            return Typed(TRUTH, {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op])
        self.want(op, a, NUMBER), self.want(op, b, NUMBER)
        zero = F.when(y == 0, F.lit(0.0))
        make = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: zero.otherwise(F.try_divide(x, y)), "%": lambda: zero.otherwise(F.try_mod(x, y)), "^": lambda: F.pow(x, y)}
        return Typed(NUMBER, make[op]())


def to_column(text: str, value_of: Callable[[str], Column]) -> Column:
    """value_of gives a name's value as a number."""
    r = _Reader(text, lambda name: Typed(NUMBER, value_of(name)))
    out = r.expression()
    if r.at < len(r.tokens):
        raise SpecError(f"expression '{text}' goes on after its end")
    return out.column
