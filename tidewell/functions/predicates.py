"""Filters as Columns.

Typed columns are compared with typed literals, so that predicates reach the scan.
Text columns compare as numbers where both sides are numbers, else as texts. A null
fails every comparison but Ne and NotIn, which it passes.
"""

from __future__ import annotations

import functools
import operator
import re
from collections.abc import Callable
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import SpecError
from tidewell.functions.dates import PATTERN, is_date_text
from tidewell.functions.numbers import NUMBER, as_double
from tidewell.spec import OPS, Filter, FilterGroup

#: The column that a filter is about, and its type.
Resolve = Callable[[Filter], tuple[Column, T.DataType]]
_COMPARE = {"Eq": operator.eq, "Gt": operator.gt, "Gte": operator.ge, "Lt": operator.lt, "Lte": operator.le}
_is_number = re.compile(NUMBER).match


def literal(value: str, kind: T.DataType) -> Column | None:
    """value as a literal of kind, or None if it can't be one and so compares with nothing."""
    text = value.strip()
    if isinstance(kind, T.NumericType):
        if not _is_number(text):
            return None
        if isinstance(kind, T.IntegralType):
            try:
                exact = Decimal(text)
                if exact == exact.to_integral_value() and abs(exact) < 1 << 63:
                    return F.lit(int(exact))
            except InvalidOperation:
                pass
            return F.lit(float(text))
        if isinstance(kind, T.DecimalType) and "n" not in text.lower():
            return F.lit(Decimal(text))
        return F.lit(float(text))
    if isinstance(kind, T.BooleanType):
        known = {"1": True, "true": True, "0": False, "false": False}
        return F.lit(known[text.lower()]) if text.lower() in known else None
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        # a date column is compared as a time with a literal that has one
        target = "timestamp_ntz" if isinstance(kind, T.DateType) and len(text) > 10 else kind.simpleString()
        return F.lit(text).try_cast(target) if is_date_text(text) else None
    return F.lit(value)


def _compare(c: Column, kind: T.DataType, op: str, value: str, hint: str | None) -> Column | None:
    """c op value, or None if the two are never comparable."""
    f = _COMPARE[op]
    if not isinstance(kind, T.StringType):
        v = literal(value, kind)
        return None if v is None else f(c, v)
    numeric = bool(_is_number(value))
    if hint in ("Int", "Float"):
        return f(as_double(c, kind), F.lit(float(value))) if numeric else None
    if hint == "Date":
        return F.when(c.rlike(PATTERN), f(c, F.lit(value))) if is_date_text(value) else None
    if not numeric:
        return f(c, F.lit(value))
    n = as_double(c, kind)
    return F.when(n.isNotNull(), f(n, F.lit(float(value)))).otherwise(f(c, F.lit(value)))


def options(f: Filter) -> list[str]:
    """The values of In and NotIn: values, else value split at commas and semicolons."""
    return [*f.values] if f.values else [x.strip() for x in re.split("[,;]", f.value or "") if x.strip()]


def _any(c: Column, kind: T.DataType, values: list[str], hint: str | None) -> Column:
    if not isinstance(kind, T.StringType):
        found = [v for v in (literal(x, kind) for x in values) if v is not None]
        return c.isin(found) if found else F.lit(False)
    plain = [x for x in values if not _is_number(x)] if hint is None or hint == "String" else []
    rest = [x for x in values if x not in plain]
    tests = [t for t in (_compare(c, kind, "Eq", x, hint) for x in rest) if t is not None]
    if plain:
        tests.append(c.isin(plain))
    return functools.reduce(operator.or_, tests) if tests else F.lit(False)


def predicate(c: Column, kind: T.DataType, f: Filter, allowed: tuple[str, ...] = OPS) -> Column:
    """One filter on a column of the given type."""
    if f.op not in allowed:
        raise SpecError(f"unknown operator '{f.op}'")
    is_text, value, false = isinstance(kind, T.StringType), f.value or "", F.lit(False)
    if f.op in _COMPARE:
        out = _compare(c, kind, f.op, value, f.field_type)
        return false if out is None else out
    if f.op == "Ne":
        same = _compare(c, kind, "Eq", value, f.field_type)
        return F.lit(True) if same is None else ~F.coalesce(same, false)
    if f.op == "In":
        return _any(c, kind, options(f), f.field_type)
    if f.op == "NotIn":
        values = options(f)
        return ~F.coalesce(_any(c, kind, values, f.field_type), false) if values else F.lit(True)
    if f.op == "Between":
        if f.value_to is None:
            return false
        low, high = _compare(c, kind, "Gte", value, f.field_type), _compare(c, kind, "Lte", f.value_to, f.field_type)
        return false if low is None or high is None else low & high
    if f.op == "IsNull":
        return c.isNull() | (F.trim(c) == "") if is_text else c.isNull()
    if f.op == "IsNotNull":
        return c.isNotNull() & (F.trim(c) != "") if is_text else c.isNotNull()
    text = F.lower(c if is_text else c.cast("string"))
    test = {"Contains": F.contains, "StartsWith": F.startswith, "EndsWith": F.endswith}[f.op]
    return test(text, F.lit(value.lower()))


def disabled(f: Filter) -> bool:
    """The placeholder '?' switches a filter off."""
    return f.field == "?" or f.value == "?"


def flat(filters: list[Filter], op: str, resolve: Resolve) -> Column | None:
    """A flat list joined by And or Or; None if nothing is left of it."""
    tests = [predicate(*resolve(f), f) for f in filters if not disabled(f)]
    return functools.reduce(operator.and_ if op == "And" else operator.or_, tests) if tests else None


def tree(node: Filter | FilterGroup, resolve: Resolve) -> Column:
    """A nested tree. An empty And is true, an empty Or false; a disabled leaf isn't there."""
    if isinstance(node, Filter):
        return predicate(*resolve(node), node)
    parts = [tree(x, resolve) for x in node.filters if not (isinstance(x, Filter) and disabled(x))]
    if not parts:
        return F.lit(node.op == "And")
    return functools.reduce(operator.and_ if node.op == "And" else operator.or_, parts)


def fields(node: Filter | FilterGroup | None) -> set[str]:
    if node is None:
        return set()
    return {node.field} if isinstance(node, Filter) else {x for n in node.filters for x in fields(n)}
