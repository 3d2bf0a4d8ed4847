"""Parameters of saved operations: $name|trim|lowercase|uppercase|split:<delimiter>:<index>."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import replace
from typing import Any

from tidewell.errors import MissingParams, SpecError
from tidewell.spec import Aggregation, Collect, Filter, FilterGroup, Having, ReadOp

_PLAIN: dict[str, Callable[[str], str]] = {"trim": str.strip, "lowercase": str.lower, "uppercase": str.upper}


def _split(value: str, rest: str) -> str:
    delimiter, colon, index = rest.rpartition(":")
    if not colon or not delimiter:
        raise SpecError("split needs a delimiter and an index")
    if not index.isascii() or not index.isdigit():
        raise SpecError(f"'{index}' is no index of split")
    parts = value.split(delimiter)
    if int(index) >= len(parts):
        raise SpecError(f"split has {len(parts)} parts, index {index} is out of bounds")
    return parts[int(index)]


def transform(value: str, steps: list[str]) -> str:
    """The steps from left to right; an unknown one is an error."""
    for step in steps:
        name, _, rest = step.partition(":")
        if name == "split":
            value = _split(value, rest)
        elif step in _PLAIN:
            value = _PLAIN[step](value)
        else:
            raise SpecError(f"unknown transform '{step}'")
    return value


def bind(value: str | None, params: Mapping[str, Any], missing: list[str]) -> str | None:
    """A value with its parameter filled in; what is no parameter stays as it is. Names without a value go to missing."""
    if value is None or not value.startswith("$") or len(value) == 1:
        return value
    name, *steps = value[1:].split("|")
    if params.get(name) is None:
        missing.append(name)
        return value
    given = params[name]
    return transform(given if isinstance(given, str) else str(given), steps)


def _filter(f: Filter, params: Mapping[str, Any], missing: list[str]) -> Filter:
    values = tuple(x for v in f.values for x in _listed(v, params, missing))
    return replace(f, value=bind(f.value, params, missing), value_to=bind(f.value_to, params, missing), values=values)


def _listed(value: str, params: Mapping[str, Any], missing: list[str]) -> list[str]:
    """A list parameter stands for all its values."""
    if value.startswith("$") and isinstance(params.get(value[1:]), (list, tuple)):
        return [str(x) for x in params[value[1:]]]
    bound = bind(value, params, missing)
    return [] if bound is None else [bound]


def _tree(node: Filter | FilterGroup, params: Mapping[str, Any], missing: list[str]) -> Filter | FilterGroup:
    if isinstance(node, Filter):
        return _filter(node, params, missing)
    return replace(node, filters=tuple(_tree(x, params, missing) for x in node.filters))


def _aggregation(a: Aggregation | Collect, params: Mapping[str, Any], missing: list[str]) -> Aggregation | Collect:
    if isinstance(a, Collect):
        return a
    h: Having | None = a.having
    if h:
        h = replace(h, value=bind(h.value, params, missing), value_to=bind(h.value_to, params, missing), values=tuple(x for v in h.values for x in _listed(v, params, missing)))
    n = bind(a.n, params, missing) if isinstance(a.n, str) else a.n
    if isinstance(n, str):
        n = int(n) if n.isascii() and n.isdigit() else 10
    return replace(a, field=bind(a.field, params, missing), expression=bind(a.expression, params, missing), group_by=bind(a.group_by, params, missing), n=n, having=h)


def bind_read(op: ReadOp, params: Mapping[str, Any]) -> ReadOp:
    """op with all its parameters filled in, or MissingParams with every name that has no value."""
    missing: list[str] = []
    out = replace(
        op,
        filters=tuple(_filter(f, params, missing) for f in op.filters),
        filter_tree=op.filter_tree and _tree(op.filter_tree, params, missing),
        aggregations=tuple(_aggregation(a, params, missing) for a in op.aggregations),
    )
    if missing:
        raise MissingParams(missing)
    return out


def scoped(params: Mapping[str, Any], op_name: str) -> dict[str, Any]:
    """The parameters of one operation of a batch: `op:name` beats the plain name."""
    own = {k.split(":", 1)[1]: v for k, v in params.items() if k.startswith(f"{op_name}:")}
    return {k: v for k, v in params.items() if ":" not in k} | own
