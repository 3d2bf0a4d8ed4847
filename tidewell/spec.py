"""Saved operations as dataclasses, and their JSON form.

Validation is strict: unknown operators, directions, join types and aggregation
kinds are errors, not silently something else.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from typing import Any

from tidewell.errors import SpecError

#: The names of comparison operators and of aggregation kinds in saved operations.
OPS = ("Eq", "Ne", "Gt", "Gte", "Lt", "Lte", "In", "NotIn", "Between", "IsNull", "IsNotNull", "Contains", "StartsWith", "EndsWith")
SIMPLE_OPS = ("Eq", "Ne", "Gt", "Gte", "Lt", "Lte", "In")
KINDS = ("Count", "GroupBy", "TopN", "Sum", "Avg", "Min", "Max", "CountDistinct", "Collect")
FIELD_TYPES = ("String", "Int", "Float", "Date")
BATCH_MODES = ("full", "computed_only", "merge_first_data")


@dataclass(frozen=True)
class Filter:
    field: str
    op: str = "Eq"
    value: str | None = ""
    value_to: str | None = None
    values: tuple[str, ...] = ()
    field_type: str | None = None


@dataclass(frozen=True)
class FilterGroup:
    op: str = "And"
    filters: tuple[Filter | FilterGroup, ...] = ()


@dataclass(frozen=True)
class JoinOn:
    left: str
    right: str
    op: str = "Eq"


@dataclass(frozen=True)
class Join:
    table: str
    on: tuple[JoinOn, ...]
    type: str = "Inner"
    alias: str | None = None
    entity: str | None = None
    count_matches_as: str | None = None
    sum_matches_field: str | None = None
    sum_matches_as: str | None = None

    @property
    def name(self) -> str:
        return (self.alias or "").strip() or self.table

    @property
    def synthetic(self) -> tuple[str, ...]:
        return tuple(x for x in (self.count_matches_as, self.sum_matches_as) if x)


@dataclass(frozen=True)
class Select:
    field: str = ""
    expression: str | None = None
    output: str | None = None

    @property
    def header(self) -> str:
        return self.output or self.expression or self.field


@dataclass(frozen=True)
class OrderBy:
    field: str
    direction: str = "Asc"


@dataclass(frozen=True)
class Having:
    op: str
    value: str | None = None
    value_to: str | None = None
    values: tuple[str, ...] = ()


@dataclass(frozen=True)
class Aggregation:
    kind: str
    field: str | None = None
    expression: str | None = None
    group_by: str | None = None
    n: int | str = 10
    having: Having | None = None


@dataclass(frozen=True)
class Collect:
    group_by: tuple[str, ...]
    items_as: str = "items"
    item_fields: tuple[str, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    include_group_fields_in_items: bool = False
    limit: int | None = None
    offset: int = 0


@dataclass(frozen=True)
class ResponseGrouping:
    fields: tuple[str, ...]
    items_as: str = "items"
    include_group_fields_in_items: bool = False
    children: tuple[ResponseGrouping, ...] = ()
    limit: int = 100
    offset: int = 0


@dataclass(frozen=True)
class Auth:
    enabled: bool = True
    table: str = "api_keys"
    token_col: str = "key_sha256"
    id_col: str = "user_id"
    filter_col: str = "user_id"
    scheme: str | None = None


@dataclass(frozen=True)
class SplitEnrichment:
    key_field: str
    enrichment: ReadOp
    ids_param: str = "split_ids"
    enrichment_key_field: str | None = None
    base_join_aliases: tuple[str, ...] = ()
    base_select_aliases: tuple[str, ...] = ()
    merge_fields: tuple[str, ...] = ()
    additive_fields: tuple[tuple[str, str], ...] = ()
    defaults: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class ReadOp:
    table: str
    name: str = ""
    entity: str = ""
    alias: str | None = None
    joins: tuple[Join, ...] = ()
    filters: tuple[Filter, ...] = ()
    filters_op: str = "And"
    filter_tree: Filter | FilterGroup | None = None
    aggregations: tuple[Aggregation | Collect, ...] = ()
    order_by: tuple[OrderBy, ...] = ()
    limit: int | None = None
    limit_param: str | None = None
    selected_fields: tuple[str, ...] = ()
    select: tuple[Select, ...] = ()
    response_grouping: ResponseGrouping | None = None
    auth: Auth | None = None
    split: SplitEnrichment | None = None

    @property
    def base(self) -> str:
        return (self.alias or "").strip() or self.table


@dataclass(frozen=True)
class InsertOp:
    name: str
    entity: str
    table: str
    expected_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class UpdateOp:
    name: str
    entity: str
    table: str
    filters: tuple[Filter, ...] = ()
    allowed_fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class DeleteOp:
    name: str
    entity: str
    table: str
    filters: tuple[Filter, ...] = ()


@dataclass(frozen=True)
class Computed:
    """language: plain for that of columns (functions/expressions), script for the wider one (functions/scripts)."""

    name: str
    expression: str
    inputs: dict[str, str] = field(default_factory=dict)
    language: str = "plain"


@dataclass(frozen=True)
class BatchOp:
    name: str
    operations: tuple[str, ...]
    computed_fields: tuple[Computed, ...] = ()
    response_mode: str = "full"


Operation = ReadOp | InsertOp | UpdateOp | DeleteOp | BatchOp


def _need(d: dict, key: str, where: str) -> Any:
    if not isinstance(d, dict) or d.get(key) in (None, ""):
        raise SpecError(f"{where} needs '{key}'")
    return d[key]


def _one_of(value: str, allowed: tuple[str, ...], what: str) -> str:
    if value not in allowed:
        raise SpecError(f"unknown {what} '{value}'; one of {', '.join(allowed)}")
    return value


def _list(value: Any) -> list:
    return [] if value is None else value if isinstance(value, list) else [value]


def _str(value: Any) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def filter_from(d: dict) -> Filter:
    kind = d.get("field_type")
    return Filter(
        _need(d, "field", "a filter"), _one_of(d.get("op", "Eq"), OPS, "operator"), _str(d.get("value", "")), _str(d.get("value_to")),
        tuple(_str(v) for v in _list(d.get("values")) if v is not None), kind and _one_of(kind, FIELD_TYPES, "field type"),
    )


def tree_from(d: dict) -> Filter | FilterGroup:
    """A leaf has a field; a group has filters (or children)."""
    if d.get("field"):
        return filter_from(d)
    return FilterGroup(_one_of(d.get("op", "And"), ("And", "Or"), "group operator"), tuple(tree_from(x) for x in _list(d.get("filters", d.get("children"))) if x is not None))


def order_from(d: dict) -> OrderBy:
    return OrderBy(_need(d, "field", "order_by"), _one_of(d.get("direction", "Asc"), ("Asc", "Desc"), "direction"))


def join_from(d: dict) -> Join:
    on = tuple(JoinOn(_need(x, "left", "a join condition"), _need(x, "right", "a join condition"), _one_of(x.get("op", "Eq"), ("Eq",), "join operator")) for x in _list(d.get("on")))
    j = Join(
        _need(d, "table", "a join"), on, _one_of(d.get("type", "Inner"), ("Inner", "Left"), "join type"), d.get("alias"), d.get("entity"),
        d.get("count_matches_as"), d.get("sum_matches_field"), d.get("sum_matches_as"),
    )
    check_join(j)
    return j


def check_join(j: Join) -> None:
    if not j.on:
        raise SpecError(f"the join of '{j.name}' has no conditions")
    if bool(j.sum_matches_field) != bool(j.sum_matches_as):
        raise SpecError("sum_matches_field and sum_matches_as go together")
    for name in j.synthetic:
        if "." in name:
            raise SpecError(f"'{name}' must be unqualified")
    if len(set(j.synthetic)) < len(j.synthetic) or j.sum_matches_as and j.sum_matches_as == j.sum_matches_field:
        raise SpecError("the names of a join's count, sum and summed field must differ")


def having_from(d: dict | None) -> Having | None:
    if d is None:
        return None
    return Having(_one_of(_need(d, "op", "having"), OPS[:9], "having operator"), _str(d.get("value")), _str(d.get("value_to")), tuple(_str(v) for v in _list(d.get("values"))))


def aggregation_from(d: Any) -> Aggregation | Collect:
    if isinstance(d, str):
        d = {d: {}}
    if not isinstance(d, dict) or len(d) != 1:
        raise SpecError("an aggregation is an object of one kind")
    (kind, p), = d.items()
    _one_of(kind, KINDS, "aggregation")
    p = p or {}
    if kind == "Collect":
        groups = tuple(_list(p.get("group_by_fields") or p.get("fields"))) or tuple(_list(p.get("group_by") or p.get("field")))
        if not groups:
            raise SpecError("Collect needs 'group_by' or 'group_by_fields'")
        include = p.get("include_group_fields_in_items", p.get("include_group_field_in_items", False))
        return Collect(groups, p.get("items_as", "items"), tuple(_list(p.get("item_fields"))), tuple(order_from(x) for x in _list(p.get("order_by"))), include, p.get("limit"), p.get("offset") or 0)
    a = Aggregation(kind, p.get("field"), p.get("expression"), p.get("group_by"), p.get("n", 10), having_from(p.get("having")))
    check_aggregation(a)
    return a


def check_aggregation(a: Aggregation) -> None:
    if a.kind in ("GroupBy", "TopN", "CountDistinct") and not a.field:
        raise SpecError(f"{a.kind} needs 'field'")
    if a.kind in ("Sum", "Avg", "Min", "Max") and not (a.field or a.expression):
        raise SpecError(f"{a.kind} needs 'field' or 'expression'")


def grouping_from(d: dict) -> ResponseGrouping:
    fields = tuple(_list(d.get("fields"))) or tuple(_list(d.get("field")))
    if not fields:
        raise SpecError("response_grouping needs 'field' or 'fields'")
    include = d.get("include_group_fields_in_items", d.get("include_group_field_in_items", False))
    limit, offset = d.get("limit_grouping"), d.get("offset_grouping")
    return ResponseGrouping(fields, d.get("items_as", "items"), include, tuple(grouping_from(x) for x in _list(d.get("children"))), min(100 if limit is None else limit, 100), offset or 0)


def split_from(d: dict) -> SplitEnrichment:
    _one_of(d.get("mode", "split_enrichment"), ("split_enrichment",), "execution mode")
    return SplitEnrichment(
        _need(d, "key_field", "split_enrichment"), read_from(_need(d, "enrichment_query", "split_enrichment")), d.get("ids_param", "split_ids"), d.get("enrichment_key_field"), tuple(_list(d.get("base_join_aliases"))),
        tuple(_list(d.get("base_select_aliases"))), tuple(_list(d.get("merge_fields"))), tuple((_need(x, "target_field", "additive_fields"), _need(x, "source_field", "additive_fields")) for x in _list(d.get("additive_fields"))), d.get("defaults") or {},
    )


def read_from(d: dict) -> ReadOp:
    tree, grouping, auth, profile = d.get("filter_tree"), d.get("response_grouping"), d.get("auth_config"), d.get("execution_profile")
    names = {"enabled", "table", "token_col", "id_col", "filter_col", "scheme"}
    return ReadOp(
        _need(d, "table", "a read"), d.get("name", ""), d.get("entity", ""), d.get("table_alias"), tuple(join_from(x) for x in _list(d.get("joins")) if x is not None),
        tuple(filter_from(x) for x in _list(d.get("filters")) if x is not None), _one_of(d.get("filters_op", "And"), ("And", "Or"), "filters_op"), tree and tree_from(tree),
        tuple(aggregation_from(x) for x in _list(d.get("aggregations"))), tuple(order_from(x) for x in _list(d.get("order_by"))), d.get("limit"), d.get("limit_param"), tuple(_list(d.get("selected_fields"))),
        tuple(Select(x.get("field") or "", x.get("expression"), x.get("as")) if isinstance(x, dict) else Select(x) for x in _list(d.get("select")) if x is not None), None if grouping is None else grouping_from(grouping),
        Auth(**{k: v for k, v in auth.items() if k in names}) if auth else None, split_from(profile) if isinstance(profile, dict) else None,
    )


def operation_from(d: dict) -> Operation:
    """{type, details} as an operation; without details the fields lie beside type."""
    kind = _one_of(d.get("type", "read"), ("read", "insert", "update", "delete", "batch"), "operation type")
    p = d.get("details")
    p = json.loads(p) if isinstance(p, str) else d if p is None else p
    if kind == "read":
        return read_from(p)
    if kind == "batch":
        computed = tuple(Computed(_need(x, "name", "computed_fields"), _need(x, "expression", "computed_fields"), x.get("inputs") or {}, _one_of(x.get("language") or "plain", ("plain", "script"), "language")) for x in _list(p.get("computed_fields")))
        return BatchOp(_need(p, "name", "a batch"), tuple(_list(p.get("operations"))), computed, _one_of(p.get("response_mode") or "full", BATCH_MODES, "response mode"))
    head = (_need(p, "name", kind), p.get("entity", ""), _need(p, "table", kind))
    if kind == "insert":
        return InsertOp(*head, tuple(_list(p.get("expected_fields"))))
    filters = tuple(filter_from(x) for x in _list(p.get("filters")))
    return UpdateOp(*head, filters, tuple(_list(p.get("allowed_fields")))) if kind == "update" else DeleteOp(*head, filters)


def load_catalog(text: str) -> dict[str, Operation]:
    """Operations by name from a JSON list of them. A name given twice is an error."""
    out: dict[str, Operation] = {}
    for d in json.loads(text):
        op = operation_from(d)
        if op.name in out:
            raise SpecError(f"operation '{op.name}' is there twice")
        out[op.name] = op
    return out


def referenced_tables(ops: list[Operation], by_name: dict[str, Operation] | None = None) -> set[tuple[str, str]]:
    """(entity, table) that the operations touch, those of joins, batches and enrichments too."""
    out: set[tuple[str, str]] = set()
    for op in ops:
        if isinstance(op, BatchOp):
            out |= referenced_tables([by_name[n] for n in op.operations if by_name and n in by_name], by_name)
            continue
        out.add((op.entity, op.table))
        if isinstance(op, ReadOp):
            out |= {(j.entity or op.entity, j.table) for j in op.joins}
            if op.auth and op.auth.enabled:
                out.add((op.entity, op.auth.table))
            if op.split:
                out |= referenced_tables([op.split.enrichment])
    return out


class OperationStore:
    """Saved operations by name: create fails on a name in use, replace and remove on an unknown one."""

    def __init__(self, ops: dict[str, Operation] | None = None):
        self.ops = dict(ops or {})

    def create(self, op: Operation) -> None:
        if op.name in self.ops:
            raise SpecError(f"operation '{op.name}' is there already")
        self.ops[op.name] = op

    def replace(self, op: Operation) -> None:
        if op.name not in self.ops:
            raise SpecError(f"no operation '{op.name}'")
        self.ops[op.name] = op

    def remove(self, name: str) -> None:
        if self.ops.pop(name, None) is None:
            raise SpecError(f"no operation '{name}'")
