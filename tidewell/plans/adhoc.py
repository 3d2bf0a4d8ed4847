"""Searches without a saved operation: one table, simple operators, the same compiler."""

from __future__ import annotations

from collections.abc import Iterable
from typing import Any

from tidewell.catalog import Catalog
from tidewell.errors import SpecError
from tidewell.plans.compiler import Options, Plan
from tidewell.spec import SIMPLE_OPS, Aggregation, Collect, Filter, OrderBy, ReadOp


def search(
    catalog: Catalog, entity: str, table: str, filters: Iterable[Filter] = (), fields: Iterable[str] = (), order_by: Iterable[OrderBy] = (), filters_op: str = "And", limit: int | None = None, page: int = 1,
    aggregations: Iterable[Aggregation | Collect] = (), identity: Any = None, options: Options = Options(max_limit=10_000),
) -> Plan:
    """A plan over one table. No limit means the default one, 0 means counts and aggregations alone."""
    filters = tuple(filters)
    for f in filters:
        if f.op not in SIMPLE_OPS:
            raise SpecError(f"operator '{f.op}' is not one of {', '.join(SIMPLE_OPS)}")
    op = ReadOp(table, "search", entity, filters=filters, filters_op=filters_op, selected_fields=tuple(fields), order_by=tuple(order_by), limit=limit, aggregations=tuple(aggregations))
    return Plan(op, catalog, {"page": page}, identity, options)
