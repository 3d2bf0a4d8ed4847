"""Batches of saved reads, and computed values over their summaries."""

from __future__ import annotations

import re
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.catalog import Catalog
from tidewell.errors import SpecError
from tidewell.functions import expressions, scripts
from tidewell.params import scoped
from tidewell.plans.compiler import Options, Plan
from tidewell.spec import BatchOp, Operation, ReadOp


class Batch:
    """The plans of a batch by name, or the error of each that has none; one bad operation doesn't stop the others."""

    def __init__(self, op: BatchOp, ops: Mapping[str, Operation], catalog: Catalog, params: Mapping[str, Any] | None = None, identity: Any = None, options: Options = Options()):
        self.op, self.spark = op, catalog.spark
        self.plans: dict[str, Plan] = {}
        self.errors: dict[str, Exception] = {}
        for name in op.operations:
            try:
                found = ops.get(name)
                if not isinstance(found, ReadOp):
                    raise SpecError(f"'{name}' is no saved read")
                self.plans[name] = Plan(found, catalog, scoped(params or {}, name), identity, options)
            except (SpecError, PermissionError) as e:
                self.errors[name] = e

    def _input(self, source: str) -> Column:
        """`op.summary` or `op.summary[i]` as a scalar subquery."""
        name, _, path = source.partition(".")
        m = re.fullmatch(r"summary(?:\[(\d+)\])?", path)
        if not m:
            raise SpecError(f"unknown input '{source}'")
        if name not in self.plans:
            raise SpecError(f"no result of '{name}'")
        every, i = self.plans[name].aggregations, int(m[1] or 0)
        if i >= len(every):
            raise SpecError(f"'{name}' has no aggregation {i}")
        return every[i].summary.select(F.col("summary").cast("double")).scalar()

    def _columns(self) -> dict[str, Column]:
        out = {}
        for c in self.op.computed_fields:
            inputs = {n: self._input(s) for n, s in c.inputs.items()}

            def value(name: str, inputs: dict[str, Column] = inputs, field: str = c.name) -> Column:
                if name not in inputs:
                    raise SpecError(f"'{field}' has no input '{name}'")
                return F.coalesce(inputs[name], F.lit(0.0))

            out[c.name] = scripts.to_column(c.expression, value) if c.language == "script" else expressions.to_column(expressions.parse(c.expression), value)
        return out

    def computed(self) -> DataFrame:
        """One row with the computed values."""
        return self.spark.range(1).select(*[c.alias(n) for n, c in self._columns().items()])

    def merged(self) -> DataFrame:
        """The data of the first operation, with the computed values in every row."""
        first = self.op.operations[0] if self.op.operations else None
        if first not in self.plans:
            raise self.errors.get(first) or SpecError("the batch has no operations")
        return self.plans[first].data.withColumns(self._columns())

    def result(self) -> DataFrame | dict[str, DataFrame | None]:
        if self.op.response_mode == "computed_only":
            return self.computed()
        if self.op.response_mode == "merge_first_data":
            return self.merged()
        return {n: p.data for n, p in self.plans.items()}

    def meta(self, threads: int = 4) -> dict[str, int]:
        """Most pages and all items over the operations; their counts run side by side."""
        with ThreadPoolExecutor(threads) as pool:
            pages = [p for p in pool.map(lambda p: p.pagination(), self.plans.values()) if p]
        return {"total_pages": max((p["total_pages"] for p in pages), default=0), "total_items": sum(p["total_items"] for p in pages)}
