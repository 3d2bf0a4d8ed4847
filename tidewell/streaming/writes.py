"""Saved updates and deletes as changes of the log: nothing is changed in place."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.catalog import Catalog
from tidewell.errors import SpecError
from tidewell.params import bind_read
from tidewell.plans.compiler import WHOLE, Plan, quoted
from tidewell.spec import DeleteOp, ReadOp, UpdateOp


def write_changes(op: UpdateOp | DeleteOp, catalog: Catalog, params: Mapping[str, Any], position: tuple[str, int], payload: Mapping[str, Any] | None = None) -> DataFrame:
    """One UPDATE or DELETE for each row that meets the filters, in the form of the change log.

    An operation without filters, a table without a key and a payload with other than
    the allowed fields are errors. Changes are numbered by the hash of their key, which
    is enough: they touch different rows.
    """
    t = catalog.table(op.entity, op.table)
    if not op.filters or not t.key:
        raise SpecError(f"'{op.name}' needs filters and a table with a key")
    payload = dict(payload or {})
    if isinstance(op, UpdateOp):
        if not payload or (extra := set(payload) - set(op.allowed_fields)):
            raise SpecError(f"fields that '{op.name}' may not set: {sorted(extra) if payload else 'none given'}")
        if set(payload) & set(t.key):
            raise SpecError("the key can't be set")
    read = bind_read(ReadOp(op.table, op.name, op.entity, filters=op.filters), params)
    rows = Plan(read, catalog, {}, None, WHOLE).rows
    parts = [F.coalesce(quoted(f"{op.table}.{k}").cast("string"), F.lit("")) for k in t.key]
    texts = [None if v is None else str(v) for v in payload.values()]
    listed = isinstance(op, UpdateOp)
    return rows.select(
        F.lit(op.entity).alias("entity"), F.lit(op.table).alias("tbl"), F.lit("UPDATE" if listed else "DELETE").alias("op_type"), F.concat_ws("\u001f", *parts).alias("pk"), F.lit(None).cast("string").alias("pk_before"),
        (F.array(*[F.lit(c) for c in payload]) if listed else F.lit(None)).cast("array<string>").alias("row_columns"), (F.array(*[F.lit(v) for v in texts]) if listed else F.lit(None)).cast("array<string>").alias("row_values"),
        F.lit(position[0]).alias("binlog_file"), F.lit(position[1]).cast("bigint").alias("binlog_pos"), F.pmod(F.hash(*parts), F.lit(1 << 30)).alias("row_no"),
    )
