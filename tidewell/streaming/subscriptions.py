"""Change notifications: the changes, batch or stream, that concern a saved read."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions import predicates
from tidewell.params import bind_read
from tidewell.spec import Filter, ReadOp


def subscribe(changes: DataFrame, op: ReadOp, params: Mapping[str, Any] | None = None) -> DataFrame:
    """The changes of any table of op whose row meets its filters, flat ones and tree, by the same rules as a read.

    Aliases don't count and column names match in any letter case. A column that a change
    doesn't carry is null. A DELETE with its old row is held against the filters; one
    without a row can't be judged and is passed on. Works on a stream as on a table.
    """
    op = bind_read(op, params or {})
    entities = [(op.entity, op.table), *((j.entity or op.entity, j.table) for j in op.joins)]
    concerned = F.lit(False)
    for e, t in dict.fromkeys(entities):
        concerned = concerned | ((F.lower("entity") == e.lower()) & (F.lower("tbl") == t.lower()))
    values = F.transform("row_columns", lambda c, i: F.struct(F.lower(c).alias("name"), F.get("row_values", i).alias("value")))

    def resolve(f: Filter) -> tuple[Column, T.DataType]:
        plain = f.field.rsplit(".", 1)[-1].lower()
        hit = F.filter(values, lambda v: v["name"] == plain)
        return F.get(hit, F.lit(0))["value"], T.StringType()

    tests = [t for t in (predicates.flat(list(op.filters), op.filters_op, resolve), op.filter_tree and predicates.tree(op.filter_tree, resolve)) if t is not None]
    out = changes.filter(concerned)
    bare = (F.upper(F.trim("op_type")) == "DELETE") & F.col("row_columns").isNull()
    for t in tests:
        out = out.filter(F.coalesce(t, F.lit(False)) | bare)
    return out


def retained(buckets: DataFrame, now: Column, hours: int = 48) -> DataFrame:
    """The hourly counts of the last so many whole hours before now's; older ones are let go."""
    return buckets.filter(F.col("bucket") >= F.date_trunc("hour", now).cast("timestamp_ntz") - F.expr(f"INTERVAL {hours} HOURS"))


def hourly_counts(events: DataFrame, at: str = "ts", kind: str = "event_type", late: str | None = None) -> DataFrame:
    """bucket, kind and n: operations or notifications by the hour; on a stream late is the watermark."""
    src = events.withWatermark(at, late) if late else events
    return src.groupBy(F.window(F.col(at), "1 hour").alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket"), kind, "n")
