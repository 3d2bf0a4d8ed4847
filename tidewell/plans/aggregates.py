"""Aggregations of a read: each over all rows that meet the filters, before sort and page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import SpecError
from tidewell.functions import predicates
from tidewell.functions.numbers import exact_sum
from tidewell.plans.compiler import AggregationResult, Plan, plain_name, quoted
from tidewell.spec import Aggregation, Collect, Filter, Having


def _having(df: DataFrame, metric: str, h: Having | None) -> DataFrame:
    if h is None:
        return df
    return df.filter(predicates.predicate(quoted(metric).cast("double"), T.DoubleType(), Filter(metric, h.op, h.value, h.value_to, h.values)))


def _summary(value: Column, df: DataFrame) -> DataFrame:
    return df.agg(value.alias("summary"))


def _group(plan: Plan, name: str) -> tuple[Column, str]:
    return plan.resolve(name)[0], plain_name(name)


def _by_count(grouped: DataFrame, group: str, metric: str) -> DataFrame:
    """Most first; ties by the group's text, so 10 stands before 9."""
    return grouped.orderBy(quoted(metric).desc(), quoted(group).cast("string").asc_nulls_first())


def aggregate(plan: Plan, a: Aggregation | Collect) -> AggregationResult:
    if isinstance(a, Collect):
        from tidewell.plans.shaping import collect

        return collect(plan, a)
    rows = plan.rows
    if a.kind == "Count":
        if not a.field:
            return AggregationResult("Count", None, _summary(F.count("*"), rows))
        # rows in which the field's table matched: on the base every row
        alias = plan.alias_of(a.field)
        if alias == plan.op.base or plan.joins[alias].type == "Inner" or plan.synthetic(a.field):
            return AggregationResult("Count", None, _summary(F.count("*"), rows))
        return AggregationResult("Count", None, _summary(F.count(_matched(plan, alias)), rows))
    if a.kind in ("GroupBy", "TopN"):
        c, group = _group(plan, a.field)
        counted = rows.groupBy(c.alias(group)).agg(F.count("*").alias("count"))
        data = _by_count(counted, group, "count")
        if a.kind == "TopN":
            data = data.limit(int(a.n))
        summary = _summary(F.coalesce(F.sum("count"), F.lit(0)), data)
        return AggregationResult(a.kind, _having(data, "count", a.having), summary)
    if a.kind == "CountDistinct":
        c, name = plan.resolve(a.field)[0], "count_distinct"
        alias = plan.alias_of(a.field)
        if not a.group_by:
            # an unmatched left row has no value; a null of a matched one counts as one
            present = F.lit(True) if alias == plan.op.base or plan.synthetic(a.field) else _matched(plan, alias).isNotNull()
            null = F.max(F.when(c.isNull() & present, 1).otherwise(0)) if plan.options.null_as_zero else F.lit(0)
            return AggregationResult(a.kind, None, _summary(F.count_distinct(c) + F.coalesce(null, F.lit(0)), rows))
        g, group = _group(plan, a.group_by)
        null = F.max(F.when(c.isNull(), 1).otherwise(0)) if plan.options.null_as_zero else F.lit(0)
        data = rows.groupBy(g.alias(group)).agg((F.count_distinct(c) + null).alias(name))
        return AggregationResult(a.kind, _having(_by_count(data, group, name), name, a.having), _summary(F.coalesce(F.sum(name), F.lit(0)), data))
    if a.kind not in ("Sum", "Avg", "Min", "Max"):
        raise SpecError(f"unknown aggregation '{a.kind}'")
    value = plan.expression(a.expression or a.field)
    metric = a.kind.lower()
    total = _metric(plan, a.kind, value)
    if not a.group_by:
        return AggregationResult(a.kind, None, _summary(total, rows))
    g, group = _group(plan, a.group_by)
    data = _by_count(rows.groupBy(g.alias(group)).agg(total.alias(metric)), group, metric)
    return AggregationResult(a.kind, _having(data, metric, a.having), _summary(total, rows))


def _metric(plan: Plan, kind: str, value: Column) -> Column:
    """An empty input gives 0. NaN doesn't count for Min and Max."""
    digits = plan.options.sum_digits
    if kind == "Sum":
        return exact_sum(value, digits)
    if kind == "Avg":
        return F.when(F.count(value) > 0, exact_sum(value, digits) / F.count(value)).otherwise(F.lit(0.0))
    real = F.when(~F.isnan(value), value)
    return F.coalesce(F.min(real) if kind == "Min" else F.max(real), F.lit(0.0))


def _matched(plan: Plan, alias: str) -> Column:
    """Not null where the alias matched: any of its join columns holds a value then."""
    sides = [plan.qualify(s) for c in plan.joins[alias].on for s in (c.left, c.right) if plan.alias_of(s) == alias]
    return F.coalesce(*[quoted(s).cast("string") for s in sides])
