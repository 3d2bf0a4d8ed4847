"""Nested results: Collect, response grouping, JSON rows."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import SpecError
from tidewell.plans.compiler import AggregationResult, Plan, quoted
from tidewell.spec import Collect, OrderBy, ResponseGrouping


def _need(df: DataFrame, names: list[str], what: str) -> None:
    if gone := [n for n in names if n not in df.columns]:
        raise SpecError(f"{what} {gone} are not in the projected result")


def _compare(order: list[tuple[str, bool]]):
    """A comparator of structs by (field, ascending), nulls first on ascending."""

    def compare(x: Column, y: Column) -> Column:
        out = F.lit(0)
        for name, up in reversed(order):
            a, b = x[name], y[name]
            less, more = (-1, 1) if up else (1, -1)
            below = (a.isNull() & b.isNotNull()) | F.coalesce(a < b, F.lit(False))
            above = (b.isNull() & a.isNotNull()) | F.coalesce(a > b, F.lit(False))
            out = F.when(below, less).when(above, more).otherwise(out)
        return out

    return compare


def collect(plan: Plan, c: Collect) -> AggregationResult:
    """One row a group with its items as an array of structs, over all rows of the read.

    Items come in the order of c.order_by, else of the read's order, else of their own
    values; groups come by key. A group with all its items is one row, so with groups of
    any size ask for a page: with c.limit only the items up to the end of the page leave
    the tasks that read them, and `<items_as>_pagination` says how many there are.
    """
    df = plan.projected(plan.rows)
    groups = list(c.group_by)
    _need(df, groups, "group fields")
    items = list(c.item_fields) or [n for n in df.columns if c.include_group_fields_in_items or n not in groups]
    if c.include_group_fields_in_items:
        items += [n for n in df.columns if n not in items]
    if not items:
        raise SpecError("Collect needs item fields")
    _need(df, items, "item fields")
    if gone := [o.field for o in c.order_by if o.field not in items]:
        raise SpecError(f"Collect order_by fields {gone} must be item fields")
    whole, totals = df, None
    if c.limit is not None:
        by = [quoted(o.field).asc_nulls_first() if o.direction == "Asc" else quoted(o.field).desc_nulls_last() for o in (c.order_by or _usable(plan, df))]
        rest = [quoted(n) for n in items if not isinstance(df.schema[n].dataType, (T.MapType, T.VariantType))]
        rank = F.row_number().over(Window.partitionBy(*[quoted(g) for g in groups]).orderBy(*by, *rest))
        df = df.withColumn("_rank", rank).filter((F.col("_rank") <= c.offset + c.limit) & (F.col("_rank") > c.offset)).drop("_rank")
        totals = whole.groupBy(*[quoted(g).alias(f"_g{i}") for i, g in enumerate(groups)]).agg(F.count("*").alias("_total"))
    lead = [quoted(o.field).alias(f"_k{i}") for i, o in enumerate(_usable(plan, df))] if not c.order_by else []
    item = F.struct(*[quoted(n) for n in items])
    entry = F.struct(*lead, item.alias("item")) if lead else F.struct(item.alias("item"))
    out = df.groupBy(*[quoted(g) for g in groups]).agg(F.collect_list(entry).alias("_all"), F.count("*").alias("_n"))
    if c.order_by:
        sorted_ = F.array_sort(F.transform("_all", lambda e: e["item"]), _compare([(o.field, o.direction == "Asc") for o in c.order_by]))
        out = out.withColumn(c.items_as, sorted_)
    else:
        usable = _usable(plan, df)
        directions = [(f"_k{i}", o.direction == "Asc") for i, o in enumerate(usable)]
        ordered = F.array_sort(F.array_sort("_all"), _compare(directions)) if directions else F.array_sort("_all")
        out = out.withColumn(c.items_as, F.transform(ordered, lambda e: e["item"]))
    if totals is None:
        data = out.select(*[quoted(g) for g in groups], quoted(c.items_as))
    else:
        met = totals.join(out, [F.col(f"_g{i}").eqNullSafe(quoted(g)) for i, g in enumerate(groups)], "left")
        none = F.array().cast(out.schema[c.items_as].dataType)
        paging = _pagination(F.col("_total"), ResponseGrouping(c.group_by, limit=c.limit, offset=c.offset)).alias(f"{c.items_as}_pagination")
        data = met.select(*[F.col(f"_g{i}").alias(g) for i, g in enumerate(groups)], F.coalesce(quoted(c.items_as), none).alias(c.items_as), paging)
    data = data.orderBy(*[quoted(g) for g in groups])
    return AggregationResult("Collect", data, plan.rows.agg(F.count("*").alias("summary")))


def _usable(plan: Plan, df: DataFrame) -> list[OrderBy]:
    """The read's order keys that the projection shows, by their header."""
    shown = {plan.qualify(s.field): s.header for s in plan.op.select if s.field and not s.expression} if plan.op.select else {}
    out = []
    for o in plan.op.order_by:
        full = plan.qualify(o.field) if o.field in plan._known else o.field
        name = shown.get(full, o.field)
        if name in df.columns:
            out.append(OrderBy(name, o.direction))
    return out


def runtime_grouping(plan: Plan) -> ResponseGrouping:
    """The read's grouping with the page that its parameters ask for: grouping_limit, grouping_offset, or
    grouping_page (also `<items_as>_pagination`). A page has at most 100 items."""
    g, p = plan.op.response_grouping, plan.params
    if g is None:
        raise SpecError("the operation has no response_grouping")
    try:
        limit = min(100, max(0, int(p.get("grouping_limit", g.limit))))
        page = p.get("grouping_page", p.get(f"{g.items_as}_pagination"))
        offset = p.get("grouping_offset")
        offset = int(offset) if offset is not None else (max(1, int(page)) - 1) * limit if page is not None else g.offset
    except (TypeError, ValueError):
        raise SpecError("grouping_limit, grouping_page and grouping_offset are numbers") from None
    return replace(g, limit=limit, offset=max(0, offset))


def group_response(plan: Plan, grouping: ResponseGrouping | None = None) -> DataFrame:
    """The rows as one row a group: group fields, a page of items and `<items_as>_pagination`; nested by children[0].

    An item whose values are all null or '' counts for nothing, though its group stays.
    Only the items up to the end of the page leave the tasks that read them, so a group
    may be of any size; its total is counted by itself. Groups come by key.
    """
    g = grouping or runtime_grouping(plan)
    df = plan.projected(plan.rows)
    fields = list(g.fields)
    _need(df, fields, "grouping fields")
    items = df.columns if g.include_group_fields_in_items else [n for n in df.columns if n not in fields]
    filled = _filled([quoted(n) for n in items], [df.schema[n].dataType for n in items])
    keys = [quoted(f) for f in fields]
    order = [quoted(o.field).asc_nulls_first() if o.direction == "Asc" else quoted(o.field).desc_nulls_last() for o in _usable(plan, df)]
    rest = [quoted(n) for n in items if not isinstance(df.schema[n].dataType, (T.MapType, T.VariantType))]
    end = g.offset + g.limit
    totals = df.groupBy(*keys).agg(F.count(F.when(filled, 1)).alias("_total"))
    ranked = df.filter(filled).withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*(order + rest or [F.lit(1)]))))
    page = ranked.filter((F.col("_rank") <= end) & (F.col("_rank") > g.offset))
    paged = page.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", F.struct(*[quoted(n) for n in items]).alias("item")))).alias("_items"))
    both = totals.join(paged.select(*[quoted(f).alias(f"_j{i}") for i, f in enumerate(fields)], "_items"), [quoted(f).eqNullSafe(F.col(f"_j{i}")) for i, f in enumerate(fields)], "left")
    none = F.array().cast(paged.schema["_items"].dataType)
    shown = F.transform(F.coalesce("_items", none), lambda e: e["item"])
    item_type = paged.schema["_items"].dataType.elementType["item"].dataType
    if g.children:
        shown = _nest(shown, item_type, g.children[0])
    return both.select(*keys, shown.alias(g.items_as), _pagination(F.col("_total"), g).alias(f"{g.items_as}_pagination")).orderBy(*keys)


def _filled(cols: list[Column], kinds: list[T.DataType]) -> Column:
    tests = [c.isNotNull() & (c != "") if isinstance(k, T.StringType) else c.isNotNull() for c, k in zip(cols, kinds)]
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def _pagination(total: Column, g: ResponseGrouping) -> Column:
    page = 1 if g.limit == 0 else g.offset // g.limit + 1
    pages = F.lit(1).cast("bigint") if g.limit == 0 else F.ceil(total / F.lit(g.limit)).cast("bigint")
    return F.struct(F.lit(page).alias("page"), F.lit(g.limit).alias("per_page"), pages.alias("total_pages"), total.alias("total_items"))


def _nest(items: Column, kind: T.StructType, g: ResponseGrouping) -> Column:
    """An array of structs, of at most a page, grouped again within the row."""
    names = kind.names
    if gone := [f for f in g.fields if f not in names]:
        raise SpecError(f"grouping fields {gone} are not in the items")
    inner = names if g.include_group_fields_in_items else [n for n in names if n not in g.fields]
    keys = F.array_distinct(F.transform(items, lambda i: F.struct(*[i[f].alias(f) for f in g.fields])))

    def group(key: Column) -> Column:
        own = F.filter(items, lambda i: F.struct(*[i[f].alias(f) for f in g.fields]).eqNullSafe(key))
        shaped = F.transform(own, lambda i: F.struct(*[i[n].alias(n) for n in inner]))
        full = F.filter(shaped, lambda i: _filled([i[n] for n in inner], [kind[n].dataType for n in inner]))
        page = F.slice(full, g.offset + 1, g.limit) if g.limit else F.filter(full, lambda _: F.lit(False))
        deeper = _nest(page, T.StructType([kind[n] for n in inner]), g.children[0]) if g.children else page
        return F.struct(*[key[f].alias(f) for f in g.fields], deeper.alias(g.items_as), _pagination(F.size(full).cast("bigint"), g).alias(f"{g.items_as}_pagination"))

    return F.transform(keys, group)


def number_text(col: Column, digits: int = 6, trim: bool = True) -> Column:
    """A double as text for display: whole numbers without decimals, others with at most (trim) or exactly so many."""
    whole = (col == F.floor(col)) & (F.abs(col) < 9e15)
    fixed = F.when(col.isNotNull(), F.format_string(f"%.{digits}f", col))
    return F.when(whole, col.cast("bigint").cast("string")).otherwise(F.regexp_replace(fixed, r"\.?0+$", "") if trim else fixed)


def json_rows(df: DataFrame) -> DataFrame:
    """One column `json`: each row as a JSON object, typed by the schema; null fields stay as null."""
    return df.select(F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}).alias("json"))


def messages(plan: Plan, size: int = 1000):
    """What a client is sent: first the columns, their types and the page, then the rows in lists of size."""
    df = plan.data
    yield {"columns": [] if df is None else df.columns, "types": [] if df is None else [f.dataType.simpleString() for f in df.schema], "pagination": plan.pagination()}
    if df is not None:
        yield from batches(df, size)


def batches(df: DataFrame, size: int = 1000):
    """The rows in lists of size, fetched partition by partition: for sinks that send row batches to a client."""
    part = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        part.append(row)
        if len(part) == size:
            yield part
            part = []
    if part:
        yield part
