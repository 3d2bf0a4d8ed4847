"""Saved reads as DataFrames.

The order of things is that of the operation: row-level security on the base, filters
that belong to one side, joins in the declared order, remaining filters, computed
columns, aggregations over all rows, sort, page, projection. All of it is declared;
pushing down, pruning and picking joins is left to Catalyst.

Inside a plan a column is named `alias.field`, so equal names of two tables never clash.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping
from dataclasses import dataclass, replace
from functools import cached_property
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.catalog import Catalog, Table
from tidewell.errors import AccessDenied, SpecError
from tidewell.functions import expressions, predicates
from tidewell.functions.dates import derived_columns
from tidewell.functions.numbers import as_double, exact_sum
from tidewell.functions.text import nfc
from tidewell.params import bind_read
from tidewell.spec import Collect, Filter, FilterGroup, Join, OrderBy, ReadOp, check_join

#: Comparisons that see canonically equal texts of key and indexed columns as one.
EQUALITIES = ("Eq", "Ne", "In", "NotIn")
#: Fixed value: the plain letters that are the NFC of a character beyond ASCII.
COMPOSED = set("K;`")


@dataclass(frozen=True)
class Options:
    """default_limit and max_limit: None for none. sum_digits: see exact_sum. round_digits: decimals of computed columns.
    null_as_zero: a missing number is 0 in expressions and their aggregates. null_safe_join: null keys meet each other.
    dedupe_right: right sides of joins are sets of the columns that the operation uses. max_joined: see Plan.guard."""

    default_limit: int | None = 100
    max_limit: int | None = 10_000
    sum_digits: int | None = 6
    round_digits: int | None = 6
    null_as_zero: bool = True
    null_safe_join: bool = False
    dedupe_right: bool = False
    max_joined: int | None = 200_000


#: Whole results, for callers that page by themselves or write them away.
WHOLE = Options(default_limit=None, max_limit=None, max_joined=None)


@dataclass
class AggregationResult:
    kind: str
    data: DataFrame | None
    summary: DataFrame
    """One row, one column `summary`."""


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def plain_name(name: str) -> str:
    return name.rsplit(".", 1)[-1]


def key_text(col: Column, kind: T.DataType) -> Column:
    """A join key that is equal for `6351`, ` 6351 ` and `6351.0`."""
    if isinstance(kind, T.IntegralType):
        return col.cast("string")
    n = as_double(col, kind)
    whole = F.when((n == F.floor(n)) & (F.abs(n) < 9e15), n.cast("bigint").cast("string"))
    return F.coalesce(whole, F.trim(col.cast("string")))


class Plan:
    """One read with its parameters bound. Nothing runs until a DataFrame of it does."""

    def __init__(self, op: ReadOp, catalog: Catalog, params: Mapping[str, Any] | None = None, identity: Any = None, options: Options = Options(), key_set: tuple[str, DataFrame] | None = None):
        self.params, self.options, self.identity, self.catalog = params or {}, options, identity, catalog
        op = bind_read(op, self.params)
        self.key_set = key_set
        self.aliases: dict[str, Table] = {op.base: catalog.table(op.entity, op.table)}
        for j in op.joins:
            check_join(j)
            if j.name in self.aliases:
                raise SpecError(f"alias '{j.name}' is there twice")
            self.aliases[j.name] = catalog.table(j.entity or op.entity, j.table)
        self.op = op = replace(op, filters=tuple(self._in_nfc(f) for f in op.filters), filter_tree=op.filter_tree and self._in_nfc(op.filter_tree))
        self.joins = {j.name: j for j in op.joins}
        self.types: dict[str, T.DataType] = {}
        self.mentioned = f"{op} {self.params.get('fields')}"
        self.scans = {alias: self._scan(alias, t) for alias, t in self.aliases.items()}
        self.windowed = False

    # -- names --

    def _scan(self, alias: str, t: Table) -> DataFrame:
        cols = {f.name: (F.col(f"`{f.name}`"), f.dataType) for f in t.df.schema}
        made = {n: c for n, (c, _) in cols.items()} | derived_columns(cols, self.mentioned)
        df = t.df.select(*[c.alias(f"{alias}.{n}") for n, c in made.items()])
        self.types |= {f.name: f.dataType for f in df.schema}
        self.types |= {f"{alias}.{n}": T.LongType() if n == self.joins[alias].count_matches_as else T.DoubleType() for n in (self.joins[alias].synthetic if alias in self.joins else ())}
        return df

    def qualify(self, name: str) -> str:
        """`alias.field`; a plain name is one of the base table."""
        name = name.strip()
        if name == "*" and self.op.joins or not name:
            raise SpecError(f"'{name}' is no field of a join")
        head, dot, rest = name.partition(".")
        full = name if dot and head in self.aliases else f"{self.op.base}.{name}"
        if full not in self.types:
            raise SpecError(f"unknown field '{name}'" + (f" of '{head}'" if dot else ""))
        return full

    def alias_of(self, name: str) -> str:
        full = self.qualify(name)
        return next(a for a in sorted(self.aliases, key=len, reverse=True) if full.startswith(f"{a}."))

    def resolve(self, name: str) -> tuple[Column, T.DataType]:
        full = self.qualify(name)
        return quoted(full), self.types[full]

    def _in_nfc(self, node: Filter | FilterGroup) -> Filter | FilterGroup:
        """Values that key and indexed columns are compared with, in NFC."""
        if isinstance(node, FilterGroup):
            return replace(node, filters=tuple(self._in_nfc(x) for x in node.filters))
        if node.op not in EQUALITIES or not self._canonical(node.field):
            return node
        form = lambda v: v and unicodedata.normalize("NFC", v)
        return replace(node, value=form(node.value), values=tuple(map(form, node.values)))

    def _canonical(self, name: str) -> Table | None:
        """The table of a key or indexed column."""
        head, dot, rest = name.strip().partition(".")
        table, column = (self.aliases[head], rest) if dot and head in self.aliases else (self.aliases[self.op.base if hasattr(self, "op") else next(iter(self.aliases))], name.strip())
        return table if column in (*table.key, *table.indexed) else None

    def looked_up(self, f: Filter) -> tuple[Column, T.DataType]:
        """The column of a filter. An equality with a key or indexed text that isn't stored in NFC compares its NFC.

        A value of plain letters is equal to itself alone, but for the three that other
        characters are composed to, so most lookups reach the scan either way.
        """
        c, kind = self.resolve(f.field)
        t = self._canonical(f.field) if f.op in EQUALITIES and isinstance(kind, T.StringType) else None
        if t is None or t.in_nfc or all(v.isascii() and not COMPOSED & set(v) for v in (f.value or "", *f.values)):
            return c, kind
        return nfc(c), kind

    def synthetic(self, name: str) -> bool:
        alias = self.alias_of(name)
        return alias in self.joins and self.qualify(name)[len(alias) + 1 :] in self.joins[alias].synthetic

    def number(self, name: str) -> Column:
        c, kind = self.resolve(name)
        n = as_double(c, kind)
        return F.coalesce(n, F.lit(0.0)) if self.options.null_as_zero else n

    def expression(self, text: str) -> Column:
        return expressions.to_column(expressions.parse(text), self.number)

    # -- rows --

    def _filters(self) -> tuple[dict[str, list[Filter]], list[Filter]]:
        """The flat filters that belong to one side before the joins, and those that come after them.

        A filter on a joined table narrows that table before the join, so on a left join
        it says what matches, not which rows stay. Filters on counts and sums of matches
        come after, and so do all of an Or list that spans tables.
        """
        live = [f for f in self.op.filters if not predicates.disabled(f)]
        if self.op.filters_op == "Or" and (len({self.alias_of(f.field) for f in live}) > 1 or any(self.synthetic(f.field) for f in live)):
            return {}, live
        sides: dict[str, list[Filter]] = {}
        late = [f for f in live if self.synthetic(f.field)]
        for f in live:
            if f not in late:
                sides.setdefault(self.alias_of(f.field), []).append(f)
        return sides, late

    def _secured(self, base: DataFrame) -> DataFrame:
        auth = self.op.auth
        if auth is None or not auth.enabled:
            return base
        if self.identity is None:
            raise AccessDenied(f"operation '{self.op.name}' needs an identity")
        if self.op.table.lower() in ("users", auth.table.lower()):
            return base
        c, kind = self.resolve(auth.filter_col)
        return base.filter(predicates.predicate(c, kind, Filter(auth.filter_col, "Eq", str(self.identity))))

    @cached_property
    def rows(self) -> DataFrame:
        """All rows that meet the filters, unsorted, with every column as `alias.field`."""
        op = self.op
        sides, late = self._filters()
        base = self._secured(self.scans[op.base])
        if self.key_set:
            name, keys = self.key_set
            base = base.join(keys.distinct(), quoted(self.qualify(name)) == quoted(keys.columns[0]), "left_semi")
        out = self._side(base, sides.get(op.base))
        bound = [op.base]
        if self._can_window(late):
            out = self._ordered(out).limit(self.offset + self.limit)
            self.windowed = True
        for j in op.joins:
            out = self._join(out, j, bound, self._side(self.scans[j.name], sides.get(j.name)))
            bound.append(j.name)
        if (test := predicates.flat(late, op.filters_op, self.looked_up)) is not None:
            out = out.filter(test)
        return out if op.filter_tree is None else out.filter(predicates.tree(op.filter_tree, self.looked_up))

    def _side(self, df: DataFrame, filters: list[Filter] | None) -> DataFrame:
        test = predicates.flat(filters or [], self.op.filters_op, self.looked_up)
        return df if test is None else df.filter(test)

    def _can_window(self, late: list[Filter]) -> bool:
        """Sort and page may come before the joins if no join can drop or repeat a base row and nothing else needs all rows."""
        op = self.op
        if not op.joins or not op.order_by or not self.limit or op.aggregations or op.filter_tree or late or op.response_grouping:
            return False
        if any(self.alias_of(o.field) != op.base for o in op.order_by):
            return False
        return all(j.type == "Left" and (j.synthetic or self._unique(j)) for j in op.joins)

    def _unique(self, j: Join) -> bool:
        key = self.aliases[j.name].key
        on = {self.qualify(side) for c in j.on for side in (c.left, c.right) if self.alias_of(side) == j.name}
        return bool(key) and {f"{j.name}.{k}" for k in key} <= on

    def _join(self, left: DataFrame, j: Join, bound: list[str], right: DataFrame) -> DataFrame:
        pairs: list[tuple[str, str]] = []
        for c in j.on:
            a, b = self.alias_of(c.left), self.alias_of(c.right)
            if a in bound and b == j.name:
                pairs.append((self.qualify(c.left), self.qualify(c.right)))
            elif b in bound and a == j.name:
                pairs.append((self.qualify(c.right), self.qualify(c.left)))
            else:
                raise SpecError(f"a condition of '{j.name}' must link it with a table before it")
        keys = [self._key_pair(a, b) for a, b in pairs]
        for i, (a, b) in enumerate(pairs):
            if all(isinstance(self.types[x], T.StringType) for x in (a, b)) and any(t and not t.in_nfc for t in (self._canonical(a), self._canonical(b))):
                # made beside the rows: a join takes no condition that might give another value each time
                left = left.withColumn(f"_left{i}", nfc(keys[i][0]))
                right = right.withColumn(f"_right{i}", nfc(keys[i][1]))
                keys[i] = F.col(f"_left{i}"), F.col(f"_right{i}")
        if self.options.dedupe_right:
            right = right.select(*[quoted(c) for c in right.columns if self._used(c)]).distinct()
        names = [f"_key{i}" for i in range(len(keys))]
        how = "inner" if j.type == "Inner" else "left"
        if j.synthetic:
            aggs = []
            if j.count_matches_as:
                aggs.append(F.count("*").alias(f"{j.name}.{j.count_matches_as}"))
            if j.sum_matches_as:
                summed = as_double(*self.resolve(f"{j.name}.{j.sum_matches_field}"))
                aggs.append(exact_sum(summed, self.options.sum_digits).alias(f"{j.name}.{j.sum_matches_as}"))
            right = right.groupBy(*[b.alias(n) for (_, b), n in zip(keys, names)]).agg(*aggs)
            if not self.options.null_safe_join:
                right = right.dropna(subset=names)
        else:
            right = right.withColumns({n: b for (_, b), n in zip(keys, names)})
        test = [(a.eqNullSafe(right[n]) if self.options.null_safe_join else a == right[n]) for (a, _), n in zip(keys, names)]
        out = left.join(right, test, how).drop(*names, *[f"_{side}{i}" for i in range(len(keys)) for side in ("left", "right")])
        zero = {f"{j.name}.{n}": F.coalesce(quoted(f"{j.name}.{n}"), F.lit(0)) for n in j.synthetic}
        return out.withColumns(zero) if zero and how == "left" else out

    def _key_pair(self, a: str, b: str) -> tuple[Column, Column]:
        ka, kb = self.types[a], self.types[b]
        if isinstance(ka, T.NumericType) and isinstance(kb, T.NumericType) or not isinstance(ka, T.StringType) and ka == kb:
            return quoted(a), quoted(b)
        return key_text(quoted(a), ka), key_text(quoted(b), kb)

    @cached_property
    def _names_used(self) -> set[str]:
        op = self.op
        texts = [*(x for s in op.select for x in ([s.field] if not s.expression else expressions.names(expressions.parse(s.expression)))), *(f.field for f in op.filters), *(o.field for o in op.order_by), *predicates.fields(op.filter_tree)]
        texts += [x for j in op.joins for c in j.on for x in (c.left, c.right)]
        texts += [f"{j.name}.{j.sum_matches_field}" for j in op.joins if j.sum_matches_field]
        for a in op.aggregations:
            if not isinstance(a, Collect):
                texts += [x for x in (a.field, a.group_by) if x and x in self._known] + [n for x in (a.expression, a.field) if x for n in expressions.names(expressions.parse(x))]
        return {self.qualify(x) for x in texts if x and x != "*" and x in self._known}

    @cached_property
    def _known(self) -> set[str]:
        base = f"{self.op.base}."
        return {*self.types} | {n[len(base) :] for n in self.types if n.startswith(base)}

    def _used(self, column: str) -> bool:
        return column in self._names_used

    # -- result --

    @cached_property
    def limit(self) -> int | None:
        o, given = self.options, None
        if self.op.limit_param and (p := self.params.get(self.op.limit_param.lstrip("$"))) is not None:
            try:
                given = max(0, int(p))
            except (TypeError, ValueError):
                raise SpecError(f"'{p}' is no limit") from None
        n = given if given is not None else self.op.limit if self.op.limit is not None else o.default_limit
        return n if o.max_limit is None or n is None else min(n, o.max_limit)

    @cached_property
    def page(self) -> int:
        given = self.params.get("page", self.params.get("pagination", 1))
        try:
            return max(1, int(given))
        except (TypeError, ValueError):
            raise SpecError(f"'{given}' is no page") from None

    @property
    def offset(self) -> int:
        return (self.page - 1) * (self.limit or 0)

    @cached_property
    def projection(self) -> list[tuple[str, Column]]:
        """(header, column); `fields` in the parameters replaces it, `*` stands for the base columns."""
        op, base = self.op, self.aliases[self.op.base]
        if given := self.params.get("fields"):
            names = [x.strip() for x in given.split(",")] if isinstance(given, str) else list(given)
            out = [(n, self.resolve(n)[0]) for x in names for n in (base.base_columns if x == "*" and not op.joins else [x])]
            out = list(dict(out).items())
        elif op.select:
            out = [(s.header, self._computed(s.expression) if s.expression else self.resolve(s.field)[0]) for s in op.select]
        elif op.selected_fields:
            out = [(n, self.resolve(n)[0]) for x in op.selected_fields for n in (base.base_columns if x == "*" and not op.joins else [x])]
            out = list(dict(out).items())
        elif op.aggregations and not any(isinstance(a, Collect) for a in op.aggregations):
            return []
        else:
            out = [(n, self.resolve(n)[0]) for n in sorted(base.base_columns)]
        if len({h for h, _ in out}) < len(out):
            raise SpecError("two output columns have the same name")
        return out

    def _computed(self, text: str) -> Column:
        c = self.expression(text)
        return c if self.options.round_digits is None else F.round(c, self.options.round_digits)

    def _sort_column(self, o: OrderBy) -> Column:
        computed = {h: c for h, c in self.projection}
        try:
            c = self.resolve(o.field)[0]
        except SpecError:
            if o.field not in computed:
                raise
            c = computed[o.field]
        return c.asc_nulls_first() if o.direction == "Asc" else c.desc_nulls_last()

    def _ordered(self, df: DataFrame) -> DataFrame:
        """By the declared keys, then by the base table's key, so that pages don't overlap."""
        if not self.op.order_by:
            return df
        named = {self.qualify(o.field) for o in self.op.order_by if o.field in self._known}
        ties = [quoted(f"{self.op.base}.{k}") for k in self.aliases[self.op.base].key if f"{self.op.base}.{k}" not in named]
        return df.orderBy(*[self._sort_column(o) for o in self.op.order_by], *ties)

    @property
    def settled(self) -> bool:
        """Whether the order leaves no ties, so that a page is the same each time: it ends with the base table's key and no join repeats a row."""
        return bool(self.op.order_by and self.aliases[self.op.base].key) and all(j.synthetic or self._unique(j) for j in self.op.joins)

    def projected(self, df: DataFrame) -> DataFrame:
        return df.select(*[c.alias(h) for h, c in self.projection])

    @cached_property
    def data(self) -> DataFrame | None:
        """The page: sorted, cut and projected. None if only aggregations or, with limit 0, only counts are wanted."""
        if not self.projection or self.limit == 0:
            return None
        out = self._ordered(self.rows)
        if self.offset:
            out = out.offset(self.offset)
        return self.projected(out if self.limit is None else out.limit(self.limit))

    @cached_property
    def whole(self) -> DataFrame:
        """All rows, sorted and projected."""
        if self.windowed:
            raise SpecError("the rows are cut to a page already")
        return self.projected(self._ordered(self.rows))

    @cached_property
    def total(self) -> DataFrame:
        """One row: total_items and total_pages over all rows that meet the filters."""
        rows = replace_paging(self).rows if self.windowed or self._can_window([]) else self.rows
        per = self.limit or 1
        n = F.count("*")
        return rows.agg(n.alias("total_items"), F.ceil(n / F.lit(per)).cast("bigint").alias("total_pages"))

    def pagination(self) -> dict[str, int] | None:
        """Page metadata, by one action; None if there are no rows."""
        r = self.total.first()
        if not r["total_items"] or not self.projection:
            return None
        return {"page": self.page, "per_page": self.limit or 0, "total_pages": r["total_pages"], "total_items": r["total_items"]}

    def guard(self) -> Plan:
        """self, or SpecError if a read with joins has more rows than Options.max_joined. It counts no further than that, by one action."""
        most = self.options.max_joined
        if most is not None and self.op.joins and not self.windowed and self.rows.limit(most + 1).count() > most:
            raise SpecError(f"the joins of '{self.op.name}' give more than {most} rows")
        return self

    @cached_property
    def aggregations(self) -> list[AggregationResult]:
        from tidewell.plans.aggregates import aggregate

        return [aggregate(self, a) for a in self.op.aggregations]


def replace_paging(plan: Plan) -> Plan:
    """The same read over all its rows."""
    return Plan(replace(plan.op, order_by=()), plan.catalog, plan.params, plan.identity, plan.options, plan.key_set)


def read(op: ReadOp, catalog: Catalog, params: Mapping[str, Any] | None = None, identity: Any = None, options: Options = Options()) -> Plan:
    return Plan(op, catalog, params, identity, options)
