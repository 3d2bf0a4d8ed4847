"""Two-phase reads: a page of base rows, enriched by a second read over their keys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.catalog import Catalog
from tidewell.errors import SpecError
from tidewell.plans.compiler import Options, Plan, quoted
from tidewell.sources import shared
from tidewell.spec import ReadOp


def enrich(op: ReadOp, catalog: Catalog, params: Mapping[str, Any] | None = None, identity: Any = None, options: Options = Options()) -> DataFrame:
    """The base page with the enrichment's fields merged in.

    The keys of the page narrow the second read by a semi-join in place of the filter
    on its ids parameter; they never leave the cluster. Of several enrichment rows of a
    key the first in the second read's order counts, else the least. A default stands
    in where the merged value is null. Additive fields are base plus enrichment, a
    missing side being 0.
    """
    s = op.split
    if s is None:
        raise SpecError(f"operation '{op.name}' has no split_enrichment")
    joins = tuple(j for j in op.joins if not s.base_join_aliases or j.name in s.base_join_aliases)
    select = tuple(x for x in op.select if not s.base_select_aliases or x.header in s.base_select_aliases)
    first = Plan(replace(op, joins=joins, select=select, split=None), catalog, params, identity, options)
    base = first.data
    if first.limit is not None and not first.settled:
        # it is used twice below, and without a whole order two evaluations may cut different pages
        base = shared.kept(base, "page")
    if s.key_field not in base.columns:
        raise SpecError(f"key field '{s.key_field}' is not in the base result")
    key, marker = s.enrichment_key_field or s.key_field, f"${s.ids_param}"
    by_ids = [f for f in s.enrichment.filters if marker in (f.value, *f.values)]
    if len(by_ids) != 1:
        raise SpecError(f"the enrichment needs one filter on {marker}")
    rest = tuple(f for f in s.enrichment.filters if f is not by_ids[0])
    keys = base.select(quoted(s.key_field).alias("_ids"))
    second = Plan(replace(s.enrichment, filters=rest, limit=None, limit_param=None), catalog, params, identity, replace(options, default_limit=None), (by_ids[0].field, keys))
    more = [h for h, _ in second.projection]
    if key not in more:
        raise SpecError(f"key field '{key}' is not in the enrichment result")
    columns = dict(second.projection)
    order = [*[second._sort_column(o) for o in second.op.order_by], *columns.values()]
    rank = F.row_number().over(Window.partitionBy(columns[key]).orderBy(*order))
    shown = second.rows.select(*[c.alias(h) for h, c in columns.items()], rank.alias("_rank"))
    one = shown.filter("_rank = 1").select(*[quoted(c).alias(f"_e.{c}") for c in more])
    out = base.join(one, quoted(s.key_field) == quoted(f"_e.{key}"), "left")
    made = {c: quoted(c) for c in base.columns}
    for f in s.merge_fields:
        made[f] = F.coalesce(quoted(f"_e.{f}"), made[f]) if f in made else quoted(f"_e.{f}")
    for f, v in s.defaults.items():
        made[f] = F.coalesce(made[f], F.lit(v)) if f in made else F.lit(v)
    for target, source in s.additive_fields:
        own = F.coalesce(made[target].try_cast("double"), F.lit(0.0)) if target in made else F.lit(0.0)
        made[target] = own + F.coalesce(quoted(f"_e.{source}").try_cast("double"), F.lit(0.0))
    return out.select(*[c.alias(n) for n, c in made.items()])
