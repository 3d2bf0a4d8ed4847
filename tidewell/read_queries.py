"""The queries of the read layer: saved operations over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import spec
from tidewell.catalog import Catalog
from tidewell.operators import maintenance
from tidewell.operators.changelog import apply_feed
from tidewell.plans import shaping
from tidewell.plans.batches import Batch
from tidewell.plans.compiler import WHOLE, Plan
from tidewell.plans.enrichment import enrich
from tidewell.security import valid_keys
from tidewell.spec import Aggregation, Auth, BatchOp, Collect, Computed, Filter, FilterGroup, Having, Join, JoinOn, OrderBy, ReadOp, ResponseGrouping, Select, SplitEnrichment
from tidewell.streaming.subscriptions import hourly_counts, subscribe

Query = Callable[[SparkSession, str], DataFrame]

KEYS: dict[str, tuple[str, ...]] = {
    "region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",), "orders": ("o_orderkey",), "lineitem": (),
    "events": ("event_id",), "documents": ("doc_id",), "deployments": (), "consistency_checks": (), "cdc_states": (), "update_events": (),
}
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def catalog(spark: SparkSession, folder: str) -> Catalog:
    return Catalog.of_folder(spark, folder, KEYS)


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__] = f
        if sql:
            _sql[f.__name__] = sql
        return f

    return add


def read(name: str, sql: str, op: ReadOp, **params: str) -> None:
    """Registers the whole data of a read."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return Plan(op, catalog(spark, folder), params, None, WHOLE).data

    _queries[name], _sql[name] = run, sql


def aggregated(name: str, sql: str, op: ReadOp, **columns: str) -> None:
    """Registers the first aggregation of a read: its groups, or its summary if it has none; columns renames."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        a = Plan(op, catalog(spark, folder), {}, None, WHOLE).aggregations[0]
        df = a.summary if a.data is None else a.data
        return df.select(*[F.col(c).alias(columns.get(c, c)) for c in df.columns])

    _queries[name], _sql[name] = run, sql


def _select(*names: str) -> tuple[Select, ...]:
    """`field` or `field=header`."""
    return tuple(Select(n.partition("=")[0], None, n.partition("=")[2] or n.rsplit(".", 1)[-1]) for n in names)


def _on(left: str, right: str) -> tuple[JoinOn, ...]:
    return (JoinOn(left, right),)


CUSTOMER = Join("customer", _on("o.o_custkey", "c.c_custkey"), "Inner", "c")
ORDERS = Join("orders", _on("c.c_custkey", "o.o_custkey"), "Left", "o")

# ---- scans and lookups ----
read("scan_project", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders", ReadOp("orders", selected_fields=("o_orderkey", "o_orderstatus", "o_totalprice")))
read("select_star_base_columns", "SELECT * FROM region", ReadOp("region", selected_fields=("*",)))
read("pk_lookup", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7", ReadOp("orders", filters=(Filter("o_orderkey", "Eq", "$key"),), selected_fields=("o_orderkey", "o_custkey", "o_totalprice")), key="7")
read(
    "composite_pk_lookup", "SELECT entity, run_no, outcome FROM cdc_states WHERE entity = 'vigilancia' AND run_no = 1245",
    ReadOp("cdc_states", filters=(Filter("entity", "Eq", "vigilancia"), Filter("run_no", "Eq", "1245")), selected_fields=("entity", "run_no", "outcome")),
)
read("pk_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey IN (1, 2, 3, 7, 999999999)", ReadOp("orders", filters=(Filter("o_orderkey", "In", "", None, ("1", "2", "3", "7", "999999999")),), selected_fields=("o_orderkey", "o_orderpriority")))
read(
    "index_eq_in", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')",
    ReadOp("orders", filters=(Filter("o_orderstatus", "Eq", "F"), Filter("o_orderpriority", "In", "1-URGENT; 2-HIGH")), selected_fields=("o_orderkey", "o_orderstatus", "o_orderpriority")),
)

# ---- predicates ----
read(
    "filter_ne_null_passes", "SELECT o.o_orderkey FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_mktsegment = 'BUILDING' WHERE c.c_mktsegment IS DISTINCT FROM 'BUILDING'",
    ReadOp("orders", alias="o", joins=(Join("customer", _on("o.o_custkey", "c.c_custkey"), "Left", "c"),), filters=(Filter("c.c_mktsegment", "Eq", "BUILDING"),), filter_tree=Filter("c.c_mktsegment", "Ne", "BUILDING"), select=_select("o.o_orderkey")),
)
LINE = ("l_orderkey", "l_linenumber", "l_quantity")
read("filter_gt_lt", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12", ReadOp("lineitem", filters=(Filter("l_quantity", "Gt", "10"), Filter("l_quantity", "Lt", "12")), selected_fields=LINE))
read("filter_gte_lte", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12", ReadOp("lineitem", filters=(Filter("l_quantity", "Gte", "10"), Filter("l_quantity", "Lte", "12")), selected_fields=LINE))
read("filter_not_in", "SELECT event_id, event_type FROM events WHERE event_type IS NULL OR event_type NOT IN ('error', 'signup')", ReadOp("events", filters=(Filter("event_type", "NotIn", "error,signup"),), selected_fields=("event_id", "event_type")))
read("filter_empty_in", "SELECT event_id FROM events WHERE false", ReadOp("events", filters=(Filter("event_type", "In", " , "),), selected_fields=("event_id",)))
read(
    "filter_between_date", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1995-12-31'",
    ReadOp("orders", filters=(Filter("o_orderdate", "Between", "1995-01-01", "1995-12-31", (), "Date"),), selected_fields=("o_orderkey", "o_orderdate")),
)
DEAR = Join("orders", _on("c.c_custkey", "o.o_custkey"), "Left", "o")
read(
    "filter_is_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NULL",
    ReadOp("customer", alias="c", joins=(DEAR,), filters=(Filter("o.o_totalprice", "Gt", "400000"),), filter_tree=Filter("o.o_orderkey", "IsNull"), select=_select("c.c_custkey")),
)
read(
    "filter_is_not_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 400000 WHERE o.o_orderkey IS NOT NULL",
    ReadOp("customer", alias="c", joins=(DEAR,), filters=(Filter("o.o_totalprice", "Gt", "400000"),), filter_tree=Filter("o.o_orderkey", "IsNotNull"), select=_select("c.c_custkey")),
)
read("filter_blank_is_null", "SELECT deployment_id FROM deployments WHERE state IS NULL OR trim(state) = ''", ReadOp("deployments", filters=(Filter("state", "IsNull"),), selected_fields=("deployment_id",)))
read("filter_contains_ci", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), lower('A'))", ReadOp("part", filters=(Filter("p_name", "Contains", "A"),), selected_fields=("p_partkey", "p_name")))
read("filter_starts_with_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE starts_with(lower(c_mktsegment), lower('bu'))", ReadOp("customer", filters=(Filter("c_mktsegment", "StartsWith", "bu"),), selected_fields=("c_custkey", "c_mktsegment")))
read("filter_ends_with_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE ends_with(lower(c_mktsegment), lower('ING'))", ReadOp("customer", filters=(Filter("c_mktsegment", "EndsWith", "ING"),), selected_fields=("c_custkey", "c_mktsegment")))
read("filter_or", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' OR o_totalprice > 300000", ReadOp("orders", filters=(Filter("o_orderstatus", "Eq", "P"), Filter("o_totalprice", "Gt", "300000")), filters_op="Or", selected_fields=("o_orderkey",)))
read(
    "filter_or_across_tables", "SELECT o.o_orderkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE o.o_orderstatus = 'P' OR c.c_mktsegment = 'BUILDING'",
    ReadOp("orders", alias="o", joins=(CUSTOMER,), filters=(Filter("o.o_orderstatus", "Eq", "P"), Filter("c.c_mktsegment", "Eq", "BUILDING")), filters_op="Or", select=_select("o.o_orderkey")),
)
read(
    "filter_tree", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 100000) OR (o_orderpriority = '1-URGENT' AND (o_orderstatus = 'O' OR o_totalprice < 20000))",
    ReadOp("orders", selected_fields=("o_orderkey",), filter_tree=FilterGroup("Or", (
        FilterGroup("And", (Filter("o_orderstatus", "Eq", "F"), Filter("o_totalprice", "Gt", "100000"))),
        FilterGroup("And", (Filter("o_orderpriority", "Eq", "1-URGENT"), FilterGroup("Or", (Filter("o_orderstatus", "Eq", "O"), Filter("o_totalprice", "Lt", "20000"))))),
    ))),
)
read("in_list_split", "SELECT event_id FROM events WHERE user_id IN (1, 2, 3)", ReadOp("events", filters=(Filter("user_id", "In", "$ids|split:/:1|trim"),), selected_fields=("event_id",)), ids="users/ 1,2;3 ")


@query("SELECT delivery_id, entity, tbl, pk FROM update_events WHERE nfc_normalize(pk) IN ('caf' || chr(233) || '-1000', 'pe' || chr(241) || 'a-1039')")
def nfc_equal(spark: SparkSession, folder: str) -> DataFrame:
    """Keys that are stored and asked for in either Unicode form."""
    c = Catalog(spark)
    c.register("", "changes", spark.read.parquet(f"{folder}/update_events.parquet"), indexed=("pk",))
    op = ReadOp("changes", filters=(Filter("pk", "In", values=("cafe\u0301-1000", "pe\u00f1a-1039")),), selected_fields=("delivery_id", "entity", "tbl", "pk"))
    return Plan(op, c, {}, None, WHOLE).data


# ---- projections and expressions ----
read("select_rename", "SELECT c_name AS customer_name, c_acctbal AS balance FROM customer", ReadOp("customer", select=_select("c_name=customer_name", "c_acctbal=balance")))
read(
    "select_expression", "SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) * (1 + CAST(l_tax AS DECIMAL(4,2))) AS DOUBLE) AS charge FROM lineitem",
    ReadOp("lineitem", select=(*_select("l_orderkey", "l_linenumber"), Select("", "l_extendedprice * (1 - l_discount) * (1 + l_tax)", "charge"))),
)
read(
    "expr_div_zero", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount <> 0 THEN round(l_tax / l_discount, 6) ELSE 0.0 END AS ratio FROM lineitem",
    ReadOp("lineitem", select=(*_select("l_orderkey", "l_linenumber"), Select("", "l_tax / l_discount", "ratio"))),
)
read(
    "expr_if_compare", "SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS is_big FROM orders",
    ReadOp("orders", select=(*_select("o_orderkey"), Select("", "if(o_totalprice >= 150000, 1, 0)", "is_big"))),
)
read(
    "expr_epsilon_eq", "SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_discount + l_tax - 0.1::DOUBLE) < 2.220446049250313e-16 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS at_tenth, CAST(-l_quantity AS DOUBLE) AS negated FROM lineitem",
    ReadOp("lineitem", select=(*_select("l_orderkey", "l_linenumber"), Select("", "l_discount + l_tax = 1e-1", "at_tenth"), Select("", "-l_quantity", "negated"))),
)
read(
    "date_derived", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts_day, strftime(ts, '%Y-%m') AS ts_month, strftime(ts, '%H') || ':00-' || strftime(ts, '%H') || ':59' AS ts_hour_bucket FROM events",
    ReadOp("events", selected_fields=("event_id", "ts_day", "ts_month", "ts_hour_bucket")),
)

# ---- joins ----
read("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey", ReadOp("orders", alias="o", joins=(CUSTOMER,), select=_select("o.o_orderkey", "c.c_name")))
read("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey", ReadOp("customer", alias="c", joins=(ORDERS,), select=_select("c.c_custkey", "o.o_orderkey")))
read(
    "join_multi_key", "SELECT a.l_orderkey, a.l_linenumber, b.l_suppkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber WHERE a.l_quantity > 45",
    ReadOp("lineitem", alias="a", joins=(Join("lineitem", (JoinOn("a.l_orderkey", "b.l_orderkey"), JoinOn("b.l_linenumber", "a.l_linenumber")), "Inner", "b"),), filters=(Filter("a.l_quantity", "Gt", "45"),), select=_select("a.l_orderkey", "a.l_linenumber", "b.l_suppkey")),
)
read(
    "join_chain", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey",
    ReadOp("customer", alias="c", joins=(Join("nation", _on("c.c_nationkey", "n.n_nationkey"), "Inner", "n"), Join("region", _on("n.n_regionkey", "r.r_regionkey"), "Inner", "r")), select=_select("c.c_custkey", "n.n_name", "r.r_name")),
)
COUNTED = Join("orders", _on("c.c_custkey", "o.o_custkey"), "Left", "o", None, "order_count")
read(
    "join_count_matches", "SELECT c.c_custkey, coalesce(m.n, 0) AS order_count FROM customer c LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey",
    ReadOp("customer", alias="c", joins=(COUNTED,), select=_select("c.c_custkey", "o.order_count")),
)
read(
    "join_sum_matches", "SELECT c.c_custkey, coalesce(m.s, 0.0) AS order_total FROM customer c LEFT JOIN (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey",
    ReadOp("customer", alias="c", joins=(Join("orders", _on("c.c_custkey", "o.o_custkey"), "Left", "o", None, None, "o_totalprice", "order_total"),), select=_select("c.c_custkey", "o.order_total")),
)
BOTH = Join("orders", _on("c.c_custkey", "o.o_custkey"), "Inner", "o", None, "order_count", "o_totalprice", "order_total")
read(
    "join_count_sum_inner", "SELECT c.c_custkey, count(*) AS order_count, CAST(sum(CAST(o.o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS order_total FROM customer c JOIN orders o ON o.o_custkey = c.c_custkey GROUP BY c.c_custkey",
    ReadOp("customer", alias="c", joins=(BOTH,), select=_select("c.c_custkey", "o.order_count", "o.order_total")),
)
read(
    "join_left_filter_as_on", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'",
    ReadOp("customer", alias="c", joins=(ORDERS,), filters=(Filter("o.o_orderstatus", "Eq", "F"),), select=_select("c.c_custkey", "o.o_orderkey")),
)
read(
    "join_count_zero", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ReadOp("customer", alias="c", joins=(COUNTED,), filters=(Filter("o.o_totalprice", "Gt", "400000"), Filter("o.order_count", "Eq", "0")), select=_select("c.c_custkey")),
)
read(
    "join_key_normalised", "SELECT d.deployment_id, m.check_id FROM deployments d JOIN consistency_checks_mirror m ON d.deployment_id = TRY_CAST(trim(m.deployment_id) AS DOUBLE)::BIGINT AND TRY_CAST(trim(m.deployment_id) AS DOUBLE) = floor(TRY_CAST(trim(m.deployment_id) AS DOUBLE))",
    ReadOp("deployments", alias="d", joins=(Join("consistency_checks_mirror", _on("d.deployment_id", "m.deployment_id"), "Inner", "m"),), select=_select("d.deployment_id", "m.check_id")),
)
KEYS["consistency_checks_mirror"] = ()


@query("SELECT o.o_orderkey, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey")
def cross_entity_join(spark: SparkSession, folder: str) -> DataFrame:
    tables = Catalog(spark)
    for entity, name in (("sales", "orders"), ("crm", "customer"), ("geo", "nation")):
        tables.register_parquet(entity, name, f"{folder}/{name}.parquet", KEYS[name])
    joins = (Join("Customer", _on("o.o_custkey", "c.c_custkey"), "Inner", "c", "crm"), Join("nation", _on("c.c_nationkey", "n.n_nationkey"), "Inner", "n", "geo"))
    return Plan(ReadOp("orders", "", "sales", "o", joins, select=_select("o.o_orderkey", "n.n_name")), tables, options=WHOLE).data


@query("SELECT b.o_orderkey, b.o_totalprice, c.c_name, b.o_totalprice + coalesce(c.c_acctbal, 0) AS total FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 100) b LEFT JOIN customer c ON b.o_custkey = c.c_custkey")
def split_enrichment(spark: SparkSession, folder: str) -> DataFrame:
    second = ReadOp("customer", filters=(Filter("c_custkey", "In", "$split_ids"),), select=_select("c_custkey", "c_name", "c_acctbal"))
    split = SplitEnrichment("o_custkey", second, enrichment_key_field="c_custkey", merge_fields=("c_name",), additive_fields=(("total", "c_acctbal"),))
    op = ReadOp("orders", order_by=(OrderBy("o_orderkey"),), limit=100, select=_select("o_orderkey", "o_totalprice", "o_custkey", "o_totalprice=total"), split=split)
    return enrich(op, catalog(spark, folder)).drop("o_custkey")


# ---- aggregations ----
F_ORDERS = (Filter("o_orderstatus", "Eq", "F"),)
aggregated("agg_count", "SELECT count(*) AS cnt FROM orders WHERE o_orderstatus = 'F'", ReadOp("orders", filters=F_ORDERS, aggregations=(Aggregation("Count"),)), summary="cnt")
aggregated("agg_count_field", "SELECT count(o.o_orderkey) AS cnt FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey", ReadOp("customer", alias="c", joins=(ORDERS,), aggregations=(Aggregation("Count", "o.o_orderkey"),)), summary="cnt")
aggregated("agg_group_by", "SELECT o_orderstatus, count(*) AS cnt FROM orders GROUP BY o_orderstatus", ReadOp("orders", aggregations=(Aggregation("GroupBy", "o_orderstatus"),)), count="cnt")
aggregated("agg_top_n", "SELECT l_suppkey, count(*) AS cnt FROM lineitem GROUP BY l_suppkey ORDER BY cnt DESC, CAST(l_suppkey AS VARCHAR) LIMIT 5", ReadOp("lineitem", aggregations=(Aggregation("TopN", "l_suppkey", n=5),)), count="cnt")
aggregated(
    "agg_sum_global", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2)))) AS DOUBLE) AS revenue FROM lineitem",
    ReadOp("lineitem", aggregations=(Aggregation("Sum", expression="l_extendedprice * (1 - l_discount)"),)), summary="revenue",
)
aggregated("agg_sum_grouped", "SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty FROM lineitem GROUP BY l_returnflag", ReadOp("lineitem", aggregations=(Aggregation("Sum", "l_quantity", group_by="l_returnflag"),)), sum="qty")
aggregated("agg_count_distinct", "SELECT count(DISTINCT l_partkey) AS parts FROM lineitem", ReadOp("lineitem", aggregations=(Aggregation("CountDistinct", "l_partkey"),)), summary="parts")
aggregated("agg_count_distinct_grouped", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", ReadOp("lineitem", aggregations=(Aggregation("CountDistinct", "l_suppkey", group_by="l_returnflag"),)), count_distinct="suppliers")
aggregated("agg_having", "SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey HAVING count(*) >= 12", ReadOp("orders", aggregations=(Aggregation("GroupBy", "o_custkey", having=Having("Gte", "12")),)), count="cnt")
aggregated(
    "agg_top_n_having", "SELECT * FROM (SELECT o_custkey, count(*) AS cnt FROM orders GROUP BY o_custkey ORDER BY cnt DESC, CAST(o_custkey AS VARCHAR) LIMIT 20) WHERE cnt > 15",
    ReadOp("orders", aggregations=(Aggregation("TopN", "o_custkey", n=20, having=Having("Gt", "15")),)), count="cnt",
)


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS avg_price FROM orders GROUP BY o_orderpriority")
def agg_avg_grouped(spark: SparkSession, folder: str) -> DataFrame:
    a = Plan(ReadOp("orders", aggregations=(Aggregation("Avg", "o_totalprice", group_by="o_orderpriority"),)), catalog(spark, folder)).aggregations[0]
    return a.data.select("o_orderpriority", F.round("avg", 4).alias("avg_price"))


@query("SELECT l_returnflag, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem GROUP BY l_returnflag")
def agg_min_max(spark: SparkSession, folder: str) -> DataFrame:
    op = ReadOp("lineitem", aggregations=tuple(Aggregation(k, "l_extendedprice", group_by="l_returnflag") for k in ("Min", "Max")))
    low, high = Plan(op, catalog(spark, folder)).aggregations
    return low.data.withColumnRenamed("min", "lo").join(high.data.withColumnRenamed("max", "hi"), "l_returnflag")


@query("SELECT 'Count' AS kind, CAST(count(*) AS DOUBLE) AS summary FROM orders UNION ALL SELECT 'Sum', CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) FROM orders UNION ALL SELECT 'Max', max(o_totalprice) FROM orders")
def agg_multi(spark: SparkSession, folder: str) -> DataFrame:
    op = ReadOp("orders", aggregations=(Aggregation("Count"), Aggregation("Sum", "o_totalprice"), Aggregation("Max", "o_totalprice")))
    parts = [a.summary.select(F.lit(a.kind).alias("kind"), F.col("summary").cast("double")) for a in Plan(op, catalog(spark, folder)).aggregations]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _collected(spark: SparkSession, folder: str, direction: str) -> DataFrame:
    op = ReadOp("orders", select=_select("o_custkey", "o_orderkey"), aggregations=(Collect(("o_custkey",), "items", (), (OrderBy("o_orderkey", direction),)),))
    data = Plan(op, catalog(spark, folder), options=WHOLE).aggregations[0].data
    return data.select("o_custkey", F.array_join(F.transform("items", lambda i: i["o_orderkey"].cast("string")), ",").alias("order_keys"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS order_keys FROM orders GROUP BY o_custkey")
def agg_collect(spark: SparkSession, folder: str) -> DataFrame:
    return _collected(spark, folder, "Asc")


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey DESC) AS order_keys FROM orders GROUP BY o_custkey")
def collect_desc_order(spark: SparkSession, folder: str) -> DataFrame:
    return _collected(spark, folder, "Desc")


@query(
    "SELECT o_custkey, count(*) AS total_items, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (WHERE rn <= 2) AS page1 "
    "FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) GROUP BY o_custkey"
)
def response_grouping(spark: SparkSession, folder: str) -> DataFrame:
    op = ReadOp("orders", select=_select("o_custkey", "o_orderkey"), order_by=(OrderBy("o_orderkey"),), response_grouping=ResponseGrouping(("o_custkey",), limit=2))
    g = shaping.group_response(Plan(op, catalog(spark, folder), options=WHOLE))
    return g.select("o_custkey", F.col("items_pagination.total_items").alias("total_items"), F.array_join(F.transform("items", lambda i: i["o_orderkey"].cast("string")), ",").alias("page1"))


# ---- sort and page ----
read("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", ReadOp("orders", order_by=(OrderBy("o_totalprice", "Desc"), OrderBy("o_orderkey")), limit=10, selected_fields=("o_orderkey", "o_totalprice")))
read(
    "sort_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey DESC LIMIT 25 OFFSET 50",
    ReadOp("orders", order_by=(OrderBy("o_orderdate"), OrderBy("o_orderkey", "Desc")), limit=100, limit_param="$limit", selected_fields=("o_orderkey", "o_orderdate")), limit="25", page="3",
)
read(
    "early_window", "SELECT o.o_orderkey, c.c_name FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) o LEFT JOIN customer c ON o.o_custkey = c.c_custkey",
    ReadOp("orders", alias="o", joins=(Join("customer", _on("o.o_custkey", "c.c_custkey"), "Left", "c"),), order_by=(OrderBy("o.o_totalprice", "Desc"),), limit=50, select=_select("o.o_orderkey", "c.c_name")),
)


@query("SELECT count(*) AS total_items, CAST(ceil(count(*) / 100.0) AS BIGINT) AS total_pages FROM orders WHERE o_orderstatus = 'O'")
def total_found(spark: SparkSession, folder: str) -> DataFrame:
    return Plan(ReadOp("orders", filters=(Filter("o_orderstatus", "Eq", "O"),), limit=100), catalog(spark, folder)).total


# ---- batches ----
BATCH = {
    "f-orders": ReadOp("orders", "f-orders", filters=F_ORDERS, aggregations=(Aggregation("Count"),)), "all-orders": ReadOp("orders", "all-orders", aggregations=(Aggregation("Count"),)),
    "regions": ReadOp("region", "regions", selected_fields=("r_regionkey", "r_name")), "nations": ReadOp("nation", "nations", aggregations=(Aggregation("Count"),)),
}


@query("SELECT CAST((SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS DOUBLE) / CAST((SELECT count(*) FROM orders) AS DOUBLE) AS share_f")
def batch_computed(spark: SparkSession, folder: str) -> DataFrame:
    b = BatchOp("share", ("f-orders", "all-orders"), (Computed("share_f", "f / n", {"f": "f-orders.summary", "n": "all-orders.summary[0]"}),), "computed_only")
    return Batch(b, BATCH, catalog(spark, folder)).result()


@query("SELECT r.r_regionkey, r.r_name, CAST((SELECT count(*) FROM nation) AS DOUBLE) AS nations FROM region r")
def batch_merge_first(spark: SparkSession, folder: str) -> DataFrame:
    b = BatchOp("merged", ("regions", "nations"), (Computed("nations", "n", {"n": "nations.summary"}),), "merge_first_data")
    return Batch(b, BATCH, catalog(spark, folder), options=WHOLE).result()


# ---- changes, security, maintenance ----
@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'error'")
def cdc_latest_per_key(spark: SparkSession, folder: str) -> DataFrame:
    events = spark.read.parquet(f"{folder}/events.parquet")
    return maintenance.latest_per_key(events, ["user_id"], ["ts", "event_id"]).filter(F.col("event_type") != "error").select("user_id", "event_id", "value")


@query("SELECT user_id, max_by(value, event_id) FILTER (WHERE event_type = 'purchase') AS last_purchase, max_by(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def cdc_partial_update(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each user, put empty, of which each event updates one or two columns."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    text = lambda *cs: F.array(*[c.cast("string") for c in cs])
    fixed = [F.lit("app").alias("entity"), F.lit("users").alias("tbl"), F.col("user_id").cast("string").alias("pk"), F.lit(None).cast("string").alias("pk_before"), F.lit("bin.1").alias("binlog_file"), F.lit(0).alias("row_no")]
    put = e.select("user_id").distinct().select(*fixed, F.lit("INSERT").alias("op_type"), F.lit(-1).cast("bigint").alias("binlog_pos"), F.array().cast("array<string>").alias("row_columns"), F.array().cast("array<string>").alias("row_values"))
    bought = F.col("event_type") == "purchase"
    names, values = F.when(bought, text(F.lit("last_type"), F.lit("last_purchase"))).otherwise(text(F.lit("last_type"))), F.when(bought, text(F.col("event_type"), F.col("value"))).otherwise(text(F.col("event_type")))
    partial = e.select(*fixed, F.lit("UPDATE").alias("op_type"), F.col("event_id").alias("binlog_pos"), names.alias("row_columns"), values.alias("row_values"))
    rows = apply_feed(put.unionByName(partial), "binlog_pos")
    held = F.map_from_entries("cells")
    return rows.select(F.col("pk").cast("bigint").alias("user_id"), F.try_element_at(held, F.lit("last_purchase")).cast("double").alias("last_purchase"), F.try_element_at(held, F.lit("last_type")).alias("last_type"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND value > 100")
def subscribe_filter(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/events.parquet")
    text = lambda *cs: F.array(*[F.col(c).cast("string") for c in cs])
    changes = e.select("event_id", "user_id", F.lit("app").alias("entity"), F.lit("Events").alias("tbl"), F.lit("INSERT").alias("op_type"), F.array(F.lit("event_type"), F.lit("VALUE")).alias("row_columns"), text("event_type", "value").alias("row_values"))
    op = ReadOp("events", "", "app", "ev", filters=(Filter("ev.event_type", "Eq", "$kind"), Filter("value", "Gt", "100", None, (), "Float")))
    got = subscribe(changes, op, {"kind": "purchase"})
    return got.select("event_id", "user_id", F.get("row_values", F.lit(0)).alias("event_type"))


@query("SELECT delivery_id FROM update_events WHERE lower(entity) = 'vigilancia' AND tbl = 'pagos' AND (upper(trim(op_type)) = 'DELETE' AND row_columns IS NULL OR TRY_CAST(list_extract(row_values, list_position(row_columns, 'valor')) AS DOUBLE) > 50000)")
def subscribe_feed(spark: SparkSession, folder: str) -> DataFrame:
    feed = spark.read.parquet(f"{folder}/update_events.parquet")
    return subscribe(feed, ReadOp("pagos", "", "vigilancia", filters=(Filter("valor", "Gt", "50000", None, (), "Float"),))).select("delivery_id")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def hourly_metering(spark: SparkSession, folder: str) -> DataFrame:
    return hourly_counts(spark.read.parquet(f"{folder}/events.parquet"))


@query(
    "SELECT 'orders' AS tbl, (SELECT count(*) FROM orders) AS source_count, (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS mirror_count, "
    "(SELECT count(*) FROM orders) - (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS diff, (SELECT count(*) FROM orders) = (SELECT count(DISTINCT l_orderkey) FROM lineitem) AS ok"
)
def drift_check(spark: SparkSession, folder: str) -> DataFrame:
    orders, lines = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("orders", "lineitem"))
    return maintenance.count_drift({"orders": orders}, {"orders": lines.select("l_orderkey").distinct()})


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 42 AND (o_orderstatus = 'F' OR o_orderstatus = 'O')")
def row_level_security(spark: SparkSession, folder: str) -> DataFrame:
    op = ReadOp("orders", filters=(Filter("o_orderstatus", "Eq", "F"), Filter("o_orderstatus", "Eq", "O")), filters_op="Or", selected_fields=("o_orderkey",), auth=Auth(filter_col="o_custkey"))
    return Plan(op, catalog(spark, folder), identity=42, options=WHOLE).data


@query("SELECT 'tok_live_' || lpad(c_custkey::VARCHAR, 10, '0') AS token, c_custkey AS user_id FROM customer WHERE c_custkey % 3 <> 0")
def api_key_auth(spark: SparkSession, folder: str) -> DataFrame:
    """Keys made from customers, every third revoked, and each asked for by its token."""
    c = spark.read.parquet(f"{folder}/customer.parquet")
    tokens = c.select(F.concat(F.lit("tok_live_"), F.lpad(F.col("c_custkey").cast("string"), 10, "0")).alias("token"), "c_custkey")
    revoked = F.when(F.col("c_custkey") % 3 == 0, F.current_timestamp())
    keys = tokens.select(F.col("c_custkey").alias("user_id"), F.substring("token", 1, 12).alias("prefix"), F.sha2("token", 256).alias("key_sha256"), revoked.alias("revoked_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    return valid_keys(keys, tokens)


@query("SELECT DISTINCT c_mktsegment AS value FROM customer WHERE c_mktsegment <> '' ORDER BY 1 LIMIT 100")
def catalog_field_values(spark: SparkSession, folder: str) -> DataFrame:
    return catalog(spark, folder).field_values("", "customer", "c_mktsegment")


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders")
def reconcile_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    orders = spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_custkey")
    winners, _ = maintenance.reconcile(orders.unionByName(orders).withColumn("segment", F.lit(1)), ["o_orderkey"], ["segment"])
    return winners.drop("segment")


FLAGSHIP = {
    "type": "read",
    "details": {
        "name": "customer-orders", "table": "customer", "table_alias": "c",
        "joins": [
            {"type": "Inner", "table": "nation", "alias": "n", "on": [{"left": "c.c_nationkey", "op": "Eq", "right": "n.n_nationkey"}]},
            {"type": "Left", "table": "orders", "alias": "o", "on": [{"left": "c.c_custkey", "op": "Eq", "right": "o.o_custkey"}], "count_matches_as": "order_count", "sum_matches_field": "o_totalprice", "sum_matches_as": "order_total"},
        ],
        "filters": [{"field": "o.o_orderstatus", "op": "Eq", "value": "F"}, {"field": "o.order_count", "op": "Gt", "value": "0"}],
        "select": [{"field": "c.c_name", "as": "customer"}, {"field": "n.n_name", "as": "nation"}, {"field": "o.order_count", "as": "orders"}, {"field": "o.order_total", "as": "total"}, {"expression": "o.order_total / o.order_count", "as": "mean_price"}],
        "order_by": [{"field": "o.order_total", "direction": "Desc"}], "limit": 100,
    },
}


@query(
    "SELECT c.c_name AS customer, n.n_name AS nation, m.k AS orders, m.s AS total, round(m.s / m.k, 6) AS mean_price FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey "
    "JOIN (SELECT o_custkey, count(*) AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS s FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey ORDER BY m.s DESC, c.c_custkey LIMIT 100"
)
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return Plan(spec.operation_from(FLAGSHIP), catalog(spark, folder)).data


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
