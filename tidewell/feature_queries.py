"""Queries on the rest of the read layer: parameters, sources, writes, replicas and access, each with its SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import spec
from tidewell.catalog import Catalog
from tidewell.operators import maintenance
from tidewell.operators.incremental import VersionedTable
from tidewell.plans import shaping
from tidewell.plans.adhoc import search
from tidewell.plans.batches import Batch
from tidewell.plans.compiler import WHOLE, Options, Plan
from tidewell.read_queries import Query, catalog
from tidewell.security import secured_read
from tidewell.sources import readers, shared
from tidewell.spec import Aggregation, Auth, BatchOp, DeleteOp, Filter, FilterGroup, Having, InsertOp, Join, JoinOn, OrderBy, ReadOp, ResponseGrouping, Select, UpdateOp
from tidewell.streaming.replica import Replica, snapshot_changes, worker_state
from tidewell.streaming.writes import write_changes

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str):
    """Registers a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        _queries[f.__name__], _sql[f.__name__] = f, sql
        return f

    return add


def _all(op: ReadOp, spark: SparkSession, folder: str, options: Options = WHOLE, **params) -> DataFrame:
    return Plan(op, catalog(spark, folder), params, None, options).data


# ---- saved operations and parameters ----


@query("SELECT o_orderkey AS id, o_totalprice / 100 AS hundreds FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_totalprice > 1000 OR o_custkey = 5)")
def spec_from_json(spark: SparkSession, folder: str) -> DataFrame:
    """An operation saved as JSON, with parameters that go through transforms."""
    text = json.dumps({"type": "read", "details": json.dumps({
        "table": "orders", "filters": [{"field": "o_orderstatus", "op": "Eq", "value": "$status|trim|uppercase"}, {"field": "o_orderpriority", "op": "In", "values": ["$levels"]}, None],
        "filter_tree": {"op": "Or", "children": [{"field": "o_totalprice", "op": "Gt", "value": "$least|split:..:0"}, {"field": "o_custkey", "op": "Eq", "value": 5}]},
        "select": [{"field": "o_orderkey", "as": "id"}, {"expression": "o_totalprice / 100", "as": "hundreds"}],
    })})
    return _all(spec.operation_from(json.loads(text)), spark, folder, Options(None, None, round_digits=None), status=" f ", levels=["1-URGENT", "2-HIGH"], least="1000..9000")


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3")
def filter_disabled(spark: SparkSession, folder: str) -> DataFrame:
    """Filters with the placeholder '?' aren't there, in lists and in trees."""
    tree = FilterGroup("And", (Filter("c_mktsegment", "Eq", "?"), Filter("?", "Eq", "x")))
    return _all(ReadOp("customer", filters=(Filter("c_nationkey", "Eq", "$n"), Filter("c_name", "Eq", "?")), filter_tree=tree, selected_fields=("c_custkey",)), spark, folder, n=3)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (7, 8, 11) AND o_totalprice >= 5000 ORDER BY o_totalprice DESC, o_orderkey LIMIT 5 OFFSET 5")
def search_page(spark: SparkSession, folder: str) -> DataFrame:
    """A search without a saved operation, its second page."""
    return search(catalog(spark, folder), "", "orders", [Filter("o_custkey", "In", "7;8, 11"), Filter("o_totalprice", "Gte", "5000")], ["o_orderkey", "o_totalprice"], [OrderBy("o_totalprice", "Desc")], limit=5, page=2).data


@query("SELECT r_name, r_regionkey FROM region")
def fields_param(spark: SparkSession, folder: str) -> DataFrame:
    """The fields parameter replaces the declared selection."""
    return _all(ReadOp("region", select=(Select("r_regionkey", None, "x"),)), spark, folder, fields="r_name, r_regionkey, r_name")


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC NULLS LAST, c_custkey LIMIT 10 OFFSET 20")
def page_param(spark: SparkSession, folder: str) -> DataFrame:
    """The third page, of a size that the parameters ask for."""
    op = ReadOp("customer", order_by=(OrderBy("c_acctbal", "Desc"),), limit=100, limit_param="n", selected_fields=("c_custkey", "c_acctbal"))
    return Plan(op, catalog(spark, folder), {"n": "10", "page": "3"}).data


@query("SELECT count(*) AS total_items, CAST(1 AS BIGINT) * count(*) AS total_pages FROM orders WHERE o_orderstatus = 'P'")
def limit_zero(spark: SparkSession, folder: str) -> DataFrame:
    """Limit 0: no rows, only counts."""
    p = Plan(ReadOp("orders", limit=0, filters=(Filter("o_orderstatus", "Eq", "P"),)), catalog(spark, folder))
    if p.data is not None:
        raise AssertionError("limit 0 has rows")
    return p.total


@query("SELECT o_custkey AS grp, count(*) AS count FROM orders GROUP BY 1 HAVING count(*) >= 14")
def having_param(spark: SparkSession, folder: str) -> DataFrame:
    """Having with a parameter."""
    op = ReadOp("orders", aggregations=(Aggregation("GroupBy", "o_custkey", having=Having("Gte", "$least")),))
    data = Plan(op, catalog(spark, folder), {"least": 14}, None, WHOLE).aggregations[0].data
    return data.select(F.col("o_custkey").alias("grp"), "count")


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS f, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS o")
def batch_scoped_params(spark: SparkSession, folder: str) -> DataFrame:
    """Two operations of a batch, of which each has its own value of a parameter."""
    one = ReadOp("orders", "one", filters=(Filter("o_orderstatus", "Eq", "$s"),), aggregations=(Aggregation("Count"),))
    made = (spec.Computed("f", "n", {"n": "one.summary"}), spec.Computed("o", "n", {"n": "two.summary"}))
    b = Batch(BatchOp("b", ("one", "two"), made, "computed_only"), {"one": one, "two": ReadOp("orders", "two", filters=one.filters, aggregations=one.aggregations)}, catalog(spark, folder), {"s": "F", "two:s": "O"})
    return b.result().select(F.col("f").cast("bigint").alias("f"), F.col("o").cast("bigint").alias("o"))


@query("SELECT n > 100 AND NOT n % 2 = 1 AS many, 'ORDERS' || ': ' || CASE WHEN n > 10 THEN 'lots' ELSE 'few' END AS shown, CAST(least(n, 7) AS DOUBLE) ^ 2 + n % 10 AS made FROM (SELECT count(*) AS n FROM orders)")
def batch_script(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, truth values and functions over the summary of an operation."""
    n = {"n": "o.summary"}
    made = [("many", "n > 100 && !(n % 2 == 1)"), ("shown", 'str::to_uppercase("orders") + ": " + if(n > 10, "lots", "few")'), ("made", "min(n, 7) ^ 2 + n % 10")]
    op = BatchOp("b", ("o",), tuple(spec.Computed(name, text, n, "script") for name, text in made), "computed_only")
    return Batch(op, {"o": ReadOp("orders", aggregations=(Aggregation("Count"),))}, catalog(spark, folder)).result()


@query("SELECT CAST(ceil(max(n) / 100.0) AS BIGINT) AS total_pages, CAST(sum(n) AS BIGINT) AS total_items FROM (SELECT count(*) AS n FROM orders UNION ALL SELECT count(*) FROM customer)")
def batch_meta(spark: SparkSession, folder: str) -> DataFrame:
    """Pages and items over the operations of a batch."""
    b = Batch(BatchOp("b", ("o", "c")), {"o": ReadOp("orders"), "c": ReadOp("customer")}, catalog(spark, folder))
    return spark.createDataFrame([b.meta()], "total_pages bigint, total_items bigint")


# ---- expressions and shapes ----


@query("SELECT l_orderkey, l_linenumber, CASE WHEN abs(l_quantity - 17) > 2.220446049250313e-16 THEN 1.0 ELSE 0.0 END AS other, CASE WHEN l_discount < 0.05 THEN 1.0 ELSE 0.0 END + CASE WHEN l_tax <= 0.02 THEN 1.0 ELSE 0.0 END AS low FROM lineitem")
def expr_compare_all(spark: SparkSession, folder: str) -> DataFrame:
    return _all(ReadOp("lineitem", select=(Select("l_orderkey"), Select("l_linenumber"), Select("", "l_quantity != 17", "other"), Select("", "(l_discount < 0.05) + (l_tax <= 0.02)", "low"))), spark, folder)


@query("SELECT check_id, CAST(coalesce(source_count, 0) - coalesce(mirror_count, 0) AS DOUBLE) AS d FROM consistency_checks")
def expr_null_is_zero(spark: SparkSession, folder: str) -> DataFrame:
    return _all(ReadOp("consistency_checks", select=(Select("check_id"), Select("", "source_count - mirror_count", "d"))), spark, folder)


@query("SELECT o_orderkey, CAST(CAST(o_totalprice AS DECIMAL(18,2)) + CAST(c_acctbal AS DECIMAL(18,2)) AS DOUBLE) AS both_ FROM orders JOIN customer ON o_custkey = c_custkey")
def expr_over_join(spark: SparkSession, folder: str) -> DataFrame:
    j = Join("customer", (JoinOn("o.o_custkey", "c.c_custkey"),), "Inner", "c")
    return _all(ReadOp("orders", alias="o", joins=(j,), select=(Select("o.o_orderkey", None, "o_orderkey"), Select("", "o_totalprice + c.c_acctbal", "both_"))), spark, folder)


@query("SELECT c_custkey, CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE rtrim(rtrim(printf('%.6f', c_acctbal), '0'), '.') END AS shown FROM customer")
def number_texts(spark: SparkSession, folder: str) -> DataFrame:
    c = spark.read.parquet(f"{folder}/customer.parquet")
    return c.select("c_custkey", shaping.number_text(F.col("c_acctbal")).alias("shown"))


@query("SELECT '{\"r_regionkey\":' || r_regionkey || ',\"r_name\":\"' || r_name || '\"}' AS json FROM region")
def rows_as_json(spark: SparkSession, folder: str) -> DataFrame:
    return shaping.json_rows(_all(ReadOp("region", selected_fields=("r_regionkey", "r_name")), spark, folder))


@query("SELECT r_name, count(DISTINCT n_name) AS nations, count(*) AS items FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def response_grouping_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Regions with their nations with their keys, counted out of the nested items."""
    joins = (Join("nation", (JoinOn("n.n_regionkey", "r.r_regionkey"),), "Inner", "n"),)
    grouping = ResponseGrouping(("r_name",), "nations", False, (ResponseGrouping(("n_name",), "keys"),))
    op = ReadOp("region", alias="r", joins=joins, response_grouping=grouping, select=(Select("r.r_name", None, "r_name"), Select("n.n_name", None, "n_name"), Select("n.n_nationkey", None, "n_nationkey")))
    out = shaping.group_response(Plan(op, catalog(spark, folder), {}, None, WHOLE))
    return out.select("r_name", F.size("nations").cast("bigint").alias("nations"), F.aggregate("nations", F.lit(0).cast("bigint"), lambda n, x: n + x["keys_pagination"]["total_items"]).alias("items"))


# ---- joins ----


@query("SELECT d.deployment_id, d.user_id, c.check_id FROM (SELECT DISTINCT deployment_id, user_id FROM deployments) d JOIN (SELECT DISTINCT check_id, deployment_id FROM consistency_checks WHERE ok) c ON c.deployment_id = d.deployment_id")
def join_null_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Null keys meet nothing."""
    c = catalog(spark, folder)
    c.register("", "d", c.table("", "deployments").df.select("deployment_id", "user_id").distinct())
    c.register("", "k", c.table("", "consistency_checks").df.select("check_id", "deployment_id", "ok").distinct())
    j = Join("k", (JoinOn("d.deployment_id", "k.deployment_id"),), "Inner", "k")
    op = ReadOp("d", joins=(j,), filters=(Filter("k.ok", "Eq", "true"),), select=(Select("d.deployment_id", None, "deployment_id"), Select("d.user_id", None, "user_id"), Select("k.check_id", None, "check_id")))
    return Plan(op, c, {}, None, WHOLE).data


@query("SELECT o.o_orderkey, l.l_partkey FROM orders o JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) l ON l.l_orderkey = o.o_orderkey")
def join_deduped(spark: SparkSession, folder: str) -> DataFrame:
    """The right side as a set of the columns in use."""
    j = Join("lineitem", (JoinOn("o.o_orderkey", "l.l_orderkey"),), "Inner", "l")
    return _all(ReadOp("orders", alias="o", joins=(j,), select=(Select("o.o_orderkey", None, "o_orderkey"), Select("l.l_partkey", None, "l_partkey"))), spark, folder, Options(None, None, dedupe_right=True))


@query("SELECT count(DISTINCT coalesce(CAST(deployment_id AS VARCHAR), 'null')) AS n FROM consistency_checks")
def count_distinct_null(spark: SparkSession, folder: str) -> DataFrame:
    """A null counts as one value."""
    return Plan(ReadOp("consistency_checks", aggregations=(Aggregation("CountDistinct", "deployment_id"),)), catalog(spark, folder)).aggregations[0].summary.select(F.col("summary").alias("n"))


# ---- sources, writes and replicas ----


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS ts_day, strftime(ts, '%Y-%m') AS ts_month, strftime(ts, '%H:00-%H:59') AS ts_hour_bucket FROM events")
def json_lines_dates(spark: SparkSession, folder: str) -> DataFrame:
    """A table written as JSON lines and read back with the columns derived from its dates."""
    path = shared.scratch_path(spark, "lines")
    spark.read.parquet(f"{folder}/events.parquet").write.json(path)
    return readers.json_lines(spark, path, "event_id bigint, ts timestamp_ntz", ["ts"]).select("event_id", "ts_day", "ts_month", "ts_hour_bucket")


@query("SELECT DISTINCT delivery_id FROM update_events WHERE lower(entity) IN (SELECT lower(entity) FROM update_events ORDER BY entity LIMIT 1)")
def changes_in_scope(spark: SparkSession, folder: str) -> DataFrame:
    """The changes of one source schema; system schemas never count."""
    feed = spark.read.parquet(f"{folder}/update_events.parquet")
    name = feed.agg(F.min("entity")).first()[0]
    system = feed.withColumn("entity", F.lit("MySQL"))
    return readers.in_scope(feed.unionByName(system), schemas=[name.upper(), "mysql"]).select("delivery_id").distinct()


@query("SELECT event_id, upper(event_type[1]) || substr(event_type, 2) AS kind, CASE WHEN value IS NULL THEN NULL ELSE strftime(make_timestamp((1700000000 + event_id) * 1000000), '%Y-%m-%d %H:%M:%S') END AS at_ FROM events WHERE event_type IN ('view', 'click', 'purchase')")
def decoded_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Enum indices as labels and epoch seconds as times."""
    e = spark.read.parquet(f"{folder}/events.parquet").filter(F.col("event_type").isin("view", "click", "purchase"))
    index = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    raw = e.select("event_id", index.alias("kind"), F.when(F.col("value").isNotNull(), 1700000000 + F.col("event_id")).alias("at_"))
    return readers.decode_columns(raw, {"kind": ["View", "Click", "Purchase"]}, ["at_"])


def _replica(spark: SparkSession) -> Replica:
    return Replica(spark, shared.scratch_path(spark, "replica"), 4)


@query("SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'renamed' ELSE n_name END AS n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 99, 'new', 0")
def replica_catch_up(spark: SparkSession, folder: str) -> DataFrame:
    """Snapshot, then saved writes and an insert taken from the log, then a typed table that a saved read goes over."""
    nation = spark.read.parquet(f"{folder}/nation.parquet")
    c = Catalog(spark)
    c.register("shop", "nation", nation, ["n_nationkey"])
    r = _replica(spark)
    r.take(snapshot_changes(nation, "shop", "nation", ["n_nationkey"], "bin.1", 100), 0)
    late = write_changes(UpdateOp("u", "shop", "nation", (Filter("n_nationkey", "Eq", "$k"),), ("n_name",)), c, {"k": 2}, ("bin.1", 99), {"n_name": "stale"})
    up = write_changes(UpdateOp("u", "shop", "nation", (Filter("n_nationkey", "Eq", "$k"),), ("n_name",)), c, {"k": 3}, ("bin.1", 101), {"n_name": "renamed"})
    down = write_changes(DeleteOp("d", "shop", "nation", (Filter("n_regionkey", "Eq", "1"),)), c, {}, ("bin.1", 102))
    put = readers.insert_change(InsertOp("i", "shop", "nation", ("n_name",)), {"n_nationkey": 99, "n_name": "new", "n_regionkey": 0}, ["n_nationkey"], ("bin.2", 1, 0))
    put_df = spark.createDataFrame([tuple(put.get(f.name) for f in readers.CHANGE_SCHEMA)], readers.CHANGE_SCHEMA)
    r.take(put_df.unionByName(up, True).unionByName(down, True).unionByName(late, True), 1)
    if not r.caught_up((2, 1)):
        raise AssertionError("the replica has not caught up")
    c.register("mirror", "nation", r.table("shop", "nation", {"n_name": "string", "n_regionkey": "int"}, {"n_nationkey": "int"}), ["n_nationkey"])
    return Plan(ReadOp("nation", "", "mirror", selected_fields=("n_nationkey", "n_name", "n_regionkey")), c, {}, None, WHOLE).data


@query("SELECT 'region' AS tbl, count(*) AS n FROM region UNION ALL SELECT 'nation', count(*) FROM nation WHERE n_regionkey = 0")
def replica_stream(spark: SparkSession, folder: str) -> DataFrame:
    """A log of files taken in as a stream: one table truncated and filled again, one altered and taken anew."""
    path = shared.scratch_path(spark, "log")
    region, nation = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("region", "nation"))
    whole = lambda tbl, op, pos: snapshot_changes(region.limit(1), "shop", tbl, ["r_regionkey"], "bin.1", pos).withColumns({"op_type": F.lit(op), "pk": F.lit(None).cast("string")})
    parts = [snapshot_changes(nation, "shop", "nation", ["n_nationkey"], "bin.1", 1), whole("nation", "TRUNCATE", 2), snapshot_changes(nation.filter("n_regionkey = 0"), "shop", "nation", ["n_nationkey"], "bin.1", 3), whole("region", "ALTER", 4)]
    for p in parts:
        p.coalesce(1).write.mode("append").parquet(path)
    r = _replica(spark)
    r.follow(path, "strict", once=True).awaitTermination()
    if r.stale() != [("shop", "region")]:
        raise AssertionError("the altered table must be stale")
    r.resync(region, "shop", "region", ["r_regionkey"], "bin.1", 5, 1000)
    return r.rows().groupBy("tbl").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, c_name FROM customer")
def replica_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """A table whose copy has drifted is taken anew from its source."""
    customer = spark.read.parquet(f"{folder}/customer.parquet")
    source = customer.select("c_custkey", "c_name")
    r = _replica(spark)
    r.take(snapshot_changes(customer.filter("c_acctbal > 0").select("c_custkey", "c_name"), "shop", "customer", ["c_custkey"], "bin.1", 1), 0)
    drift = maintenance.count_drift({"shop.customer": source}, {"shop.customer": r.rows()})
    if r.repair(drift, {"shop.customer": (source, ["c_custkey"])}, "bin.2", 1, 1) != ["shop.customer"]:
        raise AssertionError("the drift must be found")
    return r.table("shop", "customer", {"c_name": "string"}, {"c_custkey": "bigint"})


@query("SELECT o_orderkey, o_totalprice FROM orders")
def snapshot_rewritten(spark: SparkSession, folder: str) -> DataFrame:
    """A snapshot sorted by key into small files as a new version, and read from it."""
    path = shared.scratch_path(spark, "snapshot")
    maintenance.rewrite_snapshot(spark, spark.read.parquet(f"{folder}/orders.parquet").select("o_orderkey", "o_totalprice"), path, ["o_orderkey"], 5000)
    return VersionedTable(spark, path).read()


@query("SELECT deployment_id, CASE WHEN last_heartbeat_at IS NULL THEN 'unknown' WHEN epoch(TIMESTAMP '2030-01-01') - floor(epoch(last_heartbeat_at)) < 60 THEN 'live' ELSE 'lagging' END AS state FROM deployments")
def worker_states(spark: SparkSession, folder: str) -> DataFrame:
    d = spark.read.parquet(f"{folder}/deployments.parquet")
    return d.select("deployment_id", worker_state(F.col("last_heartbeat_at"), F.lit("2030-01-01").cast("timestamp_ntz")).alias("state"))


# ---- access ----


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 40")
def secured_by_key(spark: SparkSession, folder: str) -> DataFrame:
    """A read as the owner of an API key; all keys share one prefix."""
    c = catalog(spark, folder)
    token = F.concat(F.lit("tok_live_000"), F.lpad(F.col("c_custkey").cast("string"), 9, "0"))
    keys = c.table("", "customer").df.select(F.col("c_custkey").alias("user_id"), F.substring(token, 1, 12).alias("prefix"), F.sha2(token, 256).alias("key_sha256"), F.lit(None).cast("timestamp").alias("revoked_at"), F.lit(None).cast("timestamp").alias("expires_at"))
    c.register("", "api_keys", keys)
    op = ReadOp("orders", selected_fields=("o_orderkey",), auth=Auth(scheme="api_key_sha256", filter_col="o_custkey"))
    return secured_read(op, c, {}, {"authorization": "Bearer tok_live_000000000040"}, WHOLE).data


@query("SELECT o_orderkey FROM orders WHERE o_custkey = 77")
def secured_by_token(spark: SparkSession, folder: str) -> DataFrame:
    """A read as the holder of a plain token in the header of that name."""
    c = catalog(spark, folder)
    c.register("", "sessions", c.table("", "customer").df.select(F.col("c_name").alias("token"), F.col("c_custkey").alias("user_id")))
    name = c.table("", "customer").df.filter("c_custkey = 77").first()["c_name"]
    op = ReadOp("orders", selected_fields=("o_orderkey",), auth=Auth(table="sessions", token_col="token", filter_col="o_custkey"))
    return secured_read(op, c, {}, {"X-API-Key": name}, WHOLE).data


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
