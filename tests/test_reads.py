import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewell import spec
from tidewell.cache import ResponseCache
from tidewell.catalog import Catalog, normalised
from tidewell.errors import AccessDenied, SpecError
from tidewell.gate import Busy, Gate
from tidewell.plans import shaping
from tidewell.plans.batches import Batch
from tidewell.plans.compiler import WHOLE, Options, Plan
from tidewell.plans.enrichment import enrich
from tidewell.security import api_key_owner, credential, secured_read
from tidewell.spec import Aggregation, Auth, BatchOp, Collect, Computed, Filter, FilterGroup, Join, JoinOn, OrderBy, ReadOp, ResponseGrouping, Select, SplitEnrichment


@pytest.fixture(scope="module")
def tables(spark):
    c = Catalog(spark)
    c.register("e", "l", spark.createDataFrame([(1, "6351", 10.0, "a"), (2, "6351.0", None, "a"), (3, " 7 ", 5.0, "b"), (4, None, -5.0, None), (5, "", 0.0, "b"), (6, "z", 1.0, "c")], "id long, k string, n double, g string"), ["id"])
    c.register("e", "r", spark.createDataFrame([(6351, 1.5), (6351, 1.5), (7, None), (None, 9.0)], "k long, amount double"))
    c.register("e", "u", spark.createDataFrame([("a", "A"), ("b", None)], "g string, label string"), ["g"])
    c.register("f", "u", spark.createDataFrame([("a", "other")], "g string, label string"))
    return c


def rows(df):
    return [tuple(r) for r in df.collect()]


def data(op, tables, options=WHOLE, **params):
    return rows(Plan(op, tables, params, None, options).data)


def s(*names):
    return tuple(Select(n) for n in names)


ON = (JoinOn("l.k", "r.k"),)
LEFT, INNER = Join("r", ON, "Left"), Join("r", ON)


def read(*args, **kw):
    return ReadOp("l", "", "e", *args, **kw)


def test_keys_are_normalised_and_bags_kept(tables):
    got = data(read(joins=(INNER,), select=s("l.id", "r.amount")), tables)
    assert sorted(got, key=str) == [(1, 1.5), (1, 1.5), (2, 1.5), (2, 1.5), (3, None)]
    assert len(data(read(joins=(INNER,), select=s("l.id", "r.amount")), tables, Options(None, None, dedupe_right=True))) == 3
    assert len(data(read(joins=(LEFT,), select=s("l.id", "r.k")), tables)) == 8
    null = data(read(joins=(INNER,), select=s("l.id", "r.amount")), tables, Options(None, None, null_safe_join=True))
    assert (4, 9.0) in null and len(null) == 6


def test_count_and_sum_joins(tables):
    j = Join("r", ON, "Left", "x", None, "n", "amount", "total")
    j = Join("r", (JoinOn("l.k", "x.k"),), "Left", "x", None, "n", "amount", "total")
    assert sorted(data(read(joins=(j,), select=s("l.id", "x.n", "x.total")), tables)) == [(1, 2, 3.0), (2, 2, 3.0), (3, 1, 0.0), (4, 0, 0.0), (5, 0, 0.0), (6, 0, 0.0)]
    inner = Join("r", (JoinOn("l.k", "x.k"),), "Inner", "x", None, "n")
    assert sorted(data(read(joins=(inner,), select=s("l.id", "x.n")), tables)) == [(1, 2), (2, 2), (3, 1)]
    zero = read(joins=(j,), filters=(Filter("x.amount", "Gt", "1"), Filter("x.n", "Eq", "0")), select=s("l.id"))
    assert sorted(data(zero, tables)) == [(3,), (4,), (5,), (6,)]


def test_left_filters_say_what_matches_and_trees_what_stays(tables):
    u = Join("u", (JoinOn("l.g", "u.g"),), "Left")
    on = read(joins=(u,), filters=(Filter("u.label", "Eq", "A"),), select=s("l.id", "u.label"))
    assert sorted(data(on, tables), key=str) == [(1, "A"), (2, "A"), (3, None), (4, None), (5, None), (6, None)]
    tree = read(joins=(u,), filter_tree=Filter("u.label", "IsNull"), select=s("l.id"))
    assert sorted(data(tree, tables)) == [(3,), (4,), (5,), (6,)]
    both = read(joins=(u,), filters=(Filter("u.label", "Eq", "A"), Filter("n", "Gt", "4")), filters_op="Or", select=s("l.id"))
    assert sorted(data(both, tables)) == [(1,), (2,), (3,)]
    other = Join("u", (JoinOn("l.g", "v.g"),), "Inner", "v", "f")
    assert sorted(data(read(joins=(other,), select=s("l.id", "v.label")), tables)) == [(1, "other"), (2, "other")]


@pytest.mark.parametrize("bad", [
    dict(joins=(Join("r", ()),)), dict(joins=(INNER, INNER)), dict(joins=(Join("r", (JoinOn("r.k", "r.amount"),)),)), dict(joins=(Join("no", ON),)), dict(joins=(Join("r", ON, sum_matches_field="amount"),)), dict(joins=(INNER,), select=s("x.y")), dict(select=s("nope")),
    dict(joins=(INNER,), selected_fields=("*",)), dict(select=(Select("id", None, "a"), Select("k", None, "a"))), dict(order_by=(OrderBy("nope"),)), dict(select=(Select("", "1 +"),)),
])
def test_errors(tables, bad):
    with pytest.raises(SpecError):
        data(read(**bad), tables)


def test_strict_json():
    bad = [{"table": "t", "filters": [{"field": "a", "op": "Like"}]}, {"table": "t", "order_by": [{"field": "a", "direction": "Up"}]}, {"table": "t", "filters_op": "Xor"}, {"table": "t", "joins": [{"table": "r", "type": "Full", "on": [{"left": "a", "right": "b"}]}]}, {"table": "t", "joins": [{"table": "r", "on": []}]},
           {"table": "t", "aggregations": [{"Median": {}}]}, {"table": "t", "aggregations": [{"Collect": {}}]}, {"table": "t", "response_grouping": {}}, {}, {"table": "t", "joins": [{"table": "r", "on": [{"left": "a", "op": "Gt", "right": "b"}]}]}]
    for d in bad:
        with pytest.raises(SpecError):
            spec.operation_from({"type": "read", "details": d})
    with pytest.raises(SpecError):
        spec.operation_from({"type": "merge"})
    ops = spec.load_catalog(json.dumps([{"type": "insert", "details": {"name": "i", "table": "t", "expected_fields": ["a"]}}, {"type": "delete", "details": {"name": "d", "table": "t", "filters": [{"field": "a"}]}}, {"type": "update", "details": {"name": "u", "table": "t"}}, {"type": "batch", "details": {"name": "b", "operations": ["r"]}}, {"type": "read", "details": {"name": "r", "entity": "e", "table": "t", "joins": [{"table": "x", "entity": "f", "on": [{"left": "t.a", "right": "x.a"}]}]}}]))
    assert [type(o).__name__ for o in ops.values()] == ["InsertOp", "DeleteOp", "UpdateOp", "BatchOp", "ReadOp"]
    assert spec.referenced_tables([ops["b"]], ops) == {("e", "t"), ("f", "x")}
    store = spec.OperationStore(ops)
    for call in (lambda: store.create(ops["r"]), lambda: store.remove("none"), lambda: store.replace(ReadOp("t", "none"))):
        with pytest.raises(SpecError):
            call()
    store.remove("r")
    store.create(ops["r"])


def test_computed_columns_and_projection(tables):
    op = read(select=(Select("id"), Select("", "n / 3", "x"), Select("", "if(n > 0, k, -1)", "y")), order_by=(OrderBy("x", "Desc"), OrderBy("id")))
    assert data(op, tables) == [(1, 3.333333, 6351.0), (3, 1.666667, 7.0), (6, 0.333333, 0.0), (2, 0.0, -1.0), (5, 0.0, -1.0), (4, -1.666667, -1.0)]
    assert Plan(read(), tables, options=WHOLE).data.columns == ["g", "id", "k", "n"]
    assert Plan(read(selected_fields=("g", "*", "g")), tables, options=WHOLE).data.columns == ["g", "id", "k", "n"]
    assert Plan(read(select=s("id")), tables, {"fields": "k, id"}, None, WHOLE).data.columns == ["k", "id"]


def test_paging(tables):
    op = read(select=s("id"), order_by=(OrderBy("g"),), limit=2, limit_param="$n")
    assert data(op, tables, Options()) == [(4,), (1,)] and data(op, tables, Options(), page=2) == [(2,), (3,)] and data(op, tables, Options(), n="4", page="2") == [(5,), (6,)]
    p = Plan(op, tables, {"page": 3})
    assert p.pagination() == {"page": 3, "per_page": 2, "total_pages": 3, "total_items": 6}
    assert Plan(op, tables, {"n": 0}).data is None and Plan(op, tables, {"n": 0}).total.first()["total_items"] == 6
    assert Plan(read(select=s("id")), tables).limit == 100 and Plan(read(limit=50_000), tables).limit == 10_000
    assert Plan(read(filters=(Filter("id", "Eq", "77"),)), tables).pagination() is None
    with pytest.raises(SpecError):
        data(op, tables, Options(), n="many")


def test_early_window_only_where_it_changes_nothing(tables):
    u, counted = Join("u", (JoinOn("l.g", "u.g"),), "Left"), Join("r", ON, "Left", "r", None, "m")
    op = read(joins=(u, counted), order_by=(OrderBy("l.n", "Desc"),), limit=2, select=s("l.id", "u.label", "r.m"))
    p = Plan(op, tables)
    assert rows(p.data) == [(1, "A", 2), (3, None, 1)] and p.windowed and p.total.first()["total_items"] == 6
    fan = Plan(read(joins=(LEFT,), order_by=(OrderBy("l.n", "Desc"),), limit=2, select=s("l.id")), tables)
    assert rows(fan.data) == [(1,), (1,)] and not fan.windowed


def agg(tables, a, options=Options(), **kw):
    r = Plan(read(aggregations=(a,), **kw), tables, {}, None, options).aggregations[0]
    return (None if r.data is None else rows(r.data)), r.summary.first()[0]


def test_aggregations(tables):
    assert agg(tables, Aggregation("Count")) == (None, 6)
    assert agg(tables, Aggregation("Count", "r.amount"), joins=(LEFT,)) == (None, 5)
    assert agg(tables, Aggregation("GroupBy", "g")) == ([("a", 2), ("b", 2), (None, 1), ("c", 1)], 6)
    assert agg(tables, Aggregation("TopN", "g", n=2)) == ([("a", 2), ("b", 2)], 4)
    assert agg(tables, spec.aggregation_from({"TopN": {"field": "g", "n": 3, "having": {"op": "Lt", "value": "2"}}})) == ([(None, 1)], 5)
    assert agg(tables, Aggregation("Sum", "n")) == (None, 11.0) and agg(tables, Aggregation("Sum", "n"), filters=(Filter("id", "Eq", "0"),)) == (None, 0.0)
    assert agg(tables, Aggregation("Sum", expression="n * 2", group_by="g")) == ([("a", 20.0), ("b", 10.0), ("c", 2.0), (None, -10.0)], 22.0)
    assert agg(tables, Aggregation("Avg", "n", group_by="g"))[0][0] == ("a", 5.0) and agg(tables, Aggregation("Avg", "n", group_by="g"), Options(null_as_zero=False))[0][0] == ("a", 10.0)
    assert agg(tables, Aggregation("Min", "n")) == (None, -5.0) and agg(tables, Aggregation("Max", "n")) == (None, 10.0) and agg(tables, Aggregation("Max", "n"), filters=(Filter("id", "Eq", "0"),)) == (None, 0.0)
    assert agg(tables, Aggregation("CountDistinct", "g")) == (None, 4) and agg(tables, Aggregation("CountDistinct", "k", group_by="g")) == ([("a", 2), ("b", 2), (None, 1), ("c", 1)], 6)
    assert agg(tables, Aggregation("CountDistinct", "r.amount"), joins=(LEFT,)) == (None, 2)
    with pytest.raises(SpecError):
        agg(tables, Aggregation("Median", "n"))


def test_sums_do_not_hang_on_order(spark):
    c = Catalog(spark)
    c.register("", "t", spark.createDataFrame([(x,) for x in [1e17, 0.1, -1e17, 0.2, 1e300, -1e300]], "n double"))
    assert Plan(ReadOp("t", aggregations=(Aggregation("Sum", "n"),)), c).aggregations[0].summary.first()[0] == pytest.approx(0.3)


def test_collect(tables):
    op = read(select=s("g", "id", "n"), aggregations=(Collect(("g",), "xs", ("id", "n"), (OrderBy("n", "Desc"),)), Collect(("g",), include_group_fields_in_items=True)), order_by=(OrderBy("id", "Desc"),))
    first, second = Plan(op, tables, options=WHOLE).aggregations
    assert {r["g"]: [tuple(i) for i in r["xs"]] for r in first.data.collect()}["b"] == [(3, 5.0), (5, 0.0)] and first.summary.first()[0] == 6
    assert {r["g"]: [i["id"] for i in r["items"]] for r in second.data.collect()}["a"] == [2, 1] and second.data.schema["items"].dataType.elementType.names == ["g", "id", "n"]
    for c in (Collect(("zz",)), Collect(("g",), item_fields=("zz",)), Collect(("g",), item_fields=("id",), order_by=(OrderBy("n"),))):
        with pytest.raises(SpecError):
            Plan(read(select=s("g", "id", "n"), aggregations=(c,)), tables).aggregations


def test_response_grouping(spark):
    c = Catalog(spark)
    c.register("", "t", spark.createDataFrame([("a", "x", 1, "p"), ("a", "x", 2, "q"), ("a", "y", 3, None), ("a", None, None, ""), ("b", None, None, ""), (None, "x", 4, "r")], "g string, h string, i int, v string"))
    op = ReadOp("t", select=s("g", "h", "i", "v"), order_by=(OrderBy("i"),), response_grouping=ResponseGrouping(("g",), "rows", children=(ResponseGrouping(("h",), "leaves", limit=1),)))
    got = {r["g"]: r for r in shaping.group_response(Plan(op, c, options=WHOLE)).collect()}
    assert got["b"]["rows"] == [] and got["b"]["rows_pagination"]["total_items"] == 0 and got["a"]["rows_pagination"].asDict() == {"page": 1, "per_page": 100, "total_pages": 1, "total_items": 3}
    x, y = got["a"]["rows"]
    assert (x["h"], [tuple(l) for l in x["leaves"]], x["leaves_pagination"]["total_pages"]) == ("x", [(1, "p")], 2) and y["leaves"][0]["i"] == 3
    page2 = shaping.group_response(Plan(op, c, options=WHOLE), ResponseGrouping(("g",), limit=2, offset=2))
    assert {r["g"]: ([i["i"] for i in r["items"]], r["items_pagination"]["page"]) for r in page2.collect()} == {"a": ([3], 2), "b": ([], 2), None: ([], 2)}
    asked = shaping.group_response(Plan(op, c, {"grouping_limit": "2", "rows_pagination": "2"}, None, WHOLE))
    assert {r["g"]: (len(r["rows"]), r["rows_pagination"]["page"], r["rows_pagination"]["per_page"]) for r in asked.collect()}["a"] == (1, 2, 2)
    assert shaping.runtime_grouping(Plan(op, c, {"grouping_offset": 7, "grouping_limit": 500})).offset == 7
    for bad in (lambda: shaping.group_response(Plan(op, c, {"grouping_page": "x"})), lambda: shaping.group_response(Plan(ReadOp("t"), c))):
        with pytest.raises(SpecError):
            bad()
    none = shaping.group_response(Plan(op, c, options=WHOLE), ResponseGrouping(("g",), limit=0))
    assert all(r["items"] == [] and r["items_pagination"]["total_pages"] == 1 for r in none.collect())
    assert json.loads(shaping.json_rows(c.table("", "t").df.filter("i = 3")).first()[0]) == {"g": "a", "h": "y", "i": 3, "v": None}
    assert [len(b) for b in shaping.batches(spark.range(25), 10)] == [10, 10, 5]


def test_batches(tables):
    ops = {"n": read(aggregations=(Aggregation("Count"), Aggregation("Sum", "n"))), "d": read(select=s("id"), order_by=(OrderBy("id"),)), "bad": read(select=s("zz"), filters=(Filter("g", "Eq", "$need"),)), "w": spec.InsertOp("w", "e", "l")}
    made = (Computed("ratio", "total / (n - 6)", {"total": "n.summary[1]", "n": "n.summary"}), Computed("twice", "2 * t", {"t": "n.summary[1]"}))
    b = Batch(BatchOp("b", ("d", "n", "bad", "w", "none"), made, "merge_first_data"), ops, tables)
    assert set(b.errors) == {"bad", "w", "none"} and set(b.plans) == {"d", "n"}
    assert rows(b.result())[:2] == [(1, 0.0, 22.0), (2, 0.0, 22.0)] and rows(b.computed()) == [(0.0, 22.0)]
    assert b.meta() == {"total_pages": 1, "total_items": 6}
    for source in ("n", "n.data", "zz.summary", "n.summary[9]", "d.summary"):
        with pytest.raises(SpecError):
            Batch(BatchOp("b", ("d", "n"), (Computed("c", "x", {"x": source}),)), ops, tables).computed()
    assert set(Batch(BatchOp("b", ("d", "n")), ops, tables).result()) == {"d", "n"}


def test_split_enrichment(spark, tables):
    second = ReadOp("r", "", "e", filters=(Filter("k", "In", "$split_ids"),), select=(Select("k"), Select("amount")), order_by=(OrderBy("amount", "Desc"),))
    split = SplitEnrichment("kk", second, enrichment_key_field="k", merge_fields=("amount",), additive_fields=(("n", "amount"),), defaults={"amount": -1.0}, base_select_aliases=("id", "kk", "n"))
    op = read(select=(Select("id"), Select("", "k", "kk"), Select("n"), Select("g")), order_by=(OrderBy("id"),), limit=3, split=split)
    assert sorted(rows(enrich(op, tables))) == [(1, 6351.0, 11.5, 1.5), (2, 6351.0, 1.5, 1.5), (3, 7.0, 5.0, -1.0)]
    with pytest.raises(SpecError):
        enrich(read(split=SplitEnrichment("k", ReadOp("r", "", "e"))), tables)


def test_row_level_security(spark):
    import hashlib

    token, now = "tok_live_abcdefgh", datetime.datetime.now()
    sha = hashlib.sha256(token.encode()).hexdigest()
    day = datetime.timedelta(days=1)
    c = Catalog(spark)
    c.register("", "t", spark.createDataFrame([(1, 7), (2, 8), (3, None)], "id int, owner long"))
    key = "user_id long, prefix string, key_sha256 string, revoked_at timestamp, expires_at timestamp"
    c.register("", "api_keys", spark.createDataFrame([(9, token[:12], None, None, None), (8, token[:12], sha, now, None), (6, token[:12], sha, None, now - day), (7, token[:12], sha.upper(), None, now + day)], key))
    auth = Auth(scheme="api_key_sha256", filter_col="owner")
    op = ReadOp("t", select=s("id"), filters=(Filter("id", "Eq", "1"), Filter("id", "Eq", "2")), filters_op="Or", auth=auth)
    assert rows(secured_read(op, c, headers={"Authorization": f"Bearer {token}"}).data) == [(1,)]
    assert rows(Plan(op, c, identity=8).data) == [(2,)] and rows(Plan(ReadOp("t", select=s("id"), auth=Auth(enabled=False)), c).data) == [(1,), (2,), (3,)]
    for call in (lambda: secured_read(op, c), lambda: secured_read(op, c, headers={"x-api-key": token + "x"}), lambda: Plan(op, c).data, lambda: api_key_owner(c.table("", "api_keys").df, "short")):
        with pytest.raises(AccessDenied):
            call()
    assert credential({"AUTHORIZATION": "bearer  a "}) == "a" and credential({"X-Api-Key": "b"}) == "b" and credential({"authorization": "Basic x"}) is None


def test_collect_by_pages(spark):
    c = Catalog(spark)
    c.register("", "t", spark.createDataFrame([("a", i) for i in range(5)] + [("b", 9), (None, 1), (None, 2)], "g string, n int"))
    op = lambda **more: ReadOp("t", select=s("g", "n"), aggregations=(Collect(("g",), order_by=(OrderBy("n", "Desc"),), **more),))
    get = lambda **more: [(r["g"], [x["n"] for x in r["items"]], r["items_pagination"]["total_items"]) for r in Plan(op(**more), c).aggregations[0].data.collect()]
    assert get(limit=2) == [(None, [2, 1], 2), ("a", [4, 3], 5), ("b", [9], 1)] and get(limit=2, offset=4) == [(None, [], 2), ("a", [0], 5), ("b", [], 1)]
    assert "items_pagination" not in Plan(op(), c).aggregations[0].data.columns
    assert spec.aggregation_from({"Collect": {"group_by": "g", "limit": 3, "offset": 6}}).offset == 6


def test_guard_and_messages(tables):
    j = Join("r", (JoinOn("l.k", "r.k"),), "Inner", "r")
    op = read(joins=(j,), select=(Select("l.id", None, "id"),))
    assert Plan(op, tables, options=Options(max_joined=5)).guard().data.count() == 5
    with pytest.raises(SpecError):
        Plan(op, tables, options=Options(max_joined=4)).guard()
    head, *parts = shaping.messages(Plan(read(select=s("id"), order_by=(OrderBy("id"),)), tables), 4)
    assert head == {"columns": ["id"], "types": ["bigint"], "pagination": {"page": 1, "per_page": 100, "total_pages": 1, "total_items": 6}} and [len(p) for p in parts] == [4, 2]
    assert list(shaping.messages(Plan(read(limit=0, select=s("id")), tables)))[1:] == []


def test_gate(tables):
    j = Join("r", (JoinOn("l.k", "r.k"),), "Inner", "r")
    join, plain = Plan(read(joins=(j,), select=(Select("l.id", None, "id"),)), tables), Plan(read(select=s("id")), tables)
    gate = Gate(queries=2, joins=1, wait=0.05)
    with gate.open(join) as p:
        assert p.data.count() == 5
        with pytest.raises(Busy):
            gate.open(join).__enter__()
        with gate.open(plain):
            with pytest.raises(Busy):
                gate.open(plain).__enter__()
    with gate.open(join), gate.open(plain):
        pass


def test_any_number_of_keys_may_share_a_prefix(spark):
    tokens = [f"tok_live_000{i:05d}" for i in range(300)]
    df = spark.createDataFrame([(t,) for t in tokens], "token string").select(F.substring("token", 10, 8).cast("long").alias("user_id"), F.substring("token", 1, 12).alias("prefix"), F.sha2("token", 256).alias("key_sha256"))
    assert df.select("prefix").distinct().count() == 1
    assert [api_key_owner(df, tokens[i]) for i in (0, 31, 32, 150, 299)] == [0, 31, 32, 150, 299]


def test_tables_of_users_and_keys_need_an_identity_too(spark):
    c = Catalog(spark)
    c.register("", "users", spark.range(2))
    op = ReadOp("users", select=s("id"), auth=Auth(filter_col="id"))
    with pytest.raises(AccessDenied):
        Plan(op, c).data
    assert rows(Plan(op, c, identity=1).data) == [(0,), (1,)]


def test_keys_are_equal_in_any_unicode_form(spark, tmp_path):
    forms = ["caf\u00e9", "cafe\u0301", "\u03a9", "\u2126", "\ud55c", "\u1112\u1161\u11ab", "n\u0303", "\ufb01", "fi", "K1", "\u212a1", "x"]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(forms)], "id long, k string")
    c = Catalog(spark)
    c.register("", "raw", df, ["k"])
    normalised(df, ["k"]).write.parquet(str(tmp_path / "kept"))
    c.register("", "kept", spark.read.parquet(str(tmp_path / "kept")), ["id"], indexed=["k"], in_nfc=True)
    c.register("", "other", df, ["id"])
    ask = lambda t, op, v, **more: [r[0] for r in rows(Plan(ReadOp(t, select=s("id"), order_by=(OrderBy("id"),), filters=(Filter("k", op, v, **more),)), c).data)]
    for t in ("raw", "kept"):
        for asked, want in (("cafe\u0301", [0, 1]), ("caf\u00e9", [0, 1]), ("\u2126", [2, 3]), ("\u1112\u1161\u11ab", [4, 5]), ("\u00f1", [6]), ("fi", [8]), ("\ufb01", [7]), ("K1", [9, 10]), ("\u212a1", [9, 10]), ("x", [11])):
            assert ask(t, "Eq", asked) == want and ask(t, "In", None, values=(asked, "zz")) == want, (t, asked)
            assert ask(t, "Ne", asked) == ask(t, "NotIn", asked) == [i for i in range(12) if i not in want]
    assert ask("other", "Eq", "cafe\u0301") == [1]
    # a lookup in columns stored in NFC, and one of plain letters in any, is a plain comparison
    for t, v in (("kept", "cafe\u0301"), ("raw", "x")):
        assert "reflect" not in Plan(ReadOp(t, select=s("id"), filters=(Filter("k", "Eq", v),)), c).data._jdf.queryExecution().optimizedPlan().toString()
    j = Join("raw", (JoinOn("a.k", "b.k"),), "Inner", "b")
    pairs = rows(Plan(ReadOp("other", alias="a", joins=(j,), select=(Select("a.id", None, "x"), Select("b.id", None, "y"))), c, options=WHOLE).data)
    assert len(pairs) == 4 * 4 + 4 and (0, 1) in pairs and (10, 9) in pairs


def test_a_page_that_is_enriched_is_cut_once(spark):
    c = Catalog(spark)
    c.register("e", "l", spark.range(1000).selectExpr("id", "id % 10 AS k").repartition(7))
    c.register("e", "r", spark.range(10).selectExpr("id AS k", "id * 2 AS amount"))
    second = ReadOp("r", "", "e", filters=(Filter("k", "In", "$split_ids"),), select=(Select("k"), Select("amount")))
    op = ReadOp("l", "", "e", select=(Select("id"), Select("k")), limit=5, split=SplitEnrichment("k", second, merge_fields=("amount",)))
    got = enrich(op, c).collect()
    assert len(got) == 5 and all(r["amount"] == 2 * r["k"] for r in got)
    assert not Plan(op, c).settled


def test_catalog(spark):
    c = Catalog(spark)
    c.register("E", "T", spark.range(3))
    c.register("E", "t", spark.range(2))
    assert c.table("E", "t").df.count() == 2 and c.table("E", "T").df.count() == 3 and c.entities() == {"E": ["T", "t"]}
    assert c.ensure("new", "x", "a int, b string", ["a"]).df.columns == ["a", "b"] and c.table("NEW", "X").df.count() == 0
    c.register("E", "v", spark.createDataFrame([("b",), ("a",), ("",), (None,), ("a",)], "s string"))
    assert rows(c.field_values("E", "v", "s")) == [("a",), ("b",)]
    for call in (lambda: c.table("E", "none"), lambda: c.table("e", "T"), lambda: c.register("E", "k", spark.range(1), indexed=["zz"]), lambda: c.register("E", "k", spark.range(1), ["zz"])):
        with pytest.raises(SpecError):
            call()


def test_empty_tables_and_nulls_everywhere(spark):
    c = Catalog(spark)
    c.register("", "l", spark.createDataFrame([], "id long, k string, n double"))
    c.register("", "r", spark.createDataFrame([(None, None)], "k string, n double"))
    j = Join("r", (JoinOn("l.k", "r.k"),), "Left", "r", None, "m", "n", "total")
    p = Plan(ReadOp("l", joins=(j,), select=s("l.id", "r.m", "r.total"), aggregations=(Aggregation("Count"), Aggregation("Sum", "n"), Aggregation("Avg", "n"), Aggregation("CountDistinct", "k"), Aggregation("GroupBy", "k"))), c)
    assert rows(p.data) == [] and [a.summary.first()[0] for a in p.aggregations] == [0, 0.0, 0.0, 0, 0]
    nulls = Plan(ReadOp("r", select=s("k", "n"), filter_tree=FilterGroup("And", (Filter("k", "Ne", "x"), Filter("n", "IsNull")))), c)
    assert rows(nulls.data) == [(None, None)]


def test_cache():
    now = [0.0]
    made = []
    cache = ResponseCache(10, 2, {"a", "b"}, lambda: now[0])
    get = lambda op, params, who=None: cache.get(op, params, lambda: made.append(op) or len(made), who)
    assert get("a", {"x": 1, "page": 2}) == get("a", {"page": 2, "x": 1}) == 1
    assert get("c", {}) == 2 and get("c", {}) == 3 and get("a", {"x": 1, "page": 2}, "me") == 4
    now[0] = 11
    assert get("a", {"x": 1, "page": 2}) == 5
    get("b", {"i": 1}), get("b", {"i": 2})
    assert len(cache.entries) == 2 and get("a", {"x": 1, "page": 2}) == 8
