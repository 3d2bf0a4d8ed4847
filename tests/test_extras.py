import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_changelog import change, feed_of, found

from tidewell.catalog import Catalog
from tidewell.errors import MissingParams, SpecError
from tidewell.functions import gtid
from tidewell.operators.changelog import apply_feed
from tidewell.operators.maintenance import count_drift
from tidewell.plans.adhoc import search
from tidewell.plans.shaping import number_text
from tidewell.spec import Aggregation, DeleteOp, Filter, OrderBy, UpdateOp
from tidewell.sources import shared
from tidewell.streaming.replica import Replica, StaleTable
from tidewell.streaming.subscriptions import retained
from tidewell.streaming.writes import write_changes

NUMBERS = st.dictionaries(st.sampled_from(["a", "b"]), st.sets(st.integers(1, 40), min_size=1))


def as_text(sets):
    return ", ".join(f"{s.upper()}:" + ":".join(str(n) for n in sorted(ns, key=lambda x: -x)) for s, ns in sets.items())


@given(NUMBERS, NUMBERS)
def test_gtid_sets_are_sets(a, b):
    u = gtid.union(as_text(a), as_text(b))
    members = {(s, n) for s, r in gtid.parse(u).items() for lo, hi in r for n in range(lo, hi + 1)}
    assert members == {(s, n) for x in (a, b) for s, ns in x.items() for n in ns}
    assert gtid.union(u, u) == u and all(gtid.contains(u, f"{s.upper()}:{n}") for s, n in members) and not gtid.contains(u, "a:99")


def test_gtid_edges():
    assert gtid.union(None, "") == "" and gtid.parse(" A:1-3 :5,\n a:4, b:x, c") == {"a": [(1, 5)]} and gtid.add("a:1-2", "A:3") == "a:1-3" and gtid.parse("a:5-3") == {}


def test_searches(spark):
    c = Catalog(spark)
    c.register("e", "t", spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "id int, s string"), ["id"])
    p = search(c, "e", "T", [Filter("s", "Eq", "x")], ["id"], [OrderBy("id", "Desc")], limit=1, page=2, aggregations=[Aggregation("Count")])
    assert [r[0] for r in p.data.collect()] == [1] and p.aggregations[0].summary.first()[0] == 2
    assert search(c, "e", "t", limit=0).data is None and search(c, "e", "t").limit == 100
    with pytest.raises(SpecError):
        search(c, "e", "t", [Filter("s", "Contains", "x")])


def test_saved_writes_become_changes(spark):
    c = Catalog(spark)
    c.register("e", "t", spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "b", "y")], "id int, s string, v string"), ["id"])
    feed = feed_of(spark, [change(i, "INSERT", str(i), {"s": s, "v": v}) for i, s, v in ((1, "a", "x"), (2, "b", "x"), (3, "b", "y"))])
    up = write_changes(UpdateOp("u", "e", "t", (Filter("s", "Eq", "$s"),), ("v",)), c, {"s": "b"}, ("bin.10", 1), {"v": None})
    down = write_changes(DeleteOp("d", "e", "t", (Filter("id", "Eq", "1"),)), c, {}, ("bin.10", 2))
    every = feed.unionByName(up, True).unionByName(down, True)
    assert {r[2] for r in found(apply_feed(every))} == {"2", "3"}
    assert {tuple(x for x in r["cells"] if x["col"] == "v")[0]["value"] for r in apply_feed(every).collect()} == {None}
    for op, params, payload in ((UpdateOp("u", "e", "t", (Filter("id"),), ("v",)), {}, {"s": "no"}), (UpdateOp("u", "e", "t", (Filter("id"),), ("v",)), {}, {}), (UpdateOp("u", "e", "t", (Filter("id"),), ("id",)), {}, {"id": 1}), (DeleteOp("d", "e", "t"), {}, None)):
        with pytest.raises(SpecError):
            write_changes(op, c, params, ("bin.1", 1), payload)
    with pytest.raises(MissingParams):
        write_changes(DeleteOp("d", "e", "t", (Filter("id", "Eq", "$x"),)), c, {}, ("bin.1", 1))


def test_truncate_empties_a_table_up_to_its_place(spark, tmp_path):
    r = Replica(spark, str(tmp_path / "r"), 2)
    r.take(feed_of(spark, [change(1, "INSERT", "1", {"a": "x"}), change(2, "INSERT", "1", {"a": "x"}, tbl="other"), change(5, "INSERT", "2", {"a": "y"}), change(6, "UPDATE", "1", {"a": "z"})]), 0)
    r.take(feed_of(spark, [change(4, "TRUNCATE", None)]), 1)
    assert {x[1:3] for x in found(r.rows())} == {("t", "2"), ("other", "1")}
    assert spark.read.parquet(f"{r.path}/rejects").count() == 0


def test_definitions_that_change_need_a_new_snapshot(spark, tmp_path):
    r = Replica(spark, str(tmp_path / "r"), 2)
    r.take(feed_of(spark, [change(1, "INSERT", "1", {"a": "x"}), change(2, "INSERT", "9", {"a": "x"}, tbl="other"), change(3, "alter ", None)]), 0)
    assert r.stale() == [("e", "t")] and spark.read.parquet(f"{r.path}/rejects").count() == 0
    with pytest.raises(StaleTable):
        r.table("e", "t", {"a": "string"}, {"id": "bigint"})
    assert r.table("e", "other", {"a": "string"}, {"id": "bigint"}).count() == 1
    # the snapshot stands for all that came before it, and a change that was under way behind it still wins
    r.resync(spark.createDataFrame([(1, 5), (2, 6)], "id long, b long"), "e", "t", ["id"], "binlog.000009", 10, 1)
    r.take(feed_of(spark, [change(4, "UPDATE", "1", {"b": "7"}, pos=11), change(5, "UPDATE", "2", {"b": "8"}, pos=9)]), 2)
    assert r.stale() == [] and {tuple(x) for x in r.table("e", "t", {"b": "bigint", "a": "string"}, {"id": "bigint"}).collect()} == {(1, 7, None), (2, 6, None)}
    r.take(feed_of(spark, [change(6, "DROP", None, pos=12)]), 3)
    assert r.stale() == [("e", "t")] and {x[1] for x in found(r.rows())} == {"other"}


def test_one_table_is_reset_and_others_are_repaired(spark, tmp_path):
    r = Replica(spark, str(tmp_path / "r"), 2)
    r.take(feed_of(spark, [change(i, "INSERT", str(i), {"a": "x"}, tbl=t) for i in range(3) for t in ("t", "u", "v")]), 0)
    r.reset_table("e", "t", 1)
    assert {x[1] for x in found(r.rows())} == {"u", "v"}
    source = {"e.t": spark.range(20).selectExpr("id", "'y' AS a"), "e.u": spark.range(3).selectExpr("id", "'x' AS a"), "e.v": spark.range(4).selectExpr("id", "'z' AS a")}
    mirror = {f"e.{t}": r.rows().filter(f"tbl = '{t}'") for t in "tuv"}
    drift = count_drift(source, mirror)
    assert r.repair(drift, {n: (d, ["id"]) for n, d in source.items()}, "binlog.000010", 0, 2, most=0) == ["e.t", "e.v"]
    assert {t: r.rows().filter(f"tbl = '{t}'").count() for t in "tuv"} == {"t": 20, "u": 3, "v": 4}


def test_batches_fold_into_one_state(spark, tmp_path):
    r = Replica(spark, str(tmp_path / "r"), 1)
    for i in range(5):
        r.take(feed_of(spark, [change(i, "TRUNCATE" if i == 1 else "INSERT", None if i == 1 else str(i), {"a": "x"})]), i)
        if i == 3:
            before = (r.position(), found(r.rows()))
            r._fold(2)
            assert not shared.listing(spark, f"{r.path}/batches") and (r.position(), found(r.rows())) == before
    assert r.position() == (9, 4) and {x[2] for x in found(r.rows())} == {"2", "3", "4"}
    r.take(feed_of(spark, [change(9, "INSERT", "9", {"a": "x"})]), 2)
    assert r.position() == (9, 4)


def test_hours_are_kept_for_two_days(spark):
    df = spark.sql("SELECT timestamp_ntz'2024-01-03 10:00:00' - make_interval(0, 0, 0, 0, id) AS bucket FROM range(60)")
    assert retained(df, F.lit("2024-01-03 10:40:00").cast("timestamp")).count() == 49


def test_number_texts(spark):
    df = spark.createDataFrame([(5.0,), (1.5,), (0.3333333333,), (-0.0,), (None,), (1e20,)], "n double")
    assert [r[0] for r in df.select(number_text(F.col("n"))).collect()] == ["5", "1.5", "0.333333", "0", None, "100000000000000000000"]
    assert [r[0] for r in df.limit(3).select(number_text(F.col("n"), 2, False)).collect()] == ["5", "1.50", "0.33"]
