import random

from brute import current_rows, dicts
from pyspark.sql import functions as F

from tidewell.operators import changelog
from tidewell.sources import shared
from tidewell.sources.readers import CHANGE_SCHEMA

COLUMNS = [f.name for f in CHANGE_SCHEMA]


def feed_of(spark, changes):
    return spark.createDataFrame([tuple(c.get(n) for n in COLUMNS) for c in changes], CHANGE_SCHEMA)


def change(i, op, pk, values=None, before=None, file="binlog.000009", pos=None, row_no=0, entity="e", tbl="t"):
    return {
        "delivery_id": i, "entity": entity, "tbl": tbl, "op_type": op, "pk": pk, "pk_before": before, "row_columns": None if values is None else [*values], "row_values": None if values is None else [*values.values()],
        "binlog_file": file, "binlog_pos": i if pos is None else pos, "row_no": row_no,
    }


def found(df):
    rows = [tuple(r) for r in df.select(*changelog.KEY, changelog.row_md5(F.col("cells")).alias("m")).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def random_changes(n, seed):
    r = random.Random(seed)
    keys = ["1", "2", "1\x1f2", "caf\u00e9", "cafe\u0301", "k"]
    out = []
    for i in range(n):
        values = {c: r.choice([None, "", "a", "b=|", "ñ"]) for c in r.sample(["a", "B", "c", "é"], r.randint(0, 4))}
        op = r.choice(["INSERT", "update", "UPDATE ", " Delete", "UPDATE", "noop", None])
        pk = r.choice([*keys, *keys, None, " \t"])
        out.append(change(i, op, pk, None if op == " Delete" and r.random() < 0.5 else values, r.choice([None, "", *keys]) if op and "U" in op.upper() else None, f"bin.{r.choice(['99', '100', '0101'])}", r.randint(0, 20), r.randint(0, 2), r.choice(["e", "f"])))
    once = {(c["entity"], int(c["binlog_file"][4:]), c["binlog_pos"], c["row_no"]): c for c in out}
    out = [*once.values()]
    out += [{**c, "delivery_id": 1000 + i} for i, c in enumerate(r.sample(out, len(out) // 3))]
    r.shuffle(out)
    return out


def test_random_feeds_match_the_model_with_any_runs_and_after_compaction(spark):
    changes = random_changes(400, 5)
    want = current_rows(changes)
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 3)
    store.append(feed_of(spark, changes[:250]), 3, "delivery_id")
    store.append(feed_of(spark, changes[200:]))
    assert store.runs() == [0, 1, 2, 3]
    assert found(store.read()) == want
    assert store.compact() == 4 and store.runs() == [4]
    assert found(store.read()) == want
    # what is delivered again, even after compaction, changes nothing
    store.append(feed_of(spark, changes[:100]))
    assert found(store.read()) == want
    again = changelog.ChangeStore(spark, store.path)
    assert again.buckets == 3 and found(again.read()) == want
    assert not store.compact_if_needed(8) and store.compact_if_needed(1)
    assert found(store.read()) == want


def test_late_delete_and_partial_update_and_explicit_null(spark):
    changes = [change(1, "INSERT", "1", {"a": "x", "b": "y"}), change(3, "UPDATE", "1", {"a": None}), change(2, "UPDATE", "1", {"a": "z", "c": "w"}), change(5, "UPDATE", "2", {"a": "none"}), change(6, "INSERT", "3", {}), change(8, "UPDATE", "4", {"v": "1"}, before="3")]
    assert found(changelog.apply_feed(feed_of(spark, changes))) == current_rows(changes)
    late = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 2)
    late.append(feed_of(spark, [change(9, "DELETE", "1"), *changes]))
    late.compact(drop_tombstones=True)
    assert {r[2] for r in found(late.read())} == {"4"}


def test_empty_feed_and_extra_columns(spark):
    empty = feed_of(spark, [])
    assert changelog.apply_feed(empty).count() == 0
    wide = feed_of(spark, [change(1, "INSERT", "1", {"a": "x"})]).selectExpr("*", "1 AS run", "2 AS bucket", "'z' AS value", "0 AS col", "3 AS seq")
    assert len(found(changelog.apply_feed(wide))) == 1


def test_merge_on_read_needs_no_shuffle(spark):
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 3)
    store.append(feed_of(spark, random_changes(50, 1)), 2, "delivery_id")
    plan = store.read()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Bucketed: true" in plan
    # one sort merges the runs; neither the fold of columns nor that of keys sorts again
    assert plan.count("Sort [") == 1 and plan.count("SortAggregate(") + plan.count("ObjectHashAggregate(") >= 2


def test_runs_are_even_whatever_the_numbers_of_their_arrivals(spark):
    changes = [change(i, "INSERT", str(i), {"a": "x"}) for i in range(1000)] + [change(10**15, "INSERT", "last", {"a": "x"})] + [{**change(0, "INSERT", f"n{i}", {"a": "x"}, row_no=i + 1), "delivery_id": None} for i in range(100)]
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 2)
    store.append(feed_of(spark, changes), 4, "delivery_id")
    sizes = {r["run"]: r["count"] for r in spark.table(store.name).filter("col IS NULL").groupBy("run").count().collect()}
    assert sorted(sizes) == store.runs() == [0, 1, 2, 3] and sum(sizes.values()) == 1101 and max(sizes.values()) < 320
    assert found(store.read()) == current_rows([{**c, "delivery_id": 0} for c in changes])


def test_runs_are_written_in_the_order_they_are_read_in(spark):
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 2)
    store.append(feed_of(spark, random_changes(400, 9)), 2, "delivery_id")
    store.append(feed_of(spark, random_changes(90, 2)))
    for compacted in (False, True):
        if compacted:
            store.compact()
        for f in spark.table(store.name).inputFiles():
            rows = [(r[changelog.HASH], r["entity"], r["tbl"], r["pk"].encode(), (r["col"] is not None, (r["col"] or "").encode())) for r in spark.read.parquet(f).collect()]
            assert rows == sorted(rows)


def test_a_hot_key_is_folded(spark):
    changes = [change(i, "UPDATE", "hot", {"a": str(i)}) for i in range(300)] + [change(0, "INSERT", "hot", {"a": "0", "b": "1"}, pos=-1)]
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 2)
    store.append(feed_of(spark, changes), 2, "delivery_id")
    assert spark.table(store.name).count() <= 2 * 3
    assert found(store.read()) == current_rows(changes)


def test_sf_feed_matches_the_model(spark, small):
    feed = spark.read.parquet(f"{small}/update_events.parquet")
    assert found(changelog.apply_feed(feed)) == current_rows(dicts(feed))


def test_an_append_that_dies_before_its_commit_leaves_no_trace(spark, monkeypatch):
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 2)
    store.append(feed_of(spark, [change(1, "INSERT", "1", {"a": "x"})]))

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", dies)
        for call in (lambda: store.append(feed_of(spark, [change(2, "INSERT", "2", {"a": "y"})])), store.compact):
            try:
                call()
            except RuntimeError:
                pass
    assert {r[2] for r in found(store.read())} == {"1"}
    assert store.append(feed_of(spark, [change(3, "INSERT", "3", {"a": "z"})])) == [3]
    assert {r[2] for r in found(store.read())} == {"1", "3"} == {r[2] for r in found(changelog.ChangeStore(spark, store.path).read())}
    assert store.vacuum() == [1, 2] and store.compact() == 4 and store.vacuum() == [0, 3]
    assert {r[2] for r in found(store.read())} == {"1", "3"}


def test_an_append_shuffles_once(spark, monkeypatch):
    store = changelog.ChangeStore(spark, shared.scratch_path(spark, "t"), 3)
    seen = []
    write = store._write
    monkeypatch.setattr(store, "_write", lambda df: seen.append(df) or write(df))
    store.append(feed_of(spark, random_changes(50, 1)), 2, "delivery_id")
    assert seen[0]._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
