import pytest
from brute import file_no
from pyspark.sql import functions as F

from tidewell.operators import incremental
from tidewell.operators.incremental import IncrementalOutput, VersionedTable
from tidewell.sources import shared

FEED = "entity string, binlog_file string, binlog_pos long, row_no int, gtid string, state string, source int"
STATES = "entity string, run_no long, binlog_file string, binlog_pos long, gtid_executed string, outcome string, pos int"


def found(spark, feed, states, **more):
    feed_, states_ = spark.createDataFrame([(*f, "clash", 0) for f in feed], FEED), spark.createDataFrame([(*s, 0) for s in states], STATES)
    df = incremental.unprocessed(feed_, states_, shared.scratch_path(spark, "t"), **more)
    rows = [tuple(r) for r in df.select("entity", "binlog_file", "binlog_pos", "row_no").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_positions_compare_by_number(spark):
    feed = [("e", f"bin.{n}", p, 0, None) for n in ("99", "100", "0101") for p in (5, 10, 20)] * 2
    states = [("e", 3, "bin.100", 10, "", "committed"), ("e", 4, "bin.101", 99, "", "failed"), ("e", 2, "bin.099", 1, None, "committed"), ("e", 9, "bin.500", 1, None, None), ("e", 3, "bin.100", 10, "", "committed")]
    assert found(spark, feed, states) == {(*f[:4],) for f in feed if (file_no(f[1]), f[2]) > (100, 10)}


def test_gtid_sets_decide_where_both_sides_have_them(spark):
    feed = [("e", "b.1", i, 0, f"AAAA-1:{i}") for i in range(1, 12)] + [("e", "b.1", 50, 0, "bbbb:1"), ("e", "b.1", 51, 0, None), ("e", "b.3", 1, 0, ""), ("e", "b.3", 2, 0, "aaaa-1:4")]
    states = [("e", 1, "b.2", 0, " aaaa-1:1-3:5,\n AAAA-1 : 8-9 ,cccc:1", "committed")]
    want = {("e", "b.1", i, 0) for i in (4, 6, 7, 10, 11)} | {("e", "b.1", 50, 0), ("e", "b.3", 1, 0), ("e", "b.3", 2, 0)}
    assert found(spark, feed, states) == want


def test_no_state_means_everything(spark):
    feed = [("e", "b.1", 1, 0, "a:1"), ("new", "b.1", 1, 0, None), (None, "b.1", 1, 0, None)]
    assert found(spark, feed, [("e", 1, "b.9", 1, "a:1", "crashed"), (None, 1, "b.9", 1, None, "committed")]) == {f[:4] for f in feed}
    assert found(spark, [], []) == set()


def test_whole_files_are_skipped_or_added_by_the_manifest(spark):
    rows = [("f", "e", n, s, p, k) for n, s, p, k in ((1, None, 5, None), (1, None, 9, None), (2, None, 3, None), (2, None, 8, None), (3, None, 1, None), (9, "s", 1, 4), (9, "s", 2, 5), (9, "r", 2, 5))]
    scan = spark.createDataFrame(rows, "_file string, entity string, file_no long, source string, binlog_pos long, number long")
    states = incremental.last_successful(spark.createDataFrame([("e", 1, "b.2", 5, "s:1-9", "committed", 0)], STATES))
    d = incremental.entry_states(incremental.entries(scan), states)
    assert {(r["file_no"], r["source"]): r["state"] for r in d.collect()} == {(1, None): "same", (2, None): "partial", (3, None): "added", (9, "s"): "same", (9, "r"): "added"}
    assert incremental.file_states(d) == {"added": [], "same": [], "partial": ["f"]}


def test_a_run_reads_only_added_and_partial_files(spark):
    feed = [("e", f"b.{n}", p, 0, None) for n in range(1, 9) for p in range(25)]
    states = spark.createDataFrame([("e", 1, "b.6", 11, None, "committed", 0)], STATES)
    table = VersionedTable(spark, shared.scratch_path(spark, "t") + "/feed")
    old, new = incremental.import_feed(table, spark.createDataFrame([(*f, "clash", 0) for f in feed], FEED).coalesce(1), states, records_per_file=25)
    a, b = table.manifest(old), table.manifest(new)
    assert len(b["files"]) >= 8 and {*a["files"]} < {*b["files"]} and len(a["vectors"]) == 1 and not b["vectors"]
    assert table.read(old).count() == 5 * 25 + 12 and table.read(new).count() == 200
    delta = table.changes(old, new)
    assert delta.count() == 63
    # the files of processed changes alone are in no scan of the difference
    rest = {f for f in a["files"] if table.scan([f]).filter("file_no < 6 OR file_no = 6 AND binlog_pos <= 11").count() == table.scan([f]).count()}
    assert len(rest) >= 4 and not any(f.split("/")[-1] in x for f in rest for x in delta.inputFiles())


def test_a_failure_between_runs_loses_and_repeats_nothing(spark):
    feed = [("e", f"b.{n}", p, r, None) for n in (1, 2, 3) for p in range(9) for r in (0, 1)] * 2 + [("n", "b.1", 1, 0, "s:1")]
    states = [("e", 1, "b.2", 4, None, "committed")]
    want = {f[:4] for f in feed if f[0] == "n" or (file_no(f[1]), f[2]) > (2, 4)}
    for failures in (0, 1, 3):
        assert found(spark, feed, states, failures=failures, records_per_file=10) == want


def rows_of(df):
    return sorted((r["id"], r["_change"]) for r in df.select("id", "_change").collect())


def test_versions_differ_by_files_and_vectors(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    assert t.append(spark.range(10)) == 0
    assert t.append(spark.range(10, 15)) == 1
    assert t.delete(F.col("id").isin(3, 12)) == 2
    assert t.delete(F.col("id") == 4) == 3
    assert sorted(r[0] for r in t.read().collect()) == [x for x in range(15) if x not in (3, 4, 12)]
    assert t.read(1).count() == 15
    assert rows_of(t.changes(-1, 3)) == [(x, "insert") for x in range(15) if x not in (3, 4, 12)]
    assert rows_of(t.changes(0, 1)) == [(x, "insert") for x in range(10, 15)]
    assert rows_of(t.changes(1, 3)) == [(3, "delete"), (4, "delete"), (12, "delete")]
    assert rows_of(t.changes(3, 2)) == [(4, "insert")]
    assert rows_of(t.changes(0, 2)) == [(3, "delete")] + [(x, "insert") for x in (10, 11, 13, 14)]
    assert rows_of(t.changes(3, 3)) == []
    assert t.compact() == 4 and t.read().count() == 12


def test_a_failed_run_is_repeated_and_a_committed_one_is_not(spark, tmp_path):
    t, out = VersionedTable(spark, str(tmp_path / "t")), IncrementalOutput(spark, str(tmp_path / "o"))
    t.append(spark.range(5))
    assert out.run(t, lambda d: d) and not out.run(t, lambda d: d)
    t.append(spark.range(5, 8))

    def dies(d):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        out.run(t, dies)
    # dies between the write and the commit
    real = incremental.shared.write_json
    try:
        incremental.shared.write_json = lambda *a: dies(None)
        with pytest.raises(RuntimeError):
            out.run(t, lambda d: d)
    finally:
        incremental.shared.write_json = real
    assert out.processed() == 0 and out.run(t, lambda d: d) and out.processed() == 1
    assert sorted(r["id"] for r in out.read().collect()) == list(range(8))


def test_two_writers_on_one_version_conflict(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"))
    t.append(spark.range(2))
    t.commit(0, t.manifest(0)["files"], [])
    with pytest.raises(FileExistsError):
        t.commit(0, [], [])


def test_ranges_merge_into_the_fewest(spark):
    rows = [("a", 1, 3), ("a", 4, 4), ("a", 8, 9), ("a", 2, 2), ("a", 20, 10), ("b", 1, 1), ("a", 9, 12), ("a", 1, 3), (None, 5, 6)]
    out = incremental.merged_ranges(spark.createDataFrame(rows, "source string, lo long, hi long"), ["source"])
    assert {tuple(r) for r in out.collect()} == {("a", 1, 4), ("a", 8, 12), ("b", 1, 1), (None, 5, 6)}
