import datetime
import json
from decimal import Decimal

from brute import dicts, drift

from tidewell.operators import schema_drift

MANIFEST = "entity string, tbl string, manifest_version int, original_fields array<string>, field_types array<string>, primary_key string, primary_key_columns array<string>, captured_at timestamp, gone int, role string"
ROWS = "entity string, tbl string, schema_version int, rec_key string, row_json string, target int, wanted int"


def manifest(version, fields, types=None, key="id", keys=("id",)):
    return ("e", "t", version, fields, types or ["int"] * len(fields or []), key, None if keys is None else list(keys), datetime.datetime(2024, 1, version), 0, "clash")


def report(spark, manifests, rows):
    df = schema_drift.report(spark.createDataFrame(manifests, MANIFEST), spark.createDataFrame([("e", "t", v, k, json.dumps(d), 0, 0) for v, k, d in rows], ROWS))
    out = [(r["manifest_version"], r["field_name"], r["change_kind"]) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def test_every_kind_of_change(spark):
    m = [manifest(1, ["id", "a", "B", "c"], ["bigint(20)", "int", "varchar(60)", "int"]), manifest(1, ["id", "a", "B", "c"], ["bigint(20)", "int", "varchar(60)", "int"]), manifest(2, None), manifest(3, []),
         manifest(4, ["b", "ID", "d", "e"], ["VARCHAR(255)", "bigint", "int", "int"]), manifest(9, ["ID", "d", "E"], ["bigint", "text", "int(11)"], "id", None), manifest(10, ["id", "d", "e"], ["bigint", "text", "int"], "id", ("id", "d"))]
    rows = [(1, "x", {"id": 1, "a": 5, "b": "q"}), (4, "x", {"id": 1, "D": 5, "e": 8}), (1, "y", {"a": None}), (4, "y", {"d": None, "e": 2}), (1, "z", {"a": 3}), (4, "w", {"d": 4})]
    assert report(spark, m, rows) == {(4, "d", "renamed"), (4, "c", "removed"), (4, "e", "added"), (9, "b", "removed"), (9, "d", "retyped"), (10, "", "key_changed")}


def test_renames_need_shared_and_filled_values(spark):
    m = [manifest(1, ["id", "a"]), manifest(2, ["id", "b"])]
    assert report(spark, m, [(1, "x", {"a": 1}), (2, "y", {"b": 1})]) == {(2, "a", "removed"), (2, "b", "added")}
    assert report(spark, m, [(1, "x", {"a": None}), (2, "x", {})]) == {(2, "a", "removed"), (2, "b", "added")}
    assert report(spark, m, [(1, "x", {"a": 1}), (2, "x", {"b": 2})]) == {(2, "a", "removed"), (2, "b", "added")}
    assert report(spark, m, [(1, "x", {"a": 1}), (1, "x", {"a": 1}), (2, "x", {"b": 1})]) == {(2, "b", "renamed")}
    assert report(spark, m, []) == {(2, "a", "removed"), (2, "b", "added")}
    assert report(spark, [], []) == set()


def test_ingest_enforces_rescues_and_promotes(spark):
    rows = [(1, '{"ID": "7", "price": "1.50", "extra": {"x": [1]}, "note": "n", "when": "2024-01-02"}'), (2, '{"id": "seven", "price": null, "Old": "2"}'), (3, "broken {"), (4, None), (5, "{}"), (6, '{"id": 1, "id": 2, "extra": 1, "extra": 5}')]
    df = spark.createDataFrame(rows, "Price int, j string")
    out = schema_drift.ingest(df, "j", {"id": "bigint", "price": "decimal(10,2)"}, {"old": "new"})
    got = {r["_in_Price"]: r for r in out.collect()}
    assert got[1]["id"] == 7 and got[1]["price"] == Decimal("1.50") and json.loads(got[1]["_rescued"]) == {"extra": '{"x":[1]}', "note": "n", "when": "2024-01-02"}
    assert got[2]["id"] is None and json.loads(got[2]["_rescued"]) == {"id": "seven", "new": "2"}
    assert got[3]["_broken"] == "broken {" and got[4]["_rescued"] is None and got[5]["_rescued"] is None and got[5]["_broken"] is None
    assert got[6]["id"] == 2 and json.loads(got[6]["_rescued"]) == {"extra": "5"}
    done = {r["_in_Price"]: r for r in schema_drift.promote(out, {"new": "int", "note": "bigint", "when": "date"}).collect()}
    assert done[2]["new"] == 2 and json.loads(done[2]["_rescued"]) == {"id": "seven"}
    assert done[1]["when"] == datetime.date(2024, 1, 2) and done[1]["note"] is None and "note" in json.loads(done[1]["_rescued"])
    odd = schema_drift.ingest(spark.createDataFrame([("x", "y", '{"id": 1}')], "_entries string, _rescued string, j string"), "j", {"id": "int"})
    assert odd.columns == ["_in__entries", "_in__rescued", "id", "_rescued", "_broken"] and tuple(odd.first()) == ("x", "y", 1, None, None)
    assert schema_drift.ingest(df.limit(0), "j", {"id": "bigint"}).count() == 0


def test_evidence_is_linear_in_the_fields_and_groups_equal_ones(spark):
    m = [manifest(1, ["id", "a", "b", "c"]), manifest(2, ["id", "x", "y", "z"])]
    rows = [(v, k, {f: n for f in fields}) for n, k in enumerate("pqr") for v, fields in ((1, "abc"), (2, "xyz"))]
    # all six fields hold the same values: each new field is one case renamed, no gone one is removed
    assert report(spark, m, rows) == {(2, f, "renamed") for f in "xyz"}
    v = schema_drift.versions(spark.createDataFrame(m, MANIFEST))
    plan = schema_drift._renamed(v.filter("prev_manifest_version IS NOT NULL"), spark.createDataFrame([], ROWS))._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "Join Cross" not in plan


def consistent(spark, manifests, rows):
    df = schema_drift.consistent(spark.createDataFrame(manifests, MANIFEST), spark.createDataFrame([("e", "t", v, k, d if d is None or isinstance(d, str) else json.dumps(d), 0, 0) for v, k, d in rows], ROWS))
    return {(r["schema_version"], r["rec_key"]): ({c["name"]: next((c[k] for k in ("number", "at", "flag", "text") if c[k] is not None)) for c in r["cells"]}, r["_rescued"], r["_broken"]) for r in df.collect()}


def test_records_of_all_versions_come_under_the_newest_columns(spark):
    m = [manifest(1, ["id", "a", "old"], ["bigint", "int", "varchar(9)"]), manifest(2, ["id", "b", "old"], ["bigint", "int", "text"]), manifest(4, ["ID", "c", "when", "ok"], ["bigint", "decimal(9,2)", "datetime", "bit"]), manifest(5, None)]
    rows = [(1, "x", {"id": 1, "A": 5, "old": "k"}), (2, "x", {"id": 1, "b": 5, "old": "k"}), (4, "x", {"id": 1, "c": 5, "when": "2024-01-02 03:04:05", "ok": "1"}), (4, "y", {"id": "one", "c": "1.50", "when": 2699283, "ok": "maybe", "more": {"n": [1]}, "gone": None}), (1, "z", "{"), (1, "n", None), (9, "w", {"b": 7, "ok": True, "OK": False})]
    got = consistent(spark, m, rows + rows[:2])
    # a became b, and b became c: values of every version stand under c; what was removed is rescued
    assert got[1, "x"] == ({"id": 1.0, "c": 5.0}, {"old": "k"}, None) == got[2, "x"]
    assert got[4, "x"] == ({"id": 1.0, "c": 5.0, "when": datetime.datetime(2024, 1, 2, 3, 4, 5), "ok": True}, None, None)
    assert got[4, "y"] == ({"c": 1.5}, {"id": "one", "when": "2699283", "ok": "maybe", "more": '{"n":[1]}'}, None)
    assert got[1, "z"] == ({}, None, "{") and got[1, "n"] == ({}, None, None)
    # a version after all renames keeps its names, and of a name given twice the last value counts
    assert got[9, "w"] == ({"ok": False}, {"b": "7"}, None)


def test_rescued_values_are_replayed_when_a_newer_manifest_approves_their_field(spark):
    m, rows = [manifest(1, ["id", "n"])], [(1, "x", {"id": 1, "n": "1.5", "extra": "e"})]
    assert consistent(spark, m, rows)[1, "x"] == ({"id": 1.0}, {"n": "1.5", "extra": "e"}, None)
    assert consistent(spark, [*m, manifest(2, ["id", "n", "extra"], ["int", "double", "text"])], rows)[1, "x"] == ({"id": 1.0, "n": 1.5, "extra": "e"}, None, None)
    assert consistent(spark, [], rows)[1, "x"] == ({}, {"id": "1", "n": "1.5", "extra": "e"}, None) and consistent(spark, m, []) == {}


def test_sf_tables_match_the_model(spark, small):
    m, r = spark.read.parquet(f"{small}/manifests.parquet"), spark.read.parquet(f"{small}/segment_rows.parquet")
    got = [tuple(x) for x in schema_drift.report(m, r).select("entity", "tbl", "manifest_version", "field_name", "change_kind").collect()]
    assert len(got) == len(set(got)) and set(got) == drift(dicts(m), dicts(r))
