import json

import pyarrow as pa
from brute import dicts, spec_entries

from tidewell.operators import operations, shredding
from tidewell.operators.shredding import Places, entities, newest_first, shred, shred_entries

OPS = "op_id long, origin string, spec_version int, spec string, node int, label string"


def ops(spark, specs):
    return spark.createDataFrame([(i, "o", v, s if s is None or isinstance(s, str) else json.dumps(s), 0, "clash") for i, v, s in specs], OPS)


def found(df):
    rows = [tuple(r) for r in operations.found(df).select("op_id", "node_path", "node_value").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SPEC = {"joins": [{"alias": "a", "on": [{"left": "x.y"}, None, {"left": None}], "filters": {"field": "f"}}, None, "bare", {"alias": None, "on": {"left": "q"}}],
        "filters": [None, {"field": "g"}, {"op": "Eq"}], "select": ["s", {"field": "t", "as": "u"}, {"expression": {"args": [{"field": "no"}]}}, 5],
        "filter_tree": {"op": "And", "children": [{"field": "l1"}, {"op": "Or", "children": [{"field": None}, "text", None]}, {"op": "Or", "children": {"field": "only"}}]}}


def test_every_place(spark):
    specs = [(1, 1, {"type": "read", "details": SPEC}), (2, 1, {"details": json.dumps(SPEC)}), (3, 1, {"type": "read", **SPEC}), (4, 1, {"details": {"joins": {"alias": "one", "on": [{"left": "z"}]}, "select": "s", "filter_tree": {"field": "root"}}})]
    df = ops(spark, specs)
    want = spec_entries(dicts(df))
    assert (4, "joins[0].on[0]", "z") in want and (1, "filter_tree.children[2].children[0]", "only") in want and (1, "joins[0].filters[0]", "f") in want
    assert found(df) == want


def test_versions_and_broken_specs(spark):
    good = {"details": {"select": [{"field": "new"}]}}
    df = ops(spark, [(1, 1, {"details": {"select": ["old"]}}), (1, 2, good), (1, 2, good), (1, 3, '{"details": {"sel'), (2, 1, None), (2, 2, ""), (3, 1, '{"details": NaN}'), (3, 2, "[1, 2]"), (4, 1, "null"), (5, 1, '{"details": "no json"}'), (6, 1, '{"details": null, "select": ["x"]}')])
    assert found(df) == {(1, "select[0]", "new"), (6, "select[0]", "x")}


def test_nodes_keep_parents_and_scalars(spark):
    df = spark.createDataFrame([(7, '{"a": [1, {"b": null, "a.b": "\\ud800x"}], "t": true}')], "id long, j string")
    rows = {r["path"]: r for r in shred(df, "id", "j").collect()}
    assert rows["a[1].b"]["kind"] == "null" and rows["a[0]"]["scalar"] == "1" and rows["t"]["scalar"] == "true" and rows["a[1].a.b"]["scalar"] == "?x"
    assert rows["a[1].b"]["parent"] == rows["a[1]"]["node"] and rows["a[1]"]["ordinal"] == 1 and rows[""]["parent"] is None
    assert sorted(r["node"] for r in rows.values()) == list(range(len(rows)))


def test_entities_pivot_scalar_children(spark):
    df = spark.createDataFrame([(1, '{"xs": [{"p": "1", "q": {"p": "no"}}, {"q": 2}], "ys": {"p": 3, "q": []}}')], "id long, j string")
    places = Places(lambda s: s in ("xs", "ys"), lambda s: s if s in ("xs[]", "ys[]") else None, frozenset("pq"), frozenset("q"))
    out = entities(shred_entries(df, "id", "j", places), ["p", "q"], ["q"])
    assert {(r["what"], r["path"], r["v_p"], r["v_q"], r["has_q"]) for r in out.collect()} == {("xs[]", "xs[0]", "1", None, True), ("xs[]", "xs[1]", None, "2", True), ("ys[]", "ys[0]", "3", None, None)}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    # entries and children are nodes of the whole table under the same numbers
    every = {(r["node"], r["parent"], r["label"], r["kind"]) for r in shred(df, "id", "j").collect()}
    assert {(r["node"], r["parent"], r["label"], r["kind"]) for r in shred_entries(df, "id", "j", places).collect()} <= every


def test_each_document_is_parsed_once(spark):
    df = ops(spark, [(1, v, {"select": [str(v)]}) for v in range(50)] + [(1, 60, "{"), (1, 61, None), (None, 1, {"select": ["n"]}), (None, 0, {"select": ["o"]})])
    texts = [[x["_doc"], x["_text"]] for x in newest_first(df, "op_id", "spec_version", "spec").collect()]
    seen = []
    batch = pa.RecordBatch.from_arrays([pa.array([t[0] for t in texts], pa.int64()), pa.array([t[1] for t in texts])], names=["d", "t"])
    real = shredding._load
    try:
        shredding._load = lambda t: seen.append(t) or real(t)
        assert {d: r["select"] for d, r in shredding._roots(iter([batch]), None, True)} == {1: ["49"], None: ["n"]}
    finally:
        shredding._load = real
    assert len(seen) == 3
    assert found(df) == {(1, "select[0]", "49"), (None, "select[0]", "n")}


def test_depth_beyond_the_parser_is_broken_not_a_crash(spark):
    deep = '{"details": ' + "[" * 200_000 + "]" * 200_000 + "}"
    df = ops(spark, [(1, 1, deep), (2, 1, {"select": ["x"]})])
    assert found(df) == {(2, "select[0]", "x")}


def test_empty_table_and_flat_tables(spark):
    assert found(ops(spark, [])) == set()
    t = operations.flat_tables(ops(spark, [(1, 1, {"details": SPEC})]))
    on = {(r["entry_path"], r["parent_path"], r["left"]) for r in t["join_on"].collect()}
    assert ("joins[0].on[0]", "joins[0]", "x.y") in on and ("joins[3].on[0]", "joins[3]", "q") in on
    assert {r["alias"] for r in t["joins"].collect()} == {"a", "bare", None}
    assert ("filter_tree.children[1].children[0]", "filter_tree.children[1]") in {(r["entry_path"], r["parent_path"]) for r in t["tree_conditions"].collect()}


def test_sf_specs_match_the_model(spark, small):
    df = spark.read.parquet(f"{small}/saved_ops.parquet")
    assert found(df) == spec_entries(dicts(df))
