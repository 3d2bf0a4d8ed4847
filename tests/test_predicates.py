import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewell.errors import SpecError
from tidewell.functions import predicates
from tidewell.functions.dates import derived_columns
from tidewell.spec import SIMPLE_OPS, Filter, FilterGroup, tree_from


def ids(df, f):
    kind = df.schema[f.field].dataType
    return {r["id"] for r in df.filter(predicates.predicate(F.col(f.field), kind, f)).collect()}


@pytest.fixture(scope="module")
def blanks(spark):
    return spark.createDataFrame([(1, None, None), (2, "", 0.0), (3, "  ", -5.0), (4, "x", 3.0)], "id long, s string, n double")


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(["5", "5.0", "abc", "2024-01-02", "2024-1-2", "", None, "100%", "a_b", "ÁRBOL", "-7"])), "id long, v string")


def test_nulls_and_blanks(blanks):
    assert ids(blanks, Filter("s", "IsNull")) == {1, 2, 3} and ids(blanks, Filter("s", "IsNotNull")) == {4}
    assert ids(blanks, Filter("n", "IsNull")) == {1}
    assert ids(blanks, Filter("s", "Ne", "x")) == {1, 2, 3} and ids(blanks, Filter("n", "Ne", "3")) == {1, 2, 3}
    assert ids(blanks, Filter("n", "NotIn", "3;0")) == {1, 3} and ids(blanks, Filter("n", "NotIn", "")) == {1, 2, 3, 4}
    assert ids(blanks, Filter("n", "In", " , ")) == set() and ids(blanks, Filter("n", "Lt", "1")) == {2, 3}
    assert ids(blanks, Filter("n", "Between", "-5", "0")) == {2, 3} and ids(blanks, Filter("n", "Between", "0")) == set()


def test_incomparable_values(blanks):
    assert ids(blanks, Filter("n", "Eq", "abc")) == set() and ids(blanks, Filter("n", "Ne", "abc")) == {1, 2, 3, 4}
    assert ids(blanks, Filter("n", "In", "abc,3")) == {4} and ids(blanks, Filter("n", "NotIn", "abc")) == {1, 2, 3, 4}


def test_texts_compare_as_numbers_then_as_texts(texts):
    assert ids(texts, Filter("v", "Eq", "5")) == {0, 1} and ids(texts, Filter("v", "In", "5,abc")) == {0, 1, 2}
    assert ids(texts, Filter("v", "Eq", "5.00", None, (), "Int")) == {0, 1} and ids(texts, Filter("v", "Gt", "abc", None, (), "Int")) == set()
    assert ids(texts, Filter("v", "Lt", "0", None, (), "Float")) == {10}
    assert ids(texts, Filter("v", "Gte", "2024-01-01", None, (), "Date")) == {3} and ids(texts, Filter("v", "Eq", "soon", None, (), "Date")) == set()
    assert ids(texts, Filter("v", "Gt", "b")) == {9}


def test_wildcards_are_plain_letters(texts):
    assert ids(texts, Filter("v", "Contains", "%")) == {7} and ids(texts, Filter("v", "Contains", "_")) == {8}
    assert ids(texts, Filter("v", "StartsWith", "ár")) == {9} and ids(texts, Filter("v", "EndsWith", "B")) == {8}


def test_typed_literals(spark):
    df = spark.createDataFrame([(1, 7, Decimal("1.50"), datetime.date(2024, 1, 2), datetime.datetime(2024, 1, 2, 3), True)], "id long, i int, d decimal(10,2), day date, at timestamp_ntz, ok boolean")
    yes = [("i", "Eq", "7.0"), ("i", "Lt", "7.5"), ("d", "Eq", "1.5"), ("day", "Eq", "2024-01-02"), ("day", "Lt", "2024-01-02 01:00:00"), ("at", "Gt", "2024-01-02"), ("ok", "Eq", "TRUE"), ("i", "In", "9, 7"), ("i", "Lt", "99999999999999999999")]
    no = [("i", "Eq", "7.5"), ("day", "Eq", "2024-13-02"), ("at", "Eq", "x"), ("ok", "Eq", "maybe"), ("i", "Eq", "99999999999999999999")]
    assert all(ids(df, Filter(*f)) == {1} for f in yes) and all(ids(df, Filter(*f)) == set() for f in no)


def test_trees(spark, blanks):
    resolve = lambda f: (F.col(f.field), blanks.schema[f.field].dataType)
    got = lambda t: {r["id"] for r in blanks.filter(predicates.tree(t, resolve)).collect()}
    assert got(FilterGroup("And")) == {1, 2, 3, 4} and got(FilterGroup("Or")) == set()
    t = tree_from({"op": "Or", "filters": [{"field": "s", "op": "Eq", "value": "x"}, {"op": "And", "children": [{"field": "n", "op": "Lt", "value": "0"}, {"field": "s", "op": "IsNull"}]}]})
    assert got(t) == {3, 4} and predicates.fields(t) == {"s", "n"}
    assert got(FilterGroup("And", (Filter("s", "Eq", "?"), Filter("n", "Eq", "3")))) == {4}


def test_unknown_operators_are_errors(blanks):
    with pytest.raises(SpecError):
        ids(blanks, Filter("s", "Like", "x"))
    with pytest.raises(SpecError):
        predicates.predicate(F.col("s"), blanks.schema["s"].dataType, Filter("s", "Contains", "x"), SIMPLE_OPS)
    with pytest.raises(SpecError):
        tree_from({"field": "s", "op": "Like"})


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id AS string) AS s", "id % 7 AS k").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    test = predicates.flat([Filter("k", "Eq", "3"), Filter("s", "In", "x,y")], "And", lambda f: (F.col(f.field), df.schema[f.field].dataType))
    plan = df.filter(test).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(k,3)" in plan and "In(s, [x,y])" in plan


def test_derived_dates(spark):
    df = spark.createDataFrame([(datetime.datetime(2024, 5, 6, 13, 1), "2024-05-06T13:01:00"), (None, "no date")], "a timestamp_ntz, b string")
    cols = derived_columns({f.name: (F.col(f.name), f.dataType) for f in df.schema})
    rows = df.select(*[c.alias(n) for n, c in cols.items()]).collect()
    assert tuple(rows[0]) == ("2024-05-06", "2024-05", "13:00-13:59") * 2 and tuple(rows[1]) == (None,) * 6
