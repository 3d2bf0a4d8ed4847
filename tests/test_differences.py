from tidewell.operators.differences import differences, one_per_key

FIELDS = {"n": "number", "b": "boolean", "t": "time", "s": "text"}


def sides(spark, left, right):
    schema = "k long, n string, b string, t string, s string, side string, diffs int"
    pad = lambda rows: [(*r, "clash", 1) for r in rows]
    return spark.createDataFrame(pad(left), schema), spark.createDataFrame(pad(right), schema)


def report(spark, left, right):
    out = differences(*sides(spark, left, right), "k", FIELDS)
    return {(r["k"], r["side"], tuple((d["field"], d["left_value"], d["right_value"]) for d in r["diffs"])) for r in out.collect()}


def test_equal_writings_are_no_difference(spark):
    left = [(1, "7", "true", "2024-01-02 03:04:05", "caf\u00e9"), (2, None, "0", None, ""), (3, "-0.50", None, "2024-01-02", None), (4, "1e2", "TRUE", "", "x")]
    right = [(1, " +07.0 ", "1", "2024-01-02T03:04:05.000", "cafe\u0301"), (2, "", " False", "", None), (3, "-.5", "", "2024-01-02 00:00:00", ""), (4, "100", " 1 ", None, "x")]
    assert report(spark, left, right) == set()


def test_each_kind_of_difference(spark):
    left = [(1, "7", "true", "2024-01-02 03:04:05", "a"), (2, "1", "1", None, "A"), (None, "1", None, None, None)]
    right = [(1, "7.01", "0", "2024-01-02 03:04:06", "a "), (3, "1", "1", None, "A"), (None, "1", None, None, None)]
    assert report(spark, left, right) == {
        (1, "both", (("n", "7", "7.01"), ("b", "true", "0"), ("t", "2024-01-02 03:04:05", "2024-01-02 03:04:06"), ("s", "a", "a "))),
        (2, "left", ()), (3, "right", ()),
    }


def test_numbers_compare_by_value_whatever_their_length(spark):
    equal = [("1e25", "10000000000000000000000000"), ("12e-3", "0.0120"), ("1E+2", "100"), ("0e9", "-0.000"), ("7", "+07.00"), ("-0", "0.0"), (".5", "0.50"), ("1e3", "1000"), ("5.", "5"), ("9" * 60, "0" + "9" * 60 + ".0")]
    assert report(spark, [(i, a, None, None, None) for i, (a, _) in enumerate(equal)], [(i, b, None, None, None) for i, (_, b) in enumerate(equal)]) == set()
    apart = [("1e-20", "0"), ("1e25", "1e26"), ("1e", "1"), (".", "0"), ("1e-400", "1e-401"), ("1", "1.0000000000001"), ("-1", "1"), ("9" * 60, "9" * 59 + "8"), ("10", "1"), ("1.", "x")]
    assert len(report(spark, [(i, a, None, None, None) for i, (a, _) in enumerate(apart)], [(i, b, None, None, None) for i, (_, b) in enumerate(apart)])) == len(apart)


def test_unreadable_values_compare_as_texts(spark):
    assert report(spark, [(1, "many", "maybe", "soon", "x")], [(1, " many", "MAYBE", "soon", "x")]) == set()
    assert len(report(spark, [(1, "many", None, None, None)], [(1, "few", None, None, None)])) == 1


def test_empty_tables_and_long_texts(spark):
    assert report(spark, [], []) == set()
    long = "é" * 200_000
    assert report(spark, [(1, None, None, None, long)], [(1, None, None, None, long)]) == set()
    assert report(spark, [(1, None, None, None, long)], []) == {(1, "left", ())}


def test_rows_that_one_per_key_made_are_joined_as_they_lie(spark):
    left, right = sides(spark, [(1, "1", None, None, None), (None, "2", None, None, None)] * 2, [(1, "2", None, None, None), (None, "2", None, None, None)] * 2)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = differences(one_per_key(left, "k"), one_per_key(right, "k"), "k", FIELDS)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and {(r["k"], len(r["diffs"])) for r in out.collect()} == {(1, 1)}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_one_per_key_takes_the_newest_and_has_a_winner_on_ties(spark):
    df = spark.createDataFrame([(1, 1, "old"), (1, 2, "b"), (1, 2, "a"), (1, 2, "a"), (None, 1, "n")], "k int, seq int, v string")
    assert {tuple(r) for r in one_per_key(df, "k", ["seq"]).select("k", "v").collect()} == {(1, "b"), (None, "n")}
