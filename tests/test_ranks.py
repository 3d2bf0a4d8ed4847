from pyspark.sql import functions as F

from tidewell.operators.ranks import salted_number


def test_numbers_have_no_gaps_in_any_group(spark):
    df = spark.createDataFrame([("hot", i, 0) for i in range(500)] + [("a", 1, 0)] * 3 + [(None, 7, 0), (None, 7, 0), ("n", 1, 0), ("", 1, 0)], "g string, v int, _start int").repartition(5)
    out = salted_number(df, ["g"], F.pmod(F.xxhash64("v"), F.lit(7)), ["v"], "n")
    got = {}
    for r in out.collect():
        got.setdefault(r["g"], []).append(r["n"])
    assert {g: sorted(n) for g, n in got.items()} == {"hot": list(range(500)), "a": [0, 1, 2], None: [0, 1], "n": [0], "": [0]}
    assert salted_number(df.limit(0), ["g"], F.lit(0), ["v"], "n").count() == 0


def test_rows_are_shuffled_once(spark):
    df = spark.range(100).selectExpr("id % 3 AS g", "id AS v", "repeat('x', 10) AS wide")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = salted_number(df, ["g"], F.pmod("v", F.lit(4)), ["v"], "n")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    wide = [line for line in plan.split("\n") if "Exchange" in line]
    assert len(wide) <= 4  # rows, counts, counts by group, counts by (group, salt)
