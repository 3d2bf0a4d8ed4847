"""Numbers within groups, without ever holding a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def salted_number(df: DataFrame, group: list[str], salt: Column, order: list[str], name: str) -> DataFrame:
    """Adds the column name: numbers from 0 without gaps within each group, in the order (salt, *order).

    Rows are counted by (group, salt) with map-side combine, the counts are summed
    up over the salts, and rows are numbered within (group, salt). A group with a
    third of all rows is thus spread over as many tasks as there are salts. Equal
    rows get different numbers; null groups are groups of their own. Rows are
    shuffled once: the counts join them on the very keys they are numbered by.
    """
    p = "_n_"
    while any(c.startswith(p) for c in df.columns):
        p = f"_{p}"
    # a text for each group value, so that a null is a value that plain equality finds
    keys = {f"{p}k{i}": F.coalesce(F.concat(F.lit("v"), F.col(f"`{g}`").cast("string")), F.lit("n")) for i, g in enumerate(group)}
    salted = df.withColumns({**keys, f"{p}salt": salt})
    by = [*keys, f"{p}salt"]
    before = Window.partitionBy(*keys).orderBy(f"{p}salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*by).agg(F.count("*").alias(f"{p}n"))
    starts = starts.select(*by, F.coalesce(F.sum(f"{p}n").over(before), F.lit(0)).alias(f"{p}start"))
    numbered = salted.withColumn(f"{p}at", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    return numbered.join(starts, by).withColumn(name, (F.col(f"{p}start") + F.col(f"{p}at")).cast("long")).select(*df.columns, name)
