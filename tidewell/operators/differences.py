"""Differences between two copies of a dataset, key by key and field by field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.functions.text import boolean_key, number_key, text_key, time_key

KEYS: dict[str, Callable[[Column], Column]] = {"number": number_key, "boolean": boolean_key, "time": time_key, "text": text_key}


#: What a key becomes so that a null meets a null under plain equality, by which rows are then grouped and joined.
PARTS = ["_key", "_null"]


def _keyed(df: DataFrame, key: str) -> DataFrame:
    k = F.col(f"`{key}`")
    return df.withColumns({"_key": F.coalesce(k, F.lit(0)) if isinstance(df.schema[key].dataType, T.IntegralType) else F.coalesce(k.cast("string"), F.lit("")), "_null": k.isNull()})


def one_per_key(df: DataFrame, key: str, newest_by: list[str] | None = None) -> DataFrame:
    """One row a key, with PARTS: the highest in newest_by, then in all other columns, so ties and repeated rows have a defined winner."""
    lead = newest_by or []
    rest = [c for c in df.columns if c not in lead]
    return _keyed(df, key).groupBy(*PARTS).agg(F.max(F.struct(*lead, *rest)).alias("_r")).select(*PARTS, *[f"_r.{c}" for c in [*lead, *rest]])


def differences(left: DataFrame, right: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """key, side ('left', 'right' or 'both') and diffs: array of (field, left_value, right_value), empty for one-sided rows.

    fields names the compared columns and how each is normalised (number, boolean,
    time or text). Null and '' are equal; normalised values are compared null-safe, and
    only values whose texts differ are normalised at all. Both sides must have one row a
    key: those that one_per_key made are joined as they lie, without another shuffle or
    sort. A null key matches a null key. Other columns, of whatever name, are not looked at.
    """

    def side(df: DataFrame, p: str) -> DataFrame:
        df = df if set(PARTS) <= set(df.columns) else _keyed(df, key)
        raw = [F.col(f"`{f}`").cast("string").alias(f"{p}v{i}") for i, f in enumerate(fields)]
        return df.select(*[F.col(x).alias(f"{p}{x}") for x in PARTS], F.col(f"`{key}`").alias(f"{p}k"), *raw, F.lit(True).alias(f"{p}here"))

    a, b = side(left, "a"), side(right, "b")
    both = a.join(b, [a[f"a{x}"] == b[f"b{x}"] for x in PARTS], "full_outer")
    where = F.when(F.col("bhere").isNull(), "left").when(F.col("ahere").isNull(), "right").otherwise("both")

    def difference(i: int, field: str, kind: str) -> Column:
        x, y = F.col(f"av{i}"), F.col(f"bv{i}")
        found = F.struct(F.lit(field).alias("field"), x.alias("left_value"), y.alias("right_value"))
        return F.when(~x.eqNullSafe(y), F.when(~KEYS[kind](x).eqNullSafe(KEYS[kind](y)), found))

    diffs = F.array_compact(F.array(*[difference(i, f, k) for i, (f, k) in enumerate(fields.items())]))
    none = F.array().cast("array<struct<field:string,left_value:string,right_value:string>>")
    out = both.select(F.when(F.col("ahere").isNull(), F.col("bk")).otherwise(F.col("ak")).alias(key), where.alias("side"), F.when(where == "both", diffs).otherwise(none).alias("diffs"))
    return out.filter((F.col("side") != "both") | (F.size("diffs") > 0))
