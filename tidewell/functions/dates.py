"""Dates in texts and the day, month and hour columns derived from them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SUFFIXES = ("_day", "_month", "_hour_bucket")
#: A date: four digits, month 01 to 12, day 01 to 31, anything behind.
PATTERN = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])"
is_date_text = re.compile(PATTERN).match


def derived(col: Column, kind: T.DataType, suffix: str) -> Column:
    """`2024-05-06`, `2024-05` or `13:00-13:59` of a date, a timestamp or a text that starts as a date; else null."""
    if isinstance(kind, T.StringType):
        good = col.rlike(PATTERN)
        if suffix == "_day":
            return F.when(good, F.substring(col, 1, 10))
        if suffix == "_month":
            return F.when(good, F.substring(col, 1, 7))
        hour = F.regexp_extract(col, r"^.{10}[T ](\d{2})", 1)
        return F.when(good & (hour != ""), F.concat(hour, F.lit(":00-"), hour, F.lit(":59")))
    if suffix == "_day":
        return F.date_format(col, "yyyy-MM-dd")
    if suffix == "_month":
        return F.date_format(col, "yyyy-MM")
    hour = F.date_format(col.cast("timestamp_ntz"), "HH")
    return F.concat(hour, F.lit(":00-"), hour, F.lit(":59"))


def derived_columns(cols: dict[str, tuple[Column, T.DataType]], mentioned: str | None = None) -> dict[str, Column]:
    """The derived columns of the date, timestamp and text columns among cols that don't clash with one of them.

    With mentioned, only those whose name that text holds.
    """
    dated = (T.DateType, T.TimestampType, T.TimestampNTZType, T.StringType)
    wanted = [(n, s) for n, (_, k) in cols.items() if isinstance(k, dated) for s in SUFFIXES if f"{n}{s}" not in cols and (mentioned is None or f"{n}{s}" in mentioned)]
    return {f"{n}{s}": derived(*cols[n], s) for n, s in wanted}
