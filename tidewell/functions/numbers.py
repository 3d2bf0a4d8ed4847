"""Numbers in columns of any type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def as_double(col: Column, kind: T.DataType) -> Column:
    """The value as double, null if it is none. Texts such as '1d', which a cast would take, are no numbers."""
    if isinstance(kind, T.StringType):
        return F.when(col.rlike(NUMBER), F.trim(col).try_cast("double"))
    if isinstance(kind, T.BooleanType):
        return col.cast("int").cast("double")
    if isinstance(kind, T.NumericType):
        return col.cast("double")
    return F.lit(None).cast("double")


def exact_sum(col: Column, digits: int | None) -> Column:
    """The sum of doubles. With digits, each is rounded to so many decimals and summed as a decimal, so that the
    result doesn't hang on the order of rows; values of 1e18 and more, infinities and NaN are summed as doubles."""
    if digits is None:
        return F.coalesce(F.sum(col), F.lit(0.0))
    fits = F.abs(col) < 1e18
    exact = F.sum(F.when(fits, col.cast(f"decimal({20 + digits},{digits})")))
    return F.coalesce(exact.cast("double"), F.lit(0.0)) + F.coalesce(F.sum(F.when(~fits, col)), F.lit(0.0))
