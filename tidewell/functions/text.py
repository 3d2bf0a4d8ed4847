"""Text helpers on Columns: Unicode normal form, blanks, canonical numbers, booleans and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"^[\s\p{Z}\x1c-\x1f\x85]*$"
EDGE = " \t\r\n\f\u000b\u00a0"


def nfc(col: Column) -> Column:
    """NFC of a text; null stays null. Only texts beyond ASCII are looked at, all others are their own NFC.

    Done in the JVM by the ICU library that Spark brings along for its collations. To the
    optimiser a call by reflection may give another value each time, so filters stay
    above it: filter first, then normalise.
    """
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), F.coalesce(col, F.lit("")), F.lit(False))
    return F.coalesce(F.when(col.rlike(r"[^\x00-\x7F]"), composed), col)


def blank(col: Column) -> Column:
    """True for null, '' and white space alone."""
    return col.isNull() | col.rlike(BLANK)


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(EDGE))


def empty_as_null(col: Column) -> Column:
    return F.when(col.cast("string") != "", col)


NUMBER = r"^([+-]?)0*(\d*)(?:\.(\d*))?(?:[eE]([+-]?\d{1,18}))?$"


def number_key(col: Column) -> Column:
    """A text that is equal for equal numbers of any length and size: '+07', '7.0' and '70e-1' agree. What is no number stays as its stripped text.

    Digits without zeros at their ends, and the power of ten of the first of them.
    """
    raw = strip(col.cast("string"))
    whole, part, power = (F.regexp_extract(raw, NUMBER, i) for i in (2, 3, 4))
    digits = F.concat(whole, part)
    tail = F.ltrim(digits, F.lit("0"))
    first = F.coalesce(power.try_cast("bigint"), F.lit(0)) + F.length(whole) - (F.length(digits) - F.length(tail))
    sign = F.when(F.regexp_extract(raw, NUMBER, 1) == "-", "-").otherwise("")
    n = F.when(tail == "", "0").otherwise(F.concat(sign, F.rtrim(tail, F.lit("0")), F.lit("e"), first.cast("string")))
    return F.when(raw != "", F.when(raw.rlike(NUMBER) & raw.rlike(r"^[+-]?\.?\d"), n).otherwise(F.concat(F.lit("text:"), raw)))


def boolean_key(col: Column) -> Column:
    """'true' for 1 and true, 'false' for 0 and false in any letter case; other texts stay, stripped and lower case."""
    raw = F.lower(strip(col.cast("string")))
    return F.when(raw != "", F.when(raw.isin("1", "true"), "true").when(raw.isin("0", "false"), "false").otherwise(raw))


def time_key(col: Column) -> Column:
    """A text that is equal for equal points in time; what is no time stays as its stripped text."""
    raw = strip(col.cast("string"))
    at = raw.try_cast("timestamp_ntz")
    return F.when(raw != "", F.coalesce(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.concat(F.lit("text:"), raw)))


def text_key(col: Column) -> Column:
    """NFC; '' counts as null."""
    return empty_as_null(nfc(col.cast("string")))
