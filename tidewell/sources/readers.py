"""Where tables and changes come from."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.errors import SpecError
from tidewell.functions.dates import SUFFIXES, derived
from tidewell.spec import InsertOp

#: The change log: one line a delivered change. CHANGE_SCHEMA is that of update_events.
_TEXTS, _TIME = T.ArrayType(T.StringType()), T.TimestampNTZType()
CHANGE_SCHEMA = T.StructType([T.StructField(n, k) for n, k in {
    "delivery_id": T.LongType(), "entity": T.StringType(), "tbl": T.StringType(), "op_type": T.StringType(), "pk": T.StringType(), "pk_before": T.StringType(), "row_columns": _TEXTS, "row_values": _TEXTS,
    "binlog_file": T.StringType(), "binlog_pos": T.LongType(), "row_no": T.IntegerType(), "gtid": T.StringType(), "committed_at": _TIME, "received_at": _TIME,
}.items()])
#: Schemas of the source server itself, never replicated.
SYSTEM_SCHEMAS = ("information_schema", "mysql", "performance_schema", "sys")
#: Epoch seconds above this (2000-01-01) in a time column are times.
LEAST_EPOCH = 946_684_800


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, dates: Iterable[str] = ()) -> DataFrame:
    """JSON lines as a table: missing keys are null, nested values their JSON text where the schema says string.

    Each date column gets its `_day`, `_month` and `_hour_bucket`. Lines that are no JSON
    give a row of nulls, which is dropped if nothing else is in it.
    """
    df = spark.read.schema(schema).json(path).dropna(how="all")
    return df.withColumns({f"{d}{s}": derived(F.col(f"`{d}`"), df.schema[d].dataType, s) for d in dates for s in SUFFIXES})


def snapshot(spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple[int, int] | None = None, partitions: int = 64, **options: str) -> DataFrame:
    """A table of a source server over JDBC (its driver must be on the class path), read by ranges of a numeric column."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table).options(**options)
    if partition_column and bounds:
        r = r.option("partitionColumn", partition_column).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", partitions)
    return r.load()


def change_stream(spark: SparkSession, path: str, file_format: str = "parquet", files_per_trigger: int | None = None, schema: T.StructType = CHANGE_SCHEMA) -> DataFrame:
    """The change log under path as a stream of new files."""
    r = spark.readStream.schema(schema).format(file_format)
    return (r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r).load(path)


def in_scope(changes: DataFrame, tables: Iterable[tuple[str, str]] | None = None, schemas: Iterable[str] | None = None, used: Iterable[tuple[str, str]] | None = None) -> DataFrame:
    """The changes of the allowed tables and schemas, narrowed to those that saved operations use.

    Names match without regard to letter case. If nothing allowed is in use, the used
    ones count. System schemas never do.
    """
    low = lambda xs: {(e.lower(), t.lower()) for e, t in xs}
    wanted = low(tables) if tables is not None else None
    if used is not None:
        wanted = (wanted & low(used) or low(used)) if wanted is not None else low(used)
    e, t = F.lower("entity"), F.lower("tbl")
    out = changes.filter(~e.isin(*SYSTEM_SCHEMAS))
    if schemas is not None:
        names = [s.lower() for s in schemas]
        out = out.filter(e.isin(names) if names else F.lit(False))
    if wanted is not None:
        by: dict[str, list[str]] = {}
        for x, y in sorted(wanted):
            by.setdefault(x, []).append(y)
        test = F.lit(False)
        for x, ys in by.items():
            test = test | ((e == x) & t.isin(ys))
        out = out.filter(test)
    return out


def insert_change(op: InsertOp, payload: dict, key: list[str], position: tuple[str, int, int]) -> dict:
    """A payload as an INSERT of the change log. All expected fields must be there; key columns become the pk."""
    if missing := sorted(set(op.expected_fields) - set(payload)):
        raise SpecError(f"missing fields: {', '.join(missing)}")
    text = {k: v if v is None or isinstance(v, str) else str(v) for k, v in payload.items()}
    columns = [c for c in text if c not in key]
    pk = "\x1f".join(text.get(k) or "" for k in key)
    return {
        "entity": op.entity, "tbl": op.table, "op_type": "INSERT", "pk": pk, "row_columns": columns, "row_values": [text[c] for c in columns],
        "binlog_file": position[0], "binlog_pos": position[1], "row_no": position[2],
    }


def decode_columns(df: DataFrame, enums: dict[str, list[str]] | None = None, epochs: Iterable[str] = ()) -> DataFrame:
    """Enum indices (from 1) as their labels and epoch seconds in time columns as timestamps; other values stay."""
    out = df
    for name, labels in (enums or {}).items():
        i = F.col(f"`{name}`").try_cast("int")
        label = F.get(F.array(*[F.lit(x) for x in labels]), i - 1)
        out = out.withColumn(name, F.coalesce(F.when(i.between(1, len(labels)), label), F.col(f"`{name}`").cast("string")))
    for name in epochs:
        c = F.col(f"`{name}`").cast("string")
        n = F.when(c.rlike(r"^\d+$"), c.try_cast("bigint"))
        shown = F.date_format(F.timestamp_seconds(n), "yyyy-MM-dd HH:mm:ss")
        out = out.withColumn(name, F.when(n > LEAST_EPOCH, shown).otherwise(c))
    return out


def named_columns(row_columns, ordinal_names: list[str]):
    """Column names of a row image whose placeholders `@1`, `@2`... stand for ordinals of the table."""
    names = F.array(*[F.lit(n) for n in ordinal_names])
    at = lambda c: F.regexp_extract(c, r"^@(\d+)$", 1).try_cast("int")
    return F.transform(row_columns, lambda c: F.coalesce(F.get(names, at(c) - 1), c))
