"""Keeping replicas right: drift of counts, doubled keys, compaction of snapshots."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.operators.incremental import VersionedTable


def matches_table_filter(name: str, wanted: str) -> bool:
    """Whether `schema.table` is meant by a filter: the full name, the table alone, or part of the schema with the table."""
    wanted = wanted.strip().replace("/", ".").lower()
    if not wanted or wanted == name.lower():
        return True
    schema, _, table = name.lower().rpartition(".")
    part, _, wanted_table = wanted.rpartition(".")
    return table == wanted_table and (not part or part in schema)


def count_drift(source: dict[str, DataFrame], mirror: dict[str, DataFrame], only: Iterable[str] = ("",)) -> DataFrame:
    """tbl, source_count, mirror_count, diff, ok of every table of either side that a filter matches, in order.

    A table that one side lacks has no count there, and isn't ok.
    """
    wanted = [n for n in sorted({*source, *mirror}) if any(matches_table_filter(n, f) for f in only)]

    def counts(side: dict[str, DataFrame], name: str) -> DataFrame | None:
        parts = [side[n].agg(F.count("*").alias(name)).select(F.lit(n).alias("tbl"), name) for n in wanted if n in side]
        return functools.reduce(DataFrame.unionByName, parts) if parts else None

    a, b = counts(source, "source_count"), counts(mirror, "mirror_count")
    if a is None or b is None:
        have = a if a is not None else b
        if have is None:
            raise ValueError("no table matches")
        both = have.withColumn("mirror_count" if a is not None else "source_count", F.lit(None).cast("bigint"))
    else:
        both = a.join(b, "tbl", "full_outer")
    diff = F.col("source_count") - F.col("mirror_count")
    return both.select("tbl", "source_count", "mirror_count", diff.alias("diff"), F.coalesce(diff == 0, F.lit(False)).alias("ok")).orderBy("tbl")


def to_repair(drift: DataFrame, most: int = 10) -> DataFrame:
    """The tables whose counts differ by more than most, or that one side lacks."""
    return drift.filter(F.coalesce(F.abs("diff") > most, F.lit(True)))


def latest_per_key(df: DataFrame, key: list[str], sequence: list[str]) -> DataFrame:
    """One row a key, the last by sequence. The rank limit is applied before the shuffle, so a hot key ships one row a task."""
    w = Window.partitionBy(*key).orderBy(*[F.col(s).desc_nulls_last() for s in sequence])
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def reconcile(df: DataFrame, key: list[str], sequence: list[str]) -> tuple[DataFrame, DataFrame]:
    """(winners, losers) of rows that share a key; the last by sequence wins."""
    w = Window.partitionBy(*key).orderBy(*[F.col(s).desc_nulls_last() for s in sequence])
    ranked = df.withColumn("_rank", F.row_number().over(w))
    return ranked.filter("_rank = 1").drop("_rank"), ranked.filter("_rank > 1").drop("_rank")


def needs_compaction(files: int, rows: int, target: int = 50_000, least: int = 4) -> bool:
    """Whether a snapshot of so many files is worth a rewrite: at least `least` files and more than twice what its rows need."""
    return files >= least and files > 2 * max(1, math.ceil(rows / target))


def rewrite_snapshot(spark: SparkSession, df: DataFrame, path: str, key: list[str], rows_per_file: int = 50_000, bloom: bool = True) -> int:
    """df sorted by key into files of at most rows_per_file rows, with key statistics and bloom filters: a new version of the table at path.

    Rows are ranged by key, so a point lookup reads one file. Readers (VersionedTable.read)
    see the old version until the new one is committed, and a rewrite that dies on the way
    leaves it as it was; df may be the old version itself.
    """
    table = VersionedTable(spark, path)
    base = table.version()
    made = df.repartitionByRange(*[F.col(k) for k in key]).sortWithinPartitions(*key)
    blooms = {f"parquet.bloom.filter.enabled#{k}": "true" for k in key if bloom}
    return table.commit(base, table.stage(made, rows_per_file, blooms), [])


def composite_key(*cols: Column) -> Column:
    """The text form of a composite key; for keys inside a plan use the columns themselves."""
    return F.concat_ws("\u001f", *cols)
