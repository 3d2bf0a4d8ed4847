"""Current rows of source tables from a feed of inserts, updates and deletes.

A log-structured merge store. Each change is cut into cells: one marker (the row
was put whole, or a tombstone) and one cell for each listed column. A run holds,
for each (key, column), the newest cell of the changes it was built from, sorted
by key and sequence, in buckets of the key. Reading merges the runs bucket by
bucket: a bucket of all runs is read by one task, so the merge needs no shuffle.
Compaction writes the merge of all runs as one run and drops what tombstones and
puts have shadowed.

The newest cell of a (key, column) is a maximum, so runs may be built in any order,
from late, repeated or overlapping deliveries, and a hot key shrinks to its columns
before anything is shuffled.
"""

from __future__ import annotations

import functools
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.text import blank, nfc, strip
from tidewell.sources import shared

KEY = ["entity", "tbl", "pk"]
HASH = "key_hash"
SEQUENCE = ["file_no", "pos", "row_no"]
PUT, TOMBSTONE = "put", "tombstone"
#: The most changes in a run that take_in makes, and the changes that it reckons with for a bucket.
RUN_CHANGES, BUCKET_CHANGES = 20_000_000, 1_000_000
#: No bucket is made for less than so many changes.
SMALL_BUCKET = 25_000


def file_number(binlog_file: Column) -> Column:
    """The number at the end of a log file's name."""
    return F.regexp_extract(binlog_file, r"(\d+)\s*$", 1).try_cast("bigint")


def changes(feed: DataFrame, *carry: str) -> DataFrame:
    """The changes that count, as one narrow row each: KEY, was, SEQUENCE, op, row_columns, row_values and the columns in carry.

    Keys are in NFC. Left out are changes with a null or blank pk and those of unknown
    kind. was is the key that an update has moved away from, else null.
    """
    op = F.upper(strip(F.col("op_type")))
    f = feed.filter(~blank(F.col("pk")) & op.isin("INSERT", "UPDATE", "DELETE")).select(
        *carry, "entity", "tbl", "row_columns", "row_values", op.alias("op"), nfc(F.col("pk")).alias("pk"), nfc(F.when(op == "UPDATE", F.col("pk_before"))).alias("before"),
        file_number(F.col("binlog_file")).alias("file_no"), F.col("binlog_pos").cast("bigint").alias("pos"), F.col("row_no").cast("int").alias("row_no"),
    )
    was = F.when(~blank(F.col("before")) & (F.col("before") != F.col("pk")), F.col("before"))
    listed = F.col("op") != "DELETE"
    return f.select(*carry, *KEY, was.alias("was"), *SEQUENCE, F.substring("op", 1, 1).alias("op"), F.when(listed, F.col("row_columns")).alias("row_columns"), F.when(listed, F.col("row_values")).alias("row_values"))


def by_key(changes_: DataFrame) -> DataFrame:
    """A change that moves a row becomes two: a DELETE of the key it leaves and an INSERT of its new key."""
    moved = F.col("was").isNotNull()
    part = lambda pk, op, c, v: F.struct(pk.alias("pk"), op.alias("op"), c.alias("row_columns"), v.alias("row_values"))
    none = F.lit(None).cast("array<string>")
    here = part(F.col("pk"), F.when(moved, F.lit("I")).otherwise(F.col("op")), F.col("row_columns"), F.col("row_values"))
    away = part(F.col("was"), F.lit("D"), none, none)
    rest = [c for c in changes_.columns if c not in ("pk", "was", "op", "row_columns", "row_values")]
    return changes_.select(*rest, F.inline(F.when(moved, F.array(here, away)).otherwise(F.array(here))))


def cells(by_key_: DataFrame, *carry: str) -> DataFrame:
    """KEY, col, SEQUENCE, value and the columns in carry: the marker (col is null, value is PUT or TOMBSTONE) and column cells of each change.

    A null column name is left out, a missing value is null, and of a column that one
    change lists twice the greater value counts.
    """
    cell = lambda col, value: F.struct(col.alias("col"), value.alias("value"))
    marker = cell(F.lit(None).cast("string"), F.when(F.col("op") == "I", F.lit(PUT)).otherwise(F.lit(TOMBSTONE)))
    values = F.col("row_values")
    listed = F.filter(F.transform("row_columns", lambda name, i: cell(name, F.get(values, i))), lambda c: c["col"].isNotNull())
    none = F.array().cast("array<struct<col:string,value:string>>")
    every = F.when(F.col("op") == "U", F.coalesce(listed, none)).otherwise(F.concat(F.array(marker), F.coalesce(listed, none)))
    return by_key_.select(*carry, *KEY, *SEQUENCE, F.inline(every))


def hashed(cells_: DataFrame) -> DataFrame:
    """With HASH, the hash of the key: what buckets are made of and what everything is sorted by first."""
    return cells_.withColumn(HASH, F.xxhash64(*KEY))


def newest(cells_: DataFrame, *within: str) -> DataFrame:
    """The newest cell of each (key, column) of hashed cells, in the order (*within, HASH, KEY, col)."""
    by = [*within, HASH, *KEY, "col"]
    return cells_.groupBy(*by).agg(F.max(F.struct(*SEQUENCE, "value")).alias("c")).select(*by, "c.*")


def fold_keys(newest_cells: DataFrame) -> DataFrame:
    """One row a key: base (the newest marker, null if there is none) and the cells, as wide as the table.

    The order that newest() leaves is the one this needs, so nothing is sorted again.
    """
    marker = F.when(F.col("col").isNull(), F.struct(*SEQUENCE, F.col("value").alias("kind")))
    cell = F.when(F.col("col").isNotNull(), F.struct("col", F.struct(*SEQUENCE).alias("seq"), "value"))
    return newest_cells.groupBy(HASH, *KEY).agg(F.max(marker).alias("base"), F.collect_list(cell).alias("cells"))


def _base() -> Column:
    return F.struct(*[F.col(f"base.{k}").alias(k) for k in SEQUENCE])


def live_rows(newest_cells: DataFrame) -> DataFrame:
    """entity, tbl, pk and cells (an array of col, value in the order of col) of the rows that exist."""
    held = F.filter("cells", lambda c: c["seq"] >= _base())
    kept = F.transform(held, lambda c: F.struct(c["col"].alias("col"), c["value"].alias("value")))
    return fold_keys(newest_cells).filter(F.col("base.kind") == PUT).select(*KEY, F.array_sort(kept).alias("cells"))


def row_md5(cells_: Column) -> Column:
    """MD5 of `column=value` of all values that are neither null nor empty, joined by `|`, in the order of the columns."""
    filled = F.filter(cells_, lambda c: c["value"] != "")
    return F.md5(F.array_join(F.transform(filled, lambda c: F.concat(c["col"], F.lit("="), c["value"])), "|"))


class ChangeStore:
    """The runs of one store, under a path that all executors share.

    runs.json of the highest version lists the runs that count; it is written last,
    so an append or a compaction that dies on the way leaves no trace in any read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.spark, self.path = spark, path.rstrip("/")
        versions = self._versions()
        if versions:
            buckets = shared.read_json(spark, f"{self.path}/log/{versions[-1]}")["buckets"]
        self.buckets = buckets
        self.name = f"tidewell_runs_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} ({HASH} BIGINT, entity STRING, tbl STRING, pk STRING, col STRING, file_no BIGINT, pos BIGINT, row_no INT, value STRING, run INT) "
            f"USING parquet PARTITIONED BY (run) CLUSTERED BY ({HASH}) SORTED BY ({HASH}, entity, tbl, pk, col) INTO {buckets} BUCKETS LOCATION '{self.path}/data'"
        )
        shared.scratch_table(spark, self.name)  # the entry goes with the process, the files stay
        if versions:
            spark.catalog.recoverPartitions(self.name)

    def _versions(self) -> list[str]:
        return [x for x in shared.listing(self.spark, f"{self.path}/log") if x.endswith(".json")]

    def runs(self) -> list[int]:
        versions = self._versions()
        return shared.read_json(self.spark, f"{self.path}/log/{versions[-1]}")["runs"] if versions else []

    def _commit(self, runs: list[int], last: int) -> None:
        at = len(self._versions())
        shared.write_json(self.spark, f"{self.path}/log/{at:010d}.json", {"runs": runs, "last": last, "buckets": self.buckets})

    def _written(self) -> list[int]:
        """The runs that have files, whether they count or not."""
        return sorted(int(x[4:]) for x in shared.listing(self.spark, f"{self.path}/data") if x.startswith("run="))

    def _next(self) -> int:
        """A number that no run has, nor any that was written and never committed."""
        versions = self._versions()
        last = shared.read_json(self.spark, f"{self.path}/log/{versions[-1]}")["last"] if versions else -1
        return 1 + max([last, *self._written()])

    def _bucket(self) -> Column:
        """The bucket that the table's writer will choose: a task that holds whole buckets writes one file for each."""
        return F.pmod(F.hash(HASH), F.lit(self.buckets))

    def _write(self, cells_: DataFrame) -> None:
        cells_.select(HASH, *KEY, "col", *SEQUENCE, "value", F.col("run").cast("int")).write.insertInto(self.name)

    def append(self, feed: DataFrame, runs: int = 1, arrival: str | None = None) -> list[int]:
        """Adds the changes of feed as so many sorted runs of about equal size, cut at quantiles of the arrival column.

        Narrow changes are shuffled once, by run and bucket; a run is bounded, and so is
        what a hot key can bring into one task. There each (key, column) is folded to its
        newest cell, and the run is written in the order it was folded in.
        """
        first = self._next()
        cut = F.lit(0)
        if runs > 1 and arrival:
            # changes without an arrival are dealt out, so that they don't all come into one run
            at = F.coalesce(F.col(arrival).cast("double"), F.lit(0.0))
            bounds = feed.select(at.alias("at")).filter(F.col(arrival).isNotNull()).approxQuantile("at", [i / runs for i in range(1, runs)], 0.05 / runs)
            dealt = F.pmod(F.xxhash64("entity", "tbl", "pk", "binlog_pos"), F.lit(runs)).cast("int")
            cut = F.when(F.col(arrival).isNull(), dealt).otherwise(functools.reduce(lambda a, b: a + b, [F.when(at > b, 1).otherwise(0) for b in bounds], F.lit(0)))
        rows = hashed(by_key(changes(feed.withColumn("run", cut + F.lit(first)), "run"))).withColumn("bucket", self._bucket())
        # a task for each bucket of each run: none gets two by chance
        slot = ((F.col("run") - first) * self.buckets + F.col("bucket")).cast("int")
        placed = rows.withColumn("slot", slot).repartitionById(runs * self.buckets, F.col("slot"))
        self._write(newest(cells(placed, "slot", "run", HASH), "slot", "run"))
        added = list(range(first, first + runs))
        self._commit([*self.runs(), *added], added[-1])
        return added

    def merged(self) -> DataFrame:
        """The newest cells over all runs. Each task reads one bucket of every run.

        The engine has no merge of sorted inputs, but its sort (TimSort) takes the runs, each
        in order already, as they are and merges them; nothing is sorted after that.
        """
        live = self.runs()
        table = self.spark.table(self.name)
        return newest(table.filter(F.col("run").isin(live)) if live else table.filter(F.lit(False)))

    def read(self) -> DataFrame:
        return live_rows(self.merged())

    def compact(self, drop_tombstones: bool = False) -> int:
        """Merges all runs into one and drops shadowed cells; the number of the new run.

        Tombstones stay unless drop_tombstones, which is right only if no change older
        than those merged can still arrive.
        """
        run = self._next()
        folded = fold_keys(self.merged())
        if drop_tombstones:
            folded = folded.filter(F.col("base").isNull() | (F.col("base.kind") != TOMBSTONE))
        seq = [F.col(f"base.{k}").alias(k) for k in SEQUENCE]
        marker = F.when(F.col("base").isNotNull(), F.array(F.struct(F.lit(None).cast("string").alias("col"), F.struct(*seq).alias("seq"), F.col("base.kind").alias("value"))))
        none = F.array().cast(folded.schema["cells"].dataType)
        kept = F.filter("cells", lambda c: F.col("base").isNull() | (c["seq"] >= _base()))
        flat = folded.select(HASH, *KEY, F.inline(F.concat(F.coalesce(marker, none), F.array_sort(kept))))
        self._write(flat.select(HASH, *KEY, "col", "seq.*", "value", F.lit(run).alias("run")))
        self._commit([run], run)
        return run

    def compact_if_needed(self, most_runs: int = 8) -> bool:
        """Keeps the width of the merge bounded."""
        if len(self.runs()) <= most_runs:
            return False
        self.compact()
        return True

    def vacuum(self) -> list[int]:
        """Removes the files of runs that don't count. No read that began before the last compaction may still be running."""
        gone = sorted({*self._written()} - {*self.runs()})
        for run in gone:
            self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (run = {run})")
            shared.delete(self.spark, f"{self.path}/data/run={run}")
        return gone


def take_in(feed: DataFrame, arrival: str = "delivery_id", least_runs: int = 4) -> ChangeStore:
    """A new store in the shared folder that holds a whole feed, by runs of at most RUN_CHANGES changes in the order of arrival."""
    spark = feed.sparkSession
    n = feed.count()
    runs = max(least_runs, math.ceil(n / RUN_CHANGES))
    few = max(1, math.ceil(n / SMALL_BUCKET))
    buckets = min(few, max(2 * spark.sparkContext.defaultParallelism, math.ceil(n / BUCKET_CHANGES)))
    store = ChangeStore(spark, shared.scratch_path(spark, "changes"), buckets)
    store.append(feed, runs, arrival)
    return store


def apply_feed(feed: DataFrame, arrival: str = "delivery_id", least_runs: int = 4) -> DataFrame:
    """Current rows of a whole feed through a store of its own: entity, tbl, pk, cells."""
    return take_in(feed, arrival, least_runs).read()
