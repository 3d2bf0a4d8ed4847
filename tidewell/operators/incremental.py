"""Processing only what is new or changed since the last successful run.

A table version is an immutable manifest: the files that make it up and, for each, a
deletion vector of the records in it that don't count. The records to process are
the difference of two versions: files added whole, files that both hold, in which
only what one deletion vector hides and the other doesn't counts, and files that
are gone. The version processed is saved in the commit of the output, in one file,
so a run that dies leaves neither a half output nor a wrong position.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewell.functions.text import strip
from tidewell.operators.changelog import file_number
from tidewell.sources import shared

# ---- change feeds with a checkpoint for each entity ----


def last_successful(states: DataFrame) -> DataFrame:
    """entity, c_file, c_pos, c_sets (parsed gtid sets, null if empty) of the committed run with the highest run_no."""
    good = states.filter(F.lower(strip(F.col("outcome"))) == "committed").filter(F.col("entity").isNotNull())
    top = good.groupBy("entity").agg(F.max(F.struct("run_no", file_number(F.col("binlog_file")).alias("c_file"), F.col("binlog_pos").alias("c_pos"), "gtid_executed")).alias("s"))
    return top.select("entity", "s.c_file", "s.c_pos", gtid_sets(F.col("s.gtid_executed")).alias("c_sets"))


def gtid_sets(text: Column) -> Column:
    """array<struct<source, ranges: array<struct<lo, hi>>>> of `uuid:a-b:c,...` in loose notation; null if there is none.

    White space and letter case don't count; single numbers are ranges of one; a source
    may come more than once; what can't be read is left out.
    """
    plain = F.lower(F.regexp_replace(text, r"[\s\p{Z}]+", ""))
    parts = F.filter(F.split(plain, ","), lambda x: x != "")

    def one(part: Column) -> Column:
        words = F.split(part, ":")
        pieces = F.transform(F.slice(words, F.lit(2), F.size(words)), lambda w: F.split(w, "-"))
        ranges = F.transform(pieces, lambda p: F.struct(F.get(p, F.lit(0)).try_cast("bigint").alias("lo"), F.get(p, F.size(p) - 1).try_cast("bigint").alias("hi")))
        return F.struct(F.get(words, F.lit(0)).alias("source"), F.filter(ranges, lambda r: r["lo"].isNotNull() & r["hi"].isNotNull()).alias("ranges"))

    return F.when(F.size(parts) > 0, F.transform(parts, one))


def merged_ranges(ranges: DataFrame, by: list[str]) -> DataFrame:
    """by, lo, hi: the union of ranges (by, lo, hi) of transaction numbers as the fewest ranges; neighbours become one.

    Checkpoints are few and their ranges too; the ranges of one source are gone through in order.
    """
    w = Window.partitionBy(*by).orderBy("lo", "hi")
    reached = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = ranges.filter(F.col("lo") <= F.col("hi")).withColumn("_new", F.coalesce(F.col("lo") > reached + 1, F.lit(True)).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy(*by, "_island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_island")


#: The columns of the position table: one row for each change, whatever the number of its deliveries.
POSITIONS = ["entity", "binlog_file", "binlog_pos", "row_no", "file_no", "source", "number"]
ORDER = ["entity", "file_no", "binlog_pos", "row_no"]


def positions(feed: DataFrame) -> DataFrame:
    """POSITIONS of each change, each once: source and number are the parts of its gtid, null if it has none."""
    gtid = F.lower(strip(F.col("gtid")))
    slim = feed.select(
        "entity", "binlog_file", F.col("binlog_pos").cast("bigint").alias("binlog_pos"), F.col("row_no").cast("int").alias("row_no"), file_number(F.col("binlog_file")).alias("file_no"),
        F.when(gtid != "", F.substring_index(gtid, ":", 1)).alias("source"), F.when(gtid != "", F.substring_index(gtid, ":", -1)).try_cast("bigint").alias("number"),
    )
    # ranges of the order split an entity with a third of all changes, and equal changes meet in one range
    return slim.repartitionByRange(*ORDER).distinct()


def entries(table_scan: DataFrame) -> DataFrame:
    """What a manifest knows of each file: one entry for each (entity, log file, gtid source) in it, with its count and bounds."""
    return table_scan.groupBy("_file", "entity", "file_no", "source").agg(F.count("*").alias("records"), F.min("binlog_pos").alias("min_pos"), F.max("binlog_pos").alias("max_pos"), F.min("number").alias("min_no"), F.max("number").alias("max_no"))


def entry_states(entries_: DataFrame, processed: DataFrame) -> DataFrame:
    """entries with state: added (no record of it was processed), same (all were) or partial (a deletion vector decides).

    processed is last_successful(); an entity without it has only added entries.
    """
    m = entries_.join(processed.withColumn("has_state", F.lit(True)), "entity", "left")
    by_gtid = F.col("source").isNotNull() & F.col("c_sets").isNotNull()
    ranges = F.flatten(F.transform(F.filter("c_sets", lambda s: s["source"] == F.col("source")), lambda s: s["ranges"]))
    inside = F.exists(ranges, lambda r: (r["lo"] <= F.col("min_no")) & (r["hi"] >= F.col("max_no")))
    apart = ~F.exists(ranges, lambda r: (r["lo"] <= F.col("max_no")) & (r["hi"] >= F.col("min_no")))
    at = F.struct(F.col("c_file").alias("f"), F.col("c_pos").alias("p"))
    first, last = F.struct(F.col("file_no").alias("f"), F.col("min_pos").alias("p")), F.struct(F.col("file_no").alias("f"), F.col("max_pos").alias("p"))
    state = (
        F.when(F.col("has_state").isNull(), "added")
        .when(by_gtid, F.when(apart, "added").when(inside, "same").otherwise("partial"))
        .otherwise(F.when(first > at, "added").when(last <= at, "same").otherwise("partial"))
    )
    return m.withColumn("state", F.coalesce(state, F.lit("partial")))


def file_states(entry_states_: DataFrame) -> dict[str, list[str]]:
    """File names by state; a file with entries of more than one state is partial."""
    by = entry_states_.groupBy("_file").agg(F.min("state").alias("a"), F.max("state").alias("b"))
    out: dict[str, list[str]] = {"added": [], "same": [], "partial": []}
    for r in by.select("_file", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("partial").alias("state")).orderBy("_file").toLocalIterator():
        out[r["state"]].append(r["_file"])
    return out


def done(scan: DataFrame, processed: DataFrame) -> Column:
    """Of a record joined with processed: whether its entity's last successful run had it."""
    by_gtid = F.col("source").isNotNull() & F.col("c_sets").isNotNull()
    in_set = F.exists("c_sets", lambda s: (s["source"] == F.col("source")) & F.exists(s["ranges"], lambda r: F.col("number").between(r["lo"], r["hi"])))
    at = F.struct(F.col("c_file").alias("f"), F.col("c_pos").alias("p"))
    here = F.struct(F.col("file_no").alias("f"), F.col("binlog_pos").alias("p"))
    return F.col("has_state").isNotNull() & F.coalesce(F.when(by_gtid, in_set).otherwise(here <= at), F.lit(False))


def import_feed(table: VersionedTable, feed: DataFrame, states: DataFrame, records_per_file: int = 1_000_000) -> tuple[int, int]:
    """Writes a feed as files of an empty table and commits two versions of it: what the last successful runs had, and everything.

    The first lists the files that hold any processed record; a deletion vector hides the
    records of the partial ones that were not. The second lists all files. Their
    difference is what the next run must process. The numbers of both are returned.
    """
    if table.version() >= 0:
        raise ValueError(f"{table.path} has versions already")
    files = table.stage(positions(feed).sortWithinPartitions(*ORDER), records_per_file)
    processed = last_successful(states)
    vectors: list[str] = []
    have = table.scan(files)
    by = file_states(entry_states(entries(have), processed)) if files else {"added": [], "same": [], "partial": []}
    if by["partial"]:
        mixed = table.scan(by["partial"]).join(processed.withColumn("has_state", F.lit(True)), "entity", "left")
        vectors.append(table.stage_vector(mixed.filter(~done(mixed, processed))))
    before = table.commit(-1, sorted([*by["same"], *by["partial"]]), vectors)
    return before, table.commit(before, files, [])


def unprocessed(feed: DataFrame, states: DataFrame, path: str, failures: int = 0, records_per_file: int = 1_000_000) -> DataFrame:
    """entity, binlog_file, binlog_pos, row_no, each once, of the changes beyond the last successful run of their entity.

    With a gtid and a non-empty set, membership decides, else the position. An entity
    that was never processed has all its changes. The feed becomes a versioned table
    under path, the next run processes the difference of its versions, and the result
    is what the output's commits list. The first `failures` runs die after they have
    written and before they commit; they leave nothing behind.
    """
    spark = feed.sparkSession
    table, output = VersionedTable(spark, f"{path}/feed"), IncrementalOutput(spark, f"{path}/output")
    before, _ = import_feed(table, feed, states, records_per_file)
    output.adopt(before)

    def work(delta: DataFrame) -> DataFrame:
        return delta.filter(F.col("_change") == "insert").select("entity", "binlog_file", "binlog_pos", "row_no").distinct()

    def dies() -> None:
        raise RunFailed("before the commit")

    for _ in range(failures):
        try:
            output.run(table, work, dies)
        except RunFailed:
            continue
    output.run(table, work)
    return output.read()


class RunFailed(RuntimeError):
    """A run that ended before its commit."""


# ---- tables of our own ----


class VersionedTable:
    """Parquet files under path/data, deletion vectors under path/vectors, and immutable manifests path/versions/N.json.

    A manifest lists the files of its version and the vectors that apply to them. A
    vector is a Parquet table of (_file, _row); it never passes through the driver.
    Manifests hold file names only.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self) -> int:
        names = [x for x in shared.listing(self.spark, f"{self.path}/versions") if x.endswith(".json")]
        return int(names[-1][:-5]) if names else -1

    def manifest(self, version: int) -> dict[str, list[str]]:
        return {"files": [], "vectors": []} if version < 0 else shared.read_json(self.spark, f"{self.path}/versions/{version:010d}.json")

    def commit(self, base: int, files: list[str], vectors: list[str]) -> int:
        """The version after base. Two writers on one base: the second fails with FileExistsError, and its files are never listed."""
        shared.write_json(self.spark, f"{self.path}/versions/{base + 1:010d}.json", {"files": files, "vectors": vectors})
        return base + 1

    def stage(self, df: DataFrame, records_per_file: int = 0, options: dict[str, str] | None = None) -> list[str]:
        """Writes files that no version lists yet; their names. Tasks without rows leave none."""
        name = uuid.uuid4().hex
        df.write.options(maxRecordsPerFile=records_per_file, **(options or {})).parquet(f"{self.path}/data/{name}")
        return [f"{name}/{x}" for x in shared.listing(self.spark, f"{self.path}/data/{name}") if x.endswith(".parquet")]

    def append(self, df: DataFrame) -> int:
        base = self.version()
        m = self.manifest(base)
        return self.commit(base, [*m["files"], *self.stage(df)], m["vectors"])

    def stage_vector(self, marked: DataFrame) -> str:
        """Writes the (_file, _row) of marked as a vector that no version lists yet; its name."""
        name = uuid.uuid4().hex
        marked.select("_file", "_row").write.parquet(f"{self.path}/vectors/{name}")
        return name

    def scan(self, files: list[str]) -> DataFrame:
        """The records of files, with their _file and _row."""
        df = self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in files])
        name = F.concat_ws("/", F.slice(F.split("_metadata.file_path", "/"), -2, 2))
        return df.select("*", name.alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def _vectors(self, names: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.path}/vectors/{v}" for v in names]) if names else None

    def _live(self, files: list[str], vectors: list[str]) -> DataFrame:
        df, marks = self.scan(files), self._vectors(vectors)
        return df if marks is None else df.join(marks, ["_file", "_row"], "left_anti")

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(self.version() if version is None else version)
        if not m["files"]:
            raise FileNotFoundError(f"{self.path} has no files in this version")
        return self._live(m["files"], m["vectors"]).drop("_file", "_row")

    def delete(self, condition: Column) -> int:
        """A version in which the rows that meet condition are marked in a new vector."""
        base = self.version()
        m = self.manifest(base)
        if not m["files"]:
            return base
        name = self.stage_vector(self._live(m["files"], m["vectors"]).filter(condition))
        return self.commit(base, m["files"], [*m["vectors"], name])

    def compact(self) -> int:
        """Rewrites all live rows, without vectors. A consumer sees the old files go and the new ones come."""
        base = self.version()
        return self.commit(base, self.stage(self.read(base)), [])

    def changes(self, since: int, until: int) -> DataFrame:
        """The rows of the difference of two versions with _change: insert or delete.

        Files in both versions are read only if a vector that just one of them has names
        them; other files in both aren't read at all.
        """
        a, b = self.manifest(since), self.manifest(until)
        parts = []
        for here, there, kind in ((b, a, "insert"), (a, b, "delete")):
            own = [f for f in here["files"] if f not in set(there["files"])]
            if own:
                parts.append(self._live(own, here["vectors"]).withColumn("_change", F.lit(kind)))
            fresh = self._vectors([v for v in here["vectors"] if v not in set(there["vectors"])])
            if fresh is not None:
                named = {r[0] for r in fresh.select("_file").distinct().collect()} & {*here["files"]} & {*there["files"]}
                if named:
                    # hidden here and seen there: gone if here is the newer version
                    rows = self._live(sorted(named), there["vectors"]).join(fresh, ["_file", "_row"], "left_semi")
                    parts.append(rows.withColumn("_change", F.lit("delete" if kind == "insert" else "insert")))
        if not parts:
            files = [*a["files"], *b["files"]]
            if not files:
                raise FileNotFoundError(f"{self.path} has no files in these versions")
            parts = [self.scan(files[:1]).filter(F.lit(False)).withColumn("_change", F.lit(""))]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.drop("_file", "_row")


class IncrementalOutput:
    """The output of a consumer: staged folders, and commits that name the folder and the version it covers.

    Only committed folders are read. A run that fails before its commit is repeated over
    the same difference; one that committed is never repeated.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[dict]:
        names = [x for x in shared.listing(self.spark, f"{self.path}/commits") if x.endswith(".json")]
        return [shared.read_json(self.spark, f"{self.path}/commits/{x}") for x in names]

    def processed(self) -> int:
        commits = self._commits()
        return commits[-1]["version"] if commits else -1

    def adopt(self, version: int) -> None:
        """Starts from a version that runs outside of this output have processed."""
        if self._commits():
            raise ValueError(f"{self.path} has commits already")
        shared.write_json(self.spark, f"{self.path}/commits/{0:010d}.json", {"version": version, "folder": None})

    def run(self, table: VersionedTable, work: Callable[[DataFrame], DataFrame], before_commit: Callable[[], None] | None = None) -> bool:
        """Processes what came since the last commit; False if there was nothing. before_commit is called between the write and the commit."""
        commits = self._commits()
        since, until = (commits[-1]["version"] if commits else -1), table.version()
        if since == until:
            return False
        folder = uuid.uuid4().hex
        work(table.changes(since, until)).write.parquet(f"{self.path}/data/{folder}")
        if before_commit:
            before_commit()
        shared.write_json(self.spark, f"{self.path}/commits/{len(commits):010d}.json", {"version": until, "folder": folder})
        return True

    def read(self) -> DataFrame:
        folders = [c["folder"] for c in self._commits() if c["folder"]]
        if not folders:
            raise FileNotFoundError(f"{self.path} has no commit yet")
        return self.spark.read.parquet(*[f"{self.path}/data/{f}" for f in folders])
