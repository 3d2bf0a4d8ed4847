"""Few well-sized files from many small ones.

compact_directory works on real files with the engine's own split packing: the
maximum partition bytes and the cost of opening a file decide how many files one
task reads, the tasks are coalesced without a shuffle, the output is staged, its
records are held against those read, and only then it is published.

The test tables hold the records of files as rows of one table. write_segments lays
the listed files out as real small files of lines first; compact_segments then
compacts them, and what it took up and wrote is read back from its output.
"""

from __future__ import annotations

import functools
import gzip
import math
import os
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.sources import shared

TABLE = ["entity", "tbl"]
FILE = [*TABLE, "segment_path"]
RECORD = ["entity", "tbl", "segment_path", "schema_version", "row_no", "rec_key", "row_json"]
RECORD_TYPE = "entity string, tbl string, segment_path string, schema_version int, row_no int, rec_key string, row_json string"
SMALL, FULL = 20, 200
#: Formats whose files can be read without losing a column that only some of them have; JSON lines and the like are text.
FORMATS = ("parquet", "orc", "text")
#: Records of one segment that write_segments puts into one file, and files of a table for one of its tasks.
PART, TASK_FILES = 1000, 4096
KEY_LENGTH = 16
#: What a cell of a line can't hold as it is, and what follows the backslash that stands for it.
ESCAPES = {"\\": "0", "\t": "1", "\n": "2", "\r": "3"}
#: Names of text files that Spark would read by another codec than gzip; bytes of lines that leave a Python worker at once.
OTHER_CODECS, LINES_BYTES = (".bz2", ".deflate", ".lz4", ".snappy", ".zst", ".xz"), 4 << 20
#: Files of lines are compressed and, on a local disk, written without the checksum files that Hadoop puts beside each.
SCRATCH = {"compression": "gzip", "fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def plain_path(path: Column) -> Column:
    """A path without '.', '..', doubled or trailing slashes. Steps above the root are dropped."""
    parts = F.filter(F.split(F.trim(path), "/+"), lambda x: ~x.isin("", "."))
    empty = F.array().cast("array<string>")
    kept = F.aggregate(parts, empty, lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    return F.array_join(kept, "/")


def newest_listing(manifests: DataFrame) -> DataFrame:
    """TABLE and segment_path, each once, of the files that the highest manifest_version of each table lists, and `spread`: how many tasks the table is worth."""
    newest = manifests.groupBy(*TABLE).agg(F.max(F.struct("manifest_version", "captured_at", F.col("segments.path").alias("paths"))).alias("m"))
    spread = F.ceil(F.size("m.paths") / TASK_FILES).cast("int").alias("spread")
    listed = newest.select(*TABLE, spread, F.explode("m.paths").alias("path")).filter(F.col("path").isNotNull())
    return listed.select(*TABLE, plain_path(F.col("path")).alias("segment_path"), "spread").distinct()


def held_records(rows: DataFrame) -> DataFrame:
    """RECORD. A null path is ''."""
    return rows.select(*[F.coalesce(c, F.lit("")).alias(c) if c == "segment_path" else c for c in RECORD])


def escaped(text: Column) -> Column:
    """A text without tabs and line ends; null is a text too."""
    made = text
    for x, code in ESCAPES.items():
        made = F.replace(made, F.lit(x), F.lit(f"\\{code}"))
    return F.coalesce(F.when(text.rlike(r"[\\\t\n\r]"), made).otherwise(text), F.lit("\\N"))


def unescaped(text: Column) -> Column:
    """The text that escaped was given. A backslash always begins a code, so none is found across two; its own code goes last."""
    made = text
    for x, code in reversed(ESCAPES.items()):
        made = F.replace(made, F.lit(f"\\{code}"), F.lit(x))
    return F.when(~F.contains(text, F.lit("\\")), text).when(text != "\\N", made)


def read_records(lines: DataFrame, *more: Column) -> DataFrame:
    """RECORD and more of the lines of segment files."""
    names = dict(c.split(" ") for c in RECORD_TYPE.split(", "))
    held = lines.select(F.split("value", "\t").alias("r"), *more)
    return held.select(*[unescaped(F.get("r", F.lit(i))).cast(k).alias(n) for i, (n, k) in enumerate(names.items(), 1)], *[c for c in held.columns if c != "r"])


def _cells(records: DataFrame, *keys: str) -> DataFrame:
    """keys and, as `cells`, what else their records hold, each once."""
    cells = F.concat_ws("\t", *[escaped(F.col(c).cast("string")) for c in RECORD if c not in FILE])
    return records.select(*keys, cells.alias("cells")).groupBy(*keys).agg(F.collect_set("cells").alias("cells"))


def _files(cells: DataFrame, groups: int) -> DataFrame:
    """One row a file: its group g, a name and its lines as value. A line is a key of its table and RECORD, between tabs."""
    g = F.pmod(F.xxhash64(*TABLE, F.pmod(F.xxhash64("segment_path", "part"), "spread")), F.lit(groups)).cast("int")
    head = F.concat_ws("\t", F.lpad(F.hex(F.xxhash64(*TABLE)), KEY_LENGTH, "0"), *[escaped(F.col(c)) for c in FILE], F.lit(""))
    heads = cells.select(g.alias("g"), head.alias("head"), F.md5(F.concat(head, "part")).alias("name"), F.array_sort("cells").alias("cells"))
    return heads.select("g", "name", F.concat("head", F.call_function("array_join", "cells", F.concat(F.lit("\n"), "head"))).alias("value"))


def _on_disk(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Writes the files of a task. A name is the same in each attempt and comes with the whole file, so a second attempt changes nothing."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = set()
        for batch in batches:
            for g, name, value in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g not in made:
                    os.makedirs(f"{folder}/g={g}", exist_ok=True)
                    made.add(g)
                part = f"{folder}/g={g}/.{name}.{uuid.uuid4().hex}"
                with open(part, "xb") as f:
                    f.write(zlib.compress(value + b"\n", wbits=31))
                os.replace(part, f"{folder}/g={g}/{name}.txt.gz")
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return put


def write_segments(manifests: DataFrame, rows: DataFrame, path: str, groups: int) -> None:
    """Each listed segment that exists as a small file of lines of its own, in the folder path/g=<group>.

    Equal rows are one record; all others stay, also those without a row number or with
    the number of another. The files of a table lie in one folder, those of a table of
    many files in several. A segment of more than PART records comes in parts; the first
    is gathered before its shuffle, so that only one row a segment and task is shuffled,
    and written where the join with the listing leaves it; the others are dealt out, so no
    task has to go through a large segment alone. The shuffles go with the write. On a
    local disk Hadoop starts a process for each file that it makes, to set its permissions:
    files are written without it there.
    """
    spark, listing = rows.sparkSession, newest_listing(manifests)
    none = -1 - F.pmod(F.xxhash64("rec_key", "row_json"), F.lit(64))
    first = F.col("row_no") < PART
    near = _cells(held_records(rows.filter(first)), *FILE).withColumn("part", F.lit(0)).join(listing, FILE)
    rest = held_records(rows.filter(~F.coalesce(first, F.lit(False)))).withColumn("part", F.coalesce(F.floor(F.col("row_no") / PART), none).cast("int"))
    far = _cells(rest.join(listing, FILE).repartition(*FILE, "part"), *FILE, "part", "spread")
    files, folder = _files(near, groups).unionByName(_files(far, groups)), shared.local_path(spark, path)
    with shared.own_shuffles(spark):
        if folder:
            files.withColumn("value", F.col("value").cast("binary")).mapInArrow(_on_disk(folder), "n bigint").write.format("noop").mode("overwrite").save()
        else:
            files.drop("name").write.partitionBy("g").option("maxRecordsPerFile", 1).options(**SCRATCH).text(path)


class LossError(RuntimeError):
    """The staged output doesn't hold the records of the input."""


def _marks(columns: list[str]) -> dict[str, Column]:
    """Count, exclusive or and three sums of row hashes: equal for equal bags of rows, in any order and over any number of files.

    The sums are of 21 or 22 bits each, so they hold for a trillion rows. Nulls are hashed too.
    """
    cols = [F.col(f"`{c}`") for c in columns]
    h = F.xxhash64(*cols, *[c.isNull() for c in cols])
    cut = [h.bitwiseAND(F.lit((1 << 21) - 1)), F.shiftrightunsigned(h, 21).bitwiseAND(F.lit((1 << 21) - 1)), F.shiftrightunsigned(h, 42)]
    return {"n": F.count(F.lit(1)), "x": F.coalesce(F.bit_xor(h), F.lit(0)), **{f"s{i}": F.coalesce(F.sum(c), F.lit(0)) for i, c in enumerate(cut)}}


def fingerprint(df: DataFrame, columns: list[str]) -> tuple[int, ...]:
    r = df.agg(*[c.alias(n) for n, c in _marks(columns).items()]).first()
    return tuple(r)


def packed_session(spark: SparkSession, file_bytes: int, open_cost: int) -> SparkSession:
    """A session like spark that combines small files into splits of file_bytes, each file counting open_cost bytes more."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    own.conf.set("spark.sql.files.maxPartitionBytes", file_bytes)
    own.conf.set("spark.sql.files.openCostInBytes", open_cost)
    # a listing of many folders is a job: of as many tasks as there are cores, not one a folder
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.defaultParallelism)
    # in a union every group of files stays a task of its own
    own.conf.set("spark.sql.unionOutputPartitioning", "false")
    return own


def compact_directory(
    spark: SparkSession, source: str, out: str, file_bytes: int = 128 << 20, open_cost: int = 4 << 20, source_format: str = "parquet", groups: list[str] | None = None, most_records: int = 0, partition: dict[str, Column] | None = None, options: dict[str, str] | None = None, whole: bool = False,
) -> dict[str, int]:
    """Consolidates the files under source into files of about file_bytes each at out (which must not exist yet).

    open_cost is what opening one more file counts in bytes when splits are combined: the
    lower, the more small files one task reads. The settings are made in a session of
    their own. groups names folders under source that are packed each by itself, so that
    files of different groups never meet. most_records bounds a file. With partition
    (name: value made from the columns of source), files are written apart by these
    values; options are those of the writer. whole says that the files under source are
    lines, plain or by gzip, of which each fits in memory: it is read at once, as those
    written are if most_records bounds them. Columns are the union of those of all files; text files are kept line by line.
    Returns files and records before and after. Raises LossError, with nothing
    published, if a record is lost, doubled or changed: what is written is counted as it
    is read, and held against what the staged files hold.
    """
    if source_format not in FORMATS:
        raise ValueError(f"'{source_format}' can't be compacted without loss; one of {', '.join(FORMATS)}")
    if whole and (source_format != "text" or options and options.get("compression", "none") not in ("none", "gzip")):
        raise ValueError("only lines, plain or by gzip, are read whole")
    own = packed_session(spark, file_bytes, open_cost)
    own.conf.set("spark.sql.files.minPartitionNum", 1)
    schema = own.read.format(source_format).option("mergeSchema", "true").option("recursiveFileLookup", "true").load(source).schema if groups and source_format != "text" else None
    parts, before = [], 0
    for g in groups or [""]:
        r = own.read.format(source_format).option("mergeSchema", "true").option("recursiveFileLookup", "true")
        df = (r.schema(schema) if schema else r.format("binaryFile") if whole else r).load(f"{source}/{g}".rstrip("/"))
        files, size = _listed_files(df)
        df = lines_of(df) if whole else df
        before += files
        parts.append(df.coalesce(max(1, math.ceil(size / file_bytes))))
    df = functools.reduce(DataFrame.unionByName, parts)
    columns = df.columns
    seen = Observation()
    stage = f"{out.rstrip('/')}.stage"
    made = df.observe(seen, *[c.alias(n) for n, c in _marks(columns).items()]).withColumns(partition or {})
    w = made.write.mode("overwrite").format(source_format).option("maxRecordsPerFile", most_records).options(**(options or {}))
    (w.partitionBy(*partition) if partition else w).save(stage)
    r, again = own.read.option("recursiveFileLookup", "true"), whole and most_records > 0
    staged = r.format("binaryFile").load(stage) if again else r.format(source_format).schema(df.schema).load(stage)
    after = _listed_files(staged)[0]
    staged = lines_of(staged) if again else staged
    want, have = tuple(seen.get[n] for n in _marks(columns)), fingerprint(staged, columns)
    if want != have:
        shared.delete(spark, stage)
        raise LossError(f"{want} in, {have} out")
    shared.rename(spark, stage, out)
    return {"files_before": before, "files_after": after, "records": have[0]}


def lines_of(files: DataFrame, *more: Column) -> DataFrame:
    """The lines of files read as binaryFile, plain or by gzip, and more.

    For each text file that it reads, Spark copies the whole Hadoop configuration, which
    takes longer than a small file itself; for a binary one it doesn't.
    """
    held = files.select("content", "path", *more)
    kind = T.StructType([T.StructField("value", T.BinaryType()), *held.schema.fields[2:]])
    return held.mapInArrow(_split, kind).withColumn("value", F.col("value").cast("string"))


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of files and the other columns of their rows, in batches of a few MB or one file."""
    for batch in batches:
        begin, lines, counts, size = 0, [], [], 0
        for i, (content, path) in enumerate(zip(batch["content"].to_pylist(), batch["path"].to_pylist(), strict=True), 1):
            if path.endswith(OTHER_CODECS):
                raise ValueError(f"{path} is neither plain nor by gzip")
            data = gzip.decompress(content) if path.endswith(".gz") else content
            own = data.split(b"\n")
            if not own[-1]:  # what follows the last line end is no line if it is empty
                own.pop()
            lines += own
            counts.append(len(own))
            size += len(data)
            if size > LINES_BYTES or i == batch.num_rows:
                at = pa.array(np.repeat(np.arange(begin, i), counts))
                columns = {"value": pa.array(lines, pa.binary())} | {n: batch[n].take(at) for n in batch.schema.names[2:]}
                yield pa.RecordBatch.from_pydict(columns)
                begin, lines, counts, size = i, [], [], 0


def _listed_files(df: DataFrame) -> tuple[int, int]:
    """How many files df reads and their bytes, from the listing that its scan has made already."""
    scan = df._jdf.queryExecution().analyzed().collectLeaves().head().relation().location()
    return len(scan.inputFiles()), scan.sizeInBytes()


def compact_segments(manifests: DataFrame, rows: DataFrame, path: str, full: int = FULL, file_bytes: int = 128 << 20, open_cost: int = 1 << 10) -> tuple[DataFrame, dict[str, int]]:
    """Lays out the listed segments as files under path, compacts them, and reads the output back: RECORD and out_path.

    Files of a table come together by its folder and are written apart by table, up to
    `full` records each; the small files go once these are published. Also returns the counts of compact_directory, all 0 if nothing
    is listed.
    """
    spark = rows.sparkSession
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    source, out = f"{path}/small", f"{path}/large"
    write_segments(manifests, rows, source, groups)
    folders = [x for x in shared.listing(spark, source) if x.startswith("g=")]
    if not folders:
        return spark.createDataFrame([], f"{RECORD_TYPE}, out_path string"), {"files_before": 0, "files_after": 0, "records": 0}
    # a line starts with the key of its table
    done = compact_directory(spark, source, out, file_bytes, open_cost, "text", folders, full, {"table": F.substring("value", 1, KEY_LENGTH)}, SCRATCH, whole=True)
    shared.delete(spark, source)
    r, at = packed_session(spark, file_bytes, open_cost).read.option("recursiveFileLookup", "true"), F.col("_metadata.file_path").alias("out_path")
    back = lines_of(r.format("binaryFile").load(out), at) if full > 0 else r.text(out).select("value", at)
    return read_records(back, F.col("out_path")), done


def small_files(manifests: DataFrame, rows: DataFrame, path: str, below: int = SMALL) -> DataFrame:
    """TABLE, segment_path of the files with fewer records than below that a compaction has taken up and written anew.

    A record is a row number; files whose rows have none hold no record and are small.
    """
    records, _ = compact_segments(manifests, rows, path)
    counted = records.groupBy(*TABLE, "segment_path").agg(F.count_distinct("row_no").alias("records"))
    return counted.filter(F.col("records") < below).select(*TABLE, "segment_path")
