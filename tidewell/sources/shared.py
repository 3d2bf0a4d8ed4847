"""The folder that all executors share, and small atomic files in it.

Everything goes through Hadoop's FileSystem, so that the same code runs on a
local disk, HDFS or an object store.
"""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

_scratch: list[tuple[SparkSession, str]] = []
_scratch_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset (tests), a folder of our own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        have = sc.getCheckpointDir()
        if have:
            return have
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tidewell-")
        sc.setCheckpointDir(found)
        return found
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it is removed when the process ends."""
    path = f"{shared_dir(spark).rstrip('/')}/tidewell/{name}-{uuid.uuid4().hex}"
    if not _scratch:
        atexit.register(_sweep)
    _scratch.append((spark, path))
    return path


def scratch_table(spark: SparkSession, name: str) -> None:
    """A catalog entry that goes when the process ends."""
    if not _scratch_tables:
        atexit.register(_drop_tables)
    _scratch_tables.append((spark, name))


def _drop_tables() -> None:
    for spark, name in _scratch_tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the session may be gone by now
            return


@contextlib.contextmanager
def own_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go at its end, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if was is None else spark.conf.set(name, was)


def kept(df, name: str):
    """df as a table in the shared folder, without its lineage: what is used more than once, or must not change between uses."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _sweep() -> None:
    for spark, path in _scratch:
        try:
            delete(spark, path)
        except Exception:  # the session may be gone by now
            return


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it, if it is one of a local disk."""
    fs, p = _path(spark, path)
    return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def rename(spark: SparkSession, source: str, target: str) -> None:
    """Moves a folder to a name that is free; FileExistsError if it isn't.

    FileContext never replaces a target; on HDFS the test and the move are one step.
    Commits of one file go through publish(), which is one step elsewhere too.
    """
    fs, p = _path(spark, source)
    hadoop = spark._jvm.org.apache.hadoop.fs
    q = hadoop.Path(target)
    fs.mkdirs(q.getParent())
    context = hadoop.FileContext.getFileContext(p.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    try:
        context.rename(p, q, spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0))
    except Py4JJavaError as e:
        if fs.exists(q):
            raise FileExistsError(target) from e
        raise


def publish(spark: SparkSession, part: str, target: str) -> None:
    """Gives a whole written file the name target, of several writers to just one; FileExistsError for the others.

    A local disk has hard links that never replace; HDFS renames in one step; elsewhere
    (object stores) the file is created anew on condition that there is none.
    """
    fs, p = _path(spark, part)
    q = spark._jvm.org.apache.hadoop.fs.Path(target)
    scheme = fs.getUri().getScheme()
    try:
        if scheme == "file":
            nio = spark._jvm.java.nio.file
            nio.Files.createLink(nio.Path.of(q.toUri().getPath(), _strings(spark)), nio.Path.of(p.toUri().getPath(), _strings(spark)))
        elif scheme == "hdfs":
            return rename(spark, part, target)
        else:
            _write(fs, q, _read(fs, p), False)
    except Py4JJavaError as e:
        if fs.exists(q):
            raise FileExistsError(target) from e
        raise
    finally:
        fs.delete(p, False)


def _strings(spark: SparkSession):
    return spark.sparkContext._gateway.new_array(spark._jvm.java.lang.String, 0)


def _write(fs, p, data: bytes, overwrite: bool) -> None:
    stream = fs.create(p, overwrite)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def _read(fs, p) -> bytes:
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes())
    finally:
        stream.close()


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, in order; none if there is no folder."""
    fs, p = _path(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(_read(*_path(spark, path)).decode())


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written aside and published: a reader sees all of it or nothing, and of two writers one fails with FileExistsError."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    fs, p = _path(spark, part)
    fs.mkdirs(p.getParent())
    _write(fs, p, json.dumps(value).encode(), True)
    publish(spark, part, path)
