import datetime
import gzip
import os
import time
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewell.operators import small_files
from tidewell.sources import shared

MANIFEST = "entity string, tbl string, manifest_version int, captured_at timestamp, segments array<struct<id bigint, path string, record_count bigint, created_at bigint>>, records int"
ROWS = "entity string, tbl string, segment_path string, schema_version int, row_no int, rec_key string, row_json string, n int, out_path string"


def tables(spark, manifests, rows):
    m = [("e", "t", v, datetime.datetime(2024, 1, 1), None if paths is None else [(1, p, None, 0) for p in paths], 0) for v, paths in manifests]
    return spark.createDataFrame(m, MANIFEST), spark.createDataFrame([("e", "t", p, 1, n, f"k{n}", "{}", 0, "clash") for p, n in rows], ROWS)


def test_plain_path(spark):
    paths = ["segments/a", "./segments//a/", "segments/../segments/a", " /segments/./a", "../segments/a", "x/y/../../segments/a", "", None]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(small_files.plain_path(F.col("p"))).collect()] == ["segments/a"] * 6 + ["", None]


def test_small_files_of_the_newest_manifest(spark):
    rows = [("s/a", i) for i in range(5)] * 2 + [("s/b", i) for i in range(25)] + [("s/old", 0), ("s/c", None), (None, 1)]
    m, r = tables(spark, [(1, ["s/old"]), (3, ["s/a", "./s//a", "s/b", "s/missing", None, "s/c"]), (2, ["s/old"])], rows)
    found = lambda *t: {x["segment_path"] for x in small_files.small_files(*t, shared.scratch_path(spark, "s")).collect()}
    assert found(m, r) == {"s/a", "s/c"}
    assert found(*tables(spark, [], [])) == set() == found(*tables(spark, [(1, None)], rows))


def test_compaction_keeps_every_record_once_in_full_files(spark):
    rows = [(f"s/{f}", i) for f in range(30) for i in range(f)] + [("s/7", i) for i in range(7)] + [("s/big", i) for i in range(950)] + [("s/gone", 1), ("s/8", None), ("s/8", None)]
    m, r = tables(spark, [(1, [f"s/{f}" for f in range(30)] + ["s/big"])], rows)
    # two records under one number stay two
    r = r.union(r.filter("segment_path = 's/9' AND row_no = 3").withColumn("row_json", F.lit('{"a": "é\\n"}')))
    out, done = small_files.compact_segments(m, r, shared.scratch_path(spark, "c"), full=200)
    got = [tuple(x) for x in out.select(*small_files.RECORD).collect()]
    want = {tuple(x) for x in r.filter("segment_path <> 's/gone'").select(*small_files.RECORD).collect()}
    assert len(got) == len(set(got)) and set(got) == want and len([x for x in got if x[2] == "s/9" and x[4] == 3]) == 2
    sizes = sorted(x["count"] for x in out.groupBy("out_path").count().collect())
    assert sizes[1:] == [200] * (len(sizes) - 1) and len(sizes) == -(-len(got) // 200)
    # those without a number come in a file of their own
    assert done == {"files_before": 31, "files_after": len(sizes), "records": len(got)}


def test_a_file_is_one_segment_or_part_of_a_large_one(spark, monkeypatch):
    monkeypatch.setattr(small_files, "PART", 100)
    rows = [(f"s/{f}", i) for f in range(200) for i in range(3)] + [("s/big", i) for i in range(250)]
    path = shared.scratch_path(spark, "w")
    small_files.write_segments(*tables(spark, [(1, sorted({p for p, _ in rows}))], rows), path, 7)
    by_file = small_files.read_records(spark.read.text(path), F.col("_metadata.file_path").alias("f")).withColumnRenamed("segment_path", "p").groupBy("f").agg(F.collect_set("p").alias("p"), F.count("*").alias("n")).collect()
    assert len(by_file) == 203 and all(len(x["p"]) == 1 for x in by_file) and sorted(x["n"] for x in by_file) == [3] * 200 + [50, 100, 100]


def test_shuffles_of_the_layout_go_with_it(spark):
    rows = [(f"s/{f}", i) for f in range(20) for i in range(50)]
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def held():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before, path, was = held(), shared.scratch_path(spark, "w"), dict(spark.conf.getAll)
    small_files.write_segments(*tables(spark, [(1, sorted({p for p, _ in rows}))], rows), path, 3)
    end = time.time() + 10
    while held() - before and time.time() < end:
        time.sleep(0.1)
    assert not held() - before and dict(spark.conf.getAll) == was


def test_any_text_is_read_back_as_it_was(spark):
    texts = ["", "\\", "\\N", "\\0", "\\1", "\\\\1", "a\tb", "\n", "\r\n", "\\t", "0\\", "\\\t0", None, "é\x85\u2028", "\\\\N", '{"a": "x\\n"}']
    df = spark.createDataFrame([(x,) for x in texts], "x string").select("x", small_files.escaped(F.col("x")).alias("e"))
    got = df.select("x", "e", small_files.unescaped(F.col("e")).alias("u")).collect()
    assert all(r["x"] == r["u"] and not set("\t\n\r") & set(r["e"]) for r in got) and len({r["e"] for r in got}) == len(texts)
    m, r = tables(spark, [(1, [f"s/{i}" for i in range(len(texts))])], [(f"s/{i}", i) for i in range(len(texts))])
    r = r.drop("rec_key", "row_json").join(spark.createDataFrame([(i, x, x) for i, x in enumerate(texts)], "row_no int, rec_key string, row_json string"), "row_no")
    out, _ = small_files.compact_segments(m, r, shared.scratch_path(spark, "t"))
    assert {(x["row_no"], x["rec_key"], x["row_json"]) for x in out.collect()} == {(i, x, x) for i, x in enumerate(texts)}


def test_files_off_a_local_disk_hold_the_same(spark, monkeypatch):
    rows = [(f"s/{f}", i) for f in range(9) for i in range(f)] + [("s/1", None)]
    made = []
    for local in (True, False):
        if not local:
            monkeypatch.setattr(shared, "local_path", lambda *_: None)
        path = shared.scratch_path(spark, "w")
        small_files.write_segments(*tables(spark, [(1, [f"s/{f}" for f in range(9)])], rows), path, 3)
        made.append(sorted((f.parent.name, gzip.decompress(f.read_bytes())) for f in Path(path.removeprefix("file://")).glob("g=*/*.gz")))
    assert made[0] == made[1] and len(made[0]) == 9 and all(v.endswith(b"\n") for _, v in made[0])


def test_a_second_attempt_changes_nothing(spark, tmp_path):
    batch = pa.RecordBatch.from_pydict({"g": pa.array([0, 1], pa.int32()), "name": ["a", "b"], "value": [b"x\ny", "é".encode()]})
    assert [b["n"].to_pylist() for _ in range(2) for b in small_files._on_disk(str(tmp_path))(iter([batch]))] == [[2], [2]]
    assert {str(f.relative_to(tmp_path)): gzip.decompress(f.read_bytes()).decode() for f in tmp_path.rglob("*") if f.is_file()} == {"g=0/a.txt.gz": "x\ny\n", "g=1/b.txt.gz": "é\n"}


def test_lines_of_files_read_whole(spark, tmp_path, monkeypatch):
    for i, text in enumerate(["", "\n", "a", "a\n", "a\n\n", "\né\n b ", "c\n" * 500]):
        (tmp_path / f"{i}.txt").write_text(text)
        (tmp_path / f"{i}.txt.gz").write_bytes(gzip.compress(text.encode()))
    r = spark.read.option("recursiveFileLookup", "true")
    name = F.col("_metadata.file_name").alias("f")
    want = sorted(tuple(x) for x in r.text(str(tmp_path)).select("value", name).collect())
    whole = small_files.lines_of(r.format("binaryFile").load(str(tmp_path)), name)
    assert sorted(tuple(x) for x in whole.collect()) == want and len(want) == 1016
    batch = pa.RecordBatch.from_pydict({"content": [f"{i}\n{i}".encode() for i in range(9)], "path": [str(i) for i in range(9)], "f": list(range(9))})
    monkeypatch.setattr(small_files, "LINES_BYTES", 4)
    made = list(small_files._split(iter([batch])))
    assert len(made) == 5 and [(int(v), f) for b in made for v, f in zip(b["value"].to_pylist(), b["f"].to_pylist(), strict=True)] == [(i, i) for i in range(9) for _ in "ab"]
    with pytest.raises(ValueError):
        list(small_files._split(iter([pa.RecordBatch.from_pydict({"content": [b""], "path": ["7.txt.bz2"]})])))


def written(spark, path, n=1000, files=60):
    df = spark.range(n).withColumn("v", F.when(F.col("id") % 7 != 0, F.col("id").cast("string")))
    df = df.union(df.limit(3))
    df.repartition(files).write.parquet(path)
    return df


def test_directory_of_real_files(spark, tmp_path):
    df = written(spark, str(tmp_path / "in"))
    done = small_files.compact_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), 1 << 20, 1 << 10)
    assert done == {"files_before": 60, "files_after": 1, "records": 1003}
    assert small_files.fingerprint(spark.read.parquet(str(tmp_path / "out")), ["id", "v"]) == small_files.fingerprint(df, ["id", "v"])
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".parquet")]) == 1
    assert spark.conf.get("spark.sql.files.openCostInBytes") in ("4194304", "4194304b", "4MB")
    with pytest.raises(FileExistsError):
        small_files.compact_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"))


def test_a_column_of_some_files_alone_is_kept(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "in" / "a"))
    spark.range(3).withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "in" / "b"))
    for groups in (None, ["a", "b"]):
        out = str(tmp_path / f"out{len(groups or [])}")
        assert small_files.compact_directory(spark, str(tmp_path / "in"), out, groups=groups)["records"] == 6
        assert sorted(tuple(r) for r in spark.read.option("mergeSchema", "true").parquet(out).select("id", F.coalesce("extra", F.lit("-"))).collect()) == [(i, e) for i in range(3) for e in "-x"]
    with pytest.raises(ValueError):
        small_files.compact_directory(spark, str(tmp_path / "in"), str(tmp_path / "no"), source_format="csv")


def test_open_cost_decides_how_many_files_a_task_reads(spark, tmp_path):
    written(spark, str(tmp_path / "in"), files=40)
    read = lambda cost: small_files.compact_directory(spark, str(tmp_path / "in"), str(tmp_path / f"o{cost}"), 1 << 20, cost)
    assert read(1 << 10)["files_after"] == 1 == read(1 << 18)["files_after"]


def test_the_write_has_no_exchange(spark, tmp_path):
    seen = []
    df = written(spark, str(tmp_path / "in"))
    real = small_files.functools.reduce
    small_files.functools.reduce = lambda f, parts: seen.append(real(f, parts)) or seen[-1]
    try:
        small_files.compact_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    finally:
        small_files.functools.reduce = real
    assert "Exchange" not in seen[0]._jdf.queryExecution().executedPlan().toString() and df.count() == 1003


def test_a_loss_is_noticed_and_nothing_is_published(spark, tmp_path, monkeypatch):
    written(spark, str(tmp_path / "in"))
    real = small_files.fingerprint
    monkeypatch.setattr(small_files, "fingerprint", lambda df, columns: real(df.filter("id <> 3"), columns))
    with pytest.raises(small_files.LossError):
        small_files.compact_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and not (tmp_path / "out.stage").exists()


def test_fingerprints_tell_bags_apart_and_hold_for_many_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "a"), ("b", "b")], "x string, y string")
    p = lambda d: small_files.fingerprint(d, ["x", "y"])
    assert p(df) == p(df.repartition(3)) != p(df.union(df)) and p(df.filter("x = 'a'")) != p(df.filter("y = 'a'"))
    assert all(0 <= v < 1 << 22 for v in p(df.limit(1))[2:]) and p(df.limit(0))[0] == 0


def test_of_two_writers_of_one_name_one_fails(spark, tmp_path):
    shared.write_json(spark, str(tmp_path / "c" / "0.json"), {"a": 1})
    with pytest.raises(FileExistsError):
        shared.write_json(spark, str(tmp_path / "c" / "0.json"), {"a": 2})
    assert shared.read_json(spark, str(tmp_path / "c" / "0.json")) == {"a": 1}
    assert [f for f in os.listdir(tmp_path / "c") if not f.startswith(".")] == ["0.json"]
