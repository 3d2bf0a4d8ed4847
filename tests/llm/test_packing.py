import random

import pytest
from pyspark.sql import functions as F

from tidewell.llm import packing


def counts(spark, sizes):
    return spark.createDataFrame([(i, n, 0, "clash") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, bin_id int, rank string").repartition(3)


def packed(spark, sizes, capacity, lengths=(), **kw):
    """The pieces, after all that must hold of any packing was checked."""
    df = packing.pack(counts(spark, sizes), ["doc_id"], capacity, lengths, **kw)
    rows = [r.asDict() for r in df.collect()]
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_bin.setdefault(r["bin_id"], []).append(r)
    assert set(by_doc) == set(range(len(sizes)))
    for i, n in enumerate(sizes):
        ps = sorted(by_doc[i], key=lambda r: r["piece_no"])
        assert [r["piece_no"] for r in ps] == list(range(max(1, -(-n // capacity))))
        assert [r["token_start"] for r in ps] == [k * capacity for k in range(len(ps))] and sum(r["n_tokens"] for r in ps) == n
        assert all(r["n_tokens"] == capacity for r in ps[:-1])
    for b in by_bin.values():
        length = {r["bin_length"] for r in b}
        held = sum(r["n_tokens"] for r in b)
        assert len(length) == 1 and held <= (length := length.pop()) <= capacity
        shorter = [x for x in {*lengths, capacity} if x < length]
        assert not length or all(held > x for x in shorter)
    assert set(by_bin) == set(range(len(by_bin))) or not any(sizes)
    return rows, by_bin


def test_random_sizes(spark):
    r = random.Random(2)
    for lengths in ((), (16, 32)):
        sizes = [r.choice([0, 1, 5, 63, 64, 65, 200]) if r.random() < 0.5 else r.randint(1, 64) for _ in range(300)]
        rows, bins = packed(spark, sizes, 64, lengths)
        assert len(bins) <= 1.05 * sum(sizes) / 64 + 2 or lengths


def test_one_size_holds_nearly_all(spark):
    rows, bins = packed(spark, [30] * 500 + [4] * 100 + [64] * 7, 64)
    assert len(bins) == 250 + 7


def test_nothing_and_only_empty_texts(spark):
    assert packing.pack(counts(spark, []), ["doc_id"]).count() == 0
    rows, _ = packed(spark, [0, 0, 0], 64)
    assert {(r["bin_id"], r["bin_length"]) for r in rows} == {(0, 0)}


def test_empty_texts_are_dealt_out(spark):
    rows, bins = packed(spark, [64] * 4 + [0] * 8, 64)
    assert sorted(len(b) for b in bins.values()) == [3, 3, 3, 3]


def test_repeated_rows_are_items_of_their_own(spark):
    df = counts(spark, [10, 20]).union(counts(spark, [10, 20]))
    rows = packing.pack(df, ["doc_id"], 32, ()).collect()
    assert len(rows) == 4 and sum(r["n_tokens"] for r in rows) == 60


def test_plan_against_a_search_for_the_best():
    """Best fit on small cases is within one bin of the optimum."""

    def fits(sizes, bins, capacity):
        if not sizes:
            return True
        seen = set()
        for i, b in enumerate(bins):
            if b + sizes[0] <= capacity and b not in seen:
                seen.add(b)
                if fits(sizes[1:], [*bins[:i], b + sizes[0], *bins[i + 1 :]], capacity):
                    return True
        return False

    r = random.Random(7)
    for _ in range(60):
        sizes = sorted((r.randint(1, 12) for _ in range(8)), reverse=True)
        best = next(k for k in range(1, 9) if fits(sizes, [0] * k, 12))
        assert best <= packing.plan({s: sizes.count(s) for s in sizes}, (12,)).n_bins <= best + 1


def test_least_cost_lengths():
    p = packing.plan({3: 1}, (4, 8, 16), open_cost=1)
    assert p.runs == [(0, 3, 4)]
    # sizes that fill long bins go into long bins, and the last is cut down
    p = packing.plan({5: 7}, (5, 10, 20), open_cost=4)
    assert sorted(length for _, _, length in p.runs)[-1] == 20 and sum(held for _, held, _ in p.runs) <= 35
    with pytest.raises(ValueError):
        packing.plan({17: 1}, (4, 16))


def test_work_of_the_plan_hangs_on_sizes_not_items():
    r = random.Random(3)
    p = packing.plan({s: r.randint(1, 10**9) for s in range(1, 2049)}, packing.LENGTHS)
    assert len(p.segments) < 50_000
    assert p.n_bins > 10**9


def test_corpus(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    out = packing.pack_corpus(docs)
    per = out.groupBy("bin_id").agg(F.sum("n_tokens").alias("held"), F.max("bin_length").alias("length"))
    assert per.filter("held > length OR length > 2048").count() == 0 and out.select("doc_id").distinct().count() == docs.count()
    total, bins = per.agg(F.sum("held"), F.count("*")).first()
    assert bins <= 1.03 * total / 2048 + 1 and total >= 0.97 * per.agg(F.sum("length")).first()[0]
