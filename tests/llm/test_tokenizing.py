import base64
import random
from pathlib import Path

import numpy as np
import pytest
import regex

from tidewell.llm import tokenizing as t

pytestmark = pytest.mark.skipif(not Path(t.VOCABULARY).exists(), reason="no vocabulary file here")


@pytest.fixture(scope="module")
def own():
    return t.encoder(Path(t.VOCABULARY).read_bytes())


@pytest.fixture(scope="module")
def others():
    import tiktoken
    from tokenizers import Tokenizer

    hf = Tokenizer.from_file(t.VOCABULARY)
    hf.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(t.VOCABULARY).with_suffix(".tiktoken").open("rb"))}
    tt = tiktoken.Encoding("own", pat_str=t.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda s: hf.encode(s, add_special_tokens=False).ids, tt.encode_ordinary


def ids(own, s):
    return np.frombuffer(own.encode(s), "<i4").tolist()


def brute(own, s):
    """Every merge looks at all pairs."""
    out = []
    for piece in regex.findall(t.PATTERN, s):
        part = [own.of_byte[b] for b in piece.encode()]
        while True:
            ranked = [(own.merges[k], i) for i in range(len(part) - 1) if (k := part[i] << 32 | part[i + 1]) in own.merges]
            if not ranked:
                break
            (_, merged), i = min(ranked, key=lambda r: (r[0][0], r[1]))
            part[i : i + 2] = [merged]
        out += part
    return out


ODD = ["", " ", "\n", "a", " a", "a ", "  a b  c \n d\t e  ", " \x1cfoo \x1f bar\x85x \xa0y", "<|endoftext|> hi", "日本語 テキスト 😀 😀😀", "'s't're 've I'LL", "1234 56 \r\n\r\n 78", "İstanbul ÀÉ ño ñ", "é" * 700, "x y\x85z w", "aaaaaaaaaaaaaaaaa", "ab" * 800, "﻿x", "a\x00b"]


def test_agrees_with_other_libraries_and_brute_force(own, others):
    r = random.Random(4)
    letters = "ab \n\t\x1c\x1f\x85\xa0é1'’. 　日"
    texts = ODD + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(3000)]
    for s in texts:
        want = others[0](s)
        assert ids(own, s) == want == others[1](s), s
        if len(s) < 60:
            assert brute(own, s) == want


def test_a_full_memo_changes_nothing(own, monkeypatch):
    monkeypatch.setattr(t, "MEMO", 3)
    fresh = t.Encoder(Path(t.VOCABULARY).read_bytes())
    s = "the court of appeal held that the order was void " * 3
    assert fresh.encode(s) == own.encode(s)


def test_a_very_long_piece_takes_no_quadratic_time(own, others):
    s = "".join(random.Random(1).choice("abcdefgh") for _ in range(200_000))
    assert ids(own, s) == others[1](s)


def test_corpus_rows(spark, own):
    rows = [(1, None, "x", 5), (2, "", "x", 5), (3, "Hello  world", "y", 6), (3, "Hello  world", "y", 6), (None, "lone", None, None), (4, "long " * 30_000, "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = sorted(((r["doc_id"], r["ids"]) for r in t.encode_corpus(df, ["doc_id"]).collect()), key=str)
    assert got == sorted(((a, ids(own, b)) for a, b, *_ in rows), key=str)
    n = sorted(((r["doc_id"], r["n_tokens"]) for r in t.token_counts(df, ["doc_id"]).collect()), key=str)
    assert n == sorted(((a, len(ids(own, b))) for a, b, *_ in rows), key=str)
    assert t.encode_corpus(df.limit(0), ["doc_id"]).count() == 0


def test_decoding_gives_the_text_back(spark, small, own):
    back = {own.of_byte[b]: bytes([b]) for b in range(256)}
    for k, (_, merged) in sorted(own.merges.items(), key=lambda x: x[1][0]):
        back[merged] = back[k >> 32] + back[k & 0xFFFFFFFF]
    docs = spark.read.parquet(f"{small}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    for r in t.encode_corpus(docs, ["doc_id"]).collect():
        assert b"".join(back[i] for i in r["ids"]).decode() == (texts[r["doc_id"]] or "")
