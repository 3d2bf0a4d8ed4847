import random
import unicodedata
from pathlib import Path

import duckdb
import numpy as np
import pytest

from tidewell.llm import queries
from tidewell.llm import repetition as rp

SQUEEZE = rp.compressor().compress


def brute(text):
    """Words and words in repetition, letter by letter and run by run."""
    text = unicodedata.normalize("NFC", text or "")
    words = [w.lower() for w in "".join(c if unicodedata.category(c)[0] == "L" else " " for c in text).split()]
    marked = set()
    for i in range(len(words) - 9):
        if any(words[j : j + 10] == words[i : i + 10] for j in range(i)):
            marked |= set(range(i, i + 10))
    return words, len(marked)


def cases():
    r = random.Random(8)
    vocabulary = ["der", "Gericht", "sentencia", "court", "año", "año", "STRASSE", "straße", "x²y", "Ⅷ", "3rd", "o'clock", "日本", "Œuvre"]
    out = ["", None, "12 34 !!", "a " * 30, "one two three four five six seven eight nine ten " * 2]
    for _ in range(150):
        words = [r.choice(vocabulary) + ("" if r.random() < 0.6 else str(r.randint(0, 40)) + r.choice("abcdefgh") * r.randint(0, 3)) for _ in range(r.randint(1, 120))]
        if r.random() < 0.6:
            at = r.randint(0, len(words) - 1)
            words += words[at : at + r.randint(5, 40)] * r.randint(1, 3)
        out.append(" ".join(w.upper() if r.random() < 0.2 else w for w in words))
    return out


def test_words_and_repeated_words_match_brute_force():
    for text in cases():
        words, n = brute(text)
        assert rp.words(text) == words and rp.repeated(rp.numbered(text)) == n, text


def test_words_of_pieces_are_those_of_the_whole():
    r = random.Random(3)
    text = "".join(r.choice(["e\u0301", "n\u0303 ", "a", "B", " ", "  ", "\u0301", ".", "Σ", "\n", "7"]) for _ in range(4000))
    found = rp.words(text)
    ids = rp.numbered(text)
    assert [w for p in rp.pieces(text, 50) for w in rp.words(p)] == found and len(ids) == len(found)
    assert len({*zip(found, ids.tolist())}) == len({*found}) == len({*ids.tolist()})


def test_hashes_tell_words_apart_as_numbers_do():
    for text in [*cases(), "İstanbul ΣΑΣ σας istanbul " * 3, "a" * 300_000 + " b", "é" * 10, "\U00020000x \U00020000X"]:
        ids, codes = rp.numbered(text), rp.hashed(text)
        assert len(ids) == len(codes) and len({*zip(ids.tolist(), codes.tolist())}) == len({*ids.tolist()}) == len({*codes.tolist()})
    ids = rp.hashed(" ".join(worded(range(50_000), k) for k in ("latin", "hangul", "alike")))
    assert len(np.unique(ids)) == len(np.unique(rp.numbered(" ".join(worded(range(50_000), k) for k in ("latin", "hangul", "alike")))))


def test_runs_that_share_a_code_are_told_apart(monkeypatch):
    real = rp.runs_of
    monkeypatch.setattr(rp, "runs_of", lambda ids, n: real(ids, n) % np.uint64(7))
    for text in cases()[:60]:
        assert rp.repeated(rp.numbered(text)) == brute(text)[1]


def worded(ids, kind):
    """Words for numbers: of random letters, of Hangul, or all short and alike."""
    r = random.Random(5)
    made = {}

    def word(i):
        if i not in made:
            if kind == "latin":
                made[i] = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(4, 9))) + "".join(chr(97 + int(d)) for d in str(i))
            elif kind == "hangul":
                made[i] = "".join(chr(0xAC00 + (i * 7919 + k * 104729) % 11172) for k in range(3))
            else:
                made[i] = "aab" + "".join(chr(97 + int(d)) for d in str(i))
        return made[i]

    return " ".join(word(int(i)) for i in ids)


def scattered(n, place, seed, share=rp.SHARE):
    """Numbers of n words with the share in repetition in the form that saves least: runs of ten that stand apart."""
    r = np.random.default_rng(seed)
    fresh = r.permutation(n)[: int(n * (1 - share))]
    runs = -(-(n - len(fresh)) // 10)
    copies = [fresh[s : s + 10] for s in r.integers(0, len(fresh) // 2 - 10, runs)]
    if place == "behind":
        return np.concatenate([fresh, *copies])
    cuts = np.sort(r.integers(len(fresh) // 2, len(fresh), runs))
    return np.concatenate([x for a, b, c in zip([0, *cuts], cuts, copies) for x in (fresh[a:b], c)] + [fresh[cuts[-1] :]])


@pytest.mark.parametrize("kind", ["latin", "hangul", "alike"])
@pytest.mark.parametrize("place", ["behind", "between"])
def test_no_document_with_the_share_is_rejected_whatever_its_length_and_entropy(kind, place):
    for n in (64, 80, 127, 128, 200, 256, 500, 1000, 3000, 5000, 15_000, 40_000, 65_535, 65_536, 90_000):
        for seed in range(max(1, min(8, 4000 // n))):
            text = worded(scattered(n, place, seed), kind)
            m = rp.measure(text, SQUEEZE)
            assert m[4] != "incompressible" and m[6] >= rp.SHARE, (n, seed, m)


def test_the_limits_are_less_than_half_of_what_the_share_saves():
    for n in (64, 128, 256, 1000, 5000, 20_000, 65_000):
        for place in ("behind", "between"):
            for seed in range(max(1, min(20, 4000 // n))):
                ratio = rp.measure(worded(scattered(n, place, seed), "alike"), SQUEEZE)[1]
                assert ratio - 1 > 2 * (rp.limits(n)[0] - 1), (n, place, seed, ratio)


def test_no_repetitive_document_is_rejected_by_its_band():
    for text in cases():
        words, n = brute(text)
        m = rp.measure(text, SQUEEZE)
        if words and n / len(words) >= rp.SHARE:
            assert m[4] != "incompressible" and m[5] == n and m[6] == n / len(words)


def test_bands():
    noise = worded(range(2000), "hangul")
    assert rp.measure("the same ten words stand here again and again now " * 50, SQUEEZE)[4] == "repetitive"
    assert rp.measure(noise, SQUEEZE)[4:] == ("incompressible", None, None) and rp.measure(noise, SQUEEZE, count_all=True)[4:] == ("incompressible", 0, 0.0)
    assert rp.measure("!!", SQUEEZE)[4] == "empty" and rp.measure("one two", SQUEEZE)[4] == "short"
    chunked = rp.measure(worded(range(9000), "hangul") + " stop here" * 2100, SQUEEZE)
    assert chunked[3] > chunked[1] > chunked[2] and chunked[4] == "repetitive"


def test_rows(spark):
    ten = "one two three four five six seven eight nine ten "
    rows = [(1, None, 0), (2, "", 0), (3, ten * 2, 0), (3, ten * 2, 0), (4, ten + "x " + ten, 0), (5, ten, 0), (None, ten * 5000, 0), (6, "a" * 300_000, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, band int")
    got = [r["doc_id"] for r in rp.repetitive(df, ["doc_id"]).collect()]
    assert sorted(got, key=str) == [3, 3, 4, None]
    assert rp.repetition(df, ["doc_id"]).count() == len(rows) and rp.repetition(df.limit(0), ["doc_id"]).count() == 0


def test_corpus_matches_sql_and_no_band_loses_a_document(spark):
    """Over the whole corpus, with no limit of length."""
    folder = "/root/testdata/sf0.01"
    if not Path(folder).is_dir():
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = dict((d, (n, k)) for d, n, k in c.execute(queries.oracle_sql()["p9_shares"]).fetchall())
    every = queries.p9_bands(spark, folder).collect()
    assert {r["doc_id"]: (r["n_words"], r["repeated_words"]) for r in every} == want
    assert not [r["doc_id"] for r in every if r["band"] == "incompressible" and r["share"] >= rp.SHARE]
    found = {r["doc_id"] for r in queries.p9_found(spark, folder).collect()}
    assert found == {r[0] for r in c.execute(queries.oracle_sql()["p9_found"]).fetchall()} and found
