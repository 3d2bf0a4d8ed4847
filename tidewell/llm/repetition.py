"""Repetition inside single documents.

Compression bands: a document is coded as one fixed-width code for each phrase of
five consecutive words, and the codes are compressed with zstandard, as a whole and
in fixed chunks. Codes of different phrases look random, so neither the alphabet nor
the vocabulary moves the ratio: it is 1 for a text that repeats no phrase, and each
repeated run of words takes out its codes. Limits for its length put the document
into a band: incompressible, plain or repetitive. Incompressible ones can't have the
wanted share and are rejected; in all others the repeated runs are counted exactly.

A run of ten words that stands apart repeats six codes, 24 bytes, and costs some
four, so a quarter of the words in repetition saves an eighth at least. The limits
ask for less than half of that, and only up to a length at which the compressor finds
every match; shorter and longer documents are never rejected.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell.llm.spreading import spread

RUN, SHARE = 10, 0.25
PHRASE = 5
#: Words in a chunk.
CHUNK = 2048
#: From so many words on: under the first ratio a document is incompressible, over the second it is repetitive.
LIMITS = ((0, 0.0, 4 / 3), (64, 1.03, 4 / 3), (128, 1.05, 4 / 3), (65_536, 0.0, 4 / 3))
#: Characters that are cut into words at a time, so that a text of any length takes eight bytes a word.
PIECE = 1 << 20
_candidates = re.compile(r"[^\W\d_]+").findall
_MEASURES = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("ratio", T.DoubleType()), T.StructField("chunk_low", T.DoubleType()), T.StructField("chunk_high", T.DoubleType()),
    T.StructField("band", T.StringType()), T.StructField("repeated_words", T.LongType()), T.StructField("share", T.DoubleType()),
])


def words(text: str | None) -> list[str]:
    """The maximal runs of letters (category L) of the text in NFC, each in lower case."""
    if not text:
        return []
    found = _candidates(text if text.isascii() else unicodedata.normalize("NFC", text))
    if not "".join(found).isalpha():  # numerals such as U+2167 are word characters to re, but no letters
        found = "".join(x if x.isalpha() else " " for x in " ".join(found)).split(" ")
        found = [x for x in found if x]
    return " ".join(found).lower().split(" ") if found else []


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in parts of some size characters, cut at spaces: no word and no composed letter crosses one."""
    at = 0
    while at < len(text):
        end = text.find(" ", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def numbered(text: str | None) -> np.ndarray:
    """The words of a text as numbers: equal words have equal numbers, given by first occurrence."""
    known: dict[str, int] = {}
    parts = []
    for piece in pieces(text or ""):
        found = words(piece)
        for w in dict.fromkeys(found):
            known.setdefault(w, len(known))
        parts.append(np.fromiter(map(known.__getitem__, found), np.uint64, len(found)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is of category L."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), np.bool_, 0x110000)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def hashed(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word of a text, in order: the words that words() gives, but no text is made of any.

    Two different words may share a hash, if hardly ever; then a text looks more
    repetitive than it is, never less.
    """
    parts = []
    for piece in pieces(text or ""):
        points = _code_points(piece if piece.isascii() else unicodedata.normalize("NFC", piece))
        lowered = np.where(_letters()[points], points, np.uint32(32)).tobytes().decode("utf-32-le", "surrogatepass").lower()
        points = _code_points(lowered)
        inside = points != 32
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            continue
        letters = points[inside].astype(np.uint64)
        lengths = ends - starts
        firsts = np.cumsum(lengths) - lengths
        at = np.arange(len(letters)) - np.repeat(firsts, lengths)
        powers = np.cumprod(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, np.uint64))
        sums = np.add.reduceat((letters + np.uint64(0x100)) * (letters ^ np.uint64(0xBF58476D)) * powers[at], firsts)
        parts.append(_mixed(sums + lengths.astype(np.uint64)))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads a number over all bits."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def runs_of(ids: np.ndarray, length: int) -> np.ndarray:
    """One 64-bit code for each run of so many consecutive words."""
    n = len(ids) - length + 1
    if n < 1:
        return np.empty(0, np.uint64)
    spread_ids = _mixed((ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    out = np.zeros(n, np.uint64)
    for i in range(length):
        out = out * np.uint64(0x100000001B3) + spread_ids[i : i + n]
    return _mixed(out)


def repeated(ids: np.ndarray, run: int = RUN) -> int:
    """How many words lie in a run of so many words that starts at an earlier word too. Equal runs may overlap.

    Runs are found by their codes and then compared word by word, so the count is exact.
    """
    codes = runs_of(ids, run)
    order = np.argsort(codes, kind="stable")
    same = codes[order[1:]] == codes[order[:-1]]
    later, earlier = order[1:][same], order[:-1][same]
    if len(later) and any((ids[later + i] != ids[earlier + i]).any() for i in range(run)):  # two different runs share a code
        _, first, back = np.unique(np.lib.stride_tricks.sliding_window_view(ids, run), axis=0, return_index=True, return_inverse=True)
        later = np.flatnonzero(first[back.reshape(-1)] != np.arange(len(codes)))
    if not len(later):
        return 0
    starts = np.sort(later)
    return int(run + np.minimum(np.diff(starts), run).sum())


def limits(n_words: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(LIMITS) if n_words >= least)


def compressor() -> zstandard.ZstdCompressor:
    """Optimal parsing with a binary tree: no position is skipped in stretches that don't compress."""
    return zstandard.ZstdCompressor(compression_params=zstandard.ZstdCompressionParameters(window_log=22, hash_log=17, chain_log=17, search_log=4, min_match=6, target_length=32, strategy=zstandard.STRATEGY_BTOPT))


def measure(text: str | None, squeeze, run: int = RUN, count_all: bool = False) -> tuple:
    """The values of _MEASURES. A text without words is in band 'empty', one too short for a repeated run in 'short'.

    Of an incompressible document chunks and repeated words are null unless count_all.
    """
    codes = hashed(text)
    if len(codes) <= run:
        return (len(codes), 1.0, 1.0, 1.0, "short" if len(codes) else "empty", 0, 0.0)
    data = (runs_of(codes, PHRASE) >> np.uint64(32)).astype("<u4").tobytes()
    ratio = len(data) / len(squeeze(data))
    low, high = limits(len(codes))
    if ratio < low and not count_all:
        return (len(codes), ratio, None, None, "incompressible", None, None)
    ids = numbered(text)
    size = 4 * CHUNK
    parts = [ratio] if len(data) <= size else [size / len(squeeze(p)) for p in (data[i : i + size] for i in range(0, len(data), size)) if len(p) == size]
    band = "incompressible" if ratio < low else "repetitive" if max(ratio, *parts) > high else "plain"
    count = repeated(ids, run)
    return (len(ids), ratio, min(parts), max(parts), band, count, count / len(ids))


def repetition(df: DataFrame, keep: list[str], text: str = "text", run: int = RUN, count_all: bool = True) -> DataFrame:
    """The columns keep and the measures of each text: n_words, ratio, chunk_low, chunk_high, band, repeated_words, share.

    One row out for each row in. Null and empty texts and those without letters are in
    band 'empty' with share 0, and texts of at most `run` words in band 'short' with
    share 0. Without count_all, rejected documents have null in chunk_low, chunk_high,
    repeated_words and share. Whole texts are measured, however long.
    """
    source = spread(df.select(*[f"`{c}`" for c in keep], f"`{text}`"))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = compressor().compress
        kinds = [pa.int64(), *[pa.float64()] * 3, pa.string(), pa.int64(), pa.float64()]
        for batch in batches:
            rows = [measure(t, squeeze, run, count_all) for t in batch.column(batch.num_columns - 1).to_pylist()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *_MEASURES.names])

    return source.mapInArrow(measured, T.StructType([*[source.schema[c] for c in keep], *_MEASURES.fields]))


def repetitive(df: DataFrame, keep: list[str], text: str = "text", share: float = SHARE, run: int = RUN) -> DataFrame:
    """The columns keep of the rows with at least the share of their words in repetition.

    The limits hold for the share and the run they are made for; for a lower share or
    a shorter run nothing is rejected and every document is counted.
    """
    made_for = share >= SHARE and run >= RUN
    return repetition(df, keep, text, run, not made_for).filter((F.col("n_words") > 0) & (F.col("share") >= share)).select(*keep)
