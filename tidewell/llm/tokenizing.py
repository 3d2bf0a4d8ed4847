"""Encoding of a corpus with a public byte-level BPE vocabulary.

A text is cut into pieces by the vocabulary's pattern, and each piece is merged on
its own. Merging keeps a segment tree over the piece's byte positions: a leaf holds
the rank of the pair that starts there, an inner node the leftmost least rank. The
root names the next merge, and a merge updates the leaves of its live neighbours, so
a piece of n bytes takes O(n log n), however long it is.

Pieces repeat, so each Python worker keeps the ids of those it has met; the memo is
emptied when it is full, which costs time, never a result.
"""

from __future__ import annotations

import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidewell.llm.spreading import spread

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: The piece pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 300_000
_IDS = np.dtype("<i4")
# blanks as the pattern or Python knows them; a border needs neither beside it
_edge = re.compile(r"^[\s\x1c-\x1f]|[\s\x1c-\x1f]$").search
_cut = re.compile(r"(?<=[^\s\x1c-\x1f])(?= [^\s\x1c-\x1f])").split
_NEVER = 1 << 62
_SHIFT = 40


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it is printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """ids of a text by one vocabulary file (JSON with vocab and merges)."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        # (left id, right id) -> (rank, merged id)
        self.merges: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        self.pieces = regex.compile(PATTERN).findall
        self.memo = _Memo(self._merge)
        self.words = _Memo(self._word)
        self.chunks = _Memo(self._packed)

    def _merge(self, piece: str) -> tuple[int, ...]:
        """The ids of one piece."""
        part = [self.of_byte[b] for b in piece.encode("utf-8", "replace")]
        n = len(part)
        if n < 2:
            return tuple(part)
        get = self.merges.get
        width = 1 << (n - 1).bit_length()
        # rank << _SHIFT | position: the least value is the leftmost of the least rank
        tree = [_NEVER] * (2 * width)
        for i in range(n - 1):
            if (m := get(part[i] << 32 | part[i + 1])) is not None:
                tree[width + i] = m[0] << _SHIFT | i
        for k in range(width - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            k = width + i
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                least = a if a < b else b
                if tree[k] == least:
                    return
                tree[k] = least
                k >>= 1

        def leaf(i: int, j: int) -> int:
            m = get(part[i] << 32 | part[j])
            return _NEVER if m is None else m[0] << _SHIFT | i

        while tree[1] != _NEVER:
            i = tree[1] & ((1 << _SHIFT) - 1)
            j = after[i]
            part[i] = get(part[i] << 32 | part[j])[1]
            part[j] = -1
            k = after[i] = after[j]
            put(j, _NEVER)
            if k < n:
                before[k] = i
                put(i, leaf(i, k))
            else:
                put(i, _NEVER)
            if (h := before[i]) >= 0:
                put(h, leaf(h, i))
        return tuple(x for x in part if x >= 0)

    def _packed(self, text: str) -> bytes:
        memo = self.memo
        return np.asarray([*itertools.chain.from_iterable([memo[p] for p in self.pieces(text)])], _IDS).tobytes()

    def _word(self, word: str) -> bytes | None:
        """The packed ids of a blank and word, or None if the blank may not be a border of pieces on its own."""
        return None if not word or _edge(word) else self._packed(" " + word)

    def encode(self, text: str | None) -> bytes:
        """The ids as packed 32-bit integers, without special tokens: their names in a text are ordinary text.

        None and '' have no ids. Between a visible character and a single blank before
        another one there is always a border of pieces, so a text is cut there and its
        words are looked up whole. Where blanks meet other white space, what lies between
        two such borders is encoded in one go.
        """
        if not text:
            return b""
        words = iter(text.split(" "))
        first = next(words)
        if first and not _edge(first):
            try:
                return b"".join([self._packed(first), *map(self.words.__getitem__, words)])
            except TypeError:  # a word is None
                pass
        return b"".join(map(self.chunks.__getitem__, _cut(text)))


class _Memo(dict):
    """make(key) for every key, remembered for at most MEMO keys of up to 64 characters at a time."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[key] = value
        return value


_encoders: dict[int, Encoder] = {}


def encoder(vocabulary: bytes) -> Encoder:
    """One Encoder for each vocabulary and process."""
    key = hash(vocabulary)
    if key not in _encoders:
        _encoders[key] = Encoder(vocabulary)
    return _encoders[key]


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file as a broadcast: its size is that of the file, 2 MB, whatever the data."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """batch in parts of so many rows, so that the ids of one part stay small beside its texts."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _with_output(df: DataFrame, keep: list[str], text: str, name: str, kind: T.DataType, make) -> DataFrame:
    source = spread(df.select(*[f"`{c}`" for c in keep], f"`{text}`"))
    fields = [source.schema[c] for c in keep]
    return source.mapInArrow(make, T.StructType([*fields, T.StructField(name, kind)]))


def encode_corpus(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, name: str = "ids") -> DataFrame:
    """The columns keep and the ids of each text as array<int>; null and empty texts have an empty list.

    One row out for each row in, repeated rows too; other columns are not read.
    """
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            for part in _slices(batch):
                packed = [encode(t) for t in part.column(part.num_columns - 1).to_pylist()]
                offsets = np.zeros(len(packed) + 1, np.int32)
                np.cumsum([len(x) // 4 for x in packed], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), _IDS)))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], ids], names=[*part.schema.names[:-1], name])

    return _with_output(df, keep, text, name, T.ArrayType(T.IntegerType()), run)


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, name: str = "n_tokens") -> DataFrame:
    """The columns keep and the number of ids of each text; 0 for null and empty texts."""
    shared = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            n = pa.array([len(encode(t)) // 4 for t in batch.column(batch.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*batch.schema.names[:-1], name])

    return _with_output(df, keep, text, name, T.LongType(), run)
