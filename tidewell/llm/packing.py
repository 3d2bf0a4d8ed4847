"""Filling containers of fixed capacity with the texts of a corpus.

Variable-capacity best fit, over sizes instead of items. What matters of an item is
its size, and there are no more sizes than the capacity, so the histogram of sizes
is all that the plan needs: a table of at most `capacity` rows, whatever the corpus.
Sizes are taken from large to small; each goes to the open bins it fits best, many
at once; where none has room, bins of the least-cost permitted length are opened;
at the end each bin is cut down to the shortest permitted length that holds its
contents. The plan is a list of segments: items of size s with ranks from r on go,
so many a bin, to bins from b on. Each item finds its bin by the rank of its size.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.tokenizing import VOCABULARY, token_counts
from tidewell.operators.ranks import salted_number
from tidewell.sources.shared import kept

CAPACITY = 2048
LENGTHS = (256, 512, 1024, 2048)
#: What opening a bin costs beside its length, in tokens.
OPEN_COST = 16


@dataclass
class Plan:
    """segments: (size, first rank, items a bin, first bin), in order; runs: (first bin, contents, length), in order."""

    segments: list[tuple[int, int, int, int]]
    runs: list[tuple[int, int, int]]
    n_bins: int

    def cost(self, open_cost: int) -> int:
        """The lengths of all bins and what it takes to open them."""
        ends = [*[r[0] for r in self.runs[1:]], self.n_bins]
        return sum((length + open_cost) * (end - first) for (first, _, length), end in zip(self.runs, ends))


def _least_cost(size: int, lengths: tuple[int, ...], left: dict[int, int], sizes: list[int], open_cost: int) -> int:
    """The permitted length whose cost a token held is least, if filled with size and then with the largest sizes left."""
    best = None
    for length in lengths:
        if length < size:
            continue
        room = length - size
        used = {size: 1}
        while room:
            at = bisect.bisect_right(sizes, room) - 1
            while at >= 0 and left[sizes[at]] <= used.get(sizes[at], 0):
                at -= 1
            if at < 0:
                break
            s = sizes[at]
            n = min(room // s, left[s] - used.get(s, 0))
            used[s] = used.get(s, 0) + n
            room -= n * s
        cost = (length + open_cost) / (length - room)
        if best is None or cost <= best[0]:
            best = (cost, length)
    return best[1]


def plan(histogram: dict[int, int], lengths: tuple[int, ...] = LENGTHS, open_cost: int = OPEN_COST) -> Plan:
    """The plan for items counted by size; sizes from 1 to the longest permitted length.

    Bins may be opened at all lengths, at all but the shortest, and so on to the longest
    alone; of these plans the one whose bins, cut down, cost least is taken, and of equal
    ones that with fewest bins. The work hangs on the number of sizes and of bin groups
    alone, which the capacity bounds. No items give no bins.
    """
    lengths = tuple(sorted(set(lengths)))
    plans = [_plan(histogram, lengths, lengths[i:], open_cost) for i in range(len(lengths))]
    return min(plans, key=lambda p: (p.cost(open_cost), p.n_bins))


def _plan(histogram: dict[int, int], lengths: tuple[int, ...], opened: tuple[int, ...], open_cost: int) -> Plan:
    left = {s: n for s, n in histogram.items() if n > 0}
    if left and (min(left) < 1 or max(left) > lengths[-1]):
        raise ValueError("a size is outside 1..capacity")
    ascending = sorted(left)
    segments: list[tuple[int, int, int, int]] = []
    # open groups by room: room -> list of (first bin, bins, length); all bins of a group have the same room
    groups: dict[int, list[tuple[int, int, int]]] = {}
    rooms: list[int] = []
    done: list[tuple[int, int, int]] = []
    n_bins = 0

    def keep(room: int, group: tuple[int, int, int]) -> None:
        if not room:
            done.append((group[0], group[2], group[2]))
            return
        if room not in groups:
            groups[room] = []
            bisect.insort(rooms, room)
        groups[room].append(group)

    for size in reversed(ascending):
        rank = 0
        while left[size]:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                length = _least_cost(size, opened, left, ascending, open_cost)
                each = length // size
                count = max(1, left[size] // each)
                keep(length, (n_bins, count, length))
                n_bins += count
                continue
            room = rooms[at]
            first, bins, length = groups[room].pop()
            if not groups[room]:
                del groups[room]
                rooms.pop(at)
            each = room // size
            whole = min(bins, left[size] // each)
            if whole:
                segments.append((size, rank, each, first))
                rank += whole * each
                left[size] -= whole * each
                keep(room - each * size, (first, whole, length))
            if whole < bins:
                first, bins = first + whole, bins - whole
                if left[size]:  # fewer than fill one bin
                    segments.append((size, rank, left[size], first))
                    keep(room - left[size] * size, (first, 1, length))
                    rank += left[size]
                    left[size] = 0
                    first, bins = first + 1, bins - 1
                if bins:
                    keep(room, (first, bins, length))
    for room, of_room in groups.items():
        done += [(first, length - room, lengths[bisect.bisect_left(lengths, length - room)]) for first, _, length in of_room]
    return Plan(sorted(segments), sorted(done), n_bins)


def pieces(counts: DataFrame, key: list[str], capacity: int) -> DataFrame:
    """key, piece_no, token_start, n_tokens: an item is one piece unless it is longer than capacity; then full pieces and a rest."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity).cast("int"), F.lit(1))
    cut = counts.select(*key, F.col("n_tokens").alias("all"), F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no"))
    start = F.col("piece_no").cast("long") * capacity
    return cut.select(*key, "piece_no", start.alias("token_start"), F.least(F.col("all") - start, F.lit(capacity)).cast("int").alias("n_tokens"))


def pack(counts: DataFrame, key: list[str], capacity: int = CAPACITY, lengths: tuple[int, ...] = LENGTHS, open_cost: int = OPEN_COST) -> DataFrame:
    """key, piece_no, token_start, n_tokens, bin_id, bin_length of every piece of the items in counts (key, n_tokens).

    Each row of counts is an item, repeated rows too. A bin holds at most capacity
    tokens; bin_length is the permitted length it was cut down to. Items of no tokens
    need no room: they are dealt out over the bins in turn (to bin 0, of length 0, if
    there is no other item). counts is read twice, so it should be kept or cheap.
    """
    allowed = tuple(sorted({x for x in lengths if x < capacity} | {capacity}))
    cut = pieces(counts, key, capacity)
    sizes = {r["n_tokens"]: r["n"] for r in cut.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    empty = sizes.pop(0, 0)
    p = plan(sizes, allowed, open_cost)
    salts = max(1, min(4096, (max(sizes.values(), default=0) + empty) // 100_000))
    ranked = salted_number(cut, ["n_tokens"], F.pmod(F.xxhash64(*key, "piece_no"), F.lit(salts)), [*key, "piece_no"], "rank")
    segments = np.asarray(p.segments, np.int64).reshape(-1, 4)
    starts = segments[:, 0] << 44 | segments[:, 1]
    runs = np.asarray(p.runs, np.int64).reshape(-1, 3)
    n_bins = p.n_bins

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("n_tokens").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False).astype(np.int64)
            out = np.where(size == 0, rank % max(n_bins, 1), 0)
            length = np.zeros(len(size), np.int64)
            full = size > 0
            if full.any():
                at = np.searchsorted(starts, size[full] << 44 | rank[full], side="right") - 1
                out[full] = segments[at, 3] + (rank[full] - segments[at, 1]) // segments[at, 2]
            if n_bins:
                length = runs[np.searchsorted(runs[:, 0], out, side="right") - 1, 2]
            kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "rank"]
            names = [name for name in batch.schema.names if name != "rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out), pa.array(length.astype(np.int32))], names=[*names, "bin_id", "bin_length"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.select(*cut.columns, "rank").mapInArrow(place, f"{schema}, bin_id bigint, bin_length int")


def pack_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """pack() of the texts of documents, measured in tokens. Texts are encoded once; their sizes are kept in the shared folder till the process ends."""
    return pack(kept(token_counts(documents, [key], text, vocabulary), "sizes"), [key], capacity, lengths)
