"""Packing documents into sequences of bounded length by swap-based local search.

Documents longer than a sequence are cut; the pieces are dealt at random to
shards of bounded size. A shard packs its pieces best-fit, longest first, and
then takes its least filled sequences one by one: it moves pieces out of it,
exchanges one of its pieces for a shorter one of a fuller sequence, or two for
one, always so that the sum of squared fills rises, until it is empty or no
exchange is left. It goes over its sequences again until a pass changes
nothing, and stops where their number meets the total length's lower bound.

Defined results: null text is the empty text and gives one piece with the end
id alone; repeated rows are documents of their own; an empty table gives no
rows; very long texts are cut into as many pieces as they need.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Lazy, blocks, mapped, stored, utf8
from .tokens import Encoder

CAPACITY = 2048
#: Pieces in a shard, about; a shard leaves one sequence underfull at most, as a rule.
SHARD = 40_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def _cut(encoder: Lazy, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, doc_ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            for part in blocks(map(len, texts)):
                ids, at = encoder.get().encode(texts[part])
                rows = []
                for i, doc_id in enumerate(doc_ids[part]):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k in range(0, len(own), capacity):
                        piece = own[k : k + capacity]
                        rows.append((doc_id, k // capacity, k, len(piece), zlib.crc32(piece.tobytes())))
                doc, piece, start, length, crc = zip(*rows)
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return run


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices, longest first, each into the fullest bin that has room."""
    bins: list[list[int]] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has r left
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            b, room = len(bins), capacity
            bins.append([i])
        left = room - n
        with_room[left].append(b)
        rooms |= 1 << left
    return bins


class _Open:
    """Bins that may take pieces: by room, and for each length the roomiest bin that holds a piece of it."""

    def __init__(self, held: list[dict[int, list[int]]], room: list[int], capacity: int):
        self.held, self.room = held, room
        self.by_room: list[set[int]] = [set() for _ in range(capacity + 1)]
        self.rooms = 0  # bit r is set if an open bin has r left
        self.open: set[int] = set()
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.most = np.zeros(capacity + 1, np.int64)  # by length; 0: no open bin holds it

    def enter(self, b: int) -> None:
        r = self.room[b]
        if not r:
            return
        self.open.add(b)
        self.by_room[r].add(b)
        self.rooms |= 1 << r
        for n in self.held[b]:
            heapq.heappush(self.heaps[n], (-r, b))
            if r > self.most[n]:
                self.most[n] = r

    def leave(self, b: int) -> None:
        if b not in self.open:
            return
        self.open.remove(b)
        r = self.room[b]
        self.by_room[r].remove(b)
        if not self.by_room[r]:
            self.rooms ^= 1 << r
        for n in self.held[b]:
            heap = self.heaps[n]
            while heap and not (heap[0][1] in self.open and self.room[heap[0][1]] == -heap[0][0] and n in self.held[heap[0][1]]):
                heapq.heappop(heap)
            self.most[n] = -heap[0][0] if heap else 0

    def tightest(self, n: int) -> int | None:
        """An open bin with the least room for ``n``."""
        fits = self.rooms >> n
        return next(iter(self.by_room[n + (fits & -fits).bit_length() - 1])) if fits else None


def improve(lengths: list[int], bins: list[list[int]], capacity: int, tally: Counter | None = None) -> list[list[int]]:
    """Empty underfull bins by moves and swaps that raise the sum of squared fills.

    ``tally`` counts moves, swaps of one for one and of two for one, and emptied bins.
    """
    tally = Counter() if tally is None else tally
    held: list[dict[int, list[int]]] = []  # of a bin: length to pieces
    for b in bins:
        by: dict[int, list[int]] = {}
        for i in b:
            by.setdefault(lengths[i], []).append(i)
        held.append(by)
    room = [capacity - sum(lengths[i] for i in b) for b in bins]
    least = -(-sum(lengths) // capacity)
    left = len(bins)

    def shift(n: int, source: int, to: int) -> None:
        i = held[source][n].pop()
        if not held[source][n]:
            del held[source][n]
        held[to].setdefault(n, []).append(i)
        room[source] += n
        room[to] -= n

    steps = -1
    while steps != (steps := tally.total()) and left > least:
        order = sorted((b for b in range(len(bins)) if room[b] and held[b]), key=lambda b: (-room[b], b))
        state = _Open(held, room, capacity)
        for b in order:
            state.enter(b)
        # Bins still open are at least as full as the one that is emptied, so every step raises the sum.
        for low in order:
            if left <= least:
                break
            state.leave(low)
            while held[low]:
                own = sorted(held[low], reverse=True)
                fits = next((n for n in own if n < state.rooms.bit_length()), None)
                if fits is not None:  # the longest own piece that fits, where it fits best
                    to = state.tightest(fits)
                    state.leave(to)
                    shift(fits, low, to)
                    state.enter(to)
                    tally["moves"] += 1
                    continue
                # One or two own pieces for one shorter piece of another bin; the largest gain first.
                given = {own[i] + own[j]: (own[i], own[j]) for i in range(len(own)) for j in range(i + 1) if i != j or len(held[low][own[i]]) > 1}
                given |= {n: (n,) for n in own}
                totals = np.array(sorted(given), np.int64)
                theirs = np.flatnonzero(state.most)
                at = np.searchsorted(totals, theirs + state.most[theirs], "right") - 1
                gain = np.where(at >= 0, totals[at] - theirs, 0)
                if not len(gain) or gain.max() <= 0:
                    break
                k = int(np.argmax(gain))
                taken, pieces = int(theirs[k]), given[int(totals[at[k]])]
                to = state.heaps[taken][0][1]
                state.leave(to)
                shift(taken, to, low)
                for n in pieces:
                    shift(n, low, to)
                state.enter(to)
                tally["one for one" if len(pieces) == 1 else "two for one"] += 1
            if not held[low]:
                left -= 1
                tally["emptied"] += 1
    return [[i for own in by.values() for i in own] for by in held if by]


def _pack_shard(capacity: int):
    def run(key: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].tolist()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for b, held in enumerate(improve(lengths, best_fit(lengths, capacity), capacity)):
            at = 0
            for i in held:
                sequence[i], offset[i] = (int(key[0]) << 32) + b, at
                at += lengths[i]
        return pdf.drop(columns="shard").assign(sequence_id=sequence, offset=offset)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, _cut(Lazy(Encoder, tokenizer), end_id, capacity), PIECES)
    pieces = stored(made, "pieces")
    shards = max(1, -(-pieces.count() // shard))
    # Row numbers of a stored table; they deal copies and null ids out evenly.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(shards)).cast("long"))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), PACKED)
