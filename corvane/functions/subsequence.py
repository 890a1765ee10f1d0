"""Lengths of longest common subsequences for the pairs of an Arrow batch, by bit-parallel rows in numpy.

Tokens that only one side has are left out first. One side's places are bits of 64-bit words, and the other's tokens are
gone through one by one for many pairs at once: a row of the table of the usual dynamic programme is a bit vector V, and
with the bits M where the token stands, the next row is (V + (V & M)) | (V & ~M) (Crochemore and others 2001; Hyyro 2004).
Pairs are put together by size, so that little is filled up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes of match bits that are held at once.
HELD = 8 << 20


def _common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both sides without tokens that the other lacks, the longer one first."""
    a, b = a[np.isin(a, b)], b[np.isin(b, a)]
    return (a, b) if len(a) >= len(b) else (b, a)


def _matches(a: np.ndarray, b: np.ndarray, words: int) -> np.ndarray:
    """(tokens of b, words): bits of the places in a that hold each token."""
    kinds, at = np.unique(b, return_inverse=True)
    bits = np.zeros((len(kinds), words * 64), bool)
    bits[np.searchsorted(kinds, a), np.arange(len(a))] = True
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)[at]


def _long(a: np.ndarray, b: np.ndarray) -> int:
    """For a pair whose match bits for all tokens would be too many: one integer as the row."""
    places: dict[int, int] = {}
    for t in np.unique(b).tolist():
        bits = np.packbits(a == t, bitorder="little").tobytes()
        places[t] = int.from_bytes(bits, "little")
    row = every = (1 << len(a)) - 1
    for t in b.tolist():
        hit = row & places[t]
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def lengths(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = np.zeros(len(pairs), np.int64)
    common = [_common(a, b) for a, b in pairs]
    some = [i for i, (_, b) in enumerate(common) if len(b)]
    some.sort(key=lambda i: (-(-len(common[i][0]) // 64), len(common[i][1])))
    start = 0
    while start < len(some):
        words = -(-len(common[some[start]][0]) // 64)
        stop = start
        # As many pairs of so many words as fit.
        while stop < len(some) and -(-len(common[some[stop]][0]) // 64) == words and (stop - start + 1) * len(common[some[stop]][1]) * words * 8 <= HELD:
            stop += 1
        if stop == start:
            out[some[start]] = _long(*common[some[start]])
            start += 1
            continue
        own = some[start:stop]
        out[own] = _together([common[i] for i in own], words)
        start = stop
    return out


def _together(pairs: list[tuple[np.ndarray, np.ndarray]], words: int) -> np.ndarray:
    longest = max(len(b) for _, b in pairs)
    match = np.zeros((longest, words, len(pairs)), np.uint64)
    for i, (a, b) in enumerate(pairs):
        match[: len(b), :, i] = _matches(a, b, words)
    row = np.full((words, len(pairs)), np.uint64(0xFFFFFFFFFFFFFFFF))
    for m in match:
        hit = row & m
        rest = row & ~m
        carry = np.zeros(len(pairs), bool)
        for w in range(words):
            total = row[w] + hit[w]
            over = total < hit[w]
            with_carry = total + carry
            carry = over | (with_carry < total)
            row[w] = with_carry | rest[w]
    # Places that turned to 0; those behind the end of a never match and stay 1.
    return words * 64 - np.bitwise_count(row).sum(axis=0).astype(np.int64)


def of_batch(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Of two list columns of 64-bit hashes; null counts as empty."""
    sides = []
    for column in (a, b):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        values, offsets = np.asarray(column.values), np.asarray(column.offsets)
        null = np.asarray(column.is_null())
        sides.append([values[x:y] if not n else values[:0] for x, y, n in zip(offsets[:-1], offsets[1:], null)])
    return lengths(list(zip(*sides)))
