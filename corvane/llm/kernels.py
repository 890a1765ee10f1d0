"""Vectorised byte and word kernels on concatenated UTF-8 texts."""

from __future__ import annotations

import numpy as np

#: Odd, so that it has an inverse modulo 2**64.
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
MAX64 = np.uint64(0xFFFFFFFFFFFFFFFF)

_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; the longest is kept up to 16 MB."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if size <= 1 << 21:
            _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A random 64-bit value for each byte.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)


def concatenated(texts: list[bytes], gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """One buffer with ``gap`` after each text, and the starts (one more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + len(gap) for t in texts], out=starts[1:])
    return np.frombuffer(gap.join([*texts, b""]), np.uint8), starts


def table_of(chars: bytes, fill: int = 1) -> np.ndarray:
    out = np.zeros(256, np.uint8)
    out[list(chars)] = fill
    return out


#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z are lower case.
ALNUM_WORD = table_of(bytes([*range(48, 58), *range(97, 123), *range(128, 256)])).astype(bool)
#: Bytes of the words [^\x20\x09-\x0D]+.
SPACED_WORD = ~table_of(b" \t\n\x0b\x0c\r").astype(bool)


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    first = [0] if len(inside) and inside[0] else []
    last = [len(inside)] if len(inside) and inside[-1] else []
    edge = np.concatenate([first, edge, last]).astype(np.int64)
    return edge[0::2], edge[1::2]


#: What of the last eight bytes of a span counts.
_TAIL = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each span's bytes, independent of where the span lies.

    Eight bytes at a time go through a mixer that isn't linear, so that spans of one pattern don't collide.
    """
    size = np.asarray(ends - starts, np.int64)
    lanes = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(size.astype(np.uint64) * BASE + np.uint64(seed))
    live, at, left = np.arange(len(size)), np.asarray(starts, np.int64), size
    while len(live):
        lane = lanes[at] & _TAIL[np.minimum(left, 8)]
        out[live] = mix(out[live] * BASE ^ mix(lane + BASE))
        more = left > 8
        live, at, left = live[more], at[more] + 8, left[more] - 8
    return out


def span_keys(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers that tell spans without zero bytes apart: the bytes and 0 up to eight bytes, else two hashes."""
    size = np.asarray(ends - starts, np.int64)
    lanes = np.ndarray((len(buf) + 1,), "<u8", np.concatenate([buf, np.zeros(8, np.uint8)]), strides=(1,))
    key, check = lanes[starts] & _TAIL[np.minimum(size, 8)], np.zeros(len(size), np.uint64)
    long = np.flatnonzero(size > 8)
    key[long] = span_hashes(buf, starts[long], ends[long])
    check[long] = span_hashes(buf, starts[long], ends[long], seed)
    return key, check


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive word hashes, mixed word by word; empty if there are fewer."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = mix(out * BASE ^ words[j : j + n])
    return out


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A rolling (polynomial) hash of each k consecutive values; empty if there are fewer. It only says where to cut."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * BASE + words[j : j + n]
    return mix(out)


def words_of(texts: list[bytes], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of lower-cased texts, and where each text's words begin (one more than texts)."""
    buf, starts = concatenated(texts)
    buf = LOWER[buf]
    s, e = spans(inside[buf])
    return span_hashes(buf, s, e), np.searchsorted(s, starts)


def _times(matrix: list[int], vector: int) -> int:
    out = i = 0
    while vector:
        if vector & 1:
            out ^= matrix[i]
        vector >>= 1
        i += 1
    return out


def _zero_byte_matrices() -> list[list[int]]:
    """Matrix k advances a CRC-32 over 2**k zero bytes."""
    one_bit = [0xEDB88320] + [1 << i for i in range(31)]
    two = [_times(one_bit, x) for x in one_bit]
    four = [_times(two, x) for x in two]
    out = [[_times(four, x) for x in four]]
    for _ in range(40):
        out.append([_times(out[-1], x) for x in out[-1]])
    return out


_ZEROS = _zero_byte_matrices()


def crc32_joined(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two byte strings end to end, from theirs."""
    k = 0
    while second_bytes:
        if second_bytes & 1:
            first = _times(_ZEROS[k], first)
        second_bytes >>= 1
        k += 1
    return first ^ second
