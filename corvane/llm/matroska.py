"""Matroska columns: variable-length EBML elements, clusters, lacing and cues.

``mux`` stores a payload as an 8-bit PCM track: frames of ``FRAME`` samples,
up to ``LACED`` frames to a SimpleBlock, blocks in clusters, and a cue for each
cluster. Full blocks use fixed-size lacing; the last block of a payload takes
EBML lacing. ``parse`` reads any Matroska bytes into a packet table with track,
timestamp, key frame flag and byte range, following unknown-size elements,
Xiph, EBML and fixed-size lacing, BlockGroups and cues.

Defined results: null is the empty text (one padded frame); repeated rows and
equal texts give equal bytes; an empty table gives no rows; texts of any length
are stored whole; damaged bytes raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, by_block, mapped, stored, utf8

#: Samples (bytes) of a frame; payloads are padded to a positive multiple of it.
FRAME = 192
LACED, CLUSTER_BLOCKS = 8, 32
#: A frame lasts so many milliseconds: 192 samples at 48 kHz.
FRAME_MS, RATE = 4, 48_000

# Element identifiers of the format.
EBML, SEGMENT, SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
DEFAULT_DURATION = 0x23E383
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TAGS, CHAPTERS, ATTACHMENTS = 0x1254C367, 0x1043A770, 0x1941A469
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1

MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}


def vint(value: int, width: int | None = None) -> bytes:
    """An element size; the all-ones pattern of a width means unknown and is skipped."""
    if width is None:
        width = 1
        while value >= (1 << 7 * width) - 1:
            width += 1
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, marker: bool = False) -> tuple[int | None, int]:
    """Value and width at ``at``; with ``marker`` the length bit stays (identifiers). None: unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length integer at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the integer at byte {at} is cut off")
    value = int.from_bytes(data[at : at + width], "big")
    if marker:
        return value, width
    value &= (1 << 7 * width) - 1
    return (None if value == (1 << 7 * width) - 1 else value), width


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(track: int, offset: int, frames: list[bytes], fixed: bool) -> bytes:
    head = vint(track) + struct.pack(">h", offset)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    if fixed:
        return element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes = [len(f) for f in frames]
    lace = vint(sizes[0])
    for before, size in zip(sizes, sizes[1:-1]):
        width = 1
        while abs(size - before) > (1 << 7 * width - 1) - 1:
            width += 1
        lace += vint(size - before + (1 << 7 * width - 1) - 1, width)
    return element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + lace + b"".join(frames))


_HEADER = element(EBML, element(DOC_TYPE, b"matroska") + number(DOC_TYPE_VERSION, 4) + number(DOC_TYPE_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def padded(text: bytes) -> bytes:
    return text + b" " * (max(FRAME, -(-len(text) // FRAME) * FRAME) - len(text))


def mux(payload: bytes) -> bytes:
    """A Matroska file of one PCM track that holds ``payload``."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(frames) * FRAME_MS)) + element(MUXING_APP, b"corvane") + element(WRITING_APP, b"corvane"))
    body = [info, _TRACKS]
    size = len(info) + len(_TRACKS)
    cues = []
    per_cluster = LACED * CLUSTER_BLOCKS
    for c in range(0, len(frames), per_cluster):
        inside = [number(CLUSTER_TIMESTAMP, c * FRAME_MS)]
        for b in range(c, min(c + per_cluster, len(frames)), LACED):
            held = frames[b : b + LACED]
            inside.append(_block(1, (b - c) * FRAME_MS, held, b + LACED < len(frames)))
        cluster = element(CLUSTER, b"".join(inside))
        cues.append(element(CUE_POINT, number(CUE_TIME, c * FRAME_MS) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, size))))
        body.append(cluster)
        size += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(body))


@dataclass
class Packet:
    track: int
    timestamp: int
    key: bool
    lacing: str
    start: int
    end: int


@dataclass
class Parsed:
    packets: list[Packet]
    tracks: dict[int, str]
    clusters: list[int]
    cues: list[tuple[int, int, int]]  # time, track, byte of the cluster
    duration: float | None


def _elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(identifier, first byte, body start, body end) of what stands between two bytes."""
    while at < end:
        ident, n = read_vint(data, at, True)
        size, m = read_vint(data, at + n)
        start = at + n + m
        stop = end if size is None else start + size
        if stop > end:
            raise ValueError(f"element {ident:x} at byte {at} ends beyond its parent")
        if size is None and ident == CLUSTER:  # an unknown size lasts until the next element of the top level
            look = start
            while look < end:
                i, a = read_vint(data, look, True)
                if i in (CLUSTER, CUES, TRACKS, INFO, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS):
                    break
                s, b = read_vint(data, look + a)
                look += a + b + (s or 0)
            stop = look
        yield ident, at, start, stop
        at = stop


def _uint(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _packets(data: bytes, start: int, end: int, base: int, key: bool | None, scale: int, lasting: dict[int, int]) -> Iterator[Packet]:
    """The frames of a block; key None: the block's own flag says. scale: nanoseconds of a tick; lasting: of a track's frame."""
    track, n = read_vint(data, start)
    at = start + n
    (offset,) = struct.unpack_from(">h", data, at)
    flags = data[at + 2]
    at += 3
    kind = flags >> 1 & 3
    sizes: list[int] = []
    if kind:
        frames = data[at] + 1
        at += 1
        if kind == 1:  # Xiph: runs of 255
            for _ in range(frames - 1):
                size = 0
                while data[at] == 255:
                    size += 255
                    at += 1
                sizes.append(size + data[at])
                at += 1
        elif kind == 3:  # EBML: the first size, then signed differences
            for i in range(frames - 1):
                value, width = read_vint(data, at)
                at += width
                sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
        else:
            if (end - at) % frames:
                raise ValueError("fixed-size lacing does not divide the block")
            sizes = [(end - at) // frames] * (frames - 1)
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise ValueError("laced sizes exceed the block")
    for i, size in enumerate([*sizes, last]):
        yield Packet(track, ((base + offset) * scale + i * lasting.get(track, FRAME_MS * 1_000_000)) // 1_000_000, bool(flags & 128) if key is None else key, ("none", "xiph", "fixed", "ebml")[kind], at, at + size)
        at += size


def parse(data: bytes) -> Parsed:
    """Packet table of a Matroska file; cues are checked against the clusters. ``ValueError`` where bytes are damaged."""
    try:
        return _parsed(data)
    except (IndexError, KeyError, TypeError, OverflowError, struct.error) as e:
        raise ValueError(f"damaged Matroska bytes: {e!r}") from e


def _parsed(data: bytes) -> Parsed:
    out = Parsed([], {}, [], [], None)
    for ident, _, start, end in _elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        scale, lasting = 1_000_000, {}
        for kind, first, a, b in _elements(data, start, end):
            if kind == INFO:
                for i, _, s, e in _elements(data, a, b):
                    if i == TIMESTAMP_SCALE:
                        scale = _uint(data, s, e)
                    elif i == DURATION:
                        out.duration = struct.unpack(">d" if e - s == 8 else ">f", data[s:e])[0]
            elif kind == TRACKS:
                for i, _, s, e in _elements(data, a, b):
                    if i == TRACK_ENTRY:
                        own = {j: data[x:y] for j, _, x, y in _elements(data, s, e)}
                        if DEFAULT_DURATION in own:
                            lasting[int.from_bytes(own[TRACK_NUMBER], "big")] = int.from_bytes(own[DEFAULT_DURATION], "big")
                        out.tracks[int.from_bytes(own[TRACK_NUMBER], "big")] = own[CODEC_ID].decode("ascii", "replace")
            elif kind == CLUSTER:
                out.clusters.append(first)
                base = 0
                for i, _, s, e in _elements(data, a, b):
                    if i == CLUSTER_TIMESTAMP:
                        base = _uint(data, s, e)
                    elif i == SIMPLE_BLOCK:
                        out.packets.extend(_packets(data, s, e, base, None, scale, lasting))
                    elif i == BLOCK_GROUP:
                        own = {j: (x, y) for j, _, x, y in _elements(data, s, e)}
                        if BLOCK in own:
                            out.packets.extend(_packets(data, *own[BLOCK], base, REFERENCE not in own, scale, lasting))
            elif kind == CUES:
                for i, _, s, e in _elements(data, a, b):
                    if i == CUE_POINT:
                        time = 0
                        for j, _, x, y in _elements(data, s, e):
                            if j == CUE_TIME:
                                time = _uint(data, x, y)
                            elif j == CUE_TRACK_POSITIONS:
                                own = {k: _uint(data, p, q) for k, _, p, q in _elements(data, x, y)}
                                out.cues.append((time, own.get(CUE_TRACK, 0), start + own[CUE_CLUSTER]))
        if any(c[2] not in out.clusters for c in out.cues):
            raise ValueError("a cue does not point at a cluster")
    return out


def demux(data: bytes, track: int = 1) -> bytes:
    return b"".join(data[p.start : p.end] for p in parse(data).packets if p.track == track)


def _store(texts: list[bytes]) -> dict[str, pa.Array]:
    return {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), "media": pa.array([mux(padded(t)) for t in texts], pa.binary())}


def write(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: the files, stored as a table in the shared folder and read from there."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(source.transform(mapped, by_block(_store), "doc_id long, n_bytes long, media binary"), "media")


def packets(media: DataFrame) -> DataFrame:
    """doc_id, packet, track, timestamp_ms, key_frame, lacing, byte_start, byte_end: one row a packet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files = batch.column("doc_id").to_pylist(), utf8(batch.column("media"))
            for part in blocks(map(len, files)):
                rows = [(i, k, p.track, p.timestamp, p.key, p.lacing, p.start, p.end) for i, f in zip(ids[part], files[part]) for k, p in enumerate(parse(f).packets)]
                columns = list(zip(*rows)) or [()] * 8
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "packet", "track", "timestamp_ms", "key_frame", "lacing", "byte_start", "byte_end"])

    return media.select("doc_id", "media").transform(mapped, run, "doc_id long, packet long, track long, timestamp_ms long, key_frame boolean, lacing string, byte_start long, byte_end long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        files = utf8(batch.column("media"))
        rows = []
        for f in files:
            got = parse(f)
            payload = b"".join(f[p.start : p.end] for p in got.packets)
            laced = [sum(p.lacing == k for p in got.packets) for k in ("none", "xiph", "fixed", "ebml")]
            last = got.packets[-1].timestamp if got.packets else 0
            feature = f"tracks={len(got.tracks)};packets={len(got.packets)};clusters={len(got.clusters)};cues={len(got.cues)};lacing={'/'.join(map(str, laced))};last_ms={last};mean_sample={sum(payload) / max(1, len(payload)):.4f}"
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(f), hashlib.sha256(f).hexdigest(), feature))
        kinds = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}
        made = {k: pa.array(c, t) for (k, t), c in zip(kinds.items(), zip(*rows))} if rows else {k: pa.array([], t) for k, t in kinds.items()}
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_bytes": batch.column("n_bytes")} | made)


def digest(media: DataFrame) -> DataFrame:
    """What the stored files hold: sizes, SHA-256 of payload and file, CRC-32 of the payload's last 16 bytes, a feature line."""
    return media.select("doc_id", "n_bytes", "media").transform(mapped, _digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
