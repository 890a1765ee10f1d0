"""Removal of repeated byte strings with per-shard suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else is found and cut, in four steps.

1. Each window of LENGTH bytes picks its leftmost smallest ``GRAM``-byte hash,
   its anchor. The windows of one anchor are consecutive; with their bytes they
   form a context. Equal windows pick anchors of equal hash, so each window
   belongs to one context and only contexts whose hash stands at two places or
   more can hold repeats. Hashes that a block of texts has twice are settled
   there; one place of each hash goes on, so frequent passages shrink before
   the shuffle.
2. The texts that have such anchors give their contexts, equal ones of a task
   as one with a weight.
3. Contexts are dealt to shards by anchor hash. A shard sorts its suffixes by
   Larsson-Sadakane refinement (prefix doubling of groups that are still open),
   and Kasai's scan gives the common prefixes of neighbours; a window repeats
   if a neighbour shares LENGTH bytes.
4. Only where one hash has more contexts than a shard holds is it cut into
   several shards; their windows' sorted fingerprints are then merged by binary
   search, each shard's within the others'.

Texts are named by 128-bit hashes. Texts that occur twice or more are repeated
as a whole and are only partners of others.

Defined results: null is the empty text; texts under LENGTH bytes keep all;
repeated rows are places of their own, so equal texts of LENGTH bytes or more
lose everything; ids may be null or repeat; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, mapped, stored, utf8

LENGTH, GRAM = 200, 64
#: Bits of a packed value that hold the position; chunks of a text are no longer than that.
POSITION_BITS = 24
CHUNK = 1 << 22
#: Bytes of contexts in a shard, contexts of one hash in a shard, buckets of hashes for each task.
SHARD_BYTES, SHARD_CONTEXTS = 2 << 20, 8000
#: Hashes with more contexts than a shard holds that are sent to all tasks, at most.
HOT_HASHES = 100_000
BLOCK = 1 << 20


def name_of(text: bytes) -> bytes:
    """128 bits, so that no two texts of any corpus share them."""
    return hashlib.blake2b(text, digest_size=16).digest()


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash, first window, last window) of each anchor; windows count from their text's start."""
    buf, starts = kernels.concatenated(texts, b"")
    parts = []
    # A long buffer is done in chunks of windows; each window is in one chunk.
    for base in range(0, max(1, len(buf) - length + 1), CHUNK):
        parts.append(_anchors(buf[base : base + CHUNK + length - 1], base, starts, length, gram))
    return tuple(np.concatenate(x) for x in zip(*parts))


def _anchors(buf: np.ndarray, base: int, starts: np.ndarray, length: int, gram: int):
    n, width = len(buf), length - gram + 1
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(kernels.BYTE_VALUES[buf] * kernels.powers(kernels.BASE, n), out=total[1:])
    hashes = kernels.mix((total[gram:] - total[:-gram]) * kernels.powers(kernels.BASE_INVERSE, n + 1)[: n - gram + 1])
    bits = np.uint64((1 << POSITION_BITS) - 1)
    low = (hashes & ~bits) | np.arange(len(hashes), dtype=np.uint64)
    span = 1
    while span * 2 <= width:  # the smallest of 2, 4, 8 ... consecutive
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    first = np.arange(len(low)) + base
    text = np.searchsorted(starts, first, "right") - 1
    whole = np.flatnonzero(first + length <= starts[text + 1])
    at = (low[whole] & bits).astype(np.int64)
    if not len(whole):
        return none, none, none, none
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)]))
    last = np.append(new[1:], len(whole)) - 1
    own = text[whole[new]]
    return own, hashes[at[new]].view(np.int64), first[whole[new]] - starts[own], first[whole[last]] - starts[own]


_SCANNED = "kind int, doc_id long, name binary, n long, sha binary, bucket long, hash binary, owner binary, first binary, last binary"


def _scan(buckets: int, length: int, gram: int):
    """Kind 0: a row a document. Kind 1: anchors settled here (hash, first, last of one text). Kind 2: anchors for a bucket."""
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("name", pa.binary()), ("n", pa.int64()), ("sha", pa.binary()), ("bucket", pa.int64()), ("hash", pa.binary()), ("owner", pa.binary()), ("first", pa.binary()), ("last", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            texts, ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            for part in blocks(map(len, texts), BLOCK):
                rows, names, fresh = [], [], []
                for doc_id, t in zip(ids[part], texts[part]):
                    name = name_of(t)
                    rows.append((0, doc_id, name, len(t), hashlib.sha256(t).digest(), None, None, None, None, None))
                    if len(t) >= length and name not in seen:
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(name)
                        names.append(name)
                        fresh.append(t)
                if fresh:
                    rows += _dealt(_owners(b"".join(names)), *anchors(fresh, length, gram), buckets)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _owners(names: bytes) -> np.ndarray:
    """Names as rows of two numbers."""
    return np.frombuffer(names, np.int64).reshape(-1, 2)


def _dealt(names: np.ndarray, text, hashes, first, last, buckets: int) -> list[tuple]:
    rows = []
    by = np.argsort(hashes, kind="stable")
    text, hashes, first, last = text[by], hashes[by], first[by].astype(np.int32), last[by].astype(np.int32)
    new = np.concatenate([[True], hashes[1:] != hashes[:-1]])
    run = np.cumsum(new) - 1
    twice = np.bincount(run)[run] > 1
    # Settled: all places of a hash that this block has twice.
    own = np.flatnonzero(twice)
    own = own[np.argsort(text[own], kind="stable")]
    for part in np.split(own, np.flatnonzero(np.diff(text[own])) + 1) if len(own) else []:
        rows.append((1, None, names[text[part[0]]].tobytes(), None, None, None, hashes[part].tobytes(), None, first[part].tobytes(), last[part].tobytes()))
    # One place of each hash goes on; a last window below 0 marks a hash that is settled.
    one = np.flatnonzero(new)
    mark = np.where(twice[one], -1 - last[one], last[one]).astype(np.int32)
    bucket = (hashes[one].view(np.uint64) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        at = order[ends[b] : ends[b + 1]]
        if len(at):
            k = one[at]
            rows.append((2, None, None, None, None, b, hashes[k].tobytes(), names[text[k]].tobytes(), first[k].tobytes(), mark[at].tobytes()))
    return rows


_ANCHORS = "name binary, hash binary, first binary, last binary"


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of a task's buckets whose hash stands at two places or more, by text."""
    parts = [(np.frombuffer(r["hash"], np.int64), _owners(r["owner"]), np.frombuffer(r["first"], np.int32), np.frombuffer(r["last"], np.int32)) for batch in batches for r in batch.select(["hash", "owner", "first", "last"]).to_pylist()]
    if not parts:
        return
    hashes, owner, first, mark = (np.concatenate([p[i] for p in parts]) for i in range(4))
    del parts
    settled = mark < 0
    last = np.where(settled, -1 - mark, mark)
    by = np.lexsort((first, owner[:, 1], owner[:, 0], hashes))
    hashes, owner, first, last, settled = hashes[by], owner[by], first[by], last[by], settled[by]
    run = np.cumsum(np.concatenate([[True], hashes[1:] != hashes[:-1]])) - 1
    place = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]).any(1) | (first[1:] != first[:-1])])
    places = np.bincount(run, weights=place)
    keep = place & ((places[run] > 1) | (np.bincount(run, weights=settled)[run] > 0))
    hashes, owner, first, last = hashes[keep], owner[keep], first[keep], last[keep]
    by = np.lexsort((owner[:, 1], owner[:, 0]))
    hashes, owner, first, last = hashes[by], owner[by], first[by], last[by]
    cut = np.append(np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]).any(1)])) if len(owner) else [], len(owner)).astype(np.int64)
    for k in range(0, len(cut) - 1, 5000):
        spans = [slice(a, b) for a, b in zip(cut[k : k + 5000].tolist(), cut[k + 1 : k + 5001].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array([owner[s.start].tobytes() for s in spans], pa.binary()), *(pa.array([x[s].tobytes() for s in spans], pa.binary()) for x in (hashes, first, last))], names=["name", "hash", "first", "last"])


def _texts(length: int):
    """name, raw: each text of at least ``length`` bytes, once a task as a rule."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            names, kept = [], []
            for t in utf8(batch.column("text")):
                if len(t) >= length and (name := name_of(t)) not in seen:
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(name)
                    names.append(name)
                    kept.append(t)
            yield pa.RecordBatch.from_pydict({"name": pa.array(names, pa.binary()), "raw": pa.array(kept, pa.binary())})

    return run


_CONTEXTS = "kind int, name binary, hash long, context binary, bytes binary, weight long, first int"
_CONTEXT_SCHEMA = pa.schema([("kind", pa.int32()), ("name", pa.binary()), ("hash", pa.int64()), ("context", pa.binary()), ("bytes", pa.binary()), ("weight", pa.int64()), ("first", pa.int32())])


def _contexts(length: int):
    """Kind 0: a context with the weight it has in this stretch. Kind 1: a place of a context. Kind 2: a text (bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: dict[bytes, list] = {}
        size = 0

        def flushed() -> pa.RecordBatch:
            rows = [(0, None, h, c, b, w, None) for c, (h, b, w) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT_SCHEMA)], schema=_CONTEXT_SCHEMA)

        for batch in batches:
            raws = utf8(batch.column("raw"))
            for part in blocks(map(len, raws)):
                rows = []
                more = [batch.column(c)[part.start : part.stop].to_pylist() for c in ("name", "copies", "parts")]
                for raw, name, copies, parts in zip(raws[part], *more):
                    if copies > 1:  # dealt from several tasks; once is enough, and more does no harm
                        if name in seen:
                            continue
                        if len(seen) >= 500_000:
                            seen.clear()
                        seen.add(name)
                    rows.append((2, name, None, None, raw, copies, None))
                    found = set()
                    for p in parts:
                        found.update(zip(np.frombuffer(p["hash"], np.int64).tolist(), np.frombuffer(p["first"], np.int32).tolist(), np.frombuffer(p["last"], np.int32).tolist()))
                    for h, first, last in sorted(found, key=lambda x: x[1]):
                        own = raw[first : last + length]
                        context = hashlib.blake2b(h.to_bytes(8, "little", signed=True) + own, digest_size=16).digest()
                        if copies < 2:
                            rows.append((1, name, None, context, None, None, first))
                        if context in held:
                            held[context][2] += min(copies, 2)
                        else:
                            held[context] = [h, own, min(copies, 2)]
                            size += len(own) + 200
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _CONTEXT_SCHEMA)], schema=_CONTEXT_SCHEMA)
                if size > 16 << 20:
                    yield flushed()
                    held, size = {}, 0
        if held:
            yield flushed()

    return run


def suffix_order(buf: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``buf`` by its first ``limit`` bytes at least, ties by position, and each suffix's rank.

    Larsson-Sadakane: a suffix's group is numbered by its first place in the
    array; each round sorts only the groups with several members, by the group
    of the suffix that many bytes on, and doubles the bytes.
    """
    n = len(buf)
    wide = np.concatenate([buf, np.zeros(8, np.uint8)])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | wide[j : j + n]
    order = np.argsort(key, kind="stable")
    group = np.zeros(n + 1, np.int64)  # 0 is beyond the end; others are places from 1
    by = key[order]
    new = np.concatenate([[True], by[1:] != by[:-1]])
    group[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)) + 1
    step = 8
    while step < limit:
        g = group[order]
        open_ = np.zeros(n, bool)
        same = g[1:] == g[:-1]
        open_[1:] |= same
        open_[:-1] |= same
        at = np.flatnonzero(open_)
        if not len(at):
            break
        suffix = order[at]
        pair = (group[suffix].astype(np.uint64) << np.uint64(32)) | group[np.minimum(suffix + step, n)].astype(np.uint64)
        by = np.argsort(pair, kind="stable")  # groups keep their places, as they are in order already
        suffix, pair = suffix[by], pair[by]
        order[at] = suffix
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        group[suffix] = np.maximum.accumulate(np.where(new, at, 0)) + 1
        step *= 2
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    return order, rank


def common_prefixes(key: np.ndarray, before: np.ndarray, rank: np.ndarray, first: np.ndarray, windows: np.ndarray, limit: int) -> np.ndarray:
    """Bytes (up to ``limit``) that each window shares with the one before it in the array, by Kasai's scan.

    ``key`` has the eight bytes at each place; ``before`` the window before
    (-1: none). Contexts (``first`` place, number of ``windows``) are scanned
    side by side: from one place to the next at most one byte is lost.
    """
    shared = np.zeros(len(before), np.int64)
    by = np.argsort(-windows, kind="stable")
    first, windows = first[by], windows[by]
    carried = np.zeros(len(first), np.int64)
    for j in range(int(windows[0]) if len(windows) else 0):
        live = int(np.searchsorted(-windows, -j, "left"))
        p = first[:live] + j
        q = before[p]
        h = np.maximum(carried[:live] - 1, 0)
        if j:
            # The loss of one byte holds if the former neighbour's next place is a window that stands before p.
            former = before[p - 1] + 1
            h[(former <= 0) | (before[np.minimum(former, len(before) - 1)] == -2) | (rank[former] >= rank[p])] = 0
        h[q < 0] = 0
        at = np.flatnonzero((q >= 0) & (h < limit))
        while len(at):
            x = key[p[at] + h[at]] ^ key[q[at] + h[at]]
            odd_here = x != 0
            h[at[~odd_here]] += 8
            odd, x = at[odd_here], x[odd_here]
            for bits in range(8, 64, 8):
                h[odd] += x < np.uint64(1 << bits)
            at = at[~odd_here]
            at = at[h[at] < limit]
        h = np.minimum(h, limit)
        shared[p] = h
        carried = h
    return shared


def repeats(contexts: list[bytes], length: int = LENGTH) -> np.ndarray:
    """For each window of the contexts end to end (True at its first byte): does it occur twice in this shard?"""
    buf = np.frombuffer(b"".join(contexts), np.uint8)
    size = np.array([len(c) for c in contexts], np.int64)
    first = np.cumsum(size) - size
    windows = size - length + 1
    order, rank = suffix_order(buf, length)
    is_window = np.zeros(len(buf) + 1, bool)
    is_window[np.repeat(first, windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)] = True
    order = order[is_window[order]]
    before = np.full(len(buf) + 1, -2, np.int64)  # -2: no window starts there
    before[order] = np.concatenate([[-1], order[:-1]])
    rank = np.append(rank, len(buf))
    padded = np.concatenate([buf, np.zeros(length + 16, np.uint8)])
    key = np.zeros(len(buf) + length + 8, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | padded[j : j + len(key)]
    shared = common_prefixes(key, before, rank, first, windows, length)
    out = np.zeros(len(buf), bool)
    hit = order[shared[order] >= length]
    out[hit] = True
    out[before[hit]] = True
    return out


def _intervals(flags: np.ndarray, length: int) -> list[dict]:
    s, e = kernels.spans(flags)
    return [{"s": a, "e": b + length - 1} for a, b in zip(s.tolist(), e.tolist())]


_VERDICTS = "kind int, context binary, spans array<struct<s:int,e:int>>, hash long, part long, prints binary, owners binary, offsets binary"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_VERDICT_SCHEMA = pa.schema([("kind", pa.int32()), ("context", pa.binary()), ("spans", _SPANS), ("hash", pa.int64()), ("part", pa.int64()), ("prints", pa.binary()), ("owners", pa.binary()), ("offsets", pa.binary())])


def _shards(length: int, shard_bytes: int):
    """Kind 0: the repeated spans of a context. Kind 1: the fingerprints of a hash's shard, by range, if it has several."""

    def done(held: list[list]) -> list[tuple]:
        """held: [hash, salts, context, bytes, weight], all of a (hash, salt) together."""
        rows = [(0, c, [{"s": 0, "e": len(b)}], None, None, None, None, None) for _, salts, c, b, w in held if w > 1]
        alone: dict[int, bool] = {}
        count: dict[int, int] = {}
        for h, salts, _, _, w in held:
            count[h] = count.get(h, 0) + 1
            alone[h] = alone.get(h, False) or w < 2
        # A hash's only context, or contexts that all repeat as a whole, need no sorting.
        need = [x for x in held if x[1] > 1 or alone[x[0]] and count[x[0]] > 1 or len(x[3]) > length and x[4] < 2]
        if not need:
            return rows
        flags = repeats([x[3] for x in need], length)
        at = 0
        for h, salts, c, b, w in need:
            own = flags[at : at + len(b)]
            if w < 2 and own.any():
                rows.append((0, c, _intervals(own, length), None, None, None, None, None))
            at += len(b)
        for h in {x[0] for x in need if x[1] > 1}:
            rows += _prints(h, [x for x in need if x[0] == h], length)
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size, key = 0, None
        as_batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _VERDICT_SCHEMA)], schema=_VERDICT_SCHEMA)
        for batch in batches:
            for r in batch.to_pylist():
                if key != (r["hash"], r["salt"]) and size >= shard_bytes:
                    if rows := done(held):
                        yield as_batch(rows)
                    held, size = [], 0
                key = (r["hash"], r["salt"])
                if held and held[-1][2] == r["context"]:
                    held[-1][4] += r["weight"]
                else:
                    held.append([r["hash"], r["salts"], r["context"], r["bytes"], r["weight"]])
                    size += len(r["bytes"])
        if held and (rows := done(held)):
            yield as_batch(rows)

    return run


def _prints(h: int, own: list[list], length: int) -> list[tuple]:
    """Sorted 128-bit fingerprints of a shard's windows, by range; owners and offsets say which window of which context."""
    salts = own[0][1]
    prints, owner, offset = [], [], []
    for i, (_, _, _, b, _) in enumerate(own):
        for j in range(len(b) - length + 1):
            prints.append(hashlib.blake2b(b[j : j + length], digest_size=16).digest())
            owner.append(own[i][2])
            offset.append(j)
    by = sorted(range(len(prints)), key=prints.__getitem__)
    rows: dict[int, list[int]] = {}
    for i in by:
        rows.setdefault(int.from_bytes(prints[i][:8], "big") * salts >> 64, []).append(i)
    return [(1, None, None, h, part, b"".join(prints[i] for i in at), b"".join(owner[i] for i in at), np.array([offset[i] for i in at], np.int32).tobytes()) for part, at in rows.items()]


def _merged(length: int):
    """Merge the shards' fingerprints of one hash and range: windows that another shard has too."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        runs = [(np.frombuffer(r["prints"], "S16"), np.frombuffer(r["owners"], "S16"), np.frombuffer(r["offsets"], np.int32), r["owners"]) for r in table.to_pylist()]
        found: dict[bytes, list[int]] = {}
        for i, (prints, _, offsets, owners) in enumerate(runs):
            hit = np.zeros(len(prints), bool)
            for j, (other, _, _, _) in enumerate(runs):
                if i != j:  # binary search of one sorted run in the other
                    at = np.minimum(np.searchsorted(other, prints), len(other) - 1)
                    hit |= other[at] == prints
            for k in np.flatnonzero(hit).tolist():
                found.setdefault(owners[16 * k : 16 * k + 16], []).append(int(offsets[k]))
        spans = [[{"s": o, "e": o + length} for o in sorted(x)] for x in found.values()]
        return pa.table({"context": pa.array(list(found), pa.binary()), "spans": pa.array(spans, _SPANS)})

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for raw, found in zip(utf8(batch.column("raw")), batch.column("found").to_pylist()):
            spans = merged([(f["first"] + s["s"], f["first"] + s["e"]) for f in found for s in f["spans"]])
            kept, at = [], 0
            for s, e in spans:
                kept.append(raw[at:s])
                at = e
            kept = b"".join([*kept, raw[at:]])
            rows.append((len(raw) - len(kept), len(spans), hashlib.sha256(kept).digest(), [{"s": s, "e": e} for s, e in spans]))
        removed, n, sha, spans = zip(*rows) if rows else ((), (), (), ())
        yield pa.RecordBatch.from_pydict({"name": batch.column("name"), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(n, pa.int64()), "kept": pa.array(sha, pa.binary()), "spans": pa.array(spans, _SPANS)})


def find(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, shard_contexts: int = SHARD_CONTEXTS, hot_hashes: int = HOT_HASHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges that go) for each row of ``docs``."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scanned = stored(docs.transform(mapped, _scan(2 * tasks, length, gram), _SCANNED), "scanned")
    rows = scanned.where("kind = 0").select("doc_id", "name", "n", "sha")
    copies = rows.groupBy("name").agg(F.count("*").alias("copies"))
    dealt = scanned.where("kind = 2").select("bucket", "hash", "owner", "first", "last").repartition(tasks, "bucket").transform(mapped, _repeated, _ANCHORS)
    found = scanned.where("kind = 1").select("name", "hash", "first", "last").union(dealt).groupBy("name").agg(F.collect_list(F.struct("hash", "first", "last")).alias("parts")).join(copies, "name")
    made = stored(docs.select("text").transform(mapped, _texts(length), "name binary, raw binary").join(found, "name").transform(mapped, _contexts(length), _CONTEXTS), "contexts")
    contexts = made.where("kind = 0").select("hash", "context", "bytes", "weight")
    # Only hashes with more contexts than a shard holds are salted. They go to all tasks if they are few; beyond that
    # it is a join on the hash, whose skewed side Spark may split.
    many = contexts.groupBy("hash").agg(F.count("*").alias("m")).where(F.col("m") > shard_contexts)
    hot = stored(many.select("hash", F.ceil(F.col("m") / shard_contexts).cast("long").alias("hot_salts")), "hot")
    salted = contexts.join(F.broadcast(hot) if hot.count() <= hot_hashes else hot, "hash", "left").withColumn("salts", F.coalesce("hot_salts", F.lit(1).cast("long"))).drop("hot_salts").withColumn("salt", F.pmod(F.xxhash64("context"), "salts"))
    verdicts = stored(salted.repartition(F.col("hash"), F.col("salt")).sortWithinPartitions("hash", "salt", "context").transform(mapped, _shards(length, shard_bytes), _VERDICTS), "verdicts")
    across = verdicts.where("kind = 1").groupBy("hash", "part").applyInArrow(_merged(length), "context binary, spans array<struct<s:int,e:int>>")
    spans = verdicts.where("kind = 0").select("context", "spans").union(across)
    places = made.where("kind = 1").select("name", "context", "first").join(spans, "context")
    by_text = places.groupBy("name").agg(F.collect_list(F.struct("first", "spans")).alias("found"))
    cut = made.where("kind = 2 and weight < 2").select("name", F.col("bytes").alias("raw")).join(by_text, "name").transform(mapped, _cut, "name binary, n_removed long, n_spans long, kept binary, spans array<struct<s:int,e:int>>")
    whole = (F.col("copies") > 1) & (F.col("n") >= length)
    out = rows.join(copies, "name").join(cut, "name", "left")
    return out.select(
        "doc_id",
        F.col("n").alias("n_bytes"),
        F.when(whole, F.col("n")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.lower(F.hex(F.coalesce("kept", "sha")))).alias("kept_sha256"),
        F.when(whole, F.array(F.struct(F.lit(0).alias("s"), F.col("n").cast("int").alias("e")))).otherwise(F.coalesce("spans", F.array().cast("array<struct<s:int,e:int>>"))).alias("spans"),
    )
