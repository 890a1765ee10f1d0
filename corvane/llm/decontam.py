"""Benchmark decontamination by winnowing.

From each window of consecutive k-word hashes the smallest is kept, in
documents and in benchmark items alike, so any shared span of ``window`` words
shares a kept hash at the same place. Hits are extended word by word in both
directions; spans of ``window`` words or more are marked. Items with fewer
words than a window are one window each and are looked for whole.

The benchmark is held in memory by blocks of at most ``BLOCK_WORDS`` words;
if there are several, documents are scanned once a block and the spans united.

Defined results: null and empty texts have no words and are clean; an empty
table of documents gives no rows; an empty benchmark marks nothing; very long
texts are blocks of their own and are scanned whole; repeated rows are documents of their own; a null
item_id counts as the empty string; other columns are ignored.
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

#: Words of a window, and of a fingerprint.
WINDOW, K = 10, 5
#: Words of the benchmark that one scan holds (16 bytes a word, with its fingerprints).
BLOCK_WORDS = 2_000_000

HITS = "doc_id long, n_words long, spans array<struct<s:int,e:int>>, items array<string>"


def winnowed(hashes: np.ndarray, width: int, usable: np.ndarray) -> np.ndarray:
    """Places of the leftmost smallest hash of each window of ``width``; usable says which windows count."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = hashes[:n].copy(), np.arange(n)
    for j in range(1, width):
        less = hashes[j : j + n] < best
        best[less] = hashes[j : j + n][less]
        at[less] = np.flatnonzero(less) + j
    return np.unique(at[usable[:n]])


class Index:
    """Fingerprints of a block of benchmark items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW, k: int = K):
        self.window, self.k = window, k
        words, at = kernels.words_of([t for _, t in items], kernels.ALNUM_WORD)
        self.words, self.item = words, np.repeat(np.arange(len(items)), np.diff(at))
        self.begin, self.end = at[:-1], at[1:]
        self.names = [name for name, _ in items]
        length = np.diff(at)
        grams = kernels.shingle_hashes(words, k)
        full = np.zeros(max(0, len(words) - window + 1), bool)
        if len(full):
            full[:] = self.item[: len(full)] == self.item[window - 1 :]
        places = winnowed(grams, window - k + 1, full)
        order = np.argsort(grams[places], kind="stable")
        self.places, self.prints = places[order], grams[places][order]
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in range(1, window):
            own = np.flatnonzero(length == m)
            if len(own):
                h = kernels.shingle_hashes(words, m)[at[own]]
                order = np.argsort(h, kind="stable")
                self.short[m] = (h[order], own[order])

    def hits(self, words: np.ndarray, at: np.ndarray) -> list[tuple[list[tuple[int, int]], set[int]]]:
        """For each document the spans that are hit (merged, from its first word) and the items."""
        out: list[tuple[list, set]] = [([], set()) for _ in range(len(at) - 1)]
        n = len(words)
        doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found = [np.zeros((0, 3), np.int64)]  # document, start and end
        marked = [np.zeros((0, 2), np.int64)]  # document, item
        if len(self.prints) and n >= self.window:
            grams = kernels.shingle_hashes(words, self.k)
            within = doc[: n - self.window + 1] == doc[self.window - 1 :]
            places = winnowed(grams, self.window - self.k + 1, within)
            lo = np.searchsorted(self.prints, grams[places], "left")
            count = np.searchsorted(self.prints, grams[places], "right") - lo
            places, lo, count = places[count > 0], lo[count > 0], count[count > 0]
            for part in _portions(count):
                p = np.repeat(places[part], count[part])
                q = self.places[_ranges(lo[part], count[part])]
                self._extended(words, at, doc, p, q, found, marked)
        for m, (prints, owners) in self.short.items():
            grams = kernels.shingle_hashes(words, m)
            if not len(grams):
                continue
            lo = np.searchsorted(prints, grams, "left")
            count = np.searchsorted(prints, grams, "right") - lo
            p = np.flatnonzero((count > 0) & (doc[: len(grams)] == doc[m - 1 :]))
            found.append(np.stack([doc[p], p, p + m], axis=1))
            for part in _portions(count[p]):
                own = p[part]
                marked.append(np.unique(np.stack([np.repeat(doc[own], count[own]), owners[_ranges(lo[own], count[own])]], axis=1), axis=0))
        spans = np.unique(np.concatenate(found), axis=0)
        for d, s, e in spans.tolist():
            out[d][0].append((s - int(at[d]), e - int(at[d])))
        for d, i in np.concatenate(marked).tolist():
            out[d][1].add(i)
        return [(merged(s), i) for s, i in out]

    def _extended(self, words: np.ndarray, at: np.ndarray, doc: np.ndarray, p: np.ndarray, q: np.ndarray, found: list, marked: list) -> None:
        """Extend pairs of places to both sides, all at once; of those on one diagonal only the first that no span covers yet."""
        by = np.lexsort((p, p - q))
        p, q = p[by], q[by]
        while len(p):
            diagonal = p - q
            first = np.flatnonzero(np.concatenate([[True], diagonal[1:] != diagonal[:-1]]))
            a, b = p[first], q[first]
            d, i = doc[a], self.item[b]
            right = _reach(words, a, self.words, b, np.minimum(at[d + 1] - a, self.end[i] - b), 1)
            left = _reach(words, a - 1, self.words, b - 1, np.minimum(a - at[d], b - self.begin[i]), -1)
            ok = left + right >= self.window
            found.append(np.unique(np.stack([d[ok], a[ok] - left[ok], a[ok] + right[ok]], axis=1), axis=0))
            marked.append(np.unique(np.stack([d[ok], i[ok]], axis=1), axis=0))
            covered = p < np.repeat(a + np.maximum(right, 1), np.diff(np.append(first, len(p))))
            p, q = p[~covered], q[~covered]


#: Pairs of places that are extended at once.
PAIRS = 1 << 20


def _portions(count: np.ndarray) -> Iterator[slice]:
    """Slices with about PAIRS pairs each."""
    ends = np.cumsum(count)
    start = 0
    while start < len(count):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, "right")))
        yield slice(start, stop)
        start = stop


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for so many, then the same from starts[1], and so on."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def _reach(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray, most: np.ndarray, step: int) -> np.ndarray:
    """How many words from a[i] and b[j] on are equal, ``most`` at most, forwards or backwards."""
    n = np.zeros(len(i), np.int64)
    live = np.flatnonzero(most > 0)
    t = 0
    while len(live):
        live = live[a[i[live] + step * t] == b[j[live] + step * t]]
        t += 1
        n[live] = t
        live = live[most[live] > t]
    return n


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _scan(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            texts = utf8(batch.column("text"))
            for part in blocks(map(len, texts)):
                words, at = kernels.words_of(texts[part], kernels.ALNUM_WORD)
                found = index.hits(words, at)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id").slice(part.start, part.stop - part.start),
                        "n_words": pa.array(np.diff(at), pa.int64()),
                        "spans": pa.array([[{"s": s, "e": e} for s, e in x] for x, _ in found], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))),
                        "items": pa.array([sorted({index.names[i] for i in y}) for _, y in found], pa.list_(pa.string())),
                    }
                )

    return run


def _item_blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of bounded size; one partition at a time comes to the driver."""
    held, n = [], 0
    for row in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).toLocalIterator():
        text = row["text"].encode("utf-8")
        words = len(text) // 2 + 1
        if held and n + words > limit:
            yield held
            held, n = [], 0
        held.append((row["item_id"], text))
        n += words
    yield held


def _for_each_block(source: DataFrame, benchmark: DataFrame, window: int, k: int, block_words: int, scan, schema: str) -> DataFrame:
    """What ``scan`` gives for ``source`` and each block of the benchmark.

    A single block is one narrow pass. Of several, each is scanned and its result stored before the next is sent out,
    so that the driver and the tasks hold one block at a time.
    """
    spark = source.sparkSession
    item_blocks = _item_blocks(benchmark, block_words)
    block, after, paths = next(item_blocks), next(item_blocks, None), []
    while block is not None:
        held = spark.sparkContext.broadcast(Index(block, window, k))
        made = source.transform(mapped, scan(held), schema)
        if after is None and not paths:
            return made
        paths.append(stored(made, "found")._corvane_path)
        held.destroy()
        block, after = after, next(item_blocks, None)
    return spark.read.schema(made.schema).parquet(*paths)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, spans (start and end word, merged), items: one row a document."""
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if _one_block(benchmark, block_words):
        return _for_each_block(source, benchmark, window, k, block_words, _scan, HITS)
    # More than one block: number the rows in a stored table, scan it once a block, unite the spans.
    source = stored(source.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = _for_each_block(source.select(F.col("row").alias("doc_id"), "text"), benchmark, window, k, block_words, _scan, HITS)
    united = found.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return source.select("row", "doc_id").join(united, "row").select("doc_id", "n_words", "spans", F.array_sort("items").alias("items"))


def _one_block(benchmark: DataFrame, block_words: int) -> bool:
    """Whether the benchmark is one block, by the same measure as ``_item_blocks``."""
    words = benchmark.select(F.sum(F.floor(F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))) / 2) + 1)).first()[0]
    return (words or 0) <= block_words


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from ``find``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            hit = [sum(e - s for s, e in merged([(x["s"], x["e"]) for x in own])) for own in spans]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": batch.column("n_words"),
                    "n_hit": pa.array(hit, pa.int64()),
                    "n_items": pa.array([len(x) for x in items], pa.int64()),
                    "items_sha256": pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items], pa.string()),
                    "contaminated": pa.array([h > 0 for h in hit], pa.bool_()),
                }
            )

    return found.transform(mapped, run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns; for several blocks of the benchmark, one pass for each over the texts alone."""

    def kept(wanted: bool):
        def scan(held):
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    texts, clean_ = utf8(batch.column("text")), []
                    for part in blocks(map(len, texts)):
                        clean_ += [not spans for spans, _ in held.value.hits(*kernels.words_of(texts[part], kernels.ALNUM_WORD))]
                    rows = batch.filter(pa.array(clean_, pa.bool_()) if wanted else pa.array([not x for x in clean_], pa.bool_()))
                    yield rows if wanted else rows.select(["__corvane_row"])

            return run

        return scan

    if _one_block(benchmark, block_words):
        return _for_each_block(docs, benchmark, window, k, block_words, kept(True), docs.schema)
    numbered = stored(docs.withColumn("__corvane_row", F.monotonically_increasing_id()), "numbered")
    hit = _for_each_block(numbered.select("__corvane_row", F.col("text").cast("string").alias("text")), benchmark, window, k, block_words, kept(False), "__corvane_row long")
    return numbered.join(hit.distinct(), "__corvane_row", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
