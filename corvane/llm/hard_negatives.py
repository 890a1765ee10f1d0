"""Hard negatives by product quantisation with rigorous bounds.

Vectors of integers are cut into subspaces of two components. The codebooks of
the subspaces are fitted on a bounded sample; each row is stored with its codes,
the norms of what the codes leave over in each subspace (rounded up) and its
components. A scan adds up lookup tables of an anchor's products with the
codewords. By the Cauchy-Schwarz inequality the exact score differs from that sum
by at most the sum of the products of the anchor's and the residual's norms, so
rows are left out only if their bound shows that they can't be in the result;
scores of the rest are computed exactly from the integers.

Two scans: the first finds each anchor's positives (rows of its label with the
highest scores), the second, for each positive, the rows of other labels with the
highest scores within the window. Both go through all rows, for blocks of
anchors of bounded size; a task keeps a few rows for each anchor or window, and
only those are shuffled. More anchors mean more scans, no larger broadcasts.

Defined results: rows with a null label or vector, or with a null or non-finite
component, take no part, nor do rows with a null id as anchors; as positives and
negatives such rows stand last among ties. Shorter vectors are filled with zeros,
empty ones have a score of 0. Integer components beyond 2**27 count as 2**27, so
that scores of up to 512 components stay below 2**63. Rows of one id are rows of
their own: the copy of an anchor can be its positive, and ties between them are
in an arbitrary, fixed order. An anchor without positives, a positive without
negatives in its window and an empty table give no rows. Further columns don't
matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, mapped, stored

SCALE = 256
#: Components of a subspace, and codewords for each.
WIDTH, WORDS = 2, 256
#: Rows at most that codebooks are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 8192, 8
#: Anchors of a block, which goes to every task.
ANCHORS = 4096
#: Rows and anchors that a kernel compares at once.
ROWS, SOME = 2048, 256
POSITIVES, NEGATIVES = 5, 5
#: A negative's score is at least this share (in hundredths) of the positive's.
LEAST = 80
_LIMIT = 1 << 27

_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_SCHEMA = "anchor long, place int, row long, vec_id long, score long"


def whole(component: Column) -> Column:
    """floor(256 * x), within the limit."""
    return F.greatest(F.least(F.floor(component * SCALE), F.lit(_LIMIT)), F.lit(-_LIMIT)).cast("int")


def prepared(vectors: DataFrame, label: Column) -> DataFrame:
    """row (a number of its own), vec_id, label and components of the rows that take part; written once."""
    x = F.col("embedding").cast("array<double>")
    sound = F.col("label").isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    some = vectors.where(F.coalesce(sound, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.transform(x, whole).alias("x"))
    return stored(some, "vectors")


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of int64, filled with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    length = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), size), np.int64)
    out[np.arange(size) < length[:, None]] = np.asarray(column.flatten())
    return out


class Codebook:
    """Codewords (subspaces, words, WIDTH) of vectors with ``size`` components."""

    def __init__(self, sample: np.ndarray):
        self.size = sample.shape[1]
        self.parts = -(-self.size // WIDTH)
        cut = self._cut(sample)
        self.words = np.zeros((self.parts, WORDS, WIDTH))
        for s in range(self.parts):
            self.words[s] = self._fitted(np.unique(cut[:, s], axis=0), cut[:, s])

    def _cut(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * WIDTH))
        out[:, : self.size] = x
        return out.reshape(len(x), self.parts, WIDTH)

    @staticmethod
    def _fitted(distinct: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Lloyd's algorithm from codewords spread over the sample."""
        if len(distinct) <= WORDS:
            words = np.zeros((WORDS, WIDTH))
            words[: len(distinct)] = distinct
            return words
        words = distinct[np.random.default_rng(7).permutation(len(distinct))[:WORDS]].astype(np.float64)
        for _ in range(ROUNDS):
            nearest = Codebook._nearest(x, words)
            n = np.bincount(nearest, minlength=WORDS)
            for k in range(WIDTH):
                total = np.bincount(nearest, x[:, k], WORDS)
                words[:, k] = np.where(n > 0, total / np.maximum(n, 1), words[:, k])
        return words

    @staticmethod
    def _nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
        return np.argmin((words * words).sum(1) - 2 * (x @ words.T), axis=1)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (uint8) and the residual's norm in each subspace (float32, not below the true one)."""
        cut = self._cut(x)
        codes = np.empty((len(x), self.parts), np.uint8)
        norms = np.empty((len(x), self.parts), np.float32)
        for s in range(self.parts):
            codes[:, s] = near = self._nearest(cut[:, s], self.words[s])
            left = cut[:, s] - self.words[s][near]
            norms[:, s] = np.nextafter((np.sqrt((left * left).sum(1)) * (1 + 1e-9)).astype(np.float32), np.float32(np.inf))
        return codes, norms

    def tables(self, anchors: np.ndarray) -> np.ndarray:
        """(subspaces, words, anchors): products of codewords with the anchors' parts."""
        return np.einsum("swk,ask->swa", self.words, self._cut(anchors))

    def norms(self, anchors: np.ndarray) -> np.ndarray:
        cut = self._cut(anchors)
        return np.sqrt((cut * cut).sum(2)) * (1 + 1e-9)


def fit(rows: DataFrame) -> Codebook | None:
    """Codebooks from SAMPLE rows at most, those of the smallest hashes; None without rows."""
    size = rows.agg(F.max(F.size("x"))).first()[0]
    if size is None:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(7)), "row").limit(SAMPLE).select("x").toArrow()
    return Codebook(matrix(sample.column("x"), max(1, size)))


_ENCODED = "row long, vec_id long, label long, x binary, codes binary, norms binary"


def _encode(book: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), book.value.size)
            codes, norms = book.value.encode(x)
            made = {c: batch.column(c) for c in ("row", "vec_id", "label")}
            made |= {k: pa.array([r.tobytes() for r in v], pa.binary()) for k, v in (("x", x.astype(np.int32)), ("codes", codes), ("norms", norms))}
            yield pa.RecordBatch.from_pydict(made)

    return run


class Best:
    """The first few rows of each place by score and then id, with their score bounds."""

    def __init__(self, places: int, most: int):
        self.most, self.places = most, places
        self.held = np.zeros((0, 5), np.int64)  # place, -score, id is null, id, row
        self.new: list[np.ndarray] = []
        self.least = np.full(places, -np.inf)

    def add(self, place: np.ndarray, score: np.ndarray, null: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if len(place):
            self.new.append(np.column_stack([place, -score, null, vec_id, row]).astype(np.int64))
        if sum(map(len, self.new)) > max(4096, len(self.held) // 2):
            self.settle()

    def settle(self) -> None:
        rows = np.concatenate([self.held, *self.new])
        self.new = []
        if not len(rows):
            return
        rows = rows[np.lexsort(rows.T[::-1])]
        start = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        rank = np.arange(len(rows)) - np.repeat(start, np.diff(np.append(start, len(rows))))
        self.held = rows[rank < self.most]
        last = rows[rank == self.most - 1]
        self.least[last[:, 0]] = -last[:, 1]


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of pairs of int64 rows."""
    out = np.empty(len(a), np.int64)
    for i in range(0, len(a), 1 << 16):
        out[i : i + (1 << 16)] = np.einsum("ij,ij->i", a[i : i + (1 << 16)], b[i : i + (1 << 16)])
    return out


def _parts(batches: Iterator[pa.RecordBatch], book: Codebook) -> Iterator[tuple]:
    """Blocks of rows as arrays: row, id, whether it is null, label, components, codes, norms."""
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            b = batch.slice(i, ROWS)
            n = b.num_rows
            cell = lambda c, kind, m, b=b, n=n: np.frombuffer(b"".join(b.column(c).to_pylist()), kind).reshape(n, m)
            ids = b.column("vec_id")
            null = np.asarray(ids.is_null()) if ids.null_count else np.zeros(n, bool)
            yield np.asarray(b.column("row")), np.asarray(ids.fill_null(0)), null, np.asarray(b.column("label")), cell("x", np.int32, book.size).astype(np.int64), cell("codes", np.uint8, book.parts), cell("norms", np.float32, book.parts).astype(np.float64)


def _bounds(book: Codebook, lookup: np.ndarray, norms: np.ndarray, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds (rows, anchors) of scores: the looked-up sums less and plus the residuals' share."""
    total = np.zeros((len(codes), lookup.shape[2]))
    for s in range(book.parts):
        total += lookup[s][codes[:, s]]
    # The last terms are above what rounding can change.
    spread = left @ norms.T * (1 + 1e-9) + np.abs(lookup).max(1).sum(0) * 1e-12 + 1e-6
    return total - spread, total + spread


class Scan:
    """What a task knows of a block of anchors: tables by part of the block, labels, rows, and windows of scores."""

    def __init__(self, book: Codebook, anchors: dict[str, np.ndarray]):
        self.book, self.anchors = book, anchors
        x = anchors["x"]
        self.pieces = [slice(i, min(i + SOME, len(x))) for i in range(0, len(x), SOME)]
        self.norms = [book.norms(x[p]) for p in self.pieces]

    def positives(self, batches: Iterator[pa.RecordBatch]) -> Best:
        """The best rows of each anchor's label but itself."""
        own, best = self.anchors, Best(len(self.anchors["x"]), POSITIVES)
        by_label = {k: np.flatnonzero(own["label"] == k) for k in np.unique(own["label"])}
        for row, ids, null, label, x, codes, left in _parts(batches, self.book):
            for k in np.unique(label):
                if k not in by_label:
                    continue
                r = np.flatnonzero(label == k)
                for a in np.array_split(by_label[k], -(-len(by_label[k]) // SOME)):
                    low, high = _bounds(self.book, self.book.tables(own["x"][a]), self.book.norms(own["x"][a]), codes[r], left[r])
                    self_pair = row[r][:, None] == own["row"][a]
                    low[self_pair], high[self_pair] = -np.inf, -np.inf
                    least = best.least[a]
                    if len(r) > POSITIVES:  # as many lower bounds are met or passed already
                        least = np.maximum(least, np.partition(low, len(r) - POSITIVES, axis=0)[len(r) - POSITIVES])
                    i, j = np.nonzero((high >= least) & ~self_pair)
                    i, j = r[i], a[j]
                    best.add(j, exact(x[i], own["x"][j]), null[i], ids[i], row[i])
        best.settle()
        return best

    def negatives(self, batches: Iterator[pa.RecordBatch]) -> Best:
        """The best rows of other labels in each window (anchor, place)."""
        own, best = self.anchors, Best(len(self.anchors["x"]) * POSITIVES, NEGATIVES)
        top = own["top"].astype(np.float64)  # (anchors, POSITIVES), NaN-free: windows that don't exist are empty
        # 80 * top <= 100 * score <= 100 * top in whole numbers.
        floor_ = -((-LEAST * own["top"]) // 100)
        for row, ids, null, label, x, codes, left in _parts(batches, self.book):
            for p, norms in zip(self.pieces, self.norms):
                low, high = _bounds(self.book, self.book.tables(own["x"][p]), norms, codes, left)
                other = label[:, None] != own["label"][p]
                wanted = np.zeros_like(other)
                for k in range(POSITIVES):
                    place = np.arange(p.start, p.stop) * POSITIVES + k
                    wanted |= (high >= np.maximum(floor_[p, k], best.least[place])) & (low <= top[p, k]) & own["real"][p, k]
                i, j = np.nonzero(wanted & other)
                j += p.start
                score = exact(x[i], own["x"][j])
                for k in range(POSITIVES):
                    in_window = own["real"][j, k] & (score >= floor_[j, k]) & (score <= own["top"][j, k]) & (score >= best.least[j * POSITIVES + k])
                    m = i[in_window]
                    best.add(j[in_window] * POSITIVES + k, score[in_window], null[m], ids[m], row[m])
        best.settle()
        return best


def _scan(what: str, book: Broadcast, anchors: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(book.value, anchors.value)
        best = getattr(scan, what)(batches).held
        each = 1 if what == "positives" else POSITIVES
        ids = pa.array(best[:, 3], pa.int64(), mask=best[:, 2].astype(bool))
        yield pa.RecordBatch.from_pydict({"anchor": pa.array(anchors.value["row"][best[:, 0] // each]), "place": pa.array((best[:, 0] % each).astype(np.int32)), "row": pa.array(best[:, 4]), "vec_id": ids, "score": pa.array(-best[:, 1])})

    return run


def _ranked(found: DataFrame, most: int) -> DataFrame:
    """The first rows of each (anchor, place) of what tasks found: a few for each task."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.col("vec_id").isNull(), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def _block(rows, size: int) -> dict[str, np.ndarray]:
    return {"row": np.asarray(rows.column("row")), "label": np.asarray(rows.column("label")), "x": np.frombuffer(b"".join(rows.column("x").to_pylist()), np.int32).reshape(len(rows), size).astype(np.int64)}


def mine(vectors: DataFrame, is_anchor: Column, label: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``vectors`` has vec_id, embedding and label; ``is_anchor`` and ``label`` are expressions over vec_id and label.
    """
    spark = vectors.sparkSession
    rows = prepared(vectors, label)
    book = fit(rows)
    if book is None:
        discard(rows)
        return spark.createDataFrame([], _RESULT)
    shared = spark.sparkContext.broadcast(book)
    coded = stored(rows.transform(mapped, _encode(shared), _ENCODED), "coded")
    chosen = coded.where(F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull())
    # Blocks of bounded size: as many as there are partitions of anchors by a hash, dealt by count.
    n_blocks = max(1, -(-chosen.count() // (ANCHORS // 2)))
    dealt = stored(chosen.select("row", "vec_id", "label", "x", F.pmod(F.xxhash64("row"), F.lit(n_blocks)).alias("block")), "anchors", "block")
    paths, nothing = [], spark.createDataFrame([], _RESULT)
    for b in range(n_blocks):
        block = _block(dealt.where(F.col("block") == b).orderBy("row").toArrow(), book.size)
        if not len(block["row"]):
            continue
        held = spark.sparkContext.broadcast(block)
        positives = stored(_ranked(coded.transform(mapped, _scan("positives", shared, held), _SCHEMA), POSITIVES), "positives")
        held.unpersist()
        tops = positives.select("anchor", "rank", "score").toArrow()  # POSITIVES rows an anchor of the block
        at = np.searchsorted(block["row"], np.asarray(tops.column("anchor")))
        rank = np.asarray(tops.column("rank")) - 1
        block |= {"top": np.zeros((len(block["row"]), POSITIVES), np.int64), "real": np.zeros((len(block["row"]), POSITIVES), bool)}
        block["top"][at, rank], block["real"][at, rank] = np.asarray(tops.column("score")), True
        held = spark.sparkContext.broadcast(block)
        negatives = _ranked(coded.transform(mapped, _scan("negatives", shared, held), _SCHEMA), NEGATIVES)
        named = positives.select("anchor", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
        ids = dealt.where(F.col("block") == b).select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
        found = negatives.join(named, ["anchor", "place"]).join(ids, "anchor")
        found = stored(found.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")
        held.unpersist()
        discard(positives)
        paths.append(found._corvane_path)
    discard(rows, coded, dealt)
    return spark.read.schema(nothing.schema).parquet(*paths) if paths else nothing
