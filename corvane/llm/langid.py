"""Language identification by nearest centroid.

A text becomes a vector of hashed byte bigrams and trigrams of its letters:
1 + log of the count, times inverse document frequency, of length one. Each
language has several centroids from spherical k-means. A text takes the
language of the centroid with the largest cosine; it is rejected if that cosine
falls short of what learned texts of its length reach.

``fit`` takes a sample of at most ``PER_LANGUAGE`` labelled texts a language,
``SAMPLE`` in all, for centroids and radii, and learns the ``LANGUAGES`` values
of lang with the most rows (the documented bounds, which hold at any size);
document frequencies come from all labelled rows.

Defined results: null texts and texts without a letter are ``und`` with score
0 and rejected; without any labelled row every text is ``und``; ties go to the
first language by name; repeated rows are documents of their own; texts are
read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels
from .common import blocks, mapped, utf8

DIMENSIONS = 4096
#: Labelled texts that the centroids are fitted on: of a language, of all together; languages learned. At most, all three.
PER_LANGUAGE, SAMPLE, LANGUAGES = 256, 16_384, 1024
CENTROIDS = 4
#: A text is rejected below this share of the cosine that is usual at its length.
REJECT = 0.4
UNKNOWN = "und"
#: Texts in a block; a row of the matrix has DIMENSIONS cells.
ROWS = 256

_LETTER = kernels.table_of(bytes([*range(97, 123), *range(128, 256)])).astype(bool)


def counts(texts: list[bytes]) -> np.ndarray:
    """How often each hashed bigram and trigram occurs in each text; words are set off by one space."""
    buf, starts = kernels.concatenated(texts)
    buf = kernels.LOWER[buf]
    letter = _LETTER[buf]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first byte after a word stands for the space
    if len(keep):
        keep[starts[1:] - 1] = True  # and the gap after a text keeps texts apart
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))[keep]
    at = np.where(letter, buf, 32)[keep].astype(np.uint32)
    out = np.zeros(len(texts) * DIMENSIONS, np.float32)
    for n in (2, 3):
        if len(at) < n:
            continue
        gram = np.zeros(len(at) - n + 1, np.uint32)
        for j in range(n):
            gram = gram * np.uint32(257) + at[j : j + len(gram)]
        cell = ((gram * np.uint32(0x9E3779B1)) ^ np.uint32(n)) >> np.uint32(20)
        one = doc[: len(gram)] == doc[n - 1 :]
        out += np.bincount(doc[: len(gram)][one] * DIMENSIONS + cell[one], minlength=len(out))
    return out.reshape(len(texts), DIMENSIONS)


def has_letter(text: bytes) -> bool:
    return any(map(str.isalpha, text.decode("utf-8", "replace")))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


def _weighted(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return _unit(np.log1p(raw) * idf)


def clustered(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Spherical k-means from farthest-first seeds."""
    seeds = [_unit(x.mean(axis=0))]
    while len(seeds) < min(k, len(x)):
        seeds.append(x[int(np.argmin(np.max(x @ np.array(seeds).T, axis=1)))])
    c = np.array(seeds)
    for _ in range(rounds):
        own = np.argmax(x @ c.T, axis=1)
        new = np.array([_unit(x[own == j].mean(axis=0)) if (own == j).any() else c[j] for j in range(len(c))])
        if np.allclose(new, c):
            break
        c = new
    return c


@dataclass
class Model:
    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]  # of the centroids
    lengths: np.ndarray  # log2 of the n-grams in a text, ascending
    usual: np.ndarray  # the mean cosine there

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, cosine, rejected."""
        n = len(texts)
        known = np.array([bool(t) and has_letter(t) for t in texts], bool)
        if not len(self.centroids):
            return [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
        raw = counts(texts)
        cosine = _weighted(raw, self.idf) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        score = np.clip(cosine[np.arange(n), best].astype(np.float64), 0, 1)
        score[~known] = 0
        radius = self.radius(raw.sum(axis=1))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, known)], score, ~known | (score < radius)

    def radius(self, grams: np.ndarray) -> np.ndarray:
        """The least cosine that is accepted for texts of so many n-grams."""
        at = np.log2(np.maximum(grams, 1))
        usual = np.interp(at, self.lengths, self.usual)
        short = np.minimum(1, np.sqrt(np.exp2(at - self.lengths[0])))  # below the shortest learned texts
        return REJECT * usual * short


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = np.zeros(DIMENSIONS, np.int64), 0
    for batch in batches:
        texts = utf8(batch.column("text"))
        for part in blocks(map(len, texts), rows=ROWS):
            held += (counts(texts[part]) > 0).sum(axis=0)
        n += len(texts)
    cells = np.flatnonzero(held)
    yield pa.RecordBatch.from_pydict({"cell": pa.array([-1, *cells.tolist()], pa.int64()), "held": pa.array([n, *held[cells].tolist()], pa.int64())})


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = utf8(batch.column("text"))
        for part in blocks(map(len, texts), rows=ROWS):
            raw = counts(texts[part])
            yield pa.RecordBatch.from_pydict({"lang": batch.column("lang").slice(part.start, part.stop - part.start), "raw": pa.array([r.astype("<f4").tobytes() for r in raw], pa.binary())})


def fit(labelled: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """Learn from rows of doc_id, text and lang; rows with a null in text or lang are left out."""
    rows = labelled.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    total = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not total:
        return Model(np.ones(DIMENSIONS), np.zeros((0, DIMENSIONS)), [], np.zeros(1), np.zeros(1))
    frequency = np.zeros(DIMENSIONS)
    n = 1
    for r in rows.select("text").transform(mapped, _frequencies, "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held")).collect():
        if r["cell"] < 0:
            n = r["held"]
        else:
            frequency[r["cell"]] = r["held"]
    idf = np.log((1 + n) / (1 + frequency)) + 1
    each = max(1, min(per_language, sample // len(total)))
    # The rows of the least hashes: twice as many as wanted by rate, then exactly so many by rank.
    below = F.create_map(*(F.lit(x) for lang, count in total.items() for x in (lang, int(min(1.0, 2 * each / count) * (2**53 - 1)))))
    drawn = rows.withColumn("draw", F.shiftrightunsigned(F.xxhash64("doc_id", F.lit("langid")), 11)).where(F.col("draw") <= F.element_at(below, F.col("lang")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", F.xxhash64("text")))
    picked = drawn.withColumn("rank", rank).where(F.col("rank") <= each).select("lang", "text").transform(mapped, _vectors, "lang string, raw binary").collect()
    by: dict[str, list[np.ndarray]] = {}
    for r in picked:
        by.setdefault(r["lang"], []).append(np.frombuffer(r["raw"], "<f4"))
    found, names, grams, reached = [], [], [], []
    for lang in sorted(by):
        raw = np.array(by[lang])
        raw = raw[raw.sum(axis=1) > 0]
        if not len(raw):
            continue
        x = _weighted(raw, idf)
        c = clustered(x, centroids)
        found.append(c)
        names += [lang] * len(c)
        grams.append(np.log2(raw.sum(axis=1)))
        reached.append((x @ c.T).max(axis=1))
    if not found:
        return Model(idf, np.zeros((0, DIMENSIONS)), [], np.zeros(1), np.zeros(1))
    grams, reached = np.concatenate(grams), np.concatenate(reached)
    order = np.argsort(grams)
    groups = np.array_split(order, max(1, min(12, len(order) // 20)))
    return Model(idf, np.concatenate(found), names, np.array([grams[g].mean() for g in groups]), np.array([reached[g].mean() for g in groups]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for each row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            for part in blocks(map(len, texts), rows=ROWS):
                lang, score, rejected = held.value.predict(texts[part])
                yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").slice(part.start, part.stop - part.start), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "rejected": pa.array(rejected, pa.bool_())})

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.transform(mapped, run, "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column("text"))
            keep = np.concatenate([np.zeros(0, bool), *(~held.value.predict(texts[part])[2] for part in blocks(map(len, texts), rows=ROWS))])
            yield batch.filter(pa.array(keep))

    return docs.transform(mapped, run, docs.schema)


def held_out(doc_id: str = "doc_id"):
    """The fold that no model learns from: crc32 of the id's text is 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(4)) == 2, F.lit(False))
