"""Token ids in a content-addressed store.

A rolling hash over the last ids cuts each document's id stream into chunks at
places that depend on content only, so that equal passages give equal chunks.
A chunk's address is its 128-bit BLAKE2b digest and each distinct chunk is
stored once. A document is a recipe: its chunks' addresses in order, with a
Merkle root over them. Reading checks every chunk against its address and
every recipe against its root.

The store is a folder of Parquet tables: ``objects/kind=0`` has the chunks,
``objects/kind=1`` the recipes as they were made, and ``stream`` the recipes in
ascending order of doc_id, with the position of each document in the stream of
all ids.

Defined results: null text is the empty text (only the end id); rows that
repeat are documents of their own; null doc_ids come first; an empty table
gives empty tables; very long texts are cut into many chunks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels
from .common import Lazy, blocks, mapped, new_path, utf8
from .tokens import Encoder

#: Ids that the rolling hash sees.
WINDOW = 16
#: A chunk has at least so many ids, about so many more on average, and at most so many.
LEAST, AVERAGE, MOST = 128, 512, 4096
#: Addresses that a task remembers, so as not to send a chunk twice.
REMEMBERED = 200_000

OBJECTS = "kind int, key binary, doc_id long, n long, payload binary, chunks array<binary>, lengths array<int>, root binary"


@dataclass(frozen=True)
class Store:
    spark: SparkSession
    path: str

    def chunks(self) -> DataFrame:
        """key, n, payload: each distinct chunk once."""
        return self.spark.read.schema(OBJECTS).parquet(f"{self.path}/objects").where("kind = 0").select("key", "n", "payload")

    def recipes(self) -> DataFrame:
        """doc_id, n, chunks, lengths, root, start: one row a document, in ascending doc_id order by file."""
        return _with_starts(self.spark.read.parquet(f"{self.path}/stream"))


def address(payload: bytes) -> bytes:
    return hashlib.blake2b(payload, digest_size=16).digest()


def merkle_root(addresses: list[bytes]) -> bytes:
    """Root of the binary tree over the addresses; an odd node goes up as it is."""
    level = [address(b"\0" + a) for a in addresses] or [address(b"")]
    while len(level) > 1:
        level = [address(b"\1" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def cuts(ids: np.ndarray) -> list[int]:
    """Where chunks end, the last at len(ids)."""
    n = len(ids)
    if n <= LEAST:
        return [n]
    rolled = kernels.gram_hashes(kernels.mix(ids.astype(np.uint64)), WINDOW)
    wanted = np.flatnonzero(rolled < kernels.MAX64 // np.uint64(AVERAGE)) + WINDOW
    out, last = [], 0
    for at in [*wanted.tolist(), n]:
        while at - last > MOST:
            last += MOST
            out.append(last)
        if at - last >= LEAST or at == n and at > last:
            out.append(at)
            last = at
    return out


def _pack(ids: np.ndarray) -> bytes:
    """Little-endian, two bytes an id where all fit, else four; the first byte says which."""
    small = not len(ids) or int(ids.max()) < 1 << 16
    return (b"\2" if small else b"\4") + ids.astype("<u2" if small else "<u4").tobytes()


def unpack(payload: bytes) -> np.ndarray:
    return np.frombuffer(payload, "<u2" if payload[0] == 2 else "<u4", offset=1).astype("<u4")


def _objects(encoder: Lazy, end_id: int):
    schema = pa.schema([("kind", pa.int32()), ("key", pa.binary()), ("doc_id", pa.int64()), ("n", pa.int64()), ("payload", pa.binary()), ("chunks", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("root", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for batch in batches:
            texts, doc_ids = utf8(batch.column("text")), batch.column("doc_id").to_pylist()
            for part in blocks(map(len, texts)):
                ids, at = encoder.get().encode(texts[part])
                rows = []
                for i, doc_id in enumerate(doc_ids[part]):
                    own = np.append(ids[at[i] : at[i + 1]], np.uint32(end_id))
                    ends = cuts(own)
                    keys, lengths, begin = [], [], 0
                    for end in ends:
                        payload = _pack(own[begin:end])
                        keys.append(key := address(payload))
                        lengths.append(end - begin)
                        if key not in sent:
                            if len(sent) >= REMEMBERED:
                                sent.clear()
                            sent.add(key)
                            rows.append((0, key, None, end - begin, payload, None, None, None))
                        begin = end
                    root = merkle_root(keys)
                    # The doc_id spreads recipes, so that copies don't meet in one task.
                    rows.append((1, address(f"{doc_id}".encode()), doc_id, len(own), None, keys, lengths, root))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drop chunks that came before in this partition, which has all of one address."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for kind, key in zip(batch.column("kind").to_pylist(), batch.column("key").to_pylist()):
            keep.append(kind == 1 or key not in seen)
            if kind == 0:
                seen.add(key)
        yield batch.filter(pa.array(keep))


def write(docs: DataFrame, tokenizer: str, end_id: int = 2) -> Store:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and store the ids."""
    spark = docs.sparkSession
    path = new_path(spark, "ids")
    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).transform(mapped, _objects(Lazy(Encoder, tokenizer), end_id), OBJECTS)
    made.repartition(F.col("key")).transform(mapped, _once, OBJECTS).write.option("compression", "zstd").partitionBy("kind").parquet(f"{path}/objects")
    recipes = spark.read.schema(OBJECTS).parquet(f"{path}/objects").where("kind = 1").select("doc_id", "n", "chunks", "lengths", "root")
    (
        recipes.repartitionByRange(F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "root")
        .withColumn("part", F.spark_partition_id())
        .write.option("compression", "zstd")
        .parquet(f"{path}/stream")
    )
    return Store(spark, path)


def _with_starts(stream: DataFrame) -> DataFrame:
    """Add start: the ids of all documents before. One row for each written part is all that is broadcast."""
    parts = stream.groupBy("part").agg(F.sum("n").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "root").rowsBetween(Window.unboundedPreceding, -1)
    return stream.join(F.broadcast(parts), "part").select("doc_id", "n", "chunks", "lengths", "root", (F.col("base") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("start"))


def _read_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, counts, good = [], [], []
        for key, payload in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist()):
            ids = unpack(payload)
            crcs.append(zlib.crc32(ids.tobytes()))
            counts.append(len(ids))
            good.append(address(payload) == key)
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "crc": pa.array(crcs, pa.int64()), "ids": pa.array(counts, pa.int64()), "sound": pa.array(good, pa.bool_())})


def _read_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crcs, counts, good = [], [], []
        for pieces, root in zip(batch.column("pieces").to_pylist(), batch.column("root").to_pylist()):
            crc = n = 0
            pieces.sort(key=lambda p: p["pos"])
            for p in pieces:
                crc = kernels.crc32_joined(crc, p["crc"], 4 * p["ids"])
                n += p["ids"]
            crcs.append(crc)
            counts.append(n)
            good.append(all(p["sound"] for p in pieces) and merkle_root([p["key"] for p in pieces]) == root)
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": pa.array(counts, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64()), "n_chunks": pa.array([len(p) for p in batch.column("pieces").to_pylist()], pa.int64()), "verified": pa.array(good, pa.bool_())})


def read_digests(store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, n_chunks, verified, all from the stored files.

    Chunks are read once where they lie; a document's CRC-32 is put together
    from its chunks' in the order of the recipe, so payloads aren't shuffled.
    """
    chunks = store.chunks().transform(mapped, _read_chunks, "key binary, crc long, ids long, sound boolean")
    wanted = store.recipes().select("doc_id", "start", "root", F.posexplode("chunks").alias("pos", "key"))
    met = wanted.join(chunks, "key")
    whole = met.groupBy("doc_id", "start", "root").agg(F.collect_list(F.struct("pos", "key", "crc", "ids", "sound")).alias("pieces"))
    return whole.transform(mapped, _read_documents, "doc_id long, start long, n_tokens long, ids_crc32 long, n_chunks long, verified boolean")


def read_ids(store: Store, doc_ids: DataFrame) -> DataFrame:
    """doc_id, ids: the documents named in ``doc_ids`` put together again."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([unpack(p["payload"]) for p in sorted(x, key=lambda p: p["pos"])]) for x in batch.column("pieces").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "ids": pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))})

    wanted = store.recipes().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "start", F.posexplode("chunks").alias("pos", "key"))
    whole = wanted.join(store.chunks(), "key").groupBy("doc_id", "start").agg(F.collect_list(F.struct("pos", "payload")).alias("pieces"))
    return whole.transform(mapped, joined, "doc_id long, ids array<long>")
