"""Storage and Arrow plumbing shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.shared import new_path

#: Bytes of text that a numpy kernel handles at once; a longer document forms a block of its own.
BLOCK_BYTES = 1 << 19
#: Rows of an Arrow batch at most, so that batches of texts stay small in JVM and Python alike.
BATCH_ROWS = 1000


def stored(df: DataFrame, tag: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This cuts the lineage: what reads the result survives the loss of any
    executor, and an expensive stage runs once however often it is read.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` wrote and that nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._corvane_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with small batches, whose workers give memory back when a task ends."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few_arenas()
        for k, made in enumerate(run(batches)):
            yield made
            if k % 32 == 31:
                release_memory()
        release_memory()

    return df.mapInArrow(trimmed, schema)


# Parameters of glibc's mallopt.
_MMAP_THRESHOLD, _ARENA_MAX = -3, -8


def few_arenas() -> None:
    """Let large arrays have mappings of their own, which go back at once, and threads share arenas."""
    try:
        libc = ctypes.CDLL(None)
        libc.mallopt(_ARENA_MAX, 2)
        libc.mallopt(_MMAP_THRESHOLD, 4 << 20)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def release_memory() -> None:
    """Hand freed memory to the system; workers are reused for other tasks and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def utf8(column: pa.Array) -> list[bytes]:
    """A string or binary column as bytes; null becomes the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def blocks(sizes: Iterable[int], limit: int = BLOCK_BYTES, rows: int = 1 << 16) -> Iterator[slice]:
    """Slices of consecutive rows of about ``limit`` bytes and at most ``rows`` rows; at least one row each."""
    start, held, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if held and (held + n > limit or i - start >= rows):
            yield slice(start, i)
            start, held = i, 0
        held += n + 1
    if i >= start:
        yield slice(start, i + 1)


def by_block(kernel: Callable[[list[bytes]], dict[str, pa.Array]], text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = BLOCK_BYTES, rows: int = 1 << 16):
    """A function for ``mapInArrow``: ``kernel`` sees blocks of whole texts.

    ``kernel(texts)`` returns columns as long as ``texts``; the ``keep``
    columns of the input are put before them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch.column(text))
            for part in blocks(map(len, texts), limit, rows):
                made = kernel(texts[part])
                kept = {k: batch.column(k).slice(part.start, part.stop - part.start) for k in keep}
                yield pa.RecordBatch.from_pydict(kept | made)

    return run


class Lazy:
    """A value that each Python worker makes for itself, once, on first use."""

    made: dict = {}

    def __init__(self, make: Callable, *args):
        self.make, self.args = make, args

    def get(self):
        key = (self.make.__module__, self.make.__qualname__, self.args)
        if key not in Lazy.made:
            Lazy.made[key] = self.make(*self.args)
        return Lazy.made[key]
