"""Multidimensional clustered layout of documents by distributed radix partitioning.

Documents are ordered along a Z curve over four values: source, language, length
in bytes (null text: -1) and date (CRC-32 of the decimal doc_id, modulo 365).
Each value becomes a binary key whose byte order is the value's order, null
smallest. A value's coordinate is floor(16 * s / n) where s of all n rows are
smaller.

``cuts`` finds where coordinates change by most-significant-digit radix
histograms: rows are counted by the byte behind a prefix, and only buckets in
which a coordinate changes (15 at most for each value) are counted by their next
byte. Bytes that all values of a bucket share are skipped. What reaches the
driver are at most 15 * 257 counts a value and round, whatever the input.

``arrange`` then counts rows by z, refines z buckets that are too large by the
digits of doc_id (and of a hash of the row, for rows of one doc_id), prefix-sums
the buckets' counts in two levels and numbers rows within their bucket. A bucket
holds at most ``bucket_rows`` rows or a 4096th of all, so that at most 4096
buckets are refined in a round.

``answered`` counts, for each occupied cell of the 65536, the files that a query
around it touches, by 16 signed corners for each file's box and running sums over
the grid, and the files that hold a matching row, from distinct (file, cell)
pairs: as many as there are files and cells at most.

Everything is DataFrame code; only tables of at most 65536 rows are broadcast.

Defined results: a null text has length -1; null source, lang and date (of a null
doc_id) come first; empty strings come after null; rows of equal z and doc_id are
numbered in an arbitrary but fixed order (for repeated rows the results are the
same); very long texts count by their length only; further columns and their
names don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, stored

#: The values that the curve is made of, in the order of its digits.
VALUES = ("source", "lang", "length", "date")
#: Digits of a coordinate; there are 2**BITS of them.
BITS = 4
#: Coordinates of length and date that a query reaches to either side.
REACH = {"length": 2, "date": 2}
FILE_ROWS = 1000
#: Rows of a bucket that one task numbers.
BUCKET_ROWS = 65_536
#: Buckets at most that are refined in a round; larger inputs have larger buckets.
REFINED = 4096
#: Bytes that are looked at to skip what the values of a bucket share.
LOOK = 256

_SIDE = 1 << BITS


def sortable(value: Column, size: int = 8) -> Column:
    """A whole number from 0 as bytes, highest first."""
    return F.unhex(F.lpad(F.hex(value), 2 * size, "0"))


def nullable(key: Column) -> Column:
    """A key before all others where ``key`` is null."""
    return F.when(key.isNull(), F.lit(b"\0")).otherwise(F.concat(F.lit(b"\1"), key))


def date() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(365))


def keyed(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """row (a number of its own), doc_id and the binary keys of the four values; written once, as all that follows reads it."""
    row = F.monotonically_increasing_id() if row is None else row
    length = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(-1)).cast("long")
    keys = {"source": nullable(F.col("source").cast("string").cast("binary")), "lang": nullable(F.col("lang").cast("string").cast("binary")), "length": sortable(length + 1), "date": nullable(sortable(date(), 2))}
    return stored(docs.select(row.alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *[k.alias(c) for c, k in keys.items()]), "keys")


def _shared(low: bytes, high: bytes) -> int:
    n = min(len(low), len(high))
    return next((i for i in range(n) if low[i] != high[i]), n)


def cuts(keys: DataFrame, columns: tuple[str, ...] = VALUES, parts: int = _SIDE, n: int | None = None) -> dict[str, list[bytes]]:
    """For each column the smallest keys from which coordinates are 1, 2, ... at least, as far as there are such rows."""
    n = keys.count() if n is None else n
    place = lambda s: parts * s // n
    settled: dict[str, list[tuple[bytes, int]]] = {c: [] for c in columns}
    # Buckets with a cut inside: column, prefix, rows before, rows.
    cut = [(c, b"", 0, n) for c in columns] if n else []
    while cut:
        # What all keys of a bucket share needs no histogram; nor does a bucket of one key.
        ends = []
        for c, prefix, _, _ in cut:
            head = F.when(F.startswith(c, F.lit(prefix)), F.substring(c, 1, len(prefix) + LOOK))
            ends += [F.min(head), F.max(head)]
        ends = [bytes(x) for x in keys.agg(*[e.alias(f"e{i}") for i, e in enumerate(ends)]).first()]
        longer = []
        for (c, prefix, before, rows), low, high in zip(cut, ends[::2], ends[1::2]):
            if low == high and len(low) < len(prefix) + LOOK:
                settled[c].append((low, before))
            else:
                longer.append((c, low[: _shared(low, high)], before, rows))
        digit = lambda i, c, prefix: F.concat(F.lit(bytes([i])), F.substring(c, len(prefix) + 1, 1))
        codes = []
        for c in dict.fromkeys(x[0] for x in longer):
            code = F.lit(None).cast("binary")
            for i, (own, prefix, _, _) in enumerate(longer):
                if own == c:
                    code = F.when(F.startswith(c, F.lit(prefix)), digit(i, c, prefix)).otherwise(code)
            codes.append(code)
        counts: dict[int, dict[bytes, int]] = {}
        if codes:
            for code, m in keys.select(F.explode(F.array(*codes)).alias("code")).where("code IS NOT NULL").groupBy("code").count().collect():
                counts.setdefault(code[0], {})[bytes(code[1:])] = m
        cut = []
        for i, (c, prefix, before, _) in enumerate(longer):
            for byte, m in sorted(counts[i].items()):
                # A key that ends here is a bucket of its own; so are those within one coordinate.
                if byte and place(before) != place(before + m - 1):
                    cut.append((c, prefix + byte, before, m))
                else:
                    settled[c].append((prefix + byte, before))
                before += m
    out = {}
    for c in columns:
        starts = [(prefix, place(before)) for prefix, before in sorted(settled[c])]
        out[c] = [found for j in range(1, parts) if (found := next((p for p, x in starts if x >= j), None)) is not None]
    return out


def coordinate(key: str, starts: list[bytes]) -> Column:
    """How many of the cuts a key has reached."""
    return sum((F.when(F.col(key) >= F.lit(x), 1).otherwise(0) for x in starts), F.lit(0)).cast("int")


def interleaved(columns: tuple[str, ...] = VALUES) -> Column:
    """z: the coordinates' binary digits, highest first, in the order of ``columns``."""
    spread = lambda v, k: sum((v >> b & 1) << (len(columns) * b + len(columns) - 1 - k) for b in range(BITS))
    z = sum((F.element_at(F.array(*[F.lit(spread(v, k)) for v in range(_SIDE)]), F.col(c) + 1) for k, c in enumerate(columns)), F.lit(0))
    return z.cast("int")


def _bucketed(rows: DataFrame, key: Column, bucket_rows: int, n: int) -> DataFrame:
    """``rows`` with ``bucket``, the shortest prefix of the key (two bytes at least) that few enough rows share."""
    most = max(bucket_rows, -(-n // REFINED))
    rows = rows.withColumn("key", key).withColumn("bucket", F.substring("key", 1, 2))
    width = 2
    while True:
        # Each has over a REFINED-th of all rows, so there are fewer than that.
        large = rows.where((F.octet_length("bucket") == width) & (F.octet_length("key") > width)).groupBy("bucket").count().where(F.col("count") > most).select(F.col("bucket").alias("large")).collect()
        if not large:
            return rows
        width += 1
        known = rows.sparkSession.createDataFrame(large, "large binary")
        rows = rows.join(F.broadcast(known), F.col("bucket") == F.col("large"), "left").withColumn("bucket", F.when(F.col("large").isNotNull(), F.substring("key", 1, width)).otherwise(F.col("bucket"))).drop("large")


def arrange(keys: DataFrame, file_rows: int = FILE_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """row, doc_id, the four coordinates, z, position and file of each row of ``keyed``."""
    n, low, high = keys.agg(F.count("*"), F.min("doc_id"), F.max("doc_id")).first()
    starts = cuts(keys, n=n)
    rows = keys.select("row", "doc_id", *[coordinate(c, starts[c]).alias(c) for c in VALUES]).withColumn("z", interleaved())
    low, high = low or 0, high or 0
    if high - low < 1 << 62:
        size = max(1, ((high - low).bit_length() + 7) // 8)
        number = sortable(F.col("doc_id") - F.lit(low), size)
    else:  # two's complement with the sign turned is in order
        number = sortable(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63))), 8)
    rows = rows.withColumn("tie", F.xxhash64("row"))
    dealt = _bucketed(rows, F.concat(sortable(F.col("z"), 2), nullable(number), sortable(F.col("tie"), 8)), bucket_rows, n)
    counts = dealt.groupBy("bucket").agg(F.count("*").alias("m")).withColumn("top", F.substring("bucket", 1, 1))
    # Two levels: 256 sums first, then the buckets of each.
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    tops = counts.groupBy("top").agg(F.sum("m").alias("m")).select("top", F.coalesce(F.sum("m").over(before.orderBy("top")), F.lit(0)).alias("base"))
    begun = counts.join(F.broadcast(tops), "top").select("bucket", (F.col("base") + F.coalesce(F.sum("m").over(before.partitionBy("top").orderBy("bucket")), F.lit(0))).alias("begin"))
    placed = dealt.join(begun, "bucket").withColumn("position", F.col("begin") + F.row_number().over(Window.partitionBy("bucket").orderBy("key")) - 1)
    return placed.select("row", "doc_id", *VALUES, "z", F.col("position").cast("long").alias("position"), F.floor(F.col("position") / file_rows).cast("long").alias("file"))


def bounds(placed: DataFrame) -> DataFrame:
    """file, and each value's smallest and largest coordinate in it."""
    return placed.groupBy("file").agg(*[f(c).alias(f"{name}_{c}") for c in VALUES for f, name in ((F.min, "min"), (F.max, "max"))])


def touched(files: DataFrame) -> DataFrame:
    """z, files_touched of all cells: files whose box a query around the cell meets.

    A file's box, widened by the query's reach, adds to its corners with signs; running sums along each value make
    them counts. The grid has 65536 cells whatever the input.
    """
    corner = lambda c: F.explode(F.array(F.struct(F.greatest(F.col(f"min_{c}") - REACH.get(c, 0), F.lit(0)).alias("p"), F.lit(1).alias("s")), F.struct((F.col(f"max_{c}") + REACH.get(c, 0) + 1).alias("p"), F.lit(-1).alias("s")))).alias(f"at_{c}")
    boxes = files.groupBy([f"{m}_{c}" for c in VALUES for m in ("min", "max")]).agg(F.count("*").alias("m"))
    for c in VALUES:
        boxes = boxes.select("*", corner(c)).where(F.col(f"at_{c}.p") < _SIDE)
    sign = F.col("m")
    for c in VALUES:
        sign = sign * F.col(f"at_{c}.s")
    events = boxes.select(*[F.col(f"at_{c}.p").alias(c) for c in VALUES], sign.alias("m")).groupBy(*VALUES).agg(F.sum("m").alias("m"))
    grid = files.sparkSession.range(_SIDE ** len(VALUES)).select(*[(F.shiftright("id", BITS * i).bitwiseAND(_SIDE - 1)).cast("int").alias(c) for i, c in enumerate(VALUES)])
    sums = grid.join(events, list(VALUES), "left").withColumn("m", F.coalesce("m", F.lit(0)))
    for c in VALUES:
        sums = sums.withColumn("m", F.sum("m").over(Window.partitionBy([x for x in VALUES if x != c]).orderBy(c).rowsBetween(Window.unboundedPreceding, 0)))
    return sums.select(interleaved().alias("z"), F.col("m").alias("files_touched"))


def matching(placed: DataFrame) -> DataFrame:
    """z, files_matching of all cells: files that hold a row within the query around the cell."""
    held = placed.select("file", *VALUES).distinct()
    for c, reach in REACH.items():
        held = held.select(*[x for x in held.columns if x != c], F.explode(F.sequence(F.greatest(F.col(c) - reach, F.lit(0)), F.least(F.col(c) + reach, F.lit(_SIDE - 1)))).alias(c))
    return held.select("file", interleaved().alias("z")).distinct().groupBy("z").agg(F.count("*").alias("files_matching"))


def answered(placed: DataFrame) -> DataFrame:
    """doc_id, z, position, file, files_touched, files_matching and file_bounds of each row of a stored ``arrange``."""
    files = bounds(placed)
    # One row for each occupied cell: 65536 at most.
    cells = placed.select("z").distinct().join(touched(files), "z").join(matching(placed), "z")
    named = files.select("file", F.concat_ws(",", *[f"{m}_{c}" for c in VALUES for m in ("min", "max")]).alias("file_bounds"))
    rows = placed.join(F.broadcast(cells), "z").join(named, "file")
    return rows.select("doc_id", F.col("z").cast("long").alias("z"), "position", "file", "files_touched", "files_matching", "file_bounds")


def plan(docs: DataFrame, file_rows: int = FILE_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Place, file and query costs of each row of ``docs`` (doc_id, text, lang, source)."""
    keys = keyed(docs)
    placed = stored(arrange(keys, file_rows, bucket_rows), "placed")
    discard(keys)
    return answered(placed)


def write(docs: DataFrame, path: str, file_rows: int = FILE_ROWS, bucket_rows: int = BUCKET_ROWS) -> None:
    """Write ``docs`` as Parquet files of ``file_rows`` rows along the curve, with all their columns."""
    numbered = stored(docs.withColumn("__corvane_row", F.monotonically_increasing_id()), "numbered")
    keys = keyed(numbered, F.col("__corvane_row"))
    placed = stored(arrange(keys, file_rows, bucket_rows), "placed")
    files = (placed.agg(F.max("file")).first()[0] or 0) + 1
    tasks = min(files, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    each = -(-files // tasks)  # whole files for each task, so that cutting by row count keeps their borders
    place = placed.select(F.col("row").alias("__corvane_row"), F.col("position").alias("__corvane_position"), F.floor(F.col("file") / each).cast("int").alias("__corvane_task"))
    dealt = numbered.join(place, "__corvane_row").repartitionById(tasks, F.col("__corvane_task")).sortWithinPartitions("__corvane_position")
    dealt.select(*[F.col(f"`{c}`") for c in docs.columns]).write.option("maxRecordsPerFile", file_rows).parquet(path)
    discard(numbered, keys, placed)
