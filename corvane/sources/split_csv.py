"""CSV files whose quoted fields may hold newlines, read by as many tasks as they have splits.

Spark's reader hands a file with such fields to one task, as a task can't know
whether its split begins inside a field. Here it can. A first scan reads the
physical lines of each split and finds in which state the split ends if it begins
outside of a quoted field, and in which if it begins inside one. These functions
of two states are composed along each file, which gives the state in which each
split begins. A second scan puts the lines together to records; what a record has
in other splits is stitched by a small grouping of fragments, two a split at
most. The records are parsed by Spark's own CSV parser.

A quote opens a field only at the field's start, and is doubled inside; elsewhere
it is a character like others.

Spark plans a scan's splits when it runs, from settings and from the cores that it
has by then. All scans of one read go through one RDD, whose splits are planned once.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@lru_cache
def _patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Up to the quote that closes a field, from inside; whole fields from a field's start to the end of a line."""
    other = f"[^{re.escape(sep)}]"
    field = f'(?:"(?:[^"]|"")*+"{other}*+|(?!"){other}*+)'
    return re.compile('(?:[^"]|"")*+"', re.DOTALL), re.compile(f"{field}(?:{re.escape(sep)}{field})*+", re.DOTALL)


def step(line: str, inside: bool, sep: str = ",") -> bool:
    """Whether a quoted field is open after a line, from whether one is before it."""
    if '"' not in line:
        return inside
    closing, fields = _patterns(sep)
    if inside:
        found = closing.match(line)
        if not found:
            return True
        after = line.find(sep, found.end())
        if after < 0:
            return False
        line = line[after + len(sep) :]
    return not fields.fullmatch(line)


class Assembler:
    """Lines of one split, in order, to whole records and at most two fragments: one before its first record, one of its last."""

    def __init__(self, inside: bool, sep: str = ","):
        self.inside = self.in_head = inside
        self.sep = sep
        self.head: list[str] = []
        self.open: list[str] = []

    def add(self, line: str) -> str | None:
        """A record, if the line completes one."""
        self.inside = step(line, self.inside, self.sep)
        if self.in_head:
            self.head.append(line)
            self.in_head = self.inside
            return None
        self.open.append(line)
        if self.inside:
            return None
        record, self.open = "\n".join(self.open), []
        return record

    def fragments(self) -> list[tuple[int, str]]:
        """(0, text) of a record begun before this split, (1, text) of one that goes on behind it."""
        return [(kind, "\n".join(part)) for kind, part in enumerate((self.head, self.open)) if part]


def _by_split(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """The columns' values row by row; a split's rows come together and in order."""
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns))


def _ends(sep: str):
    """file, split, and whether a field is open at its end if none was (outside) or one was (inside) at its start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[int, int], list[bool]] = {}
        for file, split, line in _by_split(batches, ("file", "split", "value")):
            state = states.setdefault((file, split), [False, True])
            if '"' in line:
                state[:] = [step(line, x, sep) for x in state] if state[0] != state[1] else [step(line, state[0], sep)] * 2
        rows = [(f, s, *x) for (f, s), x in states.items()]
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["file", "split", "outside", "inside"])

    return run


_RECORDS = "kind int, file long, split long, at long, value string"


def _records(sep: str):
    """Kind 0 and 1: a split's fragments; 2: a record; 3: the first record of a file."""
    schema = pa.schema([("kind", pa.int32()), ("file", pa.int64()), ("split", pa.int64()), ("at", pa.int64()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, made, rows, first, at = None, None, [], False, 0

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for file, split, inside, line in _by_split(batches, ("file", "split", "inside", "value")):
            if (file, split) != now:
                if made:
                    rows += [(k, *now, at, v) for k, v in made.fragments()]
                now, made, first, at = (file, split), Assembler(bool(inside), sep), split == 0, 0
            record, at = made.add(line), at + 1
            if record is not None and record not in ("", "\r"):
                rows.append((3 if first else 2, file, split, at, record))
                first = False
                if len(rows) >= 2000:
                    yield batch()
                    rows = []
        if made:
            rows += [(k, *now, at + 1, v) for k, v in made.fragments()]
        yield batch()

    return run


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file (a number by name), split (its first byte) and value of each physical line, each split's in order; the splits are those planned here, however often it is read."""
    scan = spark.read.option("lineSep", "\n").text(path).select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").cast("binary").alias("value"))._jdf
    # Bytes, which rows of an RDD hold as they are.
    return DataFrame(spark._jsparkSession.createDataFrame(scan.toJavaRDD(), scan.schema()), spark).withColumn("value", F.col("value").cast("string"))


def split_states(lines: DataFrame, sep: str = ",") -> DataFrame:
    """file, split, inside: in which state each split begins."""
    ends = lines.mapInArrow(_ends(sep), "file long, split long, outside boolean, inside boolean")
    # One row a split; a file's splits meet in one row, 20 bytes for each.
    files = ends.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("split", "outside", "inside"))).alias("ends"))
    begun = F.aggregate(
        "ends",
        F.struct(F.lit(False).alias("now"), F.array().cast("array<struct<split:bigint,inside:boolean>>").alias("out")),
        lambda a, x: F.struct(F.when(a["now"], x["inside"]).otherwise(x["outside"]).alias("now"), F.concat(a["out"], F.array(F.struct(x["split"].alias("split"), a["now"].alias("inside")))).alias("out")),
    )
    return files.select("file", F.inline(begun["out"]))


def records(spark: SparkSession, path: str | list[str], sep: str = ",") -> DataFrame:
    """file, split and at (in their order the records are the file's), value and first (whether it is the file's first record)."""
    # Only splits that begin inside a field, a row of 24 bytes each; a broadcast keeps each split's lines in order.
    scanned = _lines(spark, path)
    inside = split_states(scanned, sep).where("inside")
    lines = scanned.join(F.broadcast(inside), ["file", "split"], "left").select("file", "split", F.coalesce("inside", F.lit(False)).alias("inside"), "value")
    made = lines.mapInArrow(_records(sep), _RECORDS)
    whole = made.where("kind >= 2").select("file", "split", "at", "value", (F.col("kind") == 3).alias("first"))
    # A fragment of kind 1 begins a record; those of kind 0 after it go on.
    parts = made.where("kind < 2").selectExpr("*", "sum(kind) OVER (PARTITION BY file ORDER BY split, kind) AS record")
    stitched = parts.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("split", "kind", "at", "value"))).alias("parts"))
    # Where the first record of a file is in fragments, it is the one that begins in the first split and nothing whole comes before.
    early = made.where("kind = 3").select("file").distinct().withColumn("had_first", F.lit(True))
    begin = F.col("parts")[0]
    joined = stitched.join(early, "file", "left").select("file", begin["split"].alias("split"), begin["at"].alias("at"), F.array_join(F.transform("parts", lambda p: p["value"]), "\n").alias("value"), (F.col("had_first").isNull() & (F.col("record") == 1)).alias("first"))
    return whole.union(joined)


def exact_options() -> dict[str, str]:
    """Options of Spark's reader: a field is null where it is blank and unquoted, and no text stands for null; a zero byte is a character like others."""
    return {"nullValue": f"null-{uuid.uuid4().hex}", "charToEscapeQuoteEscaping": '"'}


def _reader(spark: SparkSession, options: dict):
    return spark.read.options(**options)._jreader


def _as_dataset(strings: DataFrame):
    """The column ``value`` as a Dataset of strings, which Spark's CSV reader takes as it takes files."""
    return getattr(strings.select("value")._jdf, "as")(strings.sparkSession._jvm.org.apache.spark.sql.Encoders.STRING())


def read(spark: SparkSession, path: str | list[str], schema: T.StructType | None = None, sep: str = ",", order: str | None = None, exact: bool = False, **options) -> DataFrame:
    """The table of CSV files with a header each; without ``schema`` the records are made once more to infer types.

    ``order`` names a further column by which the rows are in the order of the files. ``exact`` reads what ``sinks.write_csv`` wrote.
    """
    options = {"sep": sep, "quote": '"', "escape": '"', "emptyValue": "", "nullValue": ""} | (exact_options() if exact else {}) | options
    rows = records(spark, path, sep)
    if not exact:
        rows = rows.withColumn("value", F.regexp_replace("value", "\r\\z", ""))
    body = rows.where("NOT first")
    if schema is None:
        header = rows.where("first").limit(1)
        if header.isEmpty():
            raise ValueError(f"{path} has no header")
        names = DataFrame(_reader(spark, options | {"header": True}).csv(_as_dataset(header)), spark).columns
        found = DataFrame(_reader(spark, options | {"inferSchema": True}).csv(_as_dataset(body)), spark)
        kinds = {f.name: f.dataType for f in found.schema.fields}
        schema = T.StructType([T.StructField(n, kinds.get(f"_c{i}", T.StringType())) for i, n in enumerate(names)])
    # Field by place: from_csv wants names of its own, as those of a header may repeat or hold anything.
    by_place = T.StructType([T.StructField(f"_c{i}", f.dataType) for i, f in enumerate(schema.fields)])
    # from_csv ends lines at U+FFFF; where a text holds it, something that no text holds stands for it.
    end, mark = F.lit("\uffff"), F.lit(f"end-{uuid.uuid4().hex}")
    row = F.from_csv(F.replace("value", end, mark), by_place.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("row")
    kept = [F.struct("file", "split", "at").alias("order")] if order else []
    parsed = [(F.col(f"row._c{i}"), f) for i, f in enumerate(schema.fields)]
    cells = [(F.replace(c, mark, end) if isinstance(f.dataType, T.StringType) else c).alias(f.name) for c, f in parsed]
    return body.select(row, *kept).select(*cells, *([F.col("order").alias(order)] if order else []))
