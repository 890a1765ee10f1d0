"""Datasets of several formats, experiment documents and configuration tables."""

from __future__ import annotations

import json
import warnings
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import split_csv

#: Keys of a dataset's configuration, first come first served, with the format each names.
FORMAT_KEYS = {"csv_file": "csv", "parquet_file": "parquet", "json_file": "json", "jsonl_file": "jsonl"}
# Texts that data frames read as missing cells.
MISSING = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_as_null: bool = True, multi_line: bool = True, in_splits: bool = True, order: str | None = None, exact: bool = False) -> DataFrame:
    """Quoted fields may hold newlines and doubled quotes; blank cells and the usual marks of missing cells are null.

    Large files are read by a task for each split, wherever their fields have newlines. ``in_splits=False`` reads each file
    by one task with Spark's own reader; ``multi_line=False`` too, in splits, for files without newlines in fields.
    ``order`` names a further column by which rows read in splits are in the order of the files.
    ``exact`` gives back the values that ``sinks.write_csv`` wrote: only its nulls are null, and only newlines end lines.
    """
    if multi_line and in_splits:
        df = split_csv.read(spark, path, schema, order=order, exact=exact)
    else:
        more = {"lineSep": "\n", **split_csv.exact_options()} if exact else {}
        reader = spark.read.options(header=True, multiLine=multi_line, quote='"', escape='"', emptyValue="", inferSchema=schema is None, **{"nullValue": ""} | more)
        df = reader.schema(schema).csv(path) if schema else reader.csv(path)
    if exact or not na_as_null:
        return df
    blank = lambda f: F.when(F.col(f"`{f.name}`").isin(MISSING), None).otherwise(F.col(f"`{f.name}`")).alias(f.name)
    return df.select(*[blank(f) if isinstance(f.dataType, T.StringType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """An array of objects, a row each, or one object; anything else is an error."""
    df = spark.read.options(multiLine=True, mode="FAILFAST").json(path)
    if not df.columns or df.columns == ["_corrupt_record"]:
        raise ValueError(f"{path} holds neither an object nor an array of objects")
    return df


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line: the lines of JSON Lines files that are neither blank nor an object."""
    line = F.trim("value")
    sound = line.startswith("{") & F.get_json_object("value", "$").isNotNull()
    return spark.read.text(path).where((line != "") & ~sound).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None, warn: bool = False) -> DataFrame:
    """One object a line; blank and malformed lines are left out, and no valid line at all is an error.

    ``warn`` reads the lines once more and warns of those left out.
    """
    if warn and (n := malformed_lines(spark, path).count()):
        warnings.warn(f"{path}: {n} malformed lines are left out", stacklevel=2)
    reader = spark.read.option("mode", "DROPMALFORMED")
    df = reader.schema(schema).json(path) if schema else reader.json(path)
    if not df.columns or df.isEmpty():
        raise ValueError(f"{path} has no valid JSON record")
    return df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


READERS = {"csv": read_csv, "parquet": read_parquet, "json": read_json, "jsonl": read_jsonl}


def dataset_file(dataset: dict, root: str = "") -> tuple[str, str]:
    """(format, path) of a dataset's configuration."""
    for key, kind in FORMAT_KEYS.items():
        if dataset.get(key):
            folder = dataset.get("download_path", "")
            return kind, str(PurePosixPath(root) / folder / dataset[key]) if root or folder else dataset[key]
    raise ValueError(f"no dataset file: one of {', '.join(FORMAT_KEYS)} is needed")


def read_dataset(spark: SparkSession, dataset: dict, root: str = "") -> DataFrame:
    kind, path = dataset_file(dataset, root)
    return READERS[kind](spark, path)


def read_ordered(spark: SparkSession, dataset: dict, root: str = "", order: str = "__order") -> DataFrame:
    """The dataset with a column by which rows are in the order of the files, however these are split among tasks."""
    kind, path = dataset_file(dataset, root)
    if kind == "csv":
        return read_csv(spark, path, order=order)
    df = READERS[kind](spark, path)
    place = ["_metadata.row_index"] if kind == "parquet" else ["_metadata.file_block_start", F.monotonically_increasing_id()]
    return df.select("*", F.struct("_metadata.file_path", *[p.alias("at") if not isinstance(p, str) else p for p in place]).alias(order))


def in_chunks(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with its partitions cut to about so many rows, for sources that hand out large ones."""
    return df.repartition(max(1, -(-df.count() // rows)))


def preview(df: DataFrame, rows: int = 5) -> DataFrame:
    return df.limit(rows)


RESPONSE = T.ArrayType(
    T.StructType(
        [
            T.StructField("prompt", T.StringType()),
            T.StructField("response", T.StringType()),
            T.StructField("expected_output", T.StringType()),
            T.StructField("question_values", T.ArrayType(T.StringType())),
            T.StructField("processing_time", T.DoubleType()),
            T.StructField("success", T.BooleanType()),
            T.StructField("error", T.StringType()),
        ]
    )
)
INFERENCE = T.StructType([T.StructField("experiment_name", T.StringType()), T.StructField("experiment_config", T.MapType(T.StringType(), T.StringType())), T.StructField("responses", RESPONSE), T.StructField("expected_outputs", T.ArrayType(T.StringType()))])
STATS = T.StructType([T.StructField(s, T.DoubleType()) for s in ("mean", "std", "min", "max", "median")])
EVALUATION = T.StructType([T.StructField("batch_name", T.StringType()), T.StructField("setup_name", T.StringType()), T.StructField("num_samples", T.LongType()), T.StructField("num_valid_evaluations", T.LongType()), T.StructField("num_failed_generation", T.LongType()), T.StructField("aggregated_scores", T.MapType(T.StringType(), STATS))])


def read_inference(spark: SparkSession, folder: str) -> DataFrame:
    """The inference documents of a folder; the name comes from the file where the document has none."""
    df = spark.read.schema(INFERENCE).options(multiLine=True, mode="DROPMALFORMED", pathGlobFilter="inference_*.json").json(folder)
    by_file = F.regexp_extract(F.col("_metadata.file_name"), r"^inference_(.*)\.json$", 1)
    return df.select(F.coalesce("experiment_name", by_file).alias("experiment_name"), "experiment_config", "responses", "expected_outputs")


def read_evaluations(spark: SparkSession, folder: str) -> DataFrame:
    """experiment_name, counts, metric and its five statistics of a folder's evaluation documents; unreadable ones are left out."""
    df = spark.read.schema(EVALUATION).options(multiLine=True, mode="DROPMALFORMED", pathGlobFilter="evaluation_*.json").json(folder)
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^evaluation_(.*)\.json$", 1)
    rows = df.select(F.coalesce("batch_name", name).alias("experiment_name"), "setup_name", "num_samples", F.col("num_valid_evaluations").alias("num_valid"), F.col("num_failed_generation").alias("num_failed"), F.explode("aggregated_scores").alias("metric", "s"))
    return rows.select("experiment_name", "setup_name", "num_samples", "num_valid", "num_failed", "metric", "s.*")


def config_table(spark: SparkSession, text: str, key: str, columns: list[str], optional: bool = False) -> DataFrame:
    """A JSON dictionary of dictionaries as a table: its keys as ``key``, the named entries as text, and ``ord``.

    ``optional``: an empty text stands for an empty dictionary; otherwise it is an error, as malformed JSON is.
    """
    if not text.strip() and optional:
        entries = {}
    else:
        try:
            entries = json.loads(text)
        except json.JSONDecodeError as e:
            raise ValueError(f"the configuration is not valid JSON: {e}") from e
    if not isinstance(entries, dict):
        raise ValueError("the configuration must be a dictionary")
    as_text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
    rows = [(name, *[as_text(entry.get(c)) for c in columns], i) for i, (name, entry) in enumerate(entries.items())]
    return spark.createDataFrame(rows, ", ".join([f"`{key}` string", *[f"`{c}` string" for c in columns], "ord int"]))
