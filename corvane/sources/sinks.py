"""Responses, evaluations and summaries as partitioned Parquet, and as JSON documents; tables as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_responses(responses: DataFrame, path: str, mode: str = "append") -> None:
    """Rows by setup, prompt and model; a shuffle on them keeps the files of a folder few."""
    responses.repartition("setup", "prompt", "model", F.pmod(F.xxhash64("experiment_name"), F.lit(8))).write.mode(mode).partitionBy("setup", "prompt", "model").parquet(path)


def inference_documents(responses: DataFrame) -> DataFrame:
    """One document an experiment: responses and expected outputs in row order. Experiments are samples, so arrays stay small."""
    row = F.struct("row_idx", "prompt", "response", "expected_output", "question_values", "processing_time", "success", "error")
    grouped = responses.groupBy("experiment_name", "setup", "prompt_name", "model").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select(
        "experiment_name",
        F.create_map(F.lit("setup"), "setup", F.lit("prompt"), "prompt_name", F.lit("model"), "model").alias("experiment_config"),
        F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("prompt", "response", "expected_output", "question_values", "processing_time", "success", "error")])).alias("responses"),
        F.transform("rows", lambda r: r["expected_output"]).alias("expected_outputs"),
    )


def evaluation_documents(stats: DataFrame, counts: DataFrame) -> DataFrame:
    """One document an experiment: counts and a map from metric to its five statistics."""
    scores = stats.groupBy("experiment_name").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", F.struct("mean", "std", "min", "max", "median"))))).alias("aggregated_scores"))
    return counts.join(scores, "experiment_name", "left").select(F.col("experiment_name").alias("batch_name"), F.col("setup").alias("setup_name"), "num_samples", F.col("num_valid").alias("num_valid_evaluations"), F.col("num_failed").alias("num_failed_generation"), "aggregated_scores")


def write_documents(documents: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, a document each; the writers commit as a whole, so a lost executor leaves no halves."""
    documents.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header each that ``readers.read_csv(exact=True)`` reads back: nulls as blank fields, empty texts as quoted ones, blanks at the ends of a text kept."""
    df.write.options(header=True, quote='"', escape='"', nullValue="", emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, lineSep="\n").csv(path)


def summary_document(summary: DataFrame, best: DataFrame, counts: DataFrame) -> DataFrame:
    """One row with the whole summary as JSON text; a summary is as small as its groups."""
    results = summary.agg(F.array_sort(F.collect_list(F.struct("setup", "prompt", "model", "num_experiments", "metric", "mean"))).alias("results"))
    performers = best.agg(F.array_sort(F.collect_list(F.struct("metric", "experiment_name", "setup", "prompt", "model", "score"))).alias("best_performers"))
    return results.crossJoin(F.broadcast(performers)).crossJoin(F.broadcast(counts)).select(F.to_json(F.struct("*")).alias("document"))
