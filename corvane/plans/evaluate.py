"""From responses to scores and five statistics per experiment and metric, for all experiments in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.core_metrics import TOKEN_METRICS, cosine_similarity, token_scores
from ..functions.ngram import NGRAM_METRICS
from ..functions.ngram_sql import with_ngram_metrics
from ..functions.registry import MetricRegistry

STATS = ["mean", "std", "min", "max", "median"]


def paired(documents: DataFrame) -> DataFrame:
    """Responses with their expected outputs by position, cut to the shorter list, from inference documents."""
    n = F.least(F.size("responses"), F.size("expected_outputs"))
    both = F.arrays_zip(F.slice("responses", 1, F.greatest(n, F.lit(0))).alias("r"), F.slice("expected_outputs", 1, F.greatest(n, F.lit(0))).alias("e"))
    rows = documents.select("experiment_name", F.posexplode(both).alias("pos", "x"))
    fields = [c for c in documents.schema["responses"].dataType.elementType.names if c != "expected_output"]
    return rows.select("experiment_name", "pos", *[F.col(f"x.r.{c}").alias(c) for c in fields], F.col("x.e").alias("expected_output"))


def scores(responses: DataFrame, keys: list[str], with_ngrams: bool = True, vectors: tuple[str, str] | None = None) -> DataFrame:
    """keys and the core metrics, side by side; semantic similarity if two vector columns are named."""
    more = {}
    if vectors:
        more["semantic_similarity"] = F.when(F.coalesce(F.col("success"), F.lit(False)), cosine_similarity(*vectors)).otherwise(0.0)
    return token_scores(responses, keys, more, with_ngram_metrics if with_ngrams else None)


def long_form(scored: DataFrame, keys: list[str], metrics: list[str] | None = None) -> DataFrame:
    metrics = metrics or [c for c in scored.columns if c not in keys and c != "generation_failed"]
    return scored.unpivot(keys, metrics, "metric", "value")


def five_stats(long: DataFrame, by: list[str]) -> DataFrame:
    """Mean, population deviation, least, greatest and interpolated median of ``value``."""
    return long.groupBy(*by).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.median("value").alias("median"))


def batch_counts(scored: DataFrame, by: list[str]) -> DataFrame:
    failed = F.col("generation_failed") > 0
    return scored.groupBy(*by).agg(F.count("*").alias("num_samples"), F.count_if(~failed).alias("num_valid"), F.count_if(failed).alias("num_failed"))


def aggregate(scored: DataFrame, by: list[str], metrics: list[str] | None = None) -> DataFrame:
    """Statistics of each experiment (``by``) and metric over successful generations."""
    metrics = metrics or [m for m in [*TOKEN_METRICS, *NGRAM_METRICS, "semantic_similarity"] if m in scored.columns]
    return five_stats(long_form(scored.where("generation_failed = 0").select(*by, *metrics), by, metrics), [*by, "metric"])


def processing_stats(responses: DataFrame, by: list[str]) -> DataFrame:
    ok = F.coalesce(F.col("success"), F.lit(False))
    return responses.groupBy(*by).agg(
        F.sum("processing_time").alias("total_time"),
        F.avg("processing_time").alias("avg_time"),
        F.min("processing_time").alias("min_time"),
        F.max("processing_time").alias("max_time"),
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_error"),
        F.count_if(F.coalesce(F.col("error").contains("Authentication"), F.lit(False))).alias("n_auth"),
        F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("success_rate"),
    )


def evaluate(responses: DataFrame, registry: MetricRegistry, by: list[str], row: str, with_ngrams: bool = True, vectors: tuple[str, str] | None = None) -> DataFrame:
    """by, metric and the five statistics of core and task metrics and registered functions; ``by`` must hold setup."""
    keys = [*by, row]
    core = long_form(scores(responses, keys, with_ngrams, vectors).where("generation_failed = 0").drop("generation_failed"), keys)
    task = registry.long_scores(responses.where(F.coalesce(F.col("success"), F.lit(False))), "setup", keys)
    return five_stats(core.unionByName(task), [*by, "metric"])
