"""Summaries over experiments: group means, best performers, rankings, comparisons, pivots and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import sampling

# Metrics that have their own place in reports, by priority, and those of the global statistics.
STANDARD_METRICS = ["f1_score", "bleu", "rouge1_f", "rouge2_f", "rougeL_f", "semantic_similarity", "exact_match", "precision", "recall", "jaccard"]
PRIORITY = ["f1_score", "semantic_similarity", "rouge1_f", "bleu", "exact_match", "rougeL_f", "jaccard", "precision", "recall", "rouge2_f"]
GLOBAL_METRICS = ["f1_score", "bleu", "rouge1_f", "rouge2_f", "rougeL_f", "semantic_similarity", "exact_match"]


def group_means(stats: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Unweighted mean of experiment means, rounded to four places; each experiment counts once."""
    return stats.groupBy(*(by or ["setup", "prompt", "model"]), "metric").agg(F.count_distinct("experiment_name").alias("num_experiments"), F.round(F.avg("mean"), 4).alias("mean"))


def rolled_up(stats: DataFrame) -> DataFrame:
    """An extension: the same means for every prefix of (setup, prompt, model)."""
    return stats.rollup("setup", "prompt", "model").agg(F.count_distinct("experiment_name").alias("num_experiments"), F.round(F.avg("mean"), 4).alias("mean"))


def counts(experiments: DataFrame) -> DataFrame:
    return experiments.agg(
        F.count_distinct("experiment_name").alias("total_experiments"),
        F.count_distinct("setup").alias("total_setups"),
        F.count_distinct("setup", "prompt").alias("total_prompts"),
        F.count_distinct("model").alias("total_models"),
        F.array_sort(F.collect_set("setup")).alias("setups"),
        F.array_sort(F.collect_set("model")).alias("models"),
    )


def prompts_per_setup(experiments: DataFrame) -> DataFrame:
    return experiments.groupBy("setup").agg(F.array_sort(F.collect_set("prompt")).alias("prompts"))


def best_performers(stats: DataFrame, order: str = "ord") -> DataFrame:
    """The experiment with the largest mean of each metric; the first in ``order`` wins ties, NaN and null never win."""
    usable = stats.where(F.col("mean").isNotNull() & ~F.isnan("mean"))
    best = usable.groupBy("metric").agg(F.max_by(F.struct("experiment_name", "setup", "prompt", "model", "mean"), F.struct(F.col("mean"), -F.col(order))).alias("b"))
    return best.select("metric", "b.experiment_name", "b.setup", "b.prompt", "b.model", F.round("b.mean", 4).alias("score"))


def global_stats(stats: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """Five statistics over experiment means for the main metrics."""
    return stats.where(F.col("metric").isin(metrics or GLOBAL_METRICS)).groupBy("metric").agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("std"), F.min("mean").alias("min"), F.max("mean").alias("max"), F.median("mean").alias("median"))


def pruning_totals(runs: DataFrame) -> DataFrame:
    """total_pruned, total_rows and the rate in percent (0 without rows)."""
    totals = runs.agg(F.coalesce(F.sum("n_pruned"), F.lit(0)).alias("total_pruned"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("total_rows"))
    return totals.withColumn("rate", F.coalesce(F.try_divide(F.col("total_pruned") * 100.0, F.col("total_rows")), F.lit(0.0)))


def ranked(stats: DataFrame, value: str = "mean", tie: str = "experiment_name") -> DataFrame:
    """Rank from 1 within each metric, largest first, ties by name. A metric's rows are ranked by as many tasks as they fill."""
    return sampling.numbered_within(stats, ["metric"], [F.desc_nulls_last(value), F.col(tie)], "rank").withColumn("rank", F.col("rank") + 1)


def compared(stats: DataFrame, experiments: list[str]) -> DataFrame:
    """One row a metric, one column an experiment; a missing metric counts 0; with the first best experiment."""
    wide = stats.where(F.col("experiment_name").isin(experiments)).groupBy("metric").pivot("experiment_name", experiments).agg(F.first("mean"))
    wide = wide.select("metric", *[F.coalesce(F.col(f"`{e}`"), F.lit(0.0)).alias(e) for e in experiments])
    most = F.greatest(*[F.col(f"`{e}`") for e in experiments]) if len(experiments) > 1 else F.col(f"`{experiments[0]}`")
    best = F.coalesce(*[F.when(F.col(f"`{e}`") == most, F.lit(e)) for e in experiments])
    return wide.withColumn("best", best)


def heat_map(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """model x metric, missing as 0; models with no value above 0 are left out."""
    wide = summary.groupBy("model").pivot("metric", metrics).agg(F.avg("mean"))
    wide = wide.select("model", *[F.coalesce(F.col(f"`{m}`"), F.lit(0.0)).alias(m) for m in metrics])
    return wide.where(F.exists(F.array(*[F.col(f"`{m}`") for m in metrics]), lambda x: x > 0))


def custom_metrics(stats: DataFrame) -> DataFrame:
    """Metrics that are not standard ones."""
    standard = stats.sparkSession.createDataFrame([(m,) for m in STANDARD_METRICS], "metric string")
    return stats.select("metric").distinct().join(F.broadcast(standard), "metric", "left_anti")


def shared_metrics(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    return stats.select("metric").intersect(wanted.select("metric"))


def not_there(configured: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return configured.select(key).exceptAll(there.select(key))


def top_metrics(stats: DataFrame, n: int = 5) -> DataFrame:
    """The first n metrics by priority, filled up with others by name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in PRIORITY]), F.col("metric")), F.lit(0))
    place = F.when(rank > 0, rank).otherwise(len(PRIORITY) + 1)
    return stats.select("metric").distinct().orderBy(place, "metric").limit(n)


def nested(summary: DataFrame) -> DataFrame:
    """setup, prompt and an array of (model, num_experiments, metrics map)."""
    by_model = summary.groupBy("setup", "prompt", "model").agg(F.max("num_experiments").alias("num_experiments"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "mean")))).alias("metrics"))
    return by_model.groupBy("setup", "prompt").agg(F.array_sort(F.collect_list(F.struct("model", "num_experiments"))).alias("models"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", F.to_json("metrics"))))).alias("metrics_by_model"))


def flattened(nested_summary: DataFrame) -> DataFrame:
    """The rows of ``nested`` again: setup, prompt, model, num_experiments, metric, mean."""
    models = nested_summary.select("setup", "prompt", F.explode("models").alias("m"), "metrics_by_model")
    metrics = F.from_json(F.try_element_at("metrics_by_model", F.col("m.model")), "map<string,double>")
    return models.select("setup", "prompt", "m.model", "m.num_experiments", F.explode(metrics).alias("metric", "mean"))


def session_summary(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Totals over evaluations, and the best F1."""
    best = best_performers(stats.where("metric = 'f1_score'")).select(F.col("experiment_name").alias("best_experiment"), F.col("score").alias("best_f1"))
    totals = runs.agg(F.count("*").alias("evaluations"), F.sum("num_samples").alias("num_samples"), F.sum("num_valid").alias("num_valid"), F.sum("num_failed").alias("num_failed"))
    return totals.join(F.broadcast(best), how="left")


def profile(df: DataFrame) -> DataFrame:
    """n_rows, n_columns, columns, and the nulls of each column as a map."""
    nulls = F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns]), F.array(*[F.count_if(F.col(f"`{c}`").isNull()) for c in df.columns]))
    return df.agg(F.count("*").alias("n_rows"), nulls.alias("null_counts")).select("n_rows", F.lit(len(df.columns)).alias("n_columns"), F.array(*[F.lit(c) for c in df.columns]).alias("columns"), "null_counts")


def tallies(checked: DataFrame, valid: str) -> DataFrame:
    return checked.agg(F.count_if(F.col(valid)).alias("n_valid"), F.count_if(~F.coalesce(F.col(valid), F.lit(False))).alias("n_invalid"))
