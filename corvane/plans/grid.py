"""Experiment grids: which (model, setup, prompt, mode) to run, and which are left to run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.paths import experiment_name
from ..operators.prompts import FEW_SHOT

DEFAULT_MODE = "zero-shot"


def triplets(prompts: DataFrame, setups: DataFrame, wanted_setups: list[str] | None = None, wanted_prompts: list[str] | None = None, mode: str | None = None, force: bool = False) -> DataFrame:
    """Distinct (setup, prompt, mode, ord), in order of first mention.

    ``prompts`` has prompt, setup, mode and ord (its place in the configuration),
    ``setups`` has setup and ord. A prompt belongs to one setup and has one mode.
    Without named prompts, restrictions filter. With named prompts, a mismatch of
    setup or mode drops the prompt, unless ``force`` keeps it with its own setup
    and mode.
    """
    spark = prompts.sparkSession
    own = prompts.select("prompt", "setup", F.coalesce("mode", F.lit(DEFAULT_MODE)).alias("mode"), F.col("ord").alias("prompt_ord")).where("setup IS NOT NULL AND setup <> ''")
    if wanted_prompts:
        named = spark.createDataFrame([(p, i) for i, p in enumerate(wanted_prompts)], "prompt string, place long")
        out = own.join(F.broadcast(named), "prompt").withColumn("place2", F.lit(0).cast("long"))
        if not force:
            if wanted_setups:
                out = out.where(F.col("setup").isin(wanted_setups))
            if mode:
                out = out.where(F.col("mode") == mode)
    else:
        if wanted_setups:
            order = spark.createDataFrame([(s, i) for i, s in enumerate(wanted_setups)], "setup string, place long")
        elif mode:
            order = setups.select("setup", F.lit(0).cast("long").alias("place"))  # prompts of a mode come in their own order
        else:
            order = setups.select("setup", F.col("ord").cast("long").alias("place"))
        out = own.join(order, "setup").withColumnRenamed("prompt_ord", "place2")
        if mode:
            out = out.where(F.col("mode") == mode)
    first = out.groupBy("setup", "prompt", "mode").agg(F.min(F.struct(F.col("place"), F.col("place2"))).alias("at"))
    return first.select("setup", "prompt", "mode", "at")


def plan(models: DataFrame, found: DataFrame, wanted_models: list[str] | None = None, size: int = 50, temperature: float = 0.1, few_shot_row: int | None = None) -> DataFrame:
    """models x triplets with experiment names; the configuration tables are small, so the product is broadcast.

    A given example row stands in the names of few-shot experiments.
    """
    if few_shot_row is not None and few_shot_row < 0:
        raise ValueError(f"the example row must not be negative: {few_shot_row}")
    shown = F.when(F.col("mode") == FEW_SHOT, F.lit(few_shot_row).cast("long"))
    chosen = models.where(F.col("model").isin(wanted_models)) if wanted_models else models
    grid = chosen.select("model", F.col("ord").alias("model_ord")).crossJoin(F.broadcast(found))
    return grid.withColumn("experiment_name", experiment_name(F.col("setup"), F.col("model"), F.col("mode"), F.col("prompt"), F.lit(size), F.lit(temperature), shown))


def missing(planned: DataFrame, existing: DataFrame) -> DataFrame:
    """What is planned and not there yet."""
    return planned.join(existing.select("experiment_name").distinct(), "experiment_name", "left_anti")


def grouped_for_models(planned: DataFrame) -> DataFrame:
    """model, setup and their experiments in order, so that each model loads once."""
    return planned.groupBy("model", "setup").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "experiment_name"))), lambda x: x["experiment_name"]).alias("experiments"))


def histograms(planned: DataFrame) -> DataFrame:
    """dimension, value, n: counts by mode, setup and model in one pass."""
    long = planned.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("mode", "setup", "model")])).alias("x"))
    return long.groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"))


def unknown_references(prompts: DataFrame, setups: DataFrame) -> DataFrame:
    """Prompts whose setup does not exist."""
    return prompts.join(setups, "setup", "left_anti")


def setup_prompts(prompts: DataFrame, setups: DataFrame) -> DataFrame:
    """setup, prompts: what is compatible, in order."""
    return setups.select("setup").join(prompts.select("setup", "prompt", "ord"), "setup").groupBy("setup").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "prompt"))), lambda x: x["prompt"]).alias("prompts"))
