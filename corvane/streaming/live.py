"""Beyond batch evaluation: the same metrics over streams of responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_stream(spark: SparkSession, folder: str, schema: T.StructType, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def success_rate(events: DataFrame, at: str, ok: Column, width: str = "1 hour", late: str = "2 hours", by: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling windows with the number of events and the share of successes; works on streams and tables."""
    # Watermarks need an instant; times without a zone are read in the session's.
    windowed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if events.isStreaming else events
    out = windowed.groupBy(F.window(at, width).alias("w"), *by).agg(F.count("*").alias("n"), F.count_if(ok).alias("n_success"))
    return out.select(F.col("w.start").alias("window_start"), *by, "n", "n_success", (F.col("n_success") / F.col("n")).alias("success_rate"))


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there, write it and stop; restarts go on from the checkpoint."""
    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path).awaitTermination()
