"""Live views of a trial log that is still being written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import TRIAL_SCHEMA


def watch_trials(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """The log's JSON lines as a stream."""
    return spark.readStream.schema(TRIAL_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path)


def incumbents(stream: DataFrame) -> DataFrame:
    """(budget, config, loss, n): the best run of each budget so far; state is a row per budget."""
    return stream.groupBy("budget").agg(F.min_by("config", F.struct("loss", "trial_id")).alias("config"), F.min("loss").alias("loss"), F.count(F.lit(1)).alias("n"))


def finished_per_window(stream: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(start, budget, n, best): runs by the window in which they finished; late ones are waited for, then state goes."""
    timed = stream.withColumn("at", F.timestamp_seconds("finished")).withWatermark("at", late)
    out = timed.groupBy(F.window("at", window), "budget").agg(F.count(F.lit(1)).alias("n"), F.min("loss").alias("best"))
    return out.select(F.col("window.start").alias("start"), "budget", "n", "best")
