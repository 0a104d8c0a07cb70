"""Reactions in a window after an action, on streams and on tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reaction_windows(actions: DataFrame, observations: DataFrame, person: str = "user_id", window: str = "5 seconds", late: str = "1 minute") -> DataFrame:
    """Each action (action_id, action_ts) with its person's observations (obs_id, obs_ts) in the window after it.

    The same join on streams and on tables: an equality on the person and an interval on time. On streams both sides have
    watermarks, so state is kept for the window and the allowed lateness only."""
    a, o = actions, observations
    if actions.isStreaming:
        a, o = a.withWatermark("action_ts", late), o.withWatermark("obs_ts", late)
    o = o.withColumnRenamed(person, "_person")
    within = (F.col(person) == F.col("_person")) & (F.col("obs_ts") > F.col("action_ts")) & (F.col("obs_ts") <= F.col("action_ts") + F.expr(f"INTERVAL {window}"))
    return a.join(o, within).drop("_person")


def record_stream(spark, folder: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, so many files a batch; each file is read once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
