"""The batch operators' streaming forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def once(plays: DataFrame, late: str = "1 day") -> DataFrame:
    """SM1: late and repeated events by their key."""
    return plays.withWatermark("played_at", late).dropDuplicatesWithinWatermark(["track_id", "played_at", "source"])


def sessions(plays: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """SM2: plays by user and session."""
    return plays.withWatermark("played_at", late).groupBy("user_id", F.session_window("played_at", gap).alias("w")).agg(F.count("*").alias("plays"))


def daily(plays: DataFrame, late: str = "1 day") -> DataFrame:
    """SM3: plays by day."""
    return plays.withWatermark("played_at", late).groupBy(F.window("played_at", "1 day").alias("w")).agg(F.count("*").alias("plays"))


def running_counts(plays: DataFrame) -> DataFrame:
    """SM5: plays of each track so far."""
    return plays.groupBy("track_id").agg(F.count("*").alias("plays"))


def available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """SM4: all that is there now, in micro-batches; a rerun goes on where the last one stopped."""
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()
