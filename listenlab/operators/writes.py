"""Write semantics as pure functions of old and new rows; files are then replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert_fill(old: DataFrame, new: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """SNK1: new keys are added; of known keys only missing fields are filled. Keys are trimmed, empty ones rejected."""
    clean = new
    for k in key:
        clean = clean.withColumn(k, F.trim(k)).where(F.length(k) > 0)
    clean = clean.groupBy(*key).agg(*[F.max(f).alias(f) for f in fields])
    j = old.alias("o").join(clean.alias("n"), key, "full_outer")
    return j.select(*key, *[F.coalesce(F.col(f"o.{f}"), F.col(f"n.{f}")).alias(f) for f in fields])


def append_once(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK2: rows of a known key aren't added again."""
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def latest(rows: DataFrame, key: list[str], version: Column) -> DataFrame:
    """SNK3, SNK4, SNK9: of each key the row of the highest version."""
    w = Window.partitionBy(*key).orderBy(version.desc())
    return rows.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK7, SNK10: rows of the keys in ``new`` go, those of ``new`` come."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    """SNK11, SNK13."""
    return rows.join(gone.select(*key), key, "left_anti")


def repoint(rows: DataFrame, ids: DataFrame, column: str, key: list[str]) -> DataFrame:
    """SNK14: rows of duplicates (dup, canonical) move to the canonical id; rows of one key are one."""
    j = rows.join(ids.select(F.col("dup").alias(column), "canonical"), column, "left")
    return j.withColumn(column, F.coalesce("canonical", column)).drop("canonical").dropDuplicates(key)


def pending(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SNK6: what has not been completed."""
    return rows.join(done.select(key), key, "left_anti")


#: The tables of a store.
TABLES = ["plays", "audio_features", "lyrics", "playlist_tracks", "playlists", "top_items", "recommendations", "tracks"]


def append(rows: DataFrame, path: str) -> None:
    """SNK5: events behind those that are there."""
    rows.write.mode("append").parquet(path)


def flush(good: DataFrame, bad: DataFrame, path: str) -> None:
    """SNK8: measured rows and rows with errors in one write; each lacks the other's columns."""
    good.unionByName(bad, allowMissingColumns=True).write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK9: rows of known keys are overwritten, others added."""
    return replaced(old, new, key)


def clear(spark: SparkSession, folder: str, names: list[str] | None = None) -> None:
    """SNK12: empties the tables of a folder, with their columns kept."""
    for name in TABLES if names is None else names:
        schema = spark.read.parquet(f"{folder}/{name}").schema
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}")
