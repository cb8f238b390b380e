"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in a local session without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="listenlab-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def written(df: DataFrame, what: str = "part") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a table that may be broadcast.
FEW = 10_000


def few(table: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has no more than FEW rows; beyond that Spark chooses the join."""
    return F.broadcast(table) if table.limit(FEW + 1).count() <= FEW else table


#: Rows of a batch that Python gets, as texts can be long; one number for the whole session, so that plans built earlier don't change.
BATCH = 256


def small_arrow_batches(spark: SparkSession) -> None:
    """Keep Python's batches small; what was set smaller stays. Spark bounds their bytes as well."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH))


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text, lower-cased in A-Z; a null text has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, SPACES), lambda w: w != "")


def shingle_hashes(text: Column, n: int) -> Column:
    """Distinct 64-bit hashes of the n-word shingles; a shorter text is one shingle, an empty one none."""

    def of(h: Column) -> Column:
        size = F.size(h)
        each = F.transform(
            F.slice(h, F.lit(1), F.greatest(size - (n - 1), F.lit(0))),
            lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, n)]),
        )
        none = F.array().cast("array<bigint>")
        return (
            F.when(size == 0, none)
            .when(size < n, F.array(F.xxhash64(F.array_join(h.cast("array<string>"), ","), F.lit(0))))
            .otherwise(F.array_distinct(each))
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def ranked(df: DataFrame, key: Column, name: str = "rank") -> DataFrame:
    """Adds the 0-based rank by ``key`` (a total order) without one task seeing all rows.

    Range partitions are numbered one by one; only a count for each partition reaches the driver.
    """
    part = written(
        df.repartitionByRange(key).withColumn("_part", F.spark_partition_id()), "ranked"
    )
    counts = {r["_part"]: r["n"] for r in part.groupBy("_part").agg(F.count("*").alias("n")).collect()}
    base, sum_ = {}, 0
    for p in sorted(counts):
        base[p], sum_ = sum_, sum_ + counts[p]
    start = F.element_at(F.create_map(*[F.lit(x) for p in base for x in (p, base[p])]), F.col("_part")) if base else F.lit(0)
    w = Window.partitionBy("_part").orderBy(key)
    return part.withColumn(name, (start + F.row_number().over(w) - 1).cast("long")).drop("_part")
