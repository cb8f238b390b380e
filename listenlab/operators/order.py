"""Ranks and running sums over all rows in one order, without one task that sees all of them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; a local one only in a local session without the setting."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="listenlab-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read again: cuts the lineage, survives lost executors."""
    to = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def in_ranges(rows: DataFrame, *order: Column) -> DataFrame:
    """``rows`` written in range partitions of a total order, numbered from 0 in ``_part``."""
    return kept(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, order: list[Column], **sums: Column) -> DataFrame:
    """Adds ``pos``, the place from 1 on in a total order, ``total``, the number of rows, and running sums of non-null numbers, the row included.

    Each range partition runs by itself; one row of counts and sums for each partition reaches the driver.
    """
    part = in_ranges(rows.withColumns({f"_{n}": c for n, c in sums.items()}), *order)
    per = part.groupBy("_part").agg(F.count("*").alias("n"), *[F.sum(f"_{n}").alias(n) for n in sums]).orderBy("_part").collect()
    before, base = [], {n: 0 for n in ("n", *sums)}
    for r in per:
        before.append((r["_part"], *[base[n] for n in base]))
        base = {n: base[n] + (r[n] or 0) for n in base}
    kinds = dict(part.dtypes)
    whole = {n: kinds[f"_{n}"] not in ("double", "float") for n in sums}
    schema = "_part int, n long" + "".join(f", {n} {'long' if whole[n] else 'double'}" for n in sums)
    ahead = rows.sparkSession.createDataFrame([(p, n, *[x if w else float(x) for x, w in zip(rest, whole.values(), strict=True)]) for p, n, *rest in before], schema).select("_part", *[F.col(n).alias(f"_b_{n}") for n in base])
    w = Window.partitionBy("_part").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    out = part.withColumns({"pos": F.row_number().over(w).cast("long")} | {n: F.sum(f"_{n}").over(run) for n in sums}).join(F.broadcast(ahead), "_part")
    out = out.withColumns({"pos": F.col("pos") + F.col("_b_n"), "total": F.lit(base["n"]).cast("long")} | {n: F.col(n) + F.col(f"_b_{n}") for n in sums})
    return out.drop("_part", *[f"_{n}" for n in sums], *[f"_b_{n}" for n in base])


def previous(rows: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """Adds to each row some values of the row before it in a total order; the last row of each range partition reaches the driver."""
    part = in_ranges(rows, *order)
    w = Window.partitionBy("_part").orderBy(*order)
    one = F.struct(*[c.alias(n) for n, c in values.items()])
    last = {r["_part"]: r["v"] for r in part.groupBy("_part").agg(F.max_by(one, F.struct(*order)).alias("v")).collect()}
    ends, held = [], None
    for p in sorted(last):
        ends.append((p, held))
        held = last[p]
    kind = part.select(one.alias("v")).schema["v"].dataType.simpleString()
    carried = rows.sparkSession.createDataFrame(ends, f"_part int, _end {kind}")
    got = part.withColumns({"_v": F.lag(one).over(w), "_first": F.row_number().over(w) == 1}).join(F.broadcast(carried), "_part")
    got = got.withColumn("_v", F.when(F.col("_first"), F.col("_end")).otherwise(F.col("_v")))
    return got.select(*rows.columns, *[F.col(f"_v.{n}").alias(n) for n in values])
