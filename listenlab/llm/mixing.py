"""Mixing sources to target weights by hash-threshold histograms.

Every document has a 48-bit hash of its id. Sizes are summed by source and hash bucket; the cumulated
sums show in which bucket a source's budget ends; only that bucket is split into finer ones, until the
hash is used up. A document is taken if its hash lies below its source's threshold, so nothing is
sorted and reruns agree. A budget above the source's size takes whole repeats first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import ranked, word_count, written

#: Weights by rank of the source, and the largest number of times a document may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3
#: Bits of the hash, used so many at a time.
BITS, STEP = 48, 8
#: Sources up to which their table is broadcast; beyond it, an ordinary join that Spark may split.
BROADCAST_SOURCES = 50_000


def doc_hash(doc_id: Column) -> Column:
    """48 bits of the id's MD5; a null id counts as the empty string."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.conv(F.substring(F.md5(text), 1, BITS // 4), 16, 10).cast("long")


@dataclass
class Mix:
    """One row for each source: source, source_size, target, reps, threshold (hashes below it are taken once more)."""

    sources: DataFrame
    few: bool

    def apply(self, docs: DataFrame, doc_id: Column, source: Column, size: Column) -> DataFrame:
        """Adds size, source_size, target and taken; columns of these names are replaced."""
        s = self.sources.select(
            F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"), "reps", "threshold",
        ).withColumnsRenamed({"reps": "_reps", "threshold": "_threshold"})
        rows = docs.withColumns({"_size": size, "_key": source, "_h": doc_hash(doc_id)})
        out = rows.join(F.broadcast(s) if self.few else s, F.col("_key").eqNullSafe(F.col("_src")), "inner")
        times = F.col("_reps") + F.when(F.col("_h") < F.col("_threshold"), 1).otherwise(0)
        return out.withColumns(
            {"size": F.col("_size"), "source_size": F.col("_source_size"), "target": F.col("_target"), "taken": F.col("_size") * times, "_times": times}
        ).drop("_size", "_key", "_h", "_src", "_source_size", "_target", "_reps", "_threshold")


def targets(sizes: DataFrame) -> DataFrame:
    """Budgets by source from rows (source, source_size).

    Sources rank by code point, null last; weights repeat in that order. A target never exceeds
    MOST times the source; what is cut is shared by weight among the rest, until none is above.
    """
    order = ranked(sizes, F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = written(order.select("source", "source_size", weight.alias("weight")), "weights")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        above = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
        cut, rest = rows.agg(F.sum(F.when(above, MOST * F.col("source_size"))), F.sum(F.when(~above, F.col("weight")))).first()
        new = (total - (cut or 0)) / rest if rest else level
        if new == level or not rest:
            break
        level = new
    above = F.col("weight") * F.lit(level) > MOST * F.col("source_size")
    return rows.withColumn(
        "target", F.when(above, (MOST * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(level))
    )


def plan(rows: DataFrame) -> Mix:
    """Thresholds by source from the narrow rows (source, size, h) of all documents; null size counts 0."""
    cells = written(
        rows.groupBy("source", "h").agg(F.sum(F.coalesce("size", F.lit(0))).alias("size")), "cells"
    )
    goals = targets(cells.groupBy("source").agg(F.sum("size").alias("source_size")))
    reps = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = written(
        goals.select("source", "source_size", "target", reps.alias("reps"))
        .withColumn("budget", F.col("target") - F.col("reps") * F.col("source_size"))
        .withColumn("threshold", F.lit(0).cast("long")),
        "budgets",
    )
    few = state.count() <= BROADCAST_SOURCES
    hint = F.broadcast if few else (lambda d: d)
    for shift in range(BITS - STEP, -1, -STEP):
        b = state.select(F.col("source").alias("s"), "threshold", "budget")
        inside = cells.join(hint(b), F.col("source").eqNullSafe(F.col("s"))).where(
            F.shiftright("h", shift + STEP) == F.shiftright("threshold", shift + STEP)
        )
        sums = inside.groupBy("source", "budget", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        seen = sums.withColumn("upto", F.sum("size").over(upto))
        fits = F.col("upto") <= F.col("budget")
        if not shift:  # the last bucket may tip over if that comes nearer
            fits = fits | ((F.col("budget") - (F.col("upto") - F.col("size"))) * 2 >= F.col("size"))
        step = seen.groupBy("source").agg(
            F.max(F.when(fits, F.col("bucket"))).alias("full"),
            F.sum(F.when(fits, F.col("size"))).alias("used"),
            F.min(F.when(~fits, F.col("bucket"))).alias("next"),
        ).select(F.col("source").alias("s"), "full", "used", "next")
        joined = state.join(hint(step), F.col("source").eqNullSafe(F.col("s")), "left")
        # the threshold moves to the start of the bucket in which the budget ends; with none left, behind all that fit
        at = F.coalesce(F.col("next"), F.col("full") + 1)
        state = written(
            joined.select(
                "source", "source_size", "target", "reps",
                F.when(F.col("s").isNull() & F.col("full").isNull(), F.col("threshold")).otherwise(F.shiftleft(at, shift)).alias("threshold"),
                (F.col("budget") - F.coalesce("used", F.lit(0))).alias("budget"),
            ),
            "budgets",
        )
    return Mix(state.drop("budget"), few)


def mixed(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of all documents.

    Null texts have size 0 and null sources are a source of their own. Documents of one id share
    their fate. An empty table gives an empty result; other columns are ignored.
    """
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    mix = plan(sized.select("source", "size", doc_hash(F.col("doc_id")).alias("h")))
    return mix.apply(sized, F.col("doc_id"), F.col("source"), F.col("size")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM s0),
it AS (
  SELECT 0 AS k, 0.0::DOUBLE AS level
  UNION ALL
  SELECT k + 1, ((SELECT sum(source_size) FROM s) - coalesce((SELECT sum({MOST} * source_size) FROM s WHERE weight * level > {MOST} * source_size), 0))::DOUBLE
         / (SELECT sum(weight) FROM s WHERE NOT weight * level > {MOST} * source_size)::DOUBLE
  FROM it WHERE k < 40),
lv AS (SELECT level FROM it ORDER BY k DESC LIMIT 1),
t AS (SELECT s.*, CASE WHEN weight * level > {MOST} * source_size THEN ({MOST} * source_size)::DOUBLE ELSE weight * level END AS target FROM s, lv),
r AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS reps FROM t),
g AS (SELECT source, h, sum(size) AS size FROM d GROUP BY source, h),
c AS (SELECT g.*, sum(g.size) OVER (PARTITION BY g.source ORDER BY g.h) AS upto, target - reps * source_size AS budget
      FROM g JOIN r ON g.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, upto <= budget AS fits, row_number() OVER (PARTITION BY source, upto <= budget ORDER BY h) AS n FROM c),
k AS (SELECT source, h FROM p WHERE fits OR (n = 1 AND (budget - (upto - size)) * 2 >= size))
SELECT d.doc_id, d.size, r.source_size, r.target,
       d.size * (r.reps + CASE WHEN k.h IS NULL THEN 0 ELSE 1 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
LEFT JOIN k ON k.source IS NOT DISTINCT FROM d.source AND k.h = d.h
"""
