"""As-of joins: for each row of one side the latest row of the other that isn't younger, by key, without a product."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .order import in_ranges


def asof(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """``left`` with ``found_at`` and ``values`` of the latest ``right`` row of its key at or before its time; nulls if there is none.

    Both sides are sorted into range partitions of (key, time), so a key of any size spreads over many; each row looks back
    to the last right row before it, and what the partitions before have to say is one row each. Of right rows of one key
    and time the one with the greatest values counts. Left rows of a null key or time find none, and all stay.
    """
    row = F.struct(*left.columns)
    value = F.struct(F.col(key).alias("_k"), F.col(right_time).alias("_t"), *values)
    ours = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_time"), F.lit(1).alias("_side"), row.alias("_row"))
    theirs = right.where(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(F.col(key).alias("_key"), F.col(right_time).alias("_time"), F.lit(0).alias("_side"), value.alias("_value"))
    order = [F.col("_key"), F.col("_time"), F.col("_side"), F.col("_value")]
    part = in_ranges(ours.unionByName(theirs, allowMissingColumns=True), *order[:3])
    last = {r["_part"]: r["v"] for r in part.groupBy("_part").agg(F.max_by("_value", F.when(F.col("_side") == 0, F.struct(*order))).alias("v")).collect()}
    before, held = [], None
    for p in sorted(last):
        before.append((p, held))
        held = last[p] if last[p] is not None else held
    carried = left.sparkSession.createDataFrame(before, f"_part int, _before {part.schema['_value'].dataType.simpleString()}")
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = part.withColumn("_seen", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").join(F.broadcast(carried), "_part", "left")
    seen = seen.withColumn("_seen", F.coalesce("_seen", "_before"))
    mine = F.when(F.col("_seen._k") == F.col("_key"), F.when(F.col("_time").isNotNull(), F.col("_seen")))
    seen = seen.withColumn("_seen", mine)
    return seen.select("_row.*", F.col("_seen._t").alias("found_at"), *[F.col(f"_seen.{v}").alias(v) for v in values])


def cached_lookups(asked: DataFrame, lookups: DataFrame, life_s: int) -> DataFrame:
    """EN4: (…asked, value, found_at, state) for asked (key, asked_at, …) and lookups (key, fetched_at, value).

    ``state`` is fresh for the latest lookup no older than its life, expired for an older one, whose value isn't given, and
    missing where there is none. A fresh lookup that found nothing is fresh with a null value, so it isn't asked again.
    """
    rows = asof(asked, lookups, "key", "asked_at", "fetched_at", ["value"])
    old = F.unix_seconds(F.col("asked_at").cast("timestamp")) - F.unix_seconds(F.col("found_at").cast("timestamp")) > life_s
    state = F.when(F.col("found_at").isNull(), "missing").when(old, "expired").otherwise("fresh")
    return rows.withColumn("state", state).withColumn("value", F.when(F.col("state") == "fresh", F.col("value")))


def replayed(plays: DataFrame, copied: DataFrame, known: DataFrame) -> DataFrame:
    """SRC21: plays (track_id, played_at, source) of copied tracks (id, library_id) as the library's events (track_id, played_at, context), those known left out, repeated ones once."""
    rows = plays.join(copied, plays["track_id"] == copied["id"]).select(F.col("library_id").alias("track_id"), "played_at", F.col("source").alias("context")).distinct()
    return rows.join(known.select("track_id", "played_at", "context"), ["track_id", "played_at", "context"], "left_anti")
