"""Invented plays and sounds for demonstrations: the same for the same seed, of any number."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How much is played in each hour, on each day from Monday on, and from which source.
HOURS = [1, 1, 1, 1, 1, 2, 4, 7, 8, 6, 5, 6, 8, 7, 6, 6, 7, 9, 11, 12, 11, 9, 6, 3]
DAYS = [1.3, 1.0, 1.0, 1.0, 1.1, 1.4, 1.5]
SOURCES = {"spotify": 6, "ytmusic": 3, "apple": 2}
START, SPAN_DAYS, PLAYS, LEAST = "2025-11-01", 242, 2600, 3


def _draw(seed: int, *keys: Column) -> Column:
    """A number from 0 to 1 that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def _weighted(u: Column, values: list, weights: list) -> Column:
    """The value in whose part of the weights u falls."""
    total, upto, out = sum(weights), 0, None
    for v, w in zip(values, weights, strict=True):
        upto += w
        test = u < upto / total
        out = F.when(test, F.lit(v)) if out is None else out.when(test, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def plays(spark: SparkSession, tracks: DataFrame, total: int = PLAYS, seed: int = 7) -> DataFrame:
    """SRC24: (track_id, played_at, source): plays of tracks (id) by a squared affinity, more of late, in the evening and at the end of the week."""
    a = tracks.select(F.col("id").alias("track_id"), F.pow(_draw(seed, F.col("id")), F.lit(2)).alias("affinity"))
    share = F.col("affinity") / F.col("sum")
    each = a.crossJoin(F.broadcast(a.agg(F.sum("affinity").alias("sum")))).withColumn("n", F.greatest(F.floor(total * share), F.lit(LEAST)))
    rows = each.select("track_id", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("k"))
    u = lambda s: _draw(seed + s, F.col("track_id"), F.col("k"))
    day = F.date_add(F.lit(START).cast("date"), F.floor(SPAN_DAYS * F.pow(u(1), F.lit(0.7))).cast("int"))
    rows = rows.withColumn("day", day).where(u(2) <= F.element_at(F.array(*map(F.lit, DAYS)), F.weekday("day") + 1) / max(DAYS))
    hour = _weighted(u(3), list(range(24)), HOURS)
    at = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), hour, F.floor(60 * u(4)).cast("int"), F.floor(60 * u(5)).cast("decimal(18,6)"))
    return rows.select("track_id", at.alias("played_at"), _weighted(u(6), list(SOURCES), list(SOURCES.values())).alias("source"))


def recordings(tracks: DataFrame, seconds: float = 4.0, rate: int = 8000) -> DataFrame:
    """(track_id, samples, rate, left, right): invented sounds of tracks (track_id, bpm, tonic, mode, noise): a chord, a click on each beat, and noise.

    Notes and clicks are as the row says, and noise is the same for the same id; a null tempo leaves the samples null. The
    right channel is the left one, weaker by the id's remainder by 4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = np.arange(int(seconds * rate)) / rate
        kind = pa.list_(pa.float32())
        for b in batches:
            ids, sounds, lefts, rights = [], [], [], []
            for r in b.to_pylist():
                ids.append(r["track_id"])
                if r["bpm"] is None:
                    sounds.append(None), lefts.append(None), rights.append(None)
                    continue
                third = 4 if r["mode"] == "major" else 3
                x = sum(0.12 * np.sin(2 * np.pi * 261.6256 * 2 ** ((r["tonic"] + s) / 12) * t) for s in (0, third, 7))
                since = t % (60 / r["bpm"])
                x += 0.6 * np.exp(-since * 60) * np.sin(2 * np.pi * 1800 * since)
                x += np.random.default_rng(r["track_id"]).normal(0, r["noise"], len(t))
                sounds.append(x.astype(np.float32))
                lefts.append(sounds[-1][: rate // 2])
                rights.append(lefts[-1] * (1 - r["track_id"] % 4 / 4))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sounds, kind), pa.array([rate] * len(ids), pa.int32()), pa.array(lefts, kind), pa.array(rights, kind)], ["track_id", "samples", "rate", "left", "right"])

    rows = tracks.select(F.col("track_id").cast("long"), F.col("bpm").cast("double"), F.col("tonic").cast("int"), "mode", F.col("noise").cast("double"))
    return rows.mapInArrow(run, "track_id long, samples array<float>, rate int, left array<float>, right array<float>")
