"""Queries of signal operators over arrays made from the vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.operators import ingest as ig
from listenlab.operators import signal as sg
from listenlab.operators.order import kept

from .bind import sql
from .registry import query

R = lambda n: F.round(n, 6).alias(n)


def R_(c, name):
    return F.round(c, 6).alias(name)


def _beats(n: int, period: float):
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i * F.lit(period))


@query("tempo_ambiguity", sql("vectors", "SELECT track_id, abs(vec[1]) > 0 AND greatest(abs(vec[2]), abs(vec[3])) > .9 * abs(vec[1]) AS ambiguous FROM vectors"))
def ambiguity(t):  # SG4: strengths at the tempo's, its double's and its half's lag
    level = F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.when(i == 40, F.abs(F.get("vec", F.lit(0)))).when(i == 20, F.abs(F.get("vec", F.lit(1)))).when(i == 80, F.abs(F.get("vec", F.lit(2)))).otherwise(0.0))
    return t.vectors.select("track_id", sg.ambiguous(level, F.lit(150.0), F.lit(100.0)).alias("ambiguous"))


@query("groove_measures", sql("vectors", "SELECT track_id, round(stddev_pop(x) * 500, 6) AS microtiming_ms FROM (SELECT track_id, unnest(vec[1:16]) / 10 AS x FROM vectors) GROUP BY 1"))
def groove(t):  # SG4, WN8: onsets lie a tenth of a vector's numbers off a grid of half a second
    on = F.transform(F.slice("vec", 1, 16), lambda x, i: (i + x / 10) * 0.5)
    return t.vectors.select("track_id", sg.groove(on, _beats(20, 0.5)).alias("g")).select("track_id", R("g.microtiming_ms").alias("microtiming_ms"))


@query("key_stability")
def stability(t):  # SG4
    frames = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: F.transform(F.slice("vec", F.when(i < 25, 1).otherwise(21), 12), lambda x: F.abs(x)))
    return t.vectors.select("track_id", R_(sg.key_stability(frames, F.lit(8)), "stability"))


@query("resampled_energy")
def resample(t):  # SG7
    return t.vectors.select("track_id", R_(F.aggregate(sg.resampled("vec", F.lit(64), F.lit(48)), F.lit(0.0), lambda a, x: a + x * x), "energy"), R_(sg.true_peak("vec"), "true_peak"))


@query("cliff_signal", sql("features", "SELECT track_id, round(CASE WHEN hz <= 0 OR hz > 22050 * .92 THEN 0 WHEN NOT l AND hz >= (CASE WHEN b < 130000 THEN 16000 WHEN b < 200000 THEN 18000 ELSE 19500 END) * .92 THEN 0 ELSE greatest(least(((22050 * .92 - hz) / (22050 * .92) - .05) / .4, 1), 0) * CASE WHEN l THEN 1 ELSE .5 END END, 6)::DOUBLE AS hf_cliff_unexplained FROM (SELECT track_id, energy * 22050 AS hz, track_id % 2 = 0 AS l, 100000 + track_id % 3 * 60000 AS b FROM features)"))
def cliffs(t):  # SG6
    rows = t.features.select("track_id", (F.col("energy") * 22050).alias("rolloff99_hz"), F.lit(44100).alias("rate"), (F.col("track_id") % 2 == 0).alias("lossless"), (100_000 + F.col("track_id") % 3 * 60_000).alias("bitrate"))
    return sg.cliff(rows).select("track_id", R("hf_cliff_unexplained"))


@query("sample_signals")
def signals(t):  # SG6
    # two seconds of each vector's numbers as partials, at 8 kHz
    tone = F.transform(F.sequence(F.lit(0), F.lit(16_399)), lambda i: F.get("vec", F.lit(0)) * F.sin(i * 0.31) + F.get("vec", F.lit(1)) * F.sin(i * 0.87) + F.get("vec", F.lit(2)) * F.sin(i * i * 0.0001))
    return t.vectors.select("track_id", sg.sample_signals(tone, F.lit(8000)).alias("s")).select("track_id", *[R_(F.col(f"s.{n}"), n) for n in sg._SIGNALS])


@query("segments")
def segments(t):  # SG5: two alternating kinds of beats
    kind = lambda i: F.floor(i / 16) % 2
    beats = F.sequence(F.lit(0), F.lit(63))
    chroma = F.transform(beats, lambda i: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.when(j % 2 == kind(i), 1.0).otherwise(0.1) + 0.02 * F.abs(F.get("vec", (i + j) % 64))))
    timbre = F.transform(beats, lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: kind(i) * 2.0 + 0.05 * F.get("vec", (i * 3 + j) % 64)))
    times = F.transform(beats, lambda i: i * 0.5)
    loud = F.transform(beats, lambda i: 0.2 + 0.5 * kind(i))
    landed = kept(t.vectors.select("track_id", chroma.alias("chroma"), timbre.alias("timbre"), times.alias("times"), loud.alias("loud")))
    found = landed.select("track_id", sg.segmented(*map(F.col, ("chroma", "timbre", "times", "loud"))).alias("s"))
    return found.select("track_id", F.inline("s")).select("track_id", "start", "stop", "label", R("energy"))


_FILES = "fi AS (SELECT '/m/' || lpad(id::VARCHAR, 8, '0') AS path, 'd' || id // 3 AS digest, title, CASE WHEN id % 11 = 0 THEN 'unreadable' END AS error FROM tracks), gd AS (SELECT digest, min(path) AS path, arg_min(title, path) AS title FROM fi WHERE error IS NULL GROUP BY 1), lb AS (SELECT 'd' || id AS digest, '/old/' || id AS path, 'old' AS title FROM tracks WHERE id < 100)"


def _files(t):
    i = F.col("id")
    files = t.tracks.select(F.concat(F.lit("/m/"), F.lpad(i.cast("string"), 8, "0")).alias("path"), F.concat(F.lit("d"), F.floor(i / 3)).alias("digest"), "title", "artist", F.lit(1.0).alias("duration_s"), F.when(i % 11 == 0, "unreadable").alias("error"))
    old = t.tracks.where("id < 100").select(F.concat(F.lit("d"), i).alias("digest"), F.concat(F.lit("/old/"), i).alias("path"), F.lit("old").alias("title"), "artist", F.lit(1.0).alias("duration_s"))
    return ig.ingest(files, old)


@query("ingest_summary", sql("tracks", "SELECT (SELECT count(*) FROM fi) AS scanned, (SELECT count(*) FROM gd) AS ingested, (SELECT count(*) FROM fi WHERE error IS NOT NULL) AS failed, (SELECT count(*) FROM gd WHERE digest NOT IN (SELECT digest FROM lb)) AS added", _FILES))
def ingest_summary(t):  # AX1
    return _files(t)[1]


@query("ingested_library", sql("tracks", "SELECT digest, path, title FROM gd UNION ALL SELECT digest, path, title FROM lb WHERE digest NOT IN (SELECT digest FROM gd)", _FILES))
def ingested(t):  # AX1: every third row of files has the same content as the two before it
    return _files(t)[0].select("digest", "path", "title")


@query("fallback_windows", sql("tracks", "SELECT id, " + ", ".join(f"greatest(least(d * {p} - 10, greatest(d - 20, 0)), 0)::DOUBLE AS w{i}" for i, p in enumerate((0.25, 0.5, 0.7))) + " FROM (SELECT id, coalesce(nullif(duration_ms / 1000.0 / (1 + id % 9), 0), 180)::DOUBLE AS d FROM tracks)"))
def fallback(t):  # AX3
    w = ig.fallback_starts(F.col("duration_ms") / 1000 / (1 + F.col("id") % 9), 20.0)
    return t.tracks.select("id", *[F.get(w, F.lit(i)).alias(f"w{i}") for i in range(3)])


@query("analysed_tracks")
def analysed(t):  # AX2
    kind = lambda i: F.floor(i / 16) % 2
    beats = F.sequence(F.lit(0), F.lit(63))
    chroma = F.transform(beats, lambda i: F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.when(j % 2 == kind(i), 1.0).otherwise(0.1) + 0.02 * F.abs(F.get("vec", (i + j) % 64))))
    timbre = F.transform(beats, lambda i: F.transform(F.sequence(F.lit(0), F.lit(4)), lambda j: kind(i) * 2.0 + 0.05 * F.get("vec", (i * 3 + j) % 64)))
    onsets = F.transform(F.slice("vec", 1, 32), lambda x, i: (i + x / 10) * 0.5)
    rows = kept(t.vectors.select("track_id", chroma.alias("chroma"), timbre.alias("timbre"), F.transform(beats, lambda i: i * 0.5).alias("times"), F.transform(beats, lambda i: 0.2 + 0.5 * kind(i)).alias("loudness"), onsets.alias("onsets"), F.lit(32.0).alias("duration_s")))
    a = ig.analysed(rows, t.features.where("error IS NOT NULL"))
    return a.select("track_id", R("microtiming_ms"), R("swing"), R("key_stability"), F.size("sections").alias("n_sections"), F.array_join(F.transform("excerpts", lambda e: e["source"]), ",").alias("excerpts"))
