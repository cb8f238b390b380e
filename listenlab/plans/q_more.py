"""Samples, breakdowns, signals, composites and streaming forms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listenlab.functions import text as tx
from listenlab.operators import asof as ao
from listenlab.operators import audio as au
from listenlab.operators import etl
from listenlab.operators import macro as m
from listenlab.operators import resolve as rs
from listenlab.operators import stats as st
from listenlab.operators.order import shared_dir
from listenlab.streaming import plays as sp
from listenlab.streaming import successors as su

from .bind import UNIT, sql
from .q_text import _MUSIC
from .registry import query

R = lambda n: F.round(n, 6).alias(n)


@query("seeded_sample")
def sample(t):  # ST7, ST8: by hash, so reruns agree
    return t.tracks.orderBy(F.xxhash64("id", F.lit(7)), "id").limit(100).select("id")


@query("weighted_sample")
def weighted(t):  # ST9
    u = (F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    rows = m.with_counts(t.tracks, t.plays, 0).withColumn("k", -F.log(u) * (1 + F.col("plays")))
    return rows.orderBy("k", "id").limit(100).select("id", "plays")


@query("exclusion_breakdown", "SELECT event_type AS reason, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE event_type <> 'click' GROUP BY 1")
def breakdown(t):  # AG45
    return t.raw("events").where("event_type <> 'click'").groupBy(F.col("event_type").alias("reason")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


@query("import_summary", sql("plays_ev", "SELECT count(*) AS seen, count(*) FILTER (played_ms < 30000) AS too_short, count(*) FILTER (skipped) AS skipped, count(DISTINCT track_id) AS tracks FROM plays_ev"))
def summary(t):  # AG46
    return t.plays_ev.agg(F.count("*").alias("seen"), F.count_if(F.col("played_ms") < 30_000).alias("too_short"), F.count_if("skipped").alias("skipped"), F.countDistinct("track_id").alias("tracks"))


@query("display_names", sql("tracks", "SELECT id, CASE WHEN id % 3 = 0 THEN 'Unknown' ELSE artist END || ' — ' || CASE WHEN id % 2 = 0 THEN 'stem' ELSE title END AS name FROM tracks"))
def display(t):  # AX13
    return t.tracks.select("id", tx.display(F.when(F.col("id") % 2 != 0, F.col("title")), F.when(F.col("id") % 3 != 0, F.col("artist")), F.lit("stem")).alias("name"))


@query("artist_lists", sql("playlist_tracks tracks", "SELECT playlist_id, string_agg(artist, ', ' ORDER BY position) AS artists FROM playlist_tracks JOIN tracks ON id = track_id GROUP BY 1"))
def artists(t):  # AX14, AR10
    j = t.playlist_tracks.join(t.tracks, F.col("track_id") == F.col("id"))
    lists = j.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", "artist"))).alias("x"))
    return lists.select("playlist_id", F.array_join(F.transform("x", lambda s: s["artist"]), ", ").alias("artists"))


@query("key_estimates")
def keys(t):  # SG2
    chroma = F.transform(F.slice("vec", 1, 12), lambda x: x + 1)
    return t.vectors.select("track_id", au.key(chroma).alias("k"), au.key_confidence(chroma).alias("confidence")).select("track_id", "k.tonic", "k.mode", "confidence")


def _sections(t):
    spans = [(0, 30, 0), (30, 35, 1), (35, 90, 0), (90, 120, 2), (120, 150, 1)]
    # the length of the second section, and with it what merges, changes from track to track
    cut = (F.col("track_id") % 20).cast("double")
    at = lambda x: F.lit(30.0) + cut if x == 35 else F.lit(float(x))
    secs = F.array(*[F.struct(at(a).alias("start"), at(b).alias("stop"), F.lit(c).alias("label"), F.abs(F.get("vec", F.lit(i))).alias("energy")) for i, (a, b, c) in enumerate(spans)])
    return t.vectors.select("track_id", secs.alias("s"))


@query("merged_sections", sql("vectors", "SELECT track_id, CASE WHEN c < 8 THEN 4 ELSE 5 END AS n, round(CASE WHEN c < 8 THEN (abs(vec[1]) * 30 + abs(vec[2]) * c) / (30 + c) ELSE abs(vec[1]) END, 6) AS first_energy FROM (SELECT *, (track_id % 20)::DOUBLE AS c FROM vectors)"))
def sections(t):  # AR12
    return _sections(t).select("track_id", au.merge_short(F.col("s")).alias("s")).select("track_id", F.size("s").alias("n"), F.round(F.get("s", F.lit(0))["energy"], 6).alias("first_energy"))


@query("dossier", sql("features", "SELECT " + ", ".join(f"round(100.0 * (SELECT count(*) FROM f x WHERE x.{n} < f.{n}) / (SELECT count(*) FROM f), 6)::DOUBLE AS {n}" for n in UNIT) + " FROM f WHERE track_id = 42", "f AS (SELECT * FROM features WHERE error IS NULL)"))
def dossier(t):  # RP2: one pass, each feature's count of smaller values beside the row looked at
    ok = t.features.where("error IS NULL")
    one = F.broadcast(ok.where("track_id = 42").select(*[F.col(n).alias(f"q_{n}") for n in UNIT]))
    return ok.crossJoin(one).agg(*[F.round(100.0 * F.count_if(F.col(n) < F.col(f"q_{n}")) / F.count("*"), 6).alias(n) for n in UNIT])


@query("recap_sentence", sql("tracks plays", "SELECT 'You played ' || count(*) || ' times, ' || count(DISTINCT track_id) || ' tracks by ' || count(DISTINCT artist) || ' artists.' AS text FROM plays JOIN tracks ON id = track_id WHERE year(played_at) = 1998"))
def sentence(t):  # SF19, RP4
    r = m.recap(t.plays, t.tracks, 1998)
    return r.select(F.concat(F.lit("You played "), "plays", F.lit(" times, "), "tracks", F.lit(" tracks by "), "artists", F.lit(" artists.")).alias("text"))


@query("findings", sql("features", "SELECT 'energy' AS about, CASE WHEN avg(energy) >= .5 THEN 'mostly energetic' ELSE 'mostly calm' END AS finding FROM features WHERE error IS NULL"))
def findings(t):  # RP3
    return st.feature_stats(t.features, ["energy"]).select(F.col("feature").alias("about"), F.when(F.col("mean") >= 0.5, "mostly energetic").otherwise("mostly calm").alias("finding"))


@query("store_copy", sql("tracks", "SELECT id, id * 10 AS library_id FROM tracks WHERE id % 2 = 0"))
def copy(t):  # SRC21: files named by a number join the rows of that number
    files = t.tracks.where("id % 2 = 0").select(F.concat(F.lit("/previews/"), "id", F.lit(".mp3")).alias("path"), (F.col("id") * 10).alias("library_id"))
    stem = F.regexp_extract("path", "/([0-9]+)\\.[a-z0-9]+$", 1).try_cast("bigint")
    return files.select(stem.alias("id"), "library_id").join(t.tracks.select("id"), "id")


@query("landed_playlists", sql("playlist_tracks", "SELECT playlist_id, position, track_id FROM playlist_tracks"))
def landed(t):  # SRC17: nested items of landed JSON, exploded with their places
    j = t.playlist_tracks.groupBy("playlist_id").agg(F.array_sort(F.collect_list(F.struct("position", "track_id"))).alias("items"))
    doc = j.select(F.to_json(F.struct("playlist_id", F.transform("items", lambda x: F.struct(x["track_id"].alias("id"))).alias("items"))).alias("j"))
    rows = doc.select(F.from_json("j", "playlist_id bigint, items array<struct<id:bigint>>").alias("p")).select("p.playlist_id", F.posexplode("p.items").alias("i", "x"))
    return rows.select("playlist_id", (F.col("i") + 1).alias("position"), F.col("x.id").alias("track_id"))


@query("sessions_batch", sql("plays_ev", "SELECT user_id, count(*) AS sessions FROM (SELECT user_id, played_at, lag(played_at) OVER (PARTITION BY user_id ORDER BY played_at) AS b FROM plays_ev) WHERE b IS NULL OR played_at - b > INTERVAL 30 MINUTE GROUP BY 1"))
def sessions(t):  # SM2
    s = t.plays_ev.withColumn("played_at", F.col("played_at").cast("timestamp")).groupBy("user_id", F.session_window("played_at", "30 minutes")).agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"))


@query("streamed_counts", sql("plays_ev", "SELECT track_id, count(*) AS plays FROM plays_ev GROUP BY 1"))
def streamed(t):  # SM4, SM5: the log as a stream, all that is there, into a table
    base = rs.kept(t.plays_ev.select("track_id", "source"))  # also sets the shared folder
    root = f"{t.spark.conf.get('spark.checkpoint.dir')}/stream-{uuid.uuid4().hex}"
    base.repartition(3).write.parquet(f"{root}/in")
    counts = sp.running_counts(sp.read(t.spark, f"{root}/in", "track_id long, source string"))
    sp.available(counts, f"{root}/ck", lambda df, _: df.write.mode("overwrite").parquet(f"{root}/out"), "complete")
    return t.spark.read.parquet(f"{root}/out")


# ranks of sections by label count, energy and length, the excerpt in the middle of each, then the greedy choice for two excerpts spelt out
@query("excerpt_windows")
def excerpts(t):  # AR11
    x = _sections(t).select("track_id", au.excerpts(F.col("s"), F.lit(150.0), F.lit(2), F.lit(20.0)).alias("e"))
    return x.select("track_id", F.inline("e"))


_SC = ["onset_mean", "rolloff", "zcr", "flatness", "harmonic_ratio", "beat_regularity"]
_SCV = ["energy * 3", "brightness * 8000", "speechiness * .2", "liveness * .1", "acousticness", "danceability"]
_C = lambda x: f"greatest(least({x}, 1), 0)"


@query("heuristic_scores", sql("features", f"SELECT track_id, round({_C(f'.45 * {_C("onset_mean / 3")} + .30 * exp(0 - (bpm - 120) ^ 2 / 2450) + .15 * energy + .10 * beat_regularity')}, 6) AS danceability, round({_C(f'.35 * energy + .25 * brightness + .20 * {_C("bpm / 160")} + CASE WHEN mode = $$major$$ THEN .20 ELSE 0 END')}, 6) AS valence, round({_C(f'1 - .6 * {_C("rolloff / 6000")} - .4 * {_C("zcr / .15")}')}, 6) AS acousticness, round({_C(f'.6 * harmonic_ratio + .4 * (1 - {_C("flatness / .1")})')}, 6) AS instrumentalness, round({_C(f'.5 * {_C("zcr / .12")} + .3 * {_C("flatness / .05")} + .2 * (1 - beat_regularity)')}, 6) AS speechiness, round({_C(f'.5 * {_C("flatness / .06")} + .5 * {_C("dynamic_range / 25")}')}, 6) AS liveness FROM x",
 "x AS (SELECT track_id, bpm, energy, brightness, mode, dynamic_range, " + ", ".join(f"{v} AS {n}" for n, v in zip(_SC, _SCV)) + " FROM features)"))
def heuristics(t):  # MT15
    rows = t.features.select("track_id", "bpm", "energy", "brightness", "mode", "dynamic_range", *[F.expr(v).alias(n) for n, v in zip(_SC, _SCV)])
    return au.heuristics(rows).select("track_id", *map(R, ["danceability", "valence", "acousticness", "instrumentalness", "speechiness", "liveness"]))


@query("liked_items", sql("videos", "SELECT id FROM mv WHERE seconds BETWEEN 75 AND 900 AND length(regexp_replace(title, '[^\\p{L}\\p{N}]', '', 'g')) >= 2 AND (category = 10 OR music)", _MUSIC))
def liked(t):  # ETL10
    return etl.liked(t.videos).select("id")


_KIND = "CASE WHEN event_id % 11 = 0 THEN 'nonmusic' WHEN event_id % 5 = 0 THEN 'nonmusic' WHEN event_id % 3 = 0 THEN 'music_video' WHEN event_id % 7 = 0 THEN 'song' WHEN event_id % 2 = 0 AND (user_id * 20 > 1200 OR user_id % 4 = 0) THEN 'nonmusic' ELSE 'song' END"


@query("session_kinds", f"SELECT event_id, {_KIND} AS kind FROM events")
def kinds(t):  # ETL9
    e = F.col("event_id")
    kind = F.when(e % 5 == 0, "music_video_type_podcast_episode").when(e % 3 == 0, "MUSIC_VIDEO_TYPE_OMV").when(e % 7 == 0, "MUSIC_VIDEO_TYPE_UGC")
    rows = t.raw("events").select("event_id", F.when(e % 11 == 0, "ep").alias("episode"), kind.alias("video_type"), (F.col("user_id") * 20).alias("seconds"), F.when(e % 2 != 0, "someone").alias("artist"), F.when(F.col("user_id") % 4 != 0, "album").alias("album"))
    return rows.select("event_id", etl.session_kind(rows).alias("kind"))


def _streamed(t, name, rows, schema, step, mode="append"):
    """A table as a stream of several files, all that is there, through a step, into a table."""
    root = f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"
    rows.repartition(3).write.parquet(f"{root}/in")
    out = step(sp.read(t.spark, f"{root}/in", schema, files=1000))
    sp.available(out, f"{root}/ck", lambda df, _: df.write.mode("append" if mode == "append" else "overwrite").parquet(f"{root}/out"), mode)
    return t.spark.read.parquet(f"{root}/out")


@query("streamed_once", sql("plays_ev", "SELECT DISTINCT track_id, date_trunc('second', played_at) AS played_at, source FROM plays_ev"))
def once(t):  # SM1: every event comes twice
    p = t.plays_ev.select("track_id", F.date_trunc("second", "played_at").cast("timestamp").alias("played_at"), "source")
    out = _streamed(t, "once", p.unionByName(p), "track_id long, played_at timestamp, source string", lambda s: sp.once(s, "100000 days"))
    return out.select("track_id", F.col("played_at").cast("timestamp_ntz").alias("played_at"), "source")


@query("streamed_days", sql("plays_ev", "SELECT date_trunc('day', played_at)::DATE AS day, count(*) AS plays FROM plays_ev GROUP BY 1"))
def days(t):  # SM3
    p = t.plays_ev.select("track_id", F.col("played_at").cast("timestamp").alias("played_at"))
    out = _streamed(t, "days", p, "track_id long, played_at timestamp", sp.daily, "complete")
    return out.select(F.col("w.start").cast("date").alias("day"), "plays")


@query("streamed_successors", sql("plays_ev", "SELECT user_id, event_id, a, track_id AS b FROM (SELECT *, lag(track_id) OVER w AS a, lag(played_at) OVER w AS before FROM plays_ev WINDOW w AS (PARTITION BY user_id ORDER BY played_at, event_id)) WHERE floor(epoch(played_at)) - floor(epoch(before)) <= 1800 AND a <> track_id"))
def streamed_successors(t):  # SM2, SM5: every event comes twice, and one of nobody long after lets all others pass
    p = t.plays_ev.select("event_id", "user_id", "track_id", F.col("played_at").cast("timestamp").alias("played_at"))
    last = p.agg(F.max("played_at").alias("last")).select(F.lit(-1).cast("long"), F.lit(-1).cast("long"), F.lit(None).cast("long"), F.col("last") + F.expr("INTERVAL 400 DAYS"))
    return _streamed(t, "successors", p.unionByName(p).union(last), "event_id long, user_id long, track_id long, played_at timestamp", lambda s: su.successors(s, late="60 days"))


_CL = "asked AS (SELECT event_id, user_id AS key, played_at AS asked_at FROM plays_ev WHERE source <> 'purchase'), found AS (SELECT user_id AS key, played_at AS fetched_at, max(track_id) AS value FROM plays_ev WHERE source = 'purchase' GROUP BY ALL)"


@query("cached_lookups", sql("plays_ev", "SELECT event_id, CASE WHEN fetched_at IS NULL THEN 'missing' WHEN floor(epoch(asked_at)) - floor(epoch(fetched_at)) > 86400 THEN 'expired' ELSE 'fresh' END AS state, CASE WHEN floor(epoch(asked_at)) - floor(epoch(fetched_at)) <= 86400 THEN value END AS value FROM asked ASOF LEFT JOIN found ON asked.key = found.key AND asked_at >= fetched_at", _CL))
def cached(t):  # EN4: a listener's events look up their last purchase, if it's of the last day
    asked = t.plays_ev.where("source <> 'purchase'").select("event_id", F.col("user_id").alias("key"), F.col("played_at").alias("asked_at"))
    found = t.plays_ev.where("source = 'purchase'").select(F.col("user_id").alias("key"), F.col("played_at").alias("fetched_at"), F.col("track_id").alias("value"))
    return ao.cached_lookups(asked, found, 86_400).select("event_id", "state", "value")


@query("replayed_plays", sql("plays", "SELECT DISTINCT track_id * 10 AS track_id, played_at, source AS context FROM plays WHERE track_id % 2 = 0 AND track_id % 4 <> 0"))
def replayed(t):  # SRC21: plays of copied tracks, of which every second one is known
    copied = t.tracks.where("id % 2 = 0").select("id", (F.col("id") * 10).alias("library_id"))
    known = t.plays.where("track_id % 4 = 0").select((F.col("track_id") * 10).alias("track_id"), "played_at", F.col("source").alias("context"))
    return ao.replayed(t.plays, copied, known)
