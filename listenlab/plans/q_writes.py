"""Queries over write semantics, imports and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.operators import macro as m
from listenlab.operators import writes as w
from listenlab.sources import importers as im
from listenlab.sources import sinks

from .bind import sql
from .registry import query


@query("upsert_fill_missing", sql("tracks", "SELECT coalesce(o.title, n.title) AS title, coalesce(o.artist, n.artist) AS artist, coalesce(o.genre, n.genre) AS genre, coalesce(o.duration_ms, n.duration_ms) AS duration_ms FROM o FULL JOIN n ON o.title = n.title AND o.artist = n.artist",
 "o AS (SELECT title, artist, max(genre) FILTER (id % 4 <> 0) AS genre, max(duration_ms) AS duration_ms FROM tracks WHERE id % 3 <> 0 GROUP BY 1, 2), n AS (SELECT trim(title) AS title, trim(artist) AS artist, max(genre) AS genre, max(duration_ms) AS duration_ms FROM tracks WHERE id % 2 = 0 AND length(trim(title)) > 0 AND length(trim(artist)) > 0 GROUP BY 1, 2)"))
def upsert(t):
    old = t.tracks.where("id % 3 <> 0").groupBy("title", "artist").agg(F.max(F.when(F.col("id") % 4 != 0, F.col("genre"))).alias("genre"), F.max("duration_ms").alias("duration_ms"))
    new = t.tracks.where("id % 2 = 0").select(F.concat(F.lit(" "), "title").alias("title"), "artist", "genre", "duration_ms")
    return w.upsert_fill(old, new, ["title", "artist"], ["genre", "duration_ms"])


@query("append_idempotent", sql("plays", "SELECT source, count(*) AS n FROM plays GROUP BY 1"))
def append(t):
    p = t.plays
    half = p.where(F.pmod("track_id", F.lit(2)) == 0)
    return w.append_once(half, p.unionByName(half), ["track_id", "played_at", "source"]).groupBy("source").agg(F.count("*").alias("n"))


@query("replace_latest", "SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def replace(t):
    return w.latest(t.raw("events"), ["user_id"], F.struct("ts", "event_id")).select("user_id", "event_id", "event_type", "value")


@query("vector_overwrite", sql("vectors", "SELECT track_id, round(vec[1], 6) AS x FROM vectors WHERE track_id % 5 <> 0 UNION ALL SELECT track_id, round(-vec[1], 6) FROM vectors WHERE track_id % 5 = 0"))
def overwrite(t):
    v = t.vectors.select("track_id", "vec")
    new = v.where("track_id % 5 = 0").withColumn("vec", F.transform("vec", lambda x: -x))
    return w.replaced(v, new, ["track_id"]).select("track_id", F.round(F.get("vec", F.lit(0)), 6).alias("x"))


@query("delete_playlist", sql("playlists", "SELECT id, name FROM playlists WHERE id NOT IN (1, 2, 3)"))
def delete(t):
    gone = t.spark.createDataFrame([(1,), (2,), (3,)], "id long")
    return w.without(t.playlists, F.broadcast(gone), ["id"]).select("id", "name")


@query("explode_daily_counts", "SELECT p_brand AS artist, p_name AS title, date_trunc('day', TIMESTAMP '2020-01-01') + INTERVAL 12 HOUR + to_seconds(i) AS played_at FROM part, range(500) r(i) WHERE i < least(greatest(p_size, 1), 500)")
def explode(t):
    rows = t.tracks.select(F.concat("artist", F.lit(" - "), "title").alias("Track Description"), F.col("popularity").cast("string").alias("Play Count"), F.lit("20200101").alias("Date Played"))
    return im.daily_plays(rows).select("artist", "title", F.col("played_at").cast("timestamp_ntz").alias("played_at"))


@query("album_backfill", sql("tracks", "SELECT id, CASE WHEN id % 2 = 0 THEN genre ELSE a END AS album FROM tracks LEFT JOIN g ON g.t = lower(title)", "g AS (SELECT lower(title) AS t, min(genre) AS a FROM tracks WHERE id % 40 = 1 GROUP BY 1 HAVING min(genre) = max(genre))"))
def backfill(t):
    some = t.tracks.select("id", "title", F.when(F.col("id") % 2 == 0, F.col("genre")).alias("album"))
    return im.album_backfill(some, t.tracks.where("id % 40 = 1").select("title", F.col("genre").alias("album"))).select("id", "album")


@query("streaming_history", sql("plays_ev", "SELECT 'song ' || track_id AS title, 'user ' || user_id AS artist, played_ms FROM plays_ev WHERE played_ms >= 30000"))
def history(t):
    rows = t.plays_ev.select(F.to_json(F.struct(F.date_format("played_at", "yyyy-MM-dd HH:mm").alias("endTime"), F.concat(F.lit("song "), "track_id").alias("trackName"), F.concat(F.lit("user "), "user_id").alias("artistName"), F.col("played_ms").alias("msPlayed"))).alias("j"))
    return im.streaming_history(rows.select(F.from_json("j", im.HISTORY).alias("r")).select("r.*")).select("title", "artist", "played_ms")


@query("watch_html")
def watch_html(t):
    rows = t.titles_raw.select(F.concat(F.lit('<div class="content-cell x"><a href="https://x.example/watch?v=vid'), F.lpad(F.col("page_id").cast("string"), 6, "0"), F.lit('">'), "title", F.lit('</a><br><a href="https://x.example/c">'), "artist", F.lit("</a><br>Jan 5, 2024, 3:04:05 PM CET</div>")).alias("value"))
    return im.watch_html(rows)


@query("merge_plays", sql("plays", "SELECT count(*) AS n, count(DISTINCT track_id) AS tracks FROM (SELECT DISTINCT CASE WHEN track_id % 10 = 1 THEN track_id - 1 ELSE track_id END AS track_id, played_at, source FROM plays)"))
def merge(t):
    ids = t.tracks.where("id % 10 = 1").select(F.col("id").alias("dup"), (F.col("id") - 1).alias("canonical"))
    return w.repoint(t.plays, ids, "track_id", ["track_id", "played_at", "source"]).agg(F.count("*").alias("n"), F.countDistinct("track_id").alias("tracks"))


@query("playlist_file", sql("tracks plays", "SELECT i AS line, value FROM (SELECT 0 AS i, '#EXTM3U' AS value UNION ALL SELECT 2 * pos - 1, '#EXTINF:' || coalesce(duration_ms // 1000, 0) || ',' || artist || ' - ' || title FROM x UNION ALL SELECT 2 * pos, '/music/' || id || '.mp3' FROM x)",
 "x AS (SELECT row_number() OVER (ORDER BY n DESC, id) AS pos, id, title, artist, duration_ms FROM (SELECT track_id, count(*) AS n FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) JOIN tracks ON id = track_id)"))
def m3u(t):
    from pyspark.sql import Window

    top = m.counts(t.plays).orderBy(F.col("plays").desc(), "track_id").limit(20).join(t.tracks, F.col("track_id") == F.col("id"))
    items = top.select(F.row_number().over(Window.orderBy(F.col("plays").desc(), "id")).alias("position"), F.floor(F.coalesce("duration_ms", F.lit(0)) / 1000).alias("seconds"), "artist", "title", F.concat(F.lit("/music/"), "id", F.lit(".mp3")).alias("path"))
    return sinks.m3u(items).select(F.greatest(2 * F.col("position") - 1 + F.col("i"), F.lit(0)).cast("long").alias("line"), "value")


@query("content_digests", "SELECT sha1(html) AS digest, min(page_id) AS page_id FROM pages GROUP BY 1")
def digests(t):
    return im.digest(t.raw("pages").select(F.lpad(F.col("page_id").cast("string"), 12, "0").alias("path"), F.encode("html", "UTF-8").alias("content"))).select("digest", F.col("path").cast("long").alias("page_id"))
