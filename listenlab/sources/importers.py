"""Readers of history exports: JSON in several shapes, HTML, and CSV told by its header."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlab.functions import text as tx
from listenlab.operators import etl

#: Shorter streams don't count as plays; most plays that one day's row may stand for.
LEAST_MS, MOST_A_DAY = 30_000, 500
HISTORY = "ts string, endTime string, master_metadata_track_name string, trackName string, master_metadata_album_artist_name string, artistName string, master_metadata_album_album_name string, ms_played bigint, msPlayed bigint"
WATCHED = "title string, time string, header string, titleUrl string, subtitles array<struct<name:string>>"


def _blank(c: str):
    return F.nullif(F.trim(c), F.lit(""))


def streaming_history(rows: DataFrame, least_ms: int = LEAST_MS) -> DataFrame:
    """SRC3: (title, artist, album, played_at, played_ms) of either JSON shape; short streams and rows without names go."""
    out = rows.select(
        F.coalesce(_blank("master_metadata_track_name"), _blank("trackName")).alias("title"), F.coalesce(_blank("master_metadata_album_artist_name"), _blank("artistName")).alias("artist"),
        _blank("master_metadata_album_album_name").alias("album"), F.try_to_timestamp(tx.minute_stamp(F.coalesce("ts", "endTime"))).alias("played_at"), F.coalesce("ms_played", "msPlayed").alias("played_ms"),
    )
    return out.where("title IS NOT NULL AND artist IS NOT NULL AND (played_ms IS NULL OR played_ms >= " + str(least_ms) + ")")


def read_streaming_history(spark: SparkSession, path: str) -> DataFrame:
    return streaming_history(spark.read.schema(HISTORY).json(path, multiLine=True))


def watch_history(rows: DataFrame) -> DataFrame:
    """SRC4: (video, title, channel, played_at, header) of watch-history JSON rows."""
    return rows.select(
        tx.video_id(F.col("titleUrl")).alias("video"), F.regexp_replace("title", "^Watched ", "").alias("title"), F.get("subtitles", F.lit(0))["name"].alias("channel"), F.try_to_timestamp("time").alias("played_at"), "header"
    ).where("video IS NOT NULL")


def watch_html(pages: DataFrame) -> DataFrame:
    """SRC5: the same from HTML (value): cells with a video link, a channel link and a date at the end."""
    cell = F.explode(F.regexp_extract_all("value", F.lit('(?s)<div class="content-cell[^>]*>(.*?)</div>'), 1))
    c = pages.select(cell.alias("c"))
    links = F.regexp_extract_all("c", F.lit('<a href="([^"]*)"'), 1)
    names = F.regexp_extract_all("c", F.lit("<a [^>]*>([^<]*)</a>"), 1)
    return c.select(
        tx.video_id(F.replace(F.get(links, 0), F.lit("&amp;"), F.lit("&"))).alias("video"), tx.unescape(F.get(names, 0)).alias("title"), tx.unescape(F.get(names, 1)).alias("channel"), tx.human_time(F.regexp_extract("c", "(?:<br>)([^<>]+)$", 1)).alias("played_at")
    ).where("video IS NOT NULL")


def is_html(value):
    """SRC6: whether a whole file is HTML rather than JSON."""
    return F.regexp_like(value, F.lit(r"^[\s\x{FEFF}]*<"))


def per_video(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """SRC15: one row for each video with its watches, joined to the landed category dimension (video, category, seconds)."""
    per = rows.groupBy("video").agg(F.min_by("title", "played_at").alias("title"), F.min_by("channel", "played_at").alias("channel"), F.count("*").alias("watches"), F.min("played_at").alias("first"))
    return per.join(categories, "video", "left")


def authoritative(rows: DataFrame, categories: DataFrame, short_s: int = 45, propagation: bool = True) -> DataFrame:
    """SRC7: every watched video (watch_history) with what becomes of it, nothing written: music by words or category, music by its channel, short, or non-music."""
    v = per_video(rows, categories)
    v = v.withColumn("hint", etl.music_hint(F.col("title"), F.col("channel"))).withColumn("music", F.col("hint") | F.coalesce(F.col("category") == 10, F.lit(False)))
    v = etl.propagate(v) if propagation else v.withColumn("reason", F.when(F.col("music"), "direct"))
    short = etl.short_clip(F.col("title"), F.lit(None).cast("string"), F.col("seconds"), F.col("hint"), short_s)
    return v.select("video", "title", "channel", "watches", "first", F.when(short & ~F.col("hint"), "short").otherwise(F.coalesce("reason", F.lit("non-music"))).alias("verdict"))


def csv_kind(columns: list[str]) -> str:
    """SRC8: which importer a header asks for."""
    have = {c.strip().lstrip("﻿").lower() for c in columns}
    if {"track description", "play count", "date played"} <= have:
        return "daily"
    return "activity" if {"song name", "album name"} <= have else "generic"


def daily_plays(rows: DataFrame, most: int = MOST_A_DAY) -> DataFrame:
    """SRC10: (title, artist, played_at): each day's count as that many plays from noon on, a second apart."""
    n = F.least(F.greatest(F.coalesce(F.col("Play Count").try_cast("int"), F.lit(1)), F.lit(1)), F.lit(most))
    day = F.try_to_timestamp(F.col("Date Played").cast("string"), F.lit("yyyyMMdd"))
    at = F.instr("Track Description", " - ")
    rows = rows.select(
        F.when(at > 0, F.trim(F.substring("Track Description", at + 3, F.length("Track Description")))).otherwise(F.trim("Track Description")).alias("title"), F.when(at > 0, F.trim(F.substring_index("Track Description", " - ", 1))).alias("artist"), day.alias("day"), F.explode(F.sequence(F.lit(0), n - 1)).alias("i")
    )
    return rows.where("day IS NOT NULL").select("title", "artist", (F.col("day") + F.make_dt_interval(F.lit(0), F.lit(12), F.lit(0), F.col("i").cast("decimal(18,6)"))).alias("played_at"))


def generic_plays(rows: DataFrame) -> DataFrame:
    """SRC11: the first column that isn't blank of several possible names."""
    low = {c.strip().lower(): c for c in rows.columns}
    pick = lambda *names: F.coalesce(*[_blank(f"`{low[n]}`") for n in names if n in low], F.lit(None).cast("string"))
    out = rows.select(pick("song name", "track name", "title", "name").alias("title"), pick("artist name", "artist", "container artist name").alias("artist"), F.try_to_timestamp(pick("event start timestamp", "last played date", "date", "played at")).alias("played_at"))
    return out.where("title IS NOT NULL")


def activity_albums(rows: DataFrame) -> DataFrame:
    """(title, album) of activity rows."""
    return rows.select(F.col("Song Name").alias("title"), F.col("Album Name").alias("album"))


def album_backfill(tracks: DataFrame, activity: DataFrame) -> DataFrame:
    """SRC12: albums of titles that have exactly one album in the activity rows (title, album)."""
    one = activity.where("album IS NOT NULL").groupBy(tx.fold(F.col("title")).alias("_t")).agg(F.min("album").alias("_a"), F.max("album").alias("_b")).where("_a = _b")
    return tracks.join(one.select("_t", "_a"), tx.fold(F.col("title")) == F.col("_t"), "left").withColumn("album", F.coalesce("album", "_a")).drop("_t", "_a")


def digest(files: DataFrame) -> DataFrame:
    """SRC18, SRC20: (path, digest) of ``spark.read.format("binaryFile")`` rows, one for each content."""
    return files.select("path", F.sha1("content").alias("digest")).groupBy("digest").agg(F.min("path").alias("path"))
