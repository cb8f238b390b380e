"""Readers of vendors' JSON that has been landed in files, and of files by their kind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlab.operators.etl import metadata_music, session_kind

from .importers import activity_albums, csv_kind, daily_plays, generic_plays

_TRACK = "struct<id:string,name:string,duration_ms:bigint,popularity:int,artists:array<struct<name:string>>,album:struct<name:string,release_date:string>>"
#: Shapes of landed pages: recently played and saved items, ranked items, session items, liked videos.
RECENT = f"items array<struct<played_at:string,track:{_TRACK}>>"
TOP = f"items array<{_TRACK}>"
SESSION = "title string, artists array<struct<name:string>>, author string, album struct<name:string>, duration_seconds bigint, videoType string, episodeId string, played string"

#: What is an audio file.
AUDIO = ["mp3", "flac", "wav", "m4a", "aac", "ogg", "opus", "wma", "aif", "aiff", "alac", "ape", "wv", "mp4"]


def artist_names(artists: Column, other: Column | None = None) -> Column:
    """AX14: names of an array of artists, joined; without any the other name, or Unknown."""
    names = F.filter(F.transform(artists, lambda a: a["name"]), lambda n: n.isNotNull() & (n != ""))
    joined = F.when(F.size(names) > 0, F.array_join(names, ", "))
    return F.coalesce(joined, F.lit("Unknown") if other is None else F.coalesce(other, F.lit("Unknown")))


def milliseconds(seconds: Column) -> Column:
    """AX14: null for an unknown or zero length."""
    return F.nullif(seconds, F.lit(0)) * 1000


def recently_played(pages: DataFrame) -> DataFrame:
    """SRC13: (id, title, artist, album, duration_ms, played_at) of pages of recently played or saved items; items without a name are left out."""
    t = pages.select(F.inline("items")).select("track.*", F.try_to_timestamp("played_at").alias("played_at"))
    return t.select("id", F.col("name").alias("title"), artist_names(F.col("artists")).alias("artist"), F.col("album.name").alias("album"), "duration_ms", "played_at").where("title IS NOT NULL")


def top_tracks(pages: DataFrame) -> DataFrame:
    """SRC13, SNK9: (time_range, rank, id, title, artist) of pages (time_range, items) of ranked items, ranks from 1 on."""
    t = pages.select("time_range", F.posexplode("items").alias("i", "t"))
    return t.select("time_range", (F.col("i") + 1).alias("rank"), "t.id", F.col("t.name").alias("title"), artist_names(F.col("t.artists")).alias("artist"))


def liked_videos(pages: DataFrame) -> DataFrame:
    """SRC14: music of landed liked videos or playlist items (video, title, channel, category): category 10, or words of title or channel."""
    return pages.where((F.col("category") == 10) | metadata_music(F.col("title"), F.col("channel"))).dropDuplicates(["video"])


def session_history(items: DataFrame, now: str, every: bool = False) -> DataFrame:
    """SRC16: plays of session items (SESSION, and place, their order in the listing) with labels instead of times.

    "Yesterday" is a day ago, all else today; and items of a day lie a second apart, as they stand. What isn't music is
    left out unless ``every``.
    """
    rows = items.where("title IS NOT NULL AND title <> ''").withColumns({"episode": F.col("episodeId"), "video_type": F.col("videoType"), "seconds": F.col("duration_seconds")})
    named = F.filter("artists", lambda a: F.coalesce(a["name"], F.lit("")) != "")
    kind = session_kind(rows.select("*", F.when(F.size(named) > 0, "x").alias("artist")))
    days = F.when(F.col("played") == "Yesterday", 1).otherwise(0)
    at = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(days, F.lit(0), F.lit(0), F.col("place").cast("decimal(18,6)"))
    out = rows.withColumn("artist", F.when(F.size(named) > 0, "x")).withColumn("kind", kind)
    out = out.select("title", artist_names(F.col("artists"), F.col("author")).alias("artist"), F.col("album.name").alias("album"), milliseconds(F.col("duration_seconds")).alias("duration_ms"), at.alias("played_at"), "kind")
    return out if every else out.where("kind <> 'nonmusic'")


def audio_files(paths: DataFrame) -> DataFrame:
    """SRC18: paths of audio files by their endings, each once."""
    return paths.where(F.lower(F.regexp_extract("path", "[.]([^./]+)$", 1)).isin(AUDIO)).select("path").distinct()


def read_audio(spark: SparkSession, folder: str) -> DataFrame:
    """SRC18: (path, length, modificationTime, content) of the audio files below a folder."""
    both = ",".join(f"{e},{e.upper()}" for e in AUDIO)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{both}}}").load(folder)


def read_csv_folder(spark: SparkSession, folder: str) -> tuple[DataFrame | None, DataFrame | None]:
    """SRC8, SRC9: (plays, albums) of all CSV files below a folder, each read by its own header; None if there are none of a kind."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(folder).select("value", "_metadata.file_path", "_metadata.file_block_start")
    first = lines.where("file_block_start = 0").withColumn("i", F.monotonically_increasing_id()).groupBy("file_path").agg(F.min_by("value", "i").alias("header"))
    groups: dict[str, list[str]] = {}
    for r in first.collect():  # one row for each file
        groups.setdefault(r["header"], []).append(r["file_path"])
    plays = albums = None
    for paths in groups.values():
        rows = spark.read.csv(paths, header=True)
        rows = rows.toDF(*[c.strip().lstrip("﻿") for c in rows.columns])
        kind = csv_kind(rows.columns)
        if kind == "activity":
            part = activity_albums(rows)
            albums = part if albums is None else albums.unionByName(part)
        else:
            part = daily_plays(rows) if kind == "daily" else generic_plays(rows)
            plays = part if plays is None else plays.unionByName(part)
    return plays, albums


