"""Recommendations from related artists, and catalogue matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def related(items: DataFrame, tracks: DataFrame, k: int = 4) -> DataFrame:
    """(a, b, depth): for each artist those that share most playlists with it, from 0 on."""
    pa = items.join(tracks.select(F.col("id").alias("track_id"), "artist"), "track_id").select("playlist_id", "artist").distinct()
    both = pa.select("playlist_id", F.col("artist").alias("a")).join(pa.select("playlist_id", F.col("artist").alias("b")), "playlist_id").where("a <> b")
    w = Window.partitionBy("a").orderBy(F.col("n").desc(), "b")
    return both.groupBy("a", "b").agg(F.count("*").alias("n")).withColumn("depth", F.row_number().over(w) - 1).where(F.col("depth") < k).select("a", "b", "depth")


def candidates(seeds: DataFrame, edges: DataFrame, tracks: DataFrame, known: DataFrame, tops: int = 4) -> DataFrame:
    """RC1, RC2, JN21: top tracks of artists related to the seeds, known pairs left out; the first of equal names wins."""
    order = seeds.select(F.col("artist").alias("a"), F.row_number().over(Window.orderBy(F.col("plays").desc(), "artist")).alias("seed"))  # a handful of rows
    best = Window.partitionBy("artist").orderBy(F.col("popularity").desc(), "id")
    top = tracks.withColumn("r", F.row_number().over(best) - 1).where(F.col("r") < tops).select("id", "title", F.col("artist").alias("b"), "r")
    top = top.join(known.select("id"), "id", "left_anti")
    j = F.broadcast(order).join(edges, "a").join(top, "b")
    w = Window.partitionBy(F.lower("title"), F.lower("b")).orderBy("seed", "depth", "r", "id")
    affinity = 1 / (1 + F.col("depth")) * 1 / (1 + 0.3 * F.col("r"))
    return j.withColumn("k", F.row_number().over(w)).where("k = 1").select("id", "title", F.col("b").alias("artist"), affinity.alias("affinity"))


def ranked(cands: DataFrame, features: DataFrame, taste: DataFrame, names: list[str], first: int = 20, k: int = 30) -> DataFrame:
    """RC3, MT8, MT9: half affinity, half likeness to a taste vector, 0.4 if it isn't known; of the candidates of most affinity."""
    top = cands.orderBy(F.col("affinity").desc(), "id").limit(first)
    j = top.join(features.where("error IS NULL").select(F.col("track_id").alias("id"), *names), "id", "left").crossJoin(F.broadcast(taste))
    d = F.sqrt(sum((F.pow(F.col(n) - F.col(f"t_{n}"), F.lit(2)) for n in names), F.lit(0.0)))
    score = 0.5 * F.col("affinity") + 0.5 * F.coalesce(1 / (1 + d), F.lit(0.4))
    return j.withColumn("score", score).orderBy(F.col("score").desc(), "id").limit(k)


def seeds(played: DataFrame, ranked_items: DataFrame, k: int = 6) -> DataFrame:
    """RC1: (artist, seed): the most played artists (artist, plays), or, if nothing was played, ranked items (name, rank)."""
    some = played.orderBy(F.col("plays").desc(), "artist").limit(k)
    first = some.agg(F.sort_array(F.collect_list(F.struct((-F.col("plays")).alias("n"), "artist"))).alias("x"))  # at most k rows
    items = ranked_items.orderBy("rank").limit(k).agg(F.sort_array(F.collect_list(F.struct(F.col("rank").cast("long").alias("n"), F.col("name").alias("artist")))).alias("y"))
    both = first.crossJoin(items).select(F.posexplode(F.when(F.size("x") > 0, F.col("x")).otherwise(F.col("y"))).alias("i", "s"))
    return both.select(F.col("s.artist").alias("artist"), (F.col("i") + 1).cast("long").alias("seed"))


def save_snapshot(rows: DataFrame, path: str, k: int = 30) -> None:
    """SNK15: the best recommendations take the place of the last snapshot."""
    rows.orderBy(F.col("score").desc(), "id").limit(k).coalesce(1).write.mode("overwrite").parquet(path)


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """RC4."""
    return spark.read.parquet(path).orderBy(F.col("score").desc(), "id")


def matched(tracks: DataFrame, catalogue: DataFrame) -> DataFrame:
    """EN1: (wanted, found): for each track the smallest id of another catalogue row of the same artist whose title begins with the track's.

    Every beginning of a catalogue title is a key beside its artist, so rows meet by equality and grow with the titles'
    length, not with the square of an artist's titles. A key's two smallest ids are enough: one of them isn't the track's own.
    They are told for equal titles first, so only different titles are taken apart. No side is broadcast, as a small file
    may hold many rows. Null ids, titles and artists find nothing.
    """

    def two_least(rows: DataFrame, *by: str) -> DataFrame:
        w = Window.partitionBy(*by).orderBy("id")
        return rows.withColumn("_k", F.dense_rank().over(w)).where("_k <= 2").groupBy(*by).agg(F.min("id").alias("found"), F.max("id").alias("next"))

    c = catalogue.where("id IS NOT NULL AND title IS NOT NULL AND artist IS NOT NULL").select("artist", F.lower("title").alias("name"), "id")
    c = two_least(c, "artist", "name").select("artist", "name", F.explode(F.array_distinct(F.array("found", "next"))).alias("id"))
    c = c.select("artist", "id", F.explode(F.transform(F.sequence(F.lit(0), F.length("name")), lambda n: F.substring("name", F.lit(1), n))).alias("lead"))
    asked = tracks.where("id IS NOT NULL").select(F.col("id").alias("wanted"), "artist", F.lower("title").alias("lead"))
    j = asked.join(two_least(c, "artist", "lead").hint("merge"), ["artist", "lead"])
    j = j.withColumn("found", F.when(F.col("wanted") != F.col("found"), F.col("found")).when(F.col("wanted") != F.col("next"), F.col("next")))
    return j.where("found IS NOT NULL").groupBy("wanted").agg(F.min("found").alias("found"))


def enriched(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """EN2, EN3: missing fields filled from what was found, and the state: 1 found, -1 not."""
    j = tracks.join(found.withColumn("hit", F.lit(1)), "id", "left")
    return j.withColumns({"state": F.coalesce("hit", F.lit(-1)), "duration_ms": F.coalesce("duration_ms", "new_ms")}).drop("hit", "new_ms")


def plausible(title: Column, artist: Column, hit_title: Column, hit_artist: Column) -> Column:
    """EN1: whether a loose hit may be meant: one title leads the other (the hit's, of four characters at least), or the artists share a word."""
    song, hit = F.lower(F.trim(title)), F.lower(F.trim(F.coalesce(hit_title, F.lit(""))))
    leads = (song != "") & (F.startswith(hit, song) | ((F.length(hit) >= 4) & F.startswith(song, hit)))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"), lambda w: F.length(w) >= 3)
    return F.coalesce(leads, F.lit(False)) | F.arrays_overlap(words(artist), words(hit_artist))


def catalogue_search(tracks: DataFrame, hits: DataFrame) -> DataFrame:
    """EN1: (id, found): of landed search hits (id, attempt, hit_title, hit_artist, found) the first in order of the attempts; attempt 0 asked for both fields and is taken as it is, others must be plausible."""
    j = tracks.join(hits, "id").where((F.col("attempt") == 0) | plausible(F.col("title"), F.col("artist"), F.col("hit_title"), F.col("hit_artist")))
    return j.groupBy("id").agg(F.min(F.struct("attempt", "found")).alias("best")).select("id", F.col("best.found").alias("found"))


def retry_pool(tracks: DataFrame) -> DataFrame:
    """EN3, FLT9: tracks not found so far whose normalised title is long enough and that are neither shorts nor non-music; an unknown flag is none."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return tracks.where((F.col("enriched") == -1) & (F.length("clean_title") >= 3) & no("is_short") & no("is_non_music"))


def retried(tracks: DataFrame, found: DataFrame, albums: DataFrame) -> DataFrame:
    """EN3, EN4: tracks with new states, 1 for those of the pool that are found (id, album_id), -2 for the rest of it, and genres by a dimension (album_id, album_genre)."""
    hits = found.join(albums, "album_id", "left").select("id", F.lit(True).alias("hit"), "album_genre")
    pool = retry_pool(tracks).select("id").join(hits, "id", "left").select("id", F.when(F.col("hit"), 1).otherwise(-2).alias("state"), F.col("album_genre").alias("genre"))
    return tracks.join(pool, "id", "left").withColumn("enriched", F.coalesce("state", "enriched")).drop("state")
