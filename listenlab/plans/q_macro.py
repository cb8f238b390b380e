"""Queries over plays and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.operators import macro as m

from .bind import sql
from .registry import query

R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]
DUR = "coalesce(duration_ms, 210000)"


@query("top_tracks", sql("tracks plays features", """SELECT t.id AS track_id, title, artist, n AS plays, round(energy, 6) AS energy, round(bpm, 6) AS bpm
 FROM (SELECT track_id, count(*) AS n FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25) p JOIN tracks t ON t.id = p.track_id LEFT JOIN features f ON f.track_id = t.id"""))
def top_tracks(t):
    return m.top_tracks(t.plays, t.tracks, t.features).select("track_id", "title", "artist", "plays", *R6("energy", "bpm"))


@query("top_artists", sql("tracks plays", "SELECT artist, count(*) AS plays, count(DISTINCT id) AS tracks FROM plays JOIN tracks ON id = track_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"))
def top_artists(t):
    return m.top_artists(t.plays, t.tracks)


@query("top_genres", sql("tracks plays", "SELECT genre, count(*) AS plays FROM plays JOIN tracks ON id = track_id WHERE genre IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15"))
def top_genres(t):
    return m.top_genres(t.plays, t.tracks)


@query("top_tracks_last_n_days", sql("tracks plays", "SELECT track_id, title, artist, n AS plays FROM (SELECT track_id, count(*) AS n FROM plays WHERE played_at >= TIMESTAMP '2001-11-04' - INTERVAL 90 DAY GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25) JOIN tracks ON id = track_id"))
def top_last(t):
    return m.top_tracks(m.since(t.plays, "2001-11-04", 90), t.tracks, t.features).select("track_id", "title", "artist", "plays")


@query("overview_counts", sql("tracks plays features", f"""SELECT count(*) AS plays, count(DISTINCT track_id) AS played_tracks, count(DISTINCT artist) AS artists, round(sum({DUR}) / 3600000.0, 6)::DOUBLE AS hours,
 min(played_at) AS first_play, max(played_at) AS last_play, (SELECT count(*) FROM features WHERE error IS NULL) AS analysed, (SELECT count(*) FROM features WHERE error IS NOT NULL) AS failed FROM plays JOIN tracks ON id = track_id"""))
def overview(t):
    return m.overview(t.plays, t.tracks, t.features).withColumn("hours", F.round("hours", 6))


@query("plays_by_source", sql("plays", "SELECT source, count(*) AS plays FROM plays GROUP BY 1"))
def by_source(t):
    return m.by_source(t.plays)


@query("plays_by_hour", sql("plays_ev", "SELECT hour(played_at)::BIGINT AS hour, count(*) AS plays FROM plays_ev GROUP BY 1"))
def by_hour(t):
    return m.bucketed(t.plays_ev, hour=F.hour("played_at").cast("long"))


@query("plays_by_weekday", sql("plays_ev", "SELECT dayofweek(played_at)::BIGINT AS weekday, count(*) AS plays FROM plays_ev GROUP BY 1"))
def by_weekday(t):
    return m.bucketed(t.plays_ev, weekday=(F.dayofweek("played_at") - 1).cast("long"))


@query("plays_by_month", sql("plays", "SELECT strftime(played_at, '%Y-%m') AS month, count(*) AS plays, count(DISTINCT track_id) AS tracks FROM plays GROUP BY 1"))
def by_month(t):
    return m.monthly(t.plays)


@query("heatmap", sql("plays_ev", "SELECT dayofweek(played_at)::BIGINT AS weekday, hour(played_at)::BIGINT AS hour, count(*) AS plays FROM plays_ev GROUP BY 1, 2"))
def heatmap(t):
    return m.bucketed(t.plays_ev, weekday=(F.dayofweek("played_at") - 1).cast("long"), hour=F.hour("played_at").cast("long"))


@query("calendar_days", sql("plays_ev", "SELECT played_at::DATE AS day, count(*) AS plays FROM plays_ev GROUP BY 1"))
def calendar(t):
    return m.bucketed(t.plays_ev, day=F.to_date("played_at"))


@query("busiest_day", sql("plays_ev", "SELECT day, plays, (SELECT count(*) FROM d) AS active_days FROM d ORDER BY plays DESC, day LIMIT 1", "d AS (SELECT played_at::DATE AS day, count(*) AS plays FROM plays_ev GROUP BY 1)"))
def busiest(t):
    return m.busiest_day(t.plays_ev)


@query("era_distribution", sql("tracks plays", "SELECT concat(substr(release_date, 1, 3), '0s') AS era, count(*) AS plays FROM plays JOIN tracks ON id = track_id WHERE length(release_date) >= 4 GROUP BY 1"))
def eras(t):
    return m.eras(t.plays, t.tracks)


@query("first_seen_by_month", sql("plays", "SELECT strftime(f, '%Y-%m') AS month, count(*) AS n FROM (SELECT track_id, min(played_at) AS f FROM plays GROUP BY 1) GROUP BY 1"))
def first_seen(t):
    return m.first_seen(t.plays, "track_id")


@query("discovery_series", sql("tracks plays", "SELECT coalesce(a.month, b.month) AS month, coalesce(new_tracks, 0) AS new_tracks, coalesce(new_artists, 0) AS new_artists FROM a FULL JOIN b ON a.month = b.month",
 "a AS (SELECT strftime(f, '%Y-%m') AS month, count(*) AS new_tracks FROM (SELECT track_id, min(played_at) AS f FROM plays GROUP BY 1) GROUP BY 1), b AS (SELECT strftime(f, '%Y-%m') AS month, count(*) AS new_artists FROM (SELECT artist, min(played_at) AS f FROM plays JOIN tracks ON id = track_id GROUP BY 1) GROUP BY 1)"))
def discovery(t):
    return m.discovery_series(t.plays, t.tracks)


@query("discovery_ratio", sql("plays", "SELECT tracks, plays, round(r, 6) AS ratio, CASE WHEN r > .8 THEN 'Explorer — you rarely repeat, always seeking new' WHEN r > .5 THEN 'Balanced — mix of new and familiar' WHEN r > .3 THEN 'Comfort listener — you replay favourites a lot' ELSE 'Loyalist — you loop a tight set of songs' END AS kind FROM (SELECT count(DISTINCT track_id) AS tracks, count(*) AS plays, count(DISTINCT track_id) / count(*)::DOUBLE AS r FROM plays)"))
def ratio(t):
    return m.discovery_ratio(t.plays).withColumn("ratio", F.round("ratio", 6))


_C = "c AS (SELECT artist, count(*) AS c FROM plays JOIN tracks ON id = track_id GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY c, artist) AS i, row_number() OVER (ORDER BY c DESC, artist) AS j FROM c)"


@query("concentration", sql("tracks plays", """SELECT keys, round(g, 6) AS gini, hhi, top1, top5, top10, CASE WHEN g > .6 THEN 'Very concentrated — a few artists dominate' WHEN g > .45 THEN 'Concentrated' WHEN g > .3 THEN 'Fairly even' ELSE 'Very diverse spread' END AS kind FROM
 (SELECT count(*) AS keys, CASE WHEN count(*) = 1 THEN 0.0 ELSE 2 * sum(i * c)::DOUBLE / (count(*) * sum(c)) - (count(*) + 1) / count(*)::DOUBLE END AS g, round(sum(c * c)::DOUBLE / (sum(c) * sum(c)), 6) AS hhi,
 round(sum(c) FILTER (j <= 1) / sum(c)::DOUBLE, 6) AS top1, round(sum(c) FILTER (j <= 5) / sum(c)::DOUBLE, 6) AS top5, round(sum(c) FILTER (j <= 10) / sum(c)::DOUBLE, 6) AS top10 FROM r)""", _C))
def concentration(t):
    return m.concentration(m.shares(t.plays, t.tracks)).select("keys", *R6("gini", "hhi", "top1", "top5", "top10"), "kind")


@query("running_share", sql("tracks plays", "SELECT artist, c, j AS pos, round(sum(c) OVER (ORDER BY c DESC, artist ROWS UNBOUNDED PRECEDING) / (sum(c) OVER ())::DOUBLE, 6) AS share FROM r", _C))
def running(t):
    return m.running_share(m.shares(t.plays, t.tracks)).withColumn("share", F.round("share", 6))


@query("play_entropy", sql("plays", "SELECT round(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM (SELECT count(*) / (sum(count(*)) OVER ())::DOUBLE AS p FROM plays GROUP BY track_id)"))
def entropy(t):
    return m.entropy(t.plays).select(*R6("entropy"))


@query("token_search", sql("tracks", "SELECT id, title, artist FROM tracks WHERE (title ILIKE '%red%' OR artist ILIKE '%red%') AND (title ILIKE '%brand#1%' OR artist ILIKE '%brand#1%')"))
def token_search(t):
    return m.search(t.tracks, "red brand#1").select("id", "title", "artist")


@query("three_column_search", sql("tracks", "SELECT id, title, artist, genre FROM tracks WHERE title ILIKE '%eco%' OR artist ILIKE '%eco%' OR genre ILIKE '%eco%'"))
def three_columns(t):
    return m.search(t.tracks, "eco", ("title", "artist", "genre")).select("id", "title", "artist", "genre")


@query("recap_headline", sql("tracks plays", f"SELECT count(*) AS plays, count(DISTINCT id) AS tracks, count(DISTINCT artist) AS artists, round(sum({DUR}) / 3600000.0, 6)::DOUBLE AS hours, round(sum({DUR}) / 60000.0, 6)::DOUBLE AS minutes FROM plays JOIN tracks ON id = track_id WHERE year(played_at) = 1998"))
def recap(t):
    return m.recap(t.plays, t.tracks, 1998).select("plays", "tracks", "artists", *R6("hours", "minutes"))


@query("recap_top", sql("tracks plays", """SELECT 'track' AS kind, title || ' #' || id AS name, n AS plays FROM (SELECT track_id, count(*) AS n FROM plays WHERE year(played_at) = 1998 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5) JOIN tracks ON id = track_id
 UNION ALL SELECT 'artist', artist, plays FROM (SELECT artist, count(*) AS plays FROM plays JOIN tracks ON id = track_id WHERE year(played_at) = 1998 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)
 UNION ALL SELECT 'genre', genre, plays FROM (SELECT genre, count(*) AS plays FROM plays JOIN tracks ON id = track_id WHERE year(played_at) = 1998 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"""))
def recap_top(t):
    some = m.of_year(t.plays, 1998)
    tops = m.top_tracks(some, t.tracks, t.features, 5).select(F.lit("track").alias("kind"), F.concat("title", F.lit(" #"), "track_id").alias("name"), "plays")
    return tops.unionByName(m.top_artists(some, t.tracks, 5).select(F.lit("artist").alias("kind"), F.col("artist").alias("name"), "plays")).unionByName(
        m.top_genres(some, t.tracks, 1).select(F.lit("genre").alias("kind"), F.col("genre").alias("name"), "plays"))


@query("recap_peak_hour", sql("plays_ev", "SELECT hour(played_at)::BIGINT AS hour, count(*) AS plays FROM plays_ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1"))
def peak(t):
    return m.peak_hour(t.plays_ev)


@query("recap_years", sql("plays", "SELECT DISTINCT year(played_at)::BIGINT AS year FROM plays"))
def years(t):
    return t.plays.select(F.year("played_at").cast("long").alias("year")).distinct()


@query("recent_by_artist", sql("tracks plays", "SELECT track_id, played_at, source FROM plays JOIN tracks ON id = track_id WHERE artist = 'Brand#11' ORDER BY played_at DESC, track_id, source LIMIT 50"))
def recent(t):  # ST3
    mine = t.tracks.where("artist = 'Brand#11'").select("id")
    return t.plays.join(mine, F.col("track_id") == F.col("id"), "left_semi").orderBy(F.col("played_at").desc(), "track_id", "source").limit(50)


@query("pending_work", sql("tracks plays features", "SELECT id, plays FROM (SELECT t.id, coalesce(n, 0) AS plays FROM tracks t LEFT JOIN (SELECT track_id, count(*) AS n FROM plays GROUP BY 1) p ON p.track_id = t.id WHERE NOT EXISTS (SELECT 1 FROM features f WHERE f.track_id = t.id)) ORDER BY plays DESC, id LIMIT 100"))
def pending(t):  # JN7, ST4: most played first among what has no features
    todo = t.tracks.join(t.features.select(F.col("track_id").alias("id")), "id", "left_anti")
    return m.with_counts(todo, t.plays, 0).select("id", "plays").orderBy(F.col("plays").desc(), "id").limit(100)


_ONE = "py AS (SELECT track_id FROM plays WHERE source = 'A' AND played_at >= TIMESTAMP '1995-01-01' AND played_at < TIMESTAMP '1996-01-01')"


def _one_year(t):
    return m.of_year(t.plays.where("source = 'A'"), 1995).select(F.col("track_id").alias("id"))


@query("orphan_tracks", sql("tracks plays", "SELECT id, title FROM tracks WHERE id NOT IN (SELECT track_id FROM py)", _ONE))
def orphans(t):  # JN7, SNK13: nothing of one source in one year refers to them
    return t.tracks.join(_one_year(t), "id", "left_anti").select("id", "title")


@query("semi_dependents", sql("tracks plays features", "SELECT track_id FROM features WHERE track_id IN (SELECT id FROM tracks WHERE id NOT IN (SELECT track_id FROM py))", _ONE))
def dependents(t):  # JN8
    gone = t.tracks.join(_one_year(t), "id", "left_anti").select(F.col("id").alias("track_id"))
    return t.features.join(gone, "track_id", "left_semi").select("track_id")


@query("in_list_lookup", sql("tracks", "SELECT id, title FROM tracks WHERE id IN (3, 5, 8, 13, 21)"))
def in_list(t):  # FLT7
    return t.tracks.where(F.col("id").isin(3, 5, 8, 13, 21)).select("id", "title")


@query("known_pair_exclusion", sql("tracks", "SELECT id FROM tracks WHERE (lower(title), lower(artist)) NOT IN (SELECT (lower(title), lower(artist)) FROM tracks WHERE id % 3 = 0)"))
def known_pairs(t):  # FLT13
    low = lambda df: df.select("id", F.lower("title").alias("t"), F.lower("artist").alias("a"))
    return low(t.tracks).join(low(t.tracks.where("id % 3 = 0")).drop("id"), ["t", "a"], "left_anti").select("id")


@query("plays_minus_source", sql("plays", "SELECT DISTINCT track_id FROM plays WHERE source = 'A' INTERSECT SELECT track_id FROM plays WHERE source = 'R' EXCEPT SELECT track_id FROM plays WHERE source = 'N' AND year(played_at) > 1996"))
def set_operations(t):  # SE1-SE3
    p = t.plays
    return p.where("source = 'A'").select("track_id").intersect(p.where("source = 'R'").select("track_id")).subtract(
        p.where("source = 'N' AND played_at >= timestamp_ntz '1997-01-01'").select("track_id"))


@query("playlist_listing", sql("playlists playlist_tracks features", "SELECT p.id, p.name, p.source, count(pt.track_id) AS tracks, count(f.track_id) AS analysed FROM playlists p LEFT JOIN playlist_tracks pt ON pt.playlist_id = p.id LEFT JOIN features f ON f.track_id = pt.track_id AND f.error IS NULL GROUP BY 1, 2, 3"))
def listing(t):  # AG34, JN4, JN10, FLT8: counts are made before the playlists are joined
    known = t.features.where("error IS NULL").select("track_id", F.lit(1).alias("ok"))
    per = t.playlist_tracks.join(known, "track_id", "left").groupBy(F.col("playlist_id").alias("id")).agg(F.count("*").alias("tracks"), F.count("ok").alias("analysed"))
    return t.playlists.join(per, "id", "left").select("id", "name", "source", F.coalesce("tracks", F.lit(0)).alias("tracks"), F.coalesce("analysed", F.lit(0)).alias("analysed"))


@query("smart_playlist_top", sql("plays", "SELECT row_number() OVER (ORDER BY n DESC, track_id) AS position, track_id FROM (SELECT track_id, count(*) AS n FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"))
def smart_top(t):  # PL1
    return _numbered(m.counts(t.plays).orderBy(F.col("plays").desc(), "track_id").limit(50), F.col("plays").desc())


@query("smart_playlist_source", sql("plays", "SELECT row_number() OVER (ORDER BY n DESC, track_id) AS position, track_id FROM (SELECT track_id, count(*) AS n FROM plays WHERE source = 'R' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"))
def smart_source(t):
    return _numbered(m.counts(t.plays.where("source = 'R'")).orderBy(F.col("plays").desc(), "track_id").limit(50), F.col("plays").desc())


@query("smart_playlist_genre", sql("tracks plays", "SELECT row_number() OVER (ORDER BY n DESC, track_id) AS position, track_id FROM (SELECT track_id, count(*) AS n FROM plays JOIN tracks ON id = track_id WHERE genre ILIKE '%pro%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"))
def smart_genre(t):
    mine = t.tracks.where(F.col("genre").ilike("%pro%")).select(F.col("id").alias("track_id"))
    return _numbered(m.counts(t.plays).join(mine, "track_id", "left_semi").orderBy(F.col("plays").desc(), "track_id").limit(50), F.col("plays").desc())


@query("smart_playlist_recent", sql("plays", "SELECT row_number() OVER (ORDER BY f DESC, track_id) AS position, track_id FROM (SELECT track_id, max(played_at) AS f FROM plays GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50)"))
def smart_recent(t):
    last = t.plays.groupBy("track_id").agg(F.max("played_at").alias("last"))
    return _numbered(last.orderBy(F.col("last").desc(), "track_id").limit(50), F.col("last").desc())


def _numbered(top, order):
    from pyspark.sql import Window

    return top.select(F.row_number().over(Window.orderBy(order, "track_id")).alias("position"), "track_id")  # at most 50 rows


@query("track_detail", sql("tracks plays features", """SELECT t.id, title, artist, (SELECT count(*) FROM plays WHERE track_id = 42) AS play_count, (SELECT min(played_at) FROM plays WHERE track_id = 42) AS first_play,
 (SELECT max(played_at) FROM plays WHERE track_id = 42) AS last_play, round(f.energy, 6) AS energy FROM tracks t LEFT JOIN features f ON f.track_id = t.id WHERE t.id = 42"""))
def detail(t):  # RP1
    p = t.plays.where("track_id = 42").agg(F.count("*").alias("play_count"), F.min("played_at").alias("first_play"), F.max("played_at").alias("last_play"))
    return t.tracks.where("id = 42").join(t.features.where("track_id = 42").select("track_id", "energy"), F.col("id") == F.col("track_id"), "left").crossJoin(p).select(
        "id", "title", "artist", "play_count", "first_play", "last_play", *R6("energy"))


@query("counts_without_skips", sql("plays_ev", "SELECT track_id, count(*) AS plays FROM plays_ev WHERE NOT skipped GROUP BY 1"))
def no_skips(t):  # AG35
    return m.counts(t.plays_ev.where(~F.col("skipped")))


@query("history_head", sql("plays_ev", "SELECT event_id, track_id, played_at FROM plays_ev WHERE NOT skipped ORDER BY played_at, event_id LIMIT 100"))
def history(t):  # AX5
    return t.plays_ev.where(~F.col("skipped")).orderBy("played_at", "event_id").limit(100).select("event_id", "track_id", "played_at")


@query("label_axes", sql("axis_labels", "SELECT axis, count(*) AS n FROM axis_labels GROUP BY 1"))
def axes(t):  # AG36
    return t.labels.groupBy("axis").agg(F.count("*").alias("n"))


@query("availability", sql("tracks plays features", "SELECT (SELECT count(*) FROM tracks) AS tracks, (SELECT count(*) FROM features WHERE error IS NULL) AS analysed, (SELECT count(DISTINCT track_id) FROM plays) AS played"))
def availability(t):  # AX19
    one = lambda df, n: df.agg(F.count("*").alias(n))
    return one(t.tracks, "tracks").crossJoin(one(t.features.where("error IS NULL"), "analysed")).crossJoin(one(t.plays.select("track_id").distinct(), "played"))


@query("top_items_latest", sql("top_items", "SELECT source, rank, name, item_id FROM top_items WHERE rank <= 6"))
def top_items(t):  # SNK9 read side, RC1 fallback
    return t.top_items.where("rank <= 6")
