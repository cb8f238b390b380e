"""Queries of composites, look-ups, writes and catalogue matches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from listenlab.functions import music as mu
from listenlab.functions import text as tx
from listenlab.operators import compose as co
from listenlab.operators import macro as m
from listenlab.operators import recommend as rc
from listenlab.operators import resolve as rs
from listenlab.operators import space as sx
from listenlab.operators import writes as w
from listenlab.operators.order import kept, shared_dir
from listenlab.sources import sinks

from .bind import UNIT, sql
from .q_music import _FC, _TRANS, _USE, _fc
from .q_resolve import _CC, _DOCS, _MT, _SIG, _docs, _signed
from .q_vectors import _SIB, _SIBLINGS
from .registry import query

R = lambda n: F.round(n, 6).alias(n)


def _folder(t, what: str) -> str:
    return f"{shared_dir(t.spark)}/{what}-{uuid.uuid4().hex}"


_AVG = ", ".join(f"avg({n}) AS {n}" for n in UNIT)
_COH = "1 - (" + " + ".join(f"stddev_pop({n})" for n in UNIT) + ") / 8"
_DIST = "sqrt(" + " + ".join(f"(pt.{n} - g.{n}) ^ 2" for n in UNIT) + ")"
_ANA = (
    f"{_FC}, it AS (SELECT playlist_id, position, p.track_id, title, artist, genre FROM playlist_tracks p JOIN tracks ON id = p.track_id), pt AS (SELECT it.playlist_id, it.position, fc.* FROM it JOIN fc USING (track_id) WHERE error IS NULL), "
    f"sz AS (SELECT playlist_id, count(*) AS n_tracks FROM it GROUP BY 1), g AS (SELECT playlist_id, count(*) AS n_analyzed, avg(bpm) AS bpm, stddev_pop(bpm) AS bpm_spread, {_AVG}, {_COH} AS c FROM pt GROUP BY 1), "
    f"fl AS (SELECT playlist_id, avg(s) AS harmonic_score, round(100 * avg((s >= .85)::INTEGER)) AS harmonic_pct FROM (SELECT *, {_TRANS} AS s FROM (SELECT playlist_id, least((num - num2 + 12) % 12, (num2 - num + 12) % 12) AS d, let = let2 AS same FROM (SELECT playlist_id, num, let, lead(num) OVER w AS num2, lead(let) OVER w AS let2 FROM pt WINDOW w AS (PARTITION BY playlist_id ORDER BY position)) WHERE num2 IS NOT NULL)) GROUP BY 1), "
    f"far AS (SELECT playlist_id, least(count(*), 3) AS n_outliers FROM (SELECT pt.playlist_id, {_DIST} AS d FROM pt JOIN g USING (playlist_id)) WHERE d > .35 GROUP BY 1), "
    "dup AS (SELECT playlist_id, count(*) AS n_duplicates FROM (SELECT playlist_id, row_number() OVER (PARTITION BY playlist_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(artist), '[^a-z0-9]', '', 'g') ORDER BY position) AS k FROM it) WHERE k > 1 GROUP BY 1), "
    "ge AS (SELECT playlist_id, genre AS top_genre FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY n DESC, genre) AS k FROM (SELECT playlist_id, genre, count(*) AS n FROM it GROUP BY 1, 2)) WHERE k = 1), "
    "us AS (SELECT playlist_id, use_case FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY score DESC, i) AS k FROM (" + " UNION ALL ".join(f"SELECT playlist_id, {i} AS i, '{u}' AS use_case, round({e}, 9) AS score FROM g" for i, (u, e) in enumerate(_USE.items())) + ")) WHERE k = 1)"
)


@query("playlist_analysis", sql("playlist_tracks tracks features", "SELECT playlist_id, n_tracks, coalesce(n_analyzed, 0) AS n_analyzed, round(bpm, 1) AS bpm, round(bpm_spread, 1) AS bpm_spread, CASE WHEN n_analyzed >= 2 THEN CASE WHEN c > .85 THEN 'Very tight / single vibe' WHEN c > .7 THEN 'Cohesive' WHEN c > .5 THEN 'Varied' ELSE 'All over the place' END END AS kind, round(harmonic_score, 6) AS harmonic_score, harmonic_pct, coalesce(n_outliers, 0) AS n_outliers, coalesce(n_duplicates, 0) AS n_duplicates, top_genre, CASE WHEN n_analyzed >= 2 THEN use_case END AS use_case, CASE WHEN n_analyzed >= 2 THEN CASE WHEN energy >= .5 AND valence >= .5 THEN 'Bright & energetic' WHEN energy >= .5 THEN 'Dark & intense' WHEN valence >= .5 THEN 'Warm & mellow' ELSE 'Moody & subdued' END || ', ' || CASE WHEN bpm >= 120 THEN 'up-tempo' WHEN bpm >= 95 THEN 'mid-tempo' ELSE 'slow' END END AS mood_label FROM sz LEFT JOIN g USING (playlist_id) LEFT JOIN fl USING (playlist_id) LEFT JOIN far USING (playlist_id) LEFT JOIN dup USING (playlist_id) LEFT JOIN ge USING (playlist_id) LEFT JOIN us USING (playlist_id)", _ANA))
def analysis(t):  # PL2
    items = t.playlist_tracks.join(t.tracks.select(F.col("id").alias("track_id"), "title", "artist", "genre"), "track_id").join(_fc(t).where("error IS NULL"), "track_id", "left")
    a = co.playlist_analysis(items, UNIT)
    return a.select("playlist_id", "n_tracks", "n_analyzed", F.round("bpm", 1).alias("bpm"), F.round("bpm_spread", 1).alias("bpm_spread"), "kind", R("harmonic_score"), "harmonic_pct", "n_outliers", "n_duplicates", "top_genre", "use_case", "mood_label")


_TEN = [*UNIT, "bpm", "loudness_db", "dynamic_range"]


@query("track_dossier", sql("features", " UNION ALL ".join(f"SELECT track_id, 'percentile' AS part, '{n}' AS name, round(100.0 * k / n)::DOUBLE AS value FROM (SELECT track_id, rank() OVER (ORDER BY {n}) - 1 AS k, count(*) OVER () AS n FROM f) WHERE track_id % 50 = 0" for n in _TEN)
 + f" UNION ALL SELECT a AS track_id, 'similar' AS part, b::VARCHAR AS name, round(sim, 3) AS value FROM ({_SIBLINGS})", _SIB))
def dossier(t):  # RP2
    f = t.features
    return co.dossier(f, kept(sx.sonic(f, UNIT, F.col("mfcc"))), f.where("track_id % 50 = 0").select("track_id"), _TEN)


_NAMED = "nf AS (SELECT f.*, title, artist FROM f JOIN tracks ON id = f.track_id), md AS (SELECT x.track_id, avg(list_distance(x.z, y.z)) AS m FROM z x JOIN z y ON x.track_id <> y.track_id GROUP BY 1), sp AS (SELECT min(bpm) AS lo, max(bpm) AS hi, count(*) AS n FROM f), pk AS (SELECT bin, lo, hi, n, count(*) AS c FROM (SELECT least(floor((bpm - lo) / (hi - lo) * 8), 7) AS bin, lo, hi, n FROM f, sp) GROUP BY ALL ORDER BY c DESC, bin LIMIT 1)"


_SIGNS = (
    "ga AS (SELECT artist, sum(coalesce(plays, 0)) AS plays, " + ", ".join(f"(avg({n}) - (SELECT avg({n}) FROM nf)) / ((SELECT stddev_pop({n}) FROM nf) + 1e-6) AS z_{n}" for n in UNIT) + " FROM nf LEFT JOIN play_counts USING (track_id) GROUP BY 1), "
    "sl AS (" + " UNION ALL ".join(f"SELECT artist, plays, '{n}' AS feature, z_{n} AS z FROM ga" for n in UNIT) + "), "
    "sg AS (SELECT artist || '''s sonic signature: markedly ' || CASE WHEN z > 0 THEN 'higher ' ELSE 'lower ' END || feature || ' than your library baseline (z = ' || printf('%.2f', round(z, 2)) || ').' AS text FROM (SELECT *, row_number() OVER (PARTITION BY artist ORDER BY abs(z) DESC, feature DESC) AS k FROM sl) WHERE k = 1 AND abs(round(z, 2)) > 1.2 ORDER BY plays DESC, artist LIMIT 3)"
)
_ERAS = (
    "ee AS (SELECT release_date[1:3] || '0s' AS era, round(avg(loudness_db), 1) AS db FROM f JOIN tracks ON id = f.track_id GROUP BY 1 HAVING count(*) >= 2), "
    "er AS (SELECT 'The loudness war is visible in your library: your ' || b || ' tracks average ' || printf('%.1f', y) || ' dB vs ' || printf('%.1f', x) || ' dB in the ' || a || ' — ' || printf('%.1f', y - x) || ' dB louder, typically at the cost of dynamics.' AS text FROM (SELECT min(era) AS a, max(era) AS b, min_by(db, era) AS x, max_by(db, era) AS y FROM ee) WHERE y - x > 2)"
)


@query("deep_findings", sql("features tracks plays play_counts", "SELECT 'centre' AS topic, (SELECT '“' || title || '” by ' || artist FROM md JOIN nf USING (track_id) ORDER BY m, track_id LIMIT 1) || ' is the sonic centre of your library — the single track most representative of everything you play.' AS text UNION ALL SELECT 'outlier', 'Your biggest outlier is ' || (SELECT '“' || title || '” by ' || artist FROM md JOIN nf USING (track_id) ORDER BY m DESC, track_id LIMIT 1) || ' — nothing else you listen to sounds like it.' UNION ALL SELECT 'dynamics', 'Most compressed master you play: “' || (SELECT title || '” (' || printf('%.1f', dynamic_range) FROM nf ORDER BY dynamic_range, title, artist LIMIT 1) || ' dB of dynamic range). Most dynamic: “' || (SELECT title || '” (' || printf('%.1f', dynamic_range) FROM nf ORDER BY dynamic_range DESC, title DESC, artist DESC LIMIT 1) || ' dB).' UNION ALL SELECT 'tempo', 'Your tempo sweet spot is ' || floor(lo + (hi - lo) * bin / 8)::INTEGER || '–' || floor(lo + (hi - lo) * (bin + 1) / 8)::INTEGER || ' BPM (' || c || ' of ' || n || ' analyzed tracks live there).' FROM pk UNION ALL SELECT 'signature', text FROM sg UNION ALL SELECT 'era', text FROM er", f"{_SIB}, {_NAMED}, {_SIGNS}, {_ERAS}"))
def findings(t):  # RP3; no pair of these features is correlated by 0.6, so that part is empty here
    return co.findings(t.features, kept(sx.sonic(t.features, UNIT, F.col("mfcc"))), t.tracks, UNIT, t.play_counts)


@query("axis_findings")
def axis_findings(t):  # RP3, ML2
    return co.axis_findings(t.features, UNIT)


@query("dedupe_preview", f"WITH RECURSIVE {_SIG}, {_MT}, {_CC}, nn AS (SELECT root, count(*) AS n, sum(plays) AS plays FROM cc JOIN songs USING (id) GROUP BY 1 HAVING count(*) > 1), el AS (SELECT DISTINCT root FROM (SELECT root, token, n, count(DISTINCT id) AS have FROM (SELECT cc.root, cc.id, n, unnest(toks) AS token FROM cc JOIN nn USING (root) JOIN tk ON tk.id = cc.id WHERE n <= 4) JOIN fr USING (token) WHERE df <= 6 GROUP BY 1, 2, 3) WHERE have = n) SELECT count(el.root) AS clusters, coalesce(sum(n - 1) FILTER (el.root IS NOT NULL), 0)::BIGINT AS rows_removed, coalesce(sum(plays) FILTER (el.root IS NOT NULL), 0)::BIGINT AS plays_affected, count(*) FILTER (el.root IS NULL) AS skipped FROM nn LEFT JOIN el USING (root)")
def preview(t):  # DD10
    s = rs.kept(_signed(t))
    df = rs.frequency(s)
    c = rs.kept(rs.components(rs.matched(s, rs.blocked(s), df)))
    return co.dedupe_preview(c, rs.eligible(c, s, df), _docs(t))


_TAGS = "tg AS (SELECT id AS track_id, unnest([genre, artist, 'size' || popularity % 5, 'all']) AS tag, unnest([.5 + popularity / 100.0, .7, .2 + popularity / 50.0, .6])::DOUBLE AS weight FROM tracks)"


@query("top_tags", sql("tracks", "SELECT track_id, tag, round(weight, 6) AS weight, place FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY weight DESC, tag)::INTEGER AS place FROM tg) WHERE place <= 3", _TAGS))
def top_tags(t):  # AX6
    p = F.col("popularity")
    pairs = F.array(*[F.struct(a.alias("tag"), b.cast("double").alias("weight")) for a, b in ((F.col("genre"), 0.5 + p / 100), (F.col("artist"), F.lit(0.7)), (F.concat(F.lit("size"), p % 5), 0.2 + p / 50), (F.lit("all"), F.lit(0.6)))])
    return co.top_tags(t.tracks.select(F.col("id").alias("track_id"), F.inline(pairs)), 3).select("track_id", "tag", R("weight"), "place")


@query("strongest_features", sql("features", "SELECT track_id, array_to_string(list_transform(list_sort([" + ", ".join(f"{{'v': -{n}, 'k': '{n}'}}" for n in UNIT) + "])[1:3], lambda x: x.k), ',') AS names FROM features"))
def strongest(t):  # AR10
    x = F.create_map(*[c for n in UNIT for c in (F.lit(n), F.col(n))])
    return t.features.select("track_id", F.array_join(F.transform(co.strongest(x, 3), lambda e: e["key"]), ",").alias("names"))


@query("artists_in_first_order", sql("playlist_tracks tracks", "SELECT playlist_id, string_agg(artist, ',' ORDER BY p) AS artists FROM (SELECT playlist_id, artist, min(position) AS p FROM playlist_tracks JOIN tracks ON id = track_id GROUP BY 1, 2) GROUP BY 1"))
def first_order(t):  # SE5
    j = t.playlist_tracks.join(t.tracks.select(F.col("id").alias("track_id"), "artist"), "track_id")
    return co.in_first_order(j, "playlist_id", "position", "artist").select("playlist_id", F.array_join("values", ",").alias("artists"))


@query("slop_documents", sql("features", "SELECT track_id, round(energy, 6) AS score, round(danceability, 6) AS confidence, CASE WHEN danceability < .35 THEN 'unclear' WHEN energy >= .65 THEN 'likely generated' WHEN energy <= .3 THEN 'likely human-performed' ELSE 'machine-produced, origin unclear' END AS verdict, round(valence, 6) AS grid FROM features"))
def documents(t):  # AX7
    rows = t.features.select("track_id", F.col("energy").alias("score"), F.col("danceability").alias("confidence"), mu.verdict(F.col("energy"), F.col("danceability")).alias("verdict"), F.lit("prior").alias("mode"), F.create_map(F.lit("grid_rigidity"), "valence").alias("signals"))
    d = co.read_documents(co.documents(rows))
    return d.select("track_id", R("score"), R("confidence"), "verdict", F.round(d.signals["grid_rigidity"], 6).alias("grid"))


@query("axis_labels", sql("axis_labels", "SELECT track_id, value FROM axis_labels WHERE axis = 'quality'"))
def axis(t):  # AX7
    return t.labels.where("axis = 'quality'").select("track_id", "value")


@query("json_rows", sql("tracks plays", "SELECT '{\"artist\":\"' || artist || '\",\"plays\":' || plays || ',\"tracks\":' || n || '}' AS value FROM (SELECT artist, count(*) AS plays, count(DISTINCT track_id) AS n FROM plays JOIN tracks ON id = track_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25)"))
def json_rows(t):  # SNK20: rows as they leave the engine
    top = m.top_artists(t.plays, t.tracks)
    return top.select(F.to_json(F.struct("artist", "plays", "tracks")).alias("value"))


@query("seeds_fallback", sql("top_items", "SELECT name AS artist, source, rank FROM top_items WHERE rank <= 6"))
def seeds(t):  # RC1: nobody has played anything, so ranked items take the place of the most played artists
    none = t.plays.where("track_id < 0")
    out = None
    for source in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"):
        s = rc.seeds(m.top_artists(none, t.tracks, 6), t.top_items.where(F.col("source") == source), 6).select(F.col("artist"), F.lit(source).alias("source"), F.col("seed").alias("rank"))
        out = s if out is None else out.unionByName(s)
    return out


@query("recommendation_snapshot", sql("tracks", "SELECT id, title, artist, 'Because you listen to ' || genre AS reason, round(popularity / 50.0, 3)::DOUBLE AS score FROM tracks WHERE id % 7 = 3 ORDER BY score DESC, id LIMIT 30"))
def snapshot(t):  # SNK15, RC4: the last snapshot takes the place of the one before
    to = _folder(t, "snapshot")
    for rest in (2, 3):
        rows = t.tracks.where(F.col("id") % 7 == rest).select("id", "title", "artist", F.concat(F.lit("Because you listen to "), "genre").alias("reason"), F.round(F.col("popularity") / 50, 3).alias("score"))
        rc.save_snapshot(rows, to)
    return rc.latest_snapshot(t.spark, to)


@query("append_event", sql("plays_ev", "SELECT source, count(*) + (source = 'click')::INTEGER AS n FROM plays_ev GROUP BY source"))
def append_event(t):  # SNK5
    to = _folder(t, "log")
    log = t.plays_ev.select("track_id", "played_at", "source")
    w.append(log, to)
    w.append(log.where("source = 'click'").orderBy("played_at", "track_id").limit(1), to)
    return t.spark.read.parquet(to).groupBy("source").agg(F.count("*").alias("n"))


@query("feature_flush", sql("features", "SELECT track_id, CASE WHEN track_id % 17 <> 0 THEN round(energy, 6) END AS energy, error FROM features"))
def flush(t):  # SNK8
    to = _folder(t, "flush")
    good = t.features.where("error IS NULL").select("track_id", "energy")
    bad = t.features.where("error IS NOT NULL").select("track_id", "error")
    w.flush(good, bad, to)
    return t.spark.read.parquet(to).select("track_id", R("energy"), "error")


@query("top_items_upsert", sql("top_items", "SELECT source, rank, CASE WHEN rank % 2 = 0 THEN name || ' again' ELSE name END AS name FROM top_items"))
def top_items(t):  # SNK9
    old = t.top_items.select("source", "rank", "name")
    new = old.where("rank % 2 = 0").withColumn("name", F.concat("name", F.lit(" again")))
    return w.upserted(old, new, ["source", "rank"])


@query("clear_all", "SELECT unnest(['audio_features', 'lyrics', 'playlist_tracks', 'playlists', 'plays', 'recommendations', 'top_items', 'tracks']) AS name, 0::BIGINT AS n")
def clear_all(t):  # SNK12
    to = _folder(t, "store")
    tables = {"plays": t.plays, "audio_features": t.features, "lyrics": t.lyrics, "playlist_tracks": t.playlist_tracks, "playlists": t.playlists, "top_items": t.top_items, "recommendations": t.tracks.limit(5), "tracks": t.tracks}
    for name, df in tables.items():
        df.write.parquet(f"{to}/{name}")
    w.clear(t.spark, to)
    out = None
    for name in tables:
        n = t.spark.read.parquet(f"{to}/{name}").agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


@query("csv_export", sql("tracks", "SELECT id, title, artist FROM tracks"))
def csv_export(t):  # SNK17
    to = _folder(t, "csv")
    sinks.write_csv(t.tracks.select("id", "title", "artist"), to)
    return t.spark.read.schema("id long, title string, artist string").csv(to, header=True)


@query("model_state", sql("vectors", "SELECT i::INTEGER AS i, round(avg(x), 6) AS mean FROM (SELECT unnest(vec) AS x, generate_subscripts(vec, 1) - 1 AS i FROM vectors) GROUP BY 1"))
def model_state(t):  # SNK21
    from listenlab.operators import vectors as vc

    to = _folder(t, "model")
    sinks.save_arrays(vc.centroid(t.vectors.withColumn("g", F.lit(1)), ["g"]).select(F.col("vec").alias("mean")), to)
    state = sinks.load_arrays(t.spark, to)
    return t.spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(state["mean"])], "i int, mean double")


@query("track_reports", sql("tracks features", "SELECT id, contains(title, 'r') AS r, length('<!DOCTYPE html><title>' || title || '</title><h1>' || title || '</h1><p>' || artist || '</p>') AS n FROM tracks JOIN features ON track_id = id"))
def reports(t):  # SNK18: a page for each row, made where the row is
    rows = t.tracks.join(t.features.select(F.col("track_id").alias("id"), "energy"), "id")
    page = sinks.report_column(F.col("title"), F.col("artist"), F.create_map(F.lit("energy"), "energy"))
    head = F.regexp_extract(page, "^(.*?)<table>", 1)
    return rows.select("id", F.contains("title", F.lit("r")).alias("r"), F.length(head).cast("long").alias("n"))


_RETRY = "rp AS (SELECT *, CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN 1 ELSE 0 END AS enriched, CASE WHEN id % 4 <> 0 THEN title ELSE 'ab' END AS clean_title, CASE id % 5 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_short, CASE id % 7 WHEN 0 THEN true WHEN 1 THEN NULL ELSE false END AS is_non_music FROM tracks)"


def _retry(t):
    i = F.col("id")
    flag = lambda k: F.when(i % k == 0, F.lit(True)).when(i % k == 1, F.lit(None).cast("boolean")).otherwise(F.lit(False))
    return t.tracks.withColumns({"enriched": F.when(i % 3 == 0, -1).when(i % 3 == 1, 1).otherwise(0), "clean_title": F.when(i % 4 != 0, F.col("title")).otherwise("ab"), "is_short": flag(5), "is_non_music": flag(7)})


@query("retry_pool", sql("tracks", "SELECT id FROM rp WHERE enriched = -1 AND length(clean_title) >= 3 AND NOT coalesce(is_short, false) AND NOT coalesce(is_non_music, false)", _RETRY))
def retry_pool(t):  # FLT9, EN3
    return rc.retry_pool(_retry(t)).select("id")


@query("retry_states", sql("tracks", "SELECT state, count(*) AS n, count(genre2) AS genres FROM (SELECT r.id, CASE WHEN NOT (r.enriched = -1 AND length(clean_title) >= 3 AND NOT coalesce(is_short, false) AND NOT coalesce(is_non_music, false)) THEN enriched WHEN r.id % 2 = 0 THEN 1 ELSE -2 END AS state, CASE WHEN r.enriched = -1 AND length(clean_title) >= 3 AND NOT coalesce(is_short, false) AND NOT coalesce(is_non_music, false) AND r.id % 2 = 0 THEN genre END AS genre2 FROM rp r) GROUP BY 1", _RETRY))
def retry_states(t):  # EN3, EN4: found by its normalised fields or not; genres of albums from a landed dimension
    found = t.tracks.where("id % 2 = 0").select("id", F.col("id").alias("album_id"))
    albums = t.tracks.select(F.col("id").alias("album_id"), F.col("genre").alias("album_genre"))
    r = rc.retried(_retry(t).drop("genre"), found, albums)
    return r.groupBy(F.col("enriched").cast("int").alias("state")).agg(F.count("*").alias("n"), F.count("genre").alias("genres"))


_HITS = "hv AS (SELECT id, brand, name, name || ' ' || 'lights' AS title, 0 AS q, name AS hit, brand AS by_, id * 10 AS found FROM videos WHERE id % 4 = 0 UNION ALL SELECT id, brand, name, name || ' ' || 'lights', 1, CASE WHEN id % 3 = 0 THEN name || ' lights forever' WHEN id % 3 = 1 THEN 'to sleep to' ELSE 'xyz' END, CASE WHEN id % 3 = 1 THEN 'the brand ' || replace(brand, '#', '') || ' band' ELSE 'nobody' END, id * 10 + 1 FROM videos)"


@query("catalogue_search", sql("videos", "SELECT id, min(found) AS found FROM (SELECT *, min(q) OVER (PARTITION BY id) AS first FROM hv WHERE q = 0 OR starts_with(lower(hit), lower(title)) OR length(hit) >= 4 AND starts_with(lower(title), lower(hit)) OR len(list_intersect(list_filter(string_split_regex(lower(brand), '[^a-z0-9]+'), lambda x: length(x) >= 3), list_filter(string_split_regex(lower(by_), '[^a-z0-9]+'), lambda x: length(x) >= 3))) > 0) WHERE q = first GROUP BY 1", _HITS))
def catalogue_search(t):  # EN1: landed hits of an exact query, taken as they are, and of a looser one, taken if plausible
    v, i = t.videos, F.col("id")
    title = F.concat("name", F.lit(" lights"))
    exact = v.where(i % 4 == 0).select("id", F.lit(0).alias("attempt"), F.col("name").alias("hit_title"), F.col("brand").alias("hit_artist"), (i * 10).alias("found"))
    loose = v.select(
        "id", F.lit(1).alias("attempt"), F.when(i % 3 == 0, F.concat("name", F.lit(" lights forever"))).when(i % 3 == 1, "to sleep to").otherwise("xyz").alias("hit_title"),
        F.when(i % 3 == 1, F.concat(F.lit("the brand "), F.replace("brand", F.lit("#"), F.lit("")), F.lit(" band"))).otherwise("nobody").alias("hit_artist"), (i * 10 + 1).alias("found"),
    )
    wanted = v.select("id", title.alias("title"), F.col("brand").alias("artist"))
    return rc.catalogue_search(wanted, exact.unionByName(loose)).select("id", "found")


@query("epochs", sql("plays_ev", "SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 7.0 ELSE CASE WHEN event_id % 5 = 3 THEN epoch(date_trunc('day', played_at)) ELSE epoch(date_trunc('second', played_at)) END END::DOUBLE AS epoch FROM plays_ev"))
def epochs(t):  # DT6
    k = F.col("event_id") % 5
    f = lambda p: F.date_format("played_at", p)
    text = F.when(k == 0, f("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, f("yyyy-MM-dd HH:mm:ss")).when(k == 2, F.concat(f("yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))).when(k == 3, f("yyyy-MM-dd")).otherwise("some day")
    return t.plays_ev.select("event_id", tx.epoch(text, F.lit(7.0)).alias("epoch"))


@query("leading_numbers", sql("tracks", "SELECT id, CASE WHEN id % 3 <> 2 THEN (id % 30)::INTEGER END AS number FROM tracks"))
def leading(t):  # AX12
    i = F.col("id")
    return t.tracks.select("id", tx.leading_int(F.when(i % 3 == 0, F.concat((i % 30).cast("string"), F.lit("/12"))).when(i % 3 == 1, (i % 30).cast("string")).otherwise("x/2")).alias("number"))


_ = (_DOCS,)  # the songs of the duplicate queries
