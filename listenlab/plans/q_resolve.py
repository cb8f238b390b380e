"""Queries over duplicate tracks and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.functions import text as tx
from listenlab.operators import macro as m
from listenlab.operators import recommend as rc
from listenlab.operators import resolve as rs

from . import bind
from .bind import sql
from .registry import query

R = lambda n: F.round(n, 6).alias(n)
_NOISE = ", ".join(f"'{w}'" for w in tx.TOKEN_NOISE)
_TOK = "list_distinct(list_filter(string_split_regex(regexp_replace(replace(replace(lower({}), chr(39), ''), '’', ''), '[(\\[][^)\\]]*[)\\]]', ' ', 'g'), '[^a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN (" + _NOISE + ")))"
_DOCS = bind.CTE["songs"] + ", dt AS (SELECT *, id % 5 = 0 AS enriched, id % 3 = 0 AS preview FROM songs)"
_SIG = f"{_DOCS}, sg AS (SELECT id, {_TOK.format('title')} AS tt, {_TOK.format('artist')} AS att FROM dt), po AS (SELECT id, unnest(tt) AS token FROM sg), fr AS (SELECT token, count(*) AS df FROM po GROUP BY 1), bl AS (SELECT DISTINCT x.id AS a, y.id AS b FROM po x JOIN po y ON x.token = y.token AND x.id < y.id WHERE x.token IN (SELECT token FROM fr WHERE df BETWEEN 2 AND 300))"
_MT = "tk AS (SELECT id, tt, list_distinct(list_concat(tt, att)) AS toks FROM sg), mt AS (SELECT a, b FROM (SELECT a, b, list_intersect(x.toks, y.toks) AS bo, x.tt AS ta, y.tt AS tb, x.toks AS ka, y.toks AS kb, CASE WHEN len(x.tt) <= len(y.tt) THEN x.tt ELSE y.tt END AS sm FROM bl JOIN tk x ON x.id = a JOIN tk y ON y.id = b) WHERE len(bo) >= 2 AND (len(ta) > 0 AND len(list_filter(ta, lambda z: NOT list_contains(kb, z))) = 0 OR len(tb) > 0 AND len(list_filter(tb, lambda z: NOT list_contains(ka, z))) = 0) AND len(list_filter(bo, lambda z: NOT list_contains(sm, z))) >= 1 AND (len(sm) > 1 OR length(sm[1]) >= 4) AND EXISTS (SELECT 1 FROM (SELECT unnest(bo) AS z) JOIN fr ON token = z WHERE df <= 6))"
_CC = "es AS (SELECT a AS x, b AS y FROM mt UNION ALL SELECT b, a FROM mt), rc(x, y) AS (SELECT x, y FROM es UNION SELECT rc.x, es.y FROM rc JOIN es ON rc.y = es.x), cc AS (SELECT x AS id, least(x, min(y)) AS root FROM rc GROUP BY x)"


def _docs(t):
    return t.songs


def _signed(t):
    return rs.signed(_docs(t))


@query("token_sets", f"WITH {_SIG} SELECT id, array_to_string(list_sort(tt), ' ') AS tokens FROM sg")
def token_sets(t):
    return _signed(t).select("id", F.array_join(F.sort_array("tt"), " ").alias("tokens"))


@query("token_df", f"WITH {_SIG} SELECT token, df FROM fr")
def token_df(t):
    return rs.frequency(_signed(t))


@query("block_pairs", f"WITH {_SIG} SELECT a, b FROM bl")
def block_pairs(t):
    return rs.blocked(_signed(t))


@query("match_pairs", f"WITH {_SIG}, {_MT} SELECT a, b FROM mt")
def match_pairs(t):
    s = _signed(t)
    return rs.matched(s, rs.blocked(s), rs.frequency(s))


@query("components", f"WITH RECURSIVE {_SIG}, {_MT}, {_CC} SELECT id, root FROM cc")
def components(t):
    s = rs.kept(_signed(t))
    return rs.components(rs.matched(s, rs.blocked(s), rs.frequency(s)))


@query("external_edges", sql("tracks", "SELECT min(id) OVER (PARTITION BY popularity, artist) AS a, id AS b FROM tracks QUALIFY a < b"))
def external(t):
    return rs.same_external(t.tracks.withColumn("external", F.concat_ws("/", "popularity", "artist")), "external")


@query("eligible_clusters", f"WITH RECURSIVE {_SIG}, {_MT}, {_CC}, nn AS (SELECT root, count(*) AS n FROM cc GROUP BY 1 HAVING count(*) BETWEEN 2 AND 4) SELECT DISTINCT root FROM (SELECT root, token, n, count(DISTINCT id) AS have FROM (SELECT cc.root, cc.id, n, unnest(toks) AS token FROM cc JOIN nn USING (root) JOIN tk ON tk.id = cc.id) JOIN fr USING (token) WHERE df <= 6 GROUP BY 1, 2, 3) WHERE have = n")
def eligible(t):
    s = rs.kept(_signed(t))
    df = rs.frequency(s)
    return rs.eligible(rs.components(rs.matched(s, rs.blocked(s), df)), s, df)


@query("canonical_pick", f"WITH RECURSIVE {_SIG}, {_MT}, {_CC} SELECT root, id AS canonical, n FROM (SELECT root, cc.id, count(*) OVER (PARTITION BY root) AS n, row_number() OVER (PARTITION BY root ORDER BY enriched DESC, preview DESC, plays DESC, length(title), cc.id) AS k FROM cc JOIN dt ON dt.id = cc.id) WHERE k = 1")
def canonical(t):
    s = rs.kept(_signed(t))
    return rs.canonical(rs.components(rs.matched(s, rs.blocked(s), rs.frequency(s))), _docs(t))


@query("dedupe_apply")
def apply(t):
    plays = t.plays_ev.select("track_id", "played_at", "source").distinct()
    tracks, plays, n = rs.merged(_docs(t), plays)
    return tracks.agg(F.count("*").alias("tracks")).crossJoin(plays.agg(F.count("*").alias("plays"))).withColumn("merged", F.lit(n))


_REL = "rel AS (SELECT a, b, k - 1 AS depth FROM (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS k FROM (SELECT x.artist AS a, y.artist AS b, count(*) AS n FROM pa x JOIN pa y ON x.playlist_id = y.playlist_id AND x.artist <> y.artist GROUP BY 1, 2)) WHERE k <= 4)"
_PA = "pa AS (SELECT DISTINCT playlist_id, artist FROM playlist_tracks JOIN tracks ON id = track_id)"
_SEED = "sd AS (SELECT artist, row_number() OVER (ORDER BY n DESC, artist) AS seed FROM (SELECT artist, count(*) AS n FROM plays JOIN tracks ON id = track_id GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6))"
_TOPS = "tp AS (SELECT artist, id, title, r FROM (SELECT artist, id, title, row_number() OVER (PARTITION BY artist ORDER BY popularity DESC, id) - 1 AS r FROM tracks) WHERE r < 4)"
_CAND = "cd AS (SELECT id, title, artist, affinity FROM (SELECT tp.id, tp.title, tp.artist, 1.0 / (1 + depth) * 1.0 / (1 + 0.3 * r) AS affinity, row_number() OVER (PARTITION BY lower(tp.title), lower(tp.artist) ORDER BY seed, depth, r, tp.id) AS k FROM sd JOIN rel ON rel.a = sd.artist JOIN tp ON tp.artist = rel.b WHERE tp.id % 3 <> 0) WHERE k = 1)"


@query("related_artists", sql("tracks playlist_tracks", "SELECT a, b, depth FROM rel", f"{_PA}, {_REL}"))
def related(t):
    return rc.related(t.playlist_tracks, t.tracks)


@query("recommend_candidates", sql("tracks plays playlist_tracks", "SELECT id, title, artist, round(affinity, 6)::DOUBLE AS affinity FROM cd", f"{_PA}, {_REL}, {_SEED}, {_TOPS}, {_CAND}"))
def candidates(t):
    c = rc.candidates(m.top_artists(t.plays, t.tracks, 6), rc.related(t.playlist_tracks, t.tracks), t.tracks, known=t.tracks.where("id % 3 = 0"))
    return c.select("id", "title", "artist", R("affinity"))


_TASTE = "ts AS (SELECT avg(energy) AS e, avg(valence) AS v, avg(danceability) AS d FROM features WHERE error IS NULL)"


@query("recommend_rank", sql("tracks plays playlist_tracks features", "SELECT id, round(0.5 * affinity + 0.5 * coalesce(1 / (1 + sqrt((f.energy - e) ^ 2 + (f.valence - v) ^ 2 + (f.danceability - d) ^ 2)), 0.4), 6)::DOUBLE AS score FROM (SELECT * FROM cd ORDER BY affinity DESC, id LIMIT 20) c CROSS JOIN ts LEFT JOIN features f ON f.track_id = c.id AND f.error IS NULL ORDER BY 2 DESC, 1 LIMIT 30",
 f"{_PA}, {_REL}, {_SEED}, {_TOPS}, {_CAND}, {_TASTE}"))
def rank(t):
    c = rc.candidates(m.top_artists(t.plays, t.tracks, 6), rc.related(t.playlist_tracks, t.tracks), t.tracks, known=t.tracks.where("id % 3 = 0"))
    taste = t.features.where("error IS NULL").agg(*[F.avg(n).alias(f"t_{n}") for n in ("energy", "valence", "danceability")])
    return rc.ranked(c, t.features, taste, ["energy", "valence", "danceability"]).select("id", R("score"))


@query("catalogue_match", sql("tracks", "SELECT a.id AS wanted, min(b.id) AS found FROM tracks a JOIN tracks b ON b.artist = a.artist AND b.id <> a.id AND starts_with(lower(b.title), lower(a.title)) GROUP BY 1"))
def catalogue(t):
    return rc.matched(t.tracks, t.tracks)


@query("enrich_states", sql("tracks", "SELECT state, count(*) AS n, count(duration_ms) AS filled FROM (SELECT a.id, CASE WHEN b.id IS NULL THEN -1 ELSE 1 END AS state, coalesce(a.duration_ms, b.duration_ms) AS duration_ms FROM tracks a LEFT JOIN (SELECT * FROM tracks WHERE id % 2 = 0) b ON b.id = a.id + 1) GROUP BY 1"))
def enrich(t):
    found = t.tracks.where("id % 2 = 0").select((F.col("id") - 1).alias("id"), F.col("duration_ms").alias("new_ms"))
    return rc.enriched(t.tracks, found).groupBy("state").agg(F.count("*").alias("n"), F.count("duration_ms").alias("filled"))
