"""Queries over keys, tempo, playlists and retrieval constraints."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.functions import music as mu
from listenlab.operators import playlist as pl

from .bind import UNIT, sql
from .registry import query

R = lambda n: F.round(n, 6).alias(n)
_MAP = "MAP {" + ", ".join(f"'{k} {m}': '{n}{c}'" for d, m, c in ((mu.MAJOR, "major", "B"), (mu.MINOR, "minor", "A")) for k, n in d.items()) + "}"
_FC = f"fc AS (SELECT f.*, {_MAP}[key || ' ' || mode] AS code, ({_MAP}[key || ' ' || mode])[:-2]::INTEGER AS num, right({_MAP}[key || ' ' || mode], 1) AS let FROM features f)"
_CODES = "codes AS (SELECT code, code[:-2]::INTEGER AS num, right(code, 1) AS let FROM (SELECT n || l AS code FROM (SELECT unnest(range(1, 13)) AS n), (SELECT unnest(['A', 'B']) AS l))), pr AS (SELECT a.code AS a, b.code AS b, least((a.num - b.num + 12) % 12, (b.num - a.num + 12) % 12) AS d, a.let = b.let AS same FROM codes a, codes b)"
_TRANS = "CASE WHEN d = 0 AND same THEN 1.0 WHEN d = 0 THEN 0.9 WHEN d = 1 AND same THEN 0.85 WHEN d = 2 AND same THEN 0.5 ELSE 0.15 END::DOUBLE"


def _fc(t):
    return t.features.withColumn("code", mu.wheel(F.col("key"), F.col("mode")))


def _pairs(t):
    one = t.spark.range(1, 13).crossJoin(t.spark.createDataFrame([("A",), ("B",)], "l string")).select(F.concat("id", "l").alias("code"))
    return one.select(F.col("code").alias("a")).crossJoin(one.select(F.col("code").alias("b")))  # 24 x 24 codes


@query("wheel_codes", sql("features", "SELECT track_id, code FROM fc", _FC))
def codes(t):
    return _fc(t).select("track_id", "code")


@query("key_transitions", f"WITH {_CODES} SELECT a, b, {_TRANS} AS score, (d + CASE WHEN same THEN 0 ELSE 1 END)::INTEGER AS distance FROM pr")
def transitions(t):
    return _pairs(t).select("a", "b", mu.transition(F.col("a"), F.col("b")).alias("score"), mu.distance(F.col("a"), F.col("b")).cast("int").alias("distance"))


@query("key_compatible", sql("features", "SELECT track_id, num || let || ',' || (num % 12 + 1) || let || ',' || ((num + 10) % 12 + 1) || let || ',' || num || CASE WHEN let = 'A' THEN 'B' ELSE 'A' END AS codes FROM fc", _FC))
def compatible(t):
    return _fc(t).select("track_id", F.array_join(mu.compatible(F.col("code")), ",").alias("codes"))


@query("tempo_window", sql("features", "SELECT track_id, round(bpm, 6) AS bpm FROM features WHERE bpm BETWEEN 80 AND 88 OR bpm * 2 BETWEEN 80 AND 88 OR bpm / 2 BETWEEN 80 AND 88"))
def window(t):
    return t.features.where(mu.half_double(F.col("bpm"), F.lit(80.0), F.lit(88.0))).select("track_id", R("bpm"))


@query("cadence_window", sql("features", "SELECT track_id FROM features WHERE bpm BETWEEN 170 * 0.97 AND 170 * 1.03 OR bpm * 2 BETWEEN 170 * 0.97 AND 170 * 1.03 OR bpm / 2 BETWEEN 170 * 0.97 AND 170 * 1.03"))
def cadence(t):
    return t.features.where(mu.cadence(F.col("bpm"), 170, 0.03)).select("track_id")


@query("filtered_candidates", sql("tracks plays features", """SELECT f.track_id FROM fc f JOIN tracks t ON t.id = f.track_id WHERE f.error IS NULL AND t.duration_ms >= 45000 AND f.speechiness <= 0.65 AND (f.bpm BETWEEN 90 AND 130 OR f.bpm * 2 BETWEEN 90 AND 130 OR f.bpm / 2 BETWEEN 90 AND 130)
 AND least((num - 8 + 12) % 12, (8 - num + 12) % 12) + CASE WHEN let = 'B' THEN 0 ELSE 1 END <= 2 AND substr(release_date, 1, 4)::INTEGER BETWEEN 1960 AND 2015 AND f.track_id NOT IN (1, 2, 3) AND t.artist <> 'Brand#11' AND f.track_id NOT IN (SELECT track_id FROM plays WHERE year(played_at) = 2000 AND source = 'A')""", _FC))
def candidates(t):  # FLT10
    from listenlab.operators.retrieve import Constraints, passing

    rows = _fc(t).join(t.tracks, F.col("track_id") == F.col("id")).withColumn("year", F.substring("release_date", 1, 4).try_cast("int"))
    heard = t.plays.where("source = 'A' AND played_at >= timestamp_ntz '2000-01-01' AND played_at < timestamp_ntz '2001-01-01'").select("track_id").distinct()
    c = Constraints(exclude=(1, 2, 3), min_duration_ms=45_000, max_slop=0.65, bpm=(90.0, 130.0), near_key="8B", years=(1960, 2015), exclude_artists=("Brand#11",))
    return passing(rows.withColumn("slop", F.col("speechiness")), c, heard).select("track_id")


_USE = {u: " + ".join(f"{w} * " + ("bpm / 180" if n == "bpm" else f"(1 - {n[1:]})" if n[0] == "-" else n) for n, w in d.items()) for u, d in mu.USES.items()}


@query("use_case", sql("features", "SELECT track_id, use, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY score DESC, i) AS k FROM u) WHERE k = 1",
 "u AS (" + " UNION ALL ".join(f"SELECT track_id, {i} AS i, '{u}' AS use, round({e}, 9) AS score FROM features" for i, (u, e) in enumerate(_USE.items())) + ")"))
def use(t):
    return t.features.select("track_id", mu.best_use().alias("b")).select("track_id", "b.use", F.round("b.score", 6).alias("score"))


_SIG = list(mu.SLOP)[:6]
_SLP = "s AS (SELECT track_id, " + ", ".join(f"{'CASE WHEN track_id % 3 <> 0 THEN ' + u + ' END' if i == 5 else u} AS {n}" for i, (n, u) in enumerate(zip(_SIG, UNIT))) + ", dynamic_range * 4 AS seconds FROM features)"


@query("slop_prior", sql("features", "SELECT track_id, round(p, 6) AS score, round(c, 6) AS confidence, CASE WHEN c < .35 THEN 'unclear' WHEN p >= .65 THEN 'likely generated' WHEN p <= .3 THEN 'likely human-performed' ELSE 'machine-produced, origin unclear' END AS verdict FROM (SELECT track_id, 1 / (1 + exp(-(-2.4 + "
 + " + ".join(f"{mu.SLOP[n]} * coalesce({n}, 0)" for n in _SIG) + "))) AS p, (" + " + ".join(f"({n} IS NOT NULL)::INTEGER" for n in _SIG) + ") / 9.0::DOUBLE * (.6 + .4 * least(seconds / 60, 1)) AS c FROM s)", _SLP))
def slop(t):  # MT13, MT14
    sig = {n: F.when(F.col("track_id") % 3 != 0, F.col(u)) if i == 5 else F.col(u) for i, (n, u) in enumerate(zip(_SIG, UNIT))}
    p, c = mu.slop_prior(sig, F.col("dynamic_range") * 4)
    return t.features.select("track_id", F.round(p, 6).alias("score"), F.round(c, 6).alias("confidence"), mu.verdict(p, c).alias("verdict"))


@query("energy_arcs", "SELECT i::BIGINT AS i, round(.35 + .5 * i / 10.0, 6)::DOUBLE AS rise, round(.85 - .5 * i / 10.0, 6)::DOUBLE AS fall, round(.35 + .55 * sin(pi() * i / 10.0), 6) AS peak, 0.6::DOUBLE AS flat FROM range(11) r(i)")
def arcs(t):  # MT10
    at = F.col("i") / 10.0
    return t.spark.range(11).withColumnRenamed("id", "i").select("i", *[F.round(mu.arc(k, at), 6).alias(k) for k in ("rise", "fall", "peak", "flat")])


@query("loudness_energy", sql("features", "SELECT track_id, round(greatest(least((loudness_db + 26) / 18, 1), 0), 6) AS energy FROM features"))
def loud(t):
    return t.features.select("track_id", F.round(mu.energy_of_lufs(F.col("loudness_db")), 6).alias("energy"))


_PT = "pt AS (SELECT playlist_id, position, fc.* FROM playlist_tracks JOIN fc USING (track_id) WHERE error IS NULL), nx AS (SELECT playlist_id, position, num, let, bpm, lead(num) OVER w AS num2, lead(let) OVER w AS let2, lead(bpm) OVER w AS bpm2 FROM pt WINDOW w AS (PARTITION BY playlist_id ORDER BY position))"


def _items(t):
    return t.playlist_tracks.join(_fc(t).where("error IS NULL"), "track_id")


@query("playlist_flow", sql("playlist_tracks features", "SELECT playlist_id, count(*) AS steps, round(avg(s), 6) AS harmonic, round(avg((s >= .85)::INTEGER), 6) AS good, round(avg(abs(bpm2 - bpm)), 6) AS bpm_step FROM x GROUP BY 1",
 f"{_FC}, {_PT}, x AS (SELECT *, {_TRANS} AS s FROM (SELECT *, least((num - num2 + 12) % 12, (num2 - num + 12) % 12) AS d, let = let2 AS same FROM nx WHERE num2 IS NOT NULL))"))
def flow(t):
    return pl.flow(_items(t)).select("playlist_id", "steps", R("harmonic"), R("good"), R("bpm_step"))


_RAW = "1 - (" + " + ".join(f"stddev_pop({n})" for n in UNIT) + ") / 8"


@query("playlist_dna", sql("playlist_tracks features", f"SELECT playlist_id, n, {', '.join(f'round({x}, 6) AS {x}' for x in UNIT)}, round(greatest(least(c, 1), 0), 6) AS cohesion, CASE WHEN c > .85 THEN 'Very tight / single vibe' WHEN c > .7 THEN 'Cohesive' WHEN c > .5 THEN 'Varied' ELSE 'All over the place' END AS kind FROM g",
 f"{_FC}, {_PT}, g AS (SELECT playlist_id, count(*) AS n, {', '.join(f'avg({x}) AS {x}' for x in UNIT)}, {_RAW} AS c FROM pt GROUP BY 1 HAVING count(*) >= 2)"))
def dna(t):
    return pl.dna(_items(t), UNIT).select("playlist_id", "n", *map(R, UNIT), R("cohesion"), "kind")


@query("playlist_duplicates", sql("playlist_tracks tracks", "SELECT playlist_id, position, track_id FROM (SELECT playlist_id, position, track_id, row_number() OVER (PARTITION BY playlist_id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), regexp_replace(lower(artist), '[^a-z0-9]', '', 'g') ORDER BY position) AS k FROM playlist_tracks JOIN tracks ON id = track_id) WHERE k > 1"))
def duplicates(t):
    return pl.duplicates(t.playlist_tracks.join(t.tracks, F.col("track_id") == F.col("id"))).select("playlist_id", "position", "track_id")


_D = "sqrt(" + " + ".join(f"(pt.{n} - c.{n}) ^ 2" for n in UNIT) + ")"


@query("playlist_outliers", sql("playlist_tracks features", "SELECT playlist_id, position, track_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY distance DESC, position) AS k FROM d WHERE distance > .35) WHERE k <= 3",
 f"{_FC}, {_PT}, c AS (SELECT playlist_id, {', '.join(f'avg({n}) AS {n}' for n in UNIT)} FROM pt GROUP BY 1), d AS (SELECT pt.playlist_id, position, track_id, round({_D}, 9) AS distance FROM pt JOIN c USING (playlist_id))"))
def outliers(t):
    return pl.outliers(_items(t), UNIT).withColumn("distance", F.round("distance", 6))


@query("playlist_top_genres", sql("playlist_tracks tracks", "SELECT playlist_id, genre, n FROM (SELECT *, row_number() OVER (PARTITION BY playlist_id ORDER BY n DESC, genre) AS k FROM (SELECT playlist_id, genre, count(*) AS n FROM playlist_tracks JOIN tracks ON id = track_id GROUP BY 1, 2)) WHERE k <= 5"))
def top_genres(t):
    return pl.top_values(t.playlist_tracks.join(t.tracks, F.col("track_id") == F.col("id")), "genre")


#: Ids of analysed tracks, at most, that lines are looked up in before they are sorted: some 32 MB.
_LOOKED_UP = 1_000_000


def _in_order(t):
    """Items whose positions tell no more than their order, so only the lines of analysed tracks are sorted."""
    f = _fc(t).where("error IS NULL").select("track_id", "energy", "bpm", "code")
    ids = f.select(F.col("track_id").alias("l_partkey"))
    ids = F.broadcast(ids) if t.raw("embeddings").count() <= _LOOKED_UP else ids
    return t.listed(t.raw("lineitem").join(ids, "l_partkey", "left_semi")).join(f, "track_id")


@query("reorder_playlist")
def reorder(t):
    return pl.reorder(_in_order(t))


@query("sequence_set")
def sequence(t):
    return pl.sequence(_in_order(t), "peak")
