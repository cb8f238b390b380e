"""Queries over measured features."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.operators import macro as m
from listenlab.operators import stats as s

from .bind import UNIT, sql
from .registry import query

FIVE = UNIT[:5]
R = lambda n: F.round(n, 6).alias(n)
_W = "w AS (SELECT f.*, coalesce(n, 1)::DOUBLE AS w FROM features f LEFT JOIN (SELECT track_id, count(*) AS n FROM plays GROUP BY 1) p USING (track_id) WHERE error IS NULL)"
_MEAN = ", ".join(f"round(sum({n} * w) / sum(w), 6) AS {n}" for n in FIVE)


@query("audio_profile_mean", sql("plays features", f"SELECT {_MEAN} FROM w", _W))
def profile(t):
    return s.profile(s.weighted(t.features, t.plays), FIVE).select(*map(R, FIVE))


@query("taste_vector", sql("plays features", f"SELECT {_MEAN} FROM w", _W))
def taste_vector(t):
    return s.taste_vector(s.weighted(t.features, t.plays), FIVE).select(*map(R, FIVE))


@query("key_histogram", sql("plays features", "SELECT trim(concat_ws(' ', key, mode)) AS key, sum(w)::BIGINT AS plays FROM w GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12", _W))
def keys(t):
    return s.key_histogram(s.weighted(t.features, t.plays))


@query("feature_histogram", sql("plays features", " UNION ALL ".join(f"SELECT '{n}' AS feature, least(floor({n} * 10), 9)::INTEGER AS bucket, count(*) AS n FROM w GROUP BY 2" for n in UNIT), _W))
def hist(t):
    return s.histogram(s.weighted(t.features, t.plays), UNIT)


@query("mood_over_time", sql("plays features", f"SELECT strftime(played_at, '%Y-%m') AS month, {', '.join(f'round(avg({n}), 6) AS {n}' for n in FIVE)}, count(*) AS plays FROM plays JOIN features USING (track_id) WHERE error IS NULL GROUP BY 1"))
def mood_time(t):
    return s.mood_over_time(t.plays, t.features, FIVE).select("month", *map(R, FIVE), "plays")


@query("mood_quadrant", sql("features", "SELECT CASE WHEN energy >= .5 AND valence >= .5 THEN 'Energetic & Happy (hype)' WHEN energy >= .5 THEN 'Energetic & Tense (intense)' WHEN valence >= .5 THEN 'Calm & Happy (chill)' ELSE 'Calm & Sad (melancholic)' END AS mood, count(*) AS n FROM features WHERE error IS NULL GROUP BY 1"))
def quadrant(t):
    return t.features.where("error IS NULL").groupBy(s.mood(F.col("energy"), F.col("valence")).alias("mood")).agg(F.count("*").alias("n"))


@query("feature_stats", sql("features", " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS std, round(min({n}), 6) AS min, round(quantile_cont({n}, .25), 6) AS q25, round(median({n}), 6) AS median, round(quantile_cont({n}, .75), 6) AS q75, round(max({n}), 6) AS max FROM features WHERE error IS NULL" for n in UNIT)))
def stats(t):
    return s.feature_stats(t.features, UNIT).select("feature", *map(R, ["mean", "std", "min", "q25", "median", "q75", "max"]))


_PAIRS = [(a, b) for i, a in enumerate(UNIT) for b in UNIT[i + 1 :]]


@query("feature_corr", sql("features", " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM features WHERE error IS NULL" for a, b in _PAIRS)))
def corr(t):
    return s.correlations(t.features, UNIT).select("a", "b", R("r"))


@query("strong_correlations", sql("features", "SELECT a, b, round(r, 6) AS r FROM c WHERE abs(r) >= 0.05 ORDER BY abs(r) DESC, a, b LIMIT 5", "c AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM features WHERE error IS NULL" for a, b in _PAIRS) + ")"))
def strong(t):
    c = s.correlations(t.features, UNIT).where(F.abs("r") >= 0.05)
    return c.orderBy(F.abs("r").desc(), "a", "b").limit(5).select("a", "b", R("r"))


_TF = "tf AS (SELECT t.artist, concat(substr(t.release_date, 1, 3), '0s') AS era, f.* FROM features f JOIN tracks t ON t.id = f.track_id WHERE f.error IS NULL)"


def _tf(t):
    return t.features.where("error IS NULL").join(t.tracks.select("id", "artist", m.era(F.col("release_date")).alias("era")), F.col("track_id") == F.col("id"))


_Z = ", ".join(f"(avg({n}) - (SELECT avg({n}) FROM tf)) / ((SELECT stddev_pop({n}) FROM tf) + 1e-6) AS z_{n}" for n in UNIT)


@query("artist_signature", sql("tracks features", "SELECT artist, n, feature, round(z, 6) AS z FROM (SELECT artist, n, feature, z, row_number() OVER (PARTITION BY artist ORDER BY abs(z) DESC, feature DESC) AS k FROM l) WHERE k = 1",
 f"{_TF}, g AS (SELECT artist, count(*) AS n, {_Z} FROM tf GROUP BY 1), l AS (" + " UNION ALL ".join(f"SELECT artist, n, '{n}' AS feature, z_{n} AS z FROM g" for n in UNIT) + ")"))
def signature(t):
    return s.signatures(_tf(t), "artist", UNIT).select("artist", "n", "feature", R("z"))


@query("era_drift", sql("tracks features", f"SELECT era, {', '.join(f'round(avg({n}), 6) AS {n}' for n in FIVE)}, count(*) AS n FROM tf GROUP BY 1 HAVING count(*) >= 2", _TF))
def drift(t):
    return s.drift(_tf(t), FIVE).select("era", *map(R, FIVE), "n")


@query("era_change", sql("tracks features", "SELECT min(era) AS first_era, max(era) AS last_era, " + ", ".join(f"round(max_by({n}, era) - min_by({n}, era), 6) AS {n}" for n in FIVE) + " FROM d",
 _TF + f", d AS (SELECT era, {', '.join(f'avg({n}) AS {n}' for n in FIVE)} FROM tf GROUP BY 1 HAVING count(*) >= 2)"))
def change(t):
    return s.first_last(s.drift(_tf(t), FIVE), FIVE).select("first_era", "last_era", *map(R, FIVE))


@query("tempo_mode", sql("features", "SELECT bin, round(lo + bin * (hi - lo) / 8, 6) AS low, count(*) AS n FROM b GROUP BY ALL ORDER BY n DESC, bin LIMIT 1",
 "x AS (SELECT min(bpm) AS lo, max(bpm) AS hi FROM features WHERE error IS NULL), b AS (SELECT least(floor((bpm - lo) / ((hi - lo) / 8)), 7)::INTEGER AS bin, lo, hi FROM features, x WHERE error IS NULL)"))
def tempo(t):
    return s.mode_bin(t.features, "bpm").withColumn("low", F.round("low", 6))


@query("extreme_dynamics", sql("features", "SELECT (SELECT track_id FROM f ORDER BY dynamic_range, track_id LIMIT 1) AS least_id, (SELECT round(min(dynamic_range), 6) FROM f) AS least, (SELECT track_id FROM f ORDER BY dynamic_range DESC, track_id LIMIT 1) AS most_id, (SELECT round(max(dynamic_range), 6) FROM f) AS most",
 "f AS (SELECT * FROM features WHERE error IS NULL)"))
def extremes(t):
    return s.extremes(t.features, "dynamic_range").select("least_id", R("least"), "most_id", R("most"))


@query("track_percentiles", sql("features", "SELECT track_id, round(energy, 6) AS energy, round(100.0 * (rank() OVER (ORDER BY energy) - 1) / (count(*) OVER ()), 6) AS percentile FROM features WHERE error IS NULL"))
def percentiles(t):
    return s.percentiles(t.features.where("error IS NULL"), "energy").select("track_id", R("energy"), R("percentile"))


@query("popularity_percentiles", sql("plays play_counts", "SELECT track_id, plays, round(100.0 * (rank() OVER (ORDER BY plays) - 1) / (count(*) OVER ()), 6) AS percentile FROM play_counts"))
def popularity(t):
    return s.percentiles(t.play_counts, "plays").select("track_id", "plays", R("percentile"))


@query("play_thirds", sql("plays play_counts", "SELECT track_id, plays, (i > n - n // 3)::INTEGER AS label FROM (SELECT *, row_number() OVER (ORDER BY plays, track_id) AS i, count(*) OVER () AS n FROM play_counts) WHERE i <= n // 3 OR i > n - n // 3"))
def thirds(t):
    return s.thirds(t.play_counts)


@query("auc_rank", sql("features", "SELECT round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0)), 6) AS auc FROM q",
 "p AS (SELECT (mode = 'major')::INTEGER AS y, round(energy, 2) AS v FROM features), q AS (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM p)"))
def auc(t):
    return s.auc(t.features.select((F.col("mode") == "major").cast("int").alias("label"), F.round("energy", 2).alias("score"))).select(R("auc"))


@query("set_contrast", sql("features", " UNION ALL ".join(f"SELECT '{n}' AS feature, round((avg({n}) FILTER (track_id % 10 = 3) - avg({n}) FILTER (track_id % 10 <> 3)) / (stddev_pop({n}) FILTER (track_id % 10 <> 3) + 1e-6), 6) AS z FROM features WHERE error IS NULL" for n in UNIT)))
def contrast(t):
    return s.contrast(t.features.where("error IS NULL"), F.col("track_id") % 10 == 3, UNIT).select("feature", R("z"))


@query("library_summary", sql("features", "SELECT count(*) AS tracks, round(median(bpm), 6) AS bpm, round(median(loudness_db), 6) AS loudness_db, round(avg((energy > 0.6)::INTEGER), 6) AS flag_rate FROM features WHERE error IS NULL"))
def summary(t):  # AG41
    return t.features.where("error IS NULL").agg(F.count("*").alias("tracks"), F.median("bpm").alias("bpm"), F.median("loudness_db").alias("loudness_db"), (F.count_if(F.col("energy") > 0.6) / F.count("*")).alias("flag_rate")).select(
        "tracks", R("bpm"), R("loudness_db"), R("flag_rate"))


_SEC = "s AS (SELECT track_id, unnest([0, 30, 60, 90, 120]) AS start, unnest([30, 60, 90, 120, 150 + track_id % 7]) AS stop, unnest([0, 1, 0, 1 + track_id % 2, 2]) AS label FROM features)"


@query("repetition_index", sql("features", "SELECT track_id, round(sum(CASE WHEN k > 1 THEN d ELSE 0 END) / sum(d)::DOUBLE, 6) AS repetition FROM (SELECT track_id, label, count(*) AS k, sum(stop - start) AS d FROM s GROUP BY 1, 2) GROUP BY 1", _SEC))
def repetition(t):  # AG42
    spans = F.arrays_zip(F.array(*map(F.lit, [0, 30, 60, 90, 120])).alias("start"), F.array(F.lit(30), F.lit(60), F.lit(90), F.lit(120), (150 + F.col("track_id") % 7)).cast("array<bigint>").alias("stop"), F.array(F.lit(0), F.lit(1), F.lit(0), 1 + F.col("track_id") % 2, F.lit(2)).cast("array<bigint>").alias("label"))
    rows = t.features.select("track_id", F.explode(spans).alias("x")).select("track_id", "x.start", "x.stop", "x.label")
    per = rows.groupBy("track_id", "label").agg(F.count("*").alias("k"), F.sum(F.col("stop") - F.col("start")).alias("d"))
    return per.groupBy("track_id").agg((F.sum(F.when(F.col("k") > 1, F.col("d")).otherwise(0)) / F.sum("d")).alias("repetition")).select("track_id", R("repetition"))
