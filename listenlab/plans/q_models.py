"""Queries that fit or apply models."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.operators import models as md
from listenlab.operators import stats as st
from listenlab.operators import vectors as vc

from .bind import UNIT, sql
from .registry import query

R = lambda n: F.round(n, 6).alias(n)


@query("kmeans_clusters")
def kmeans(t):
    return md.clusters(vc.standardised(t.features, UNIT))


@query("cluster_profiles")
def cluster_profiles(t):
    c = md.clusters(vc.standardised(t.features, UNIT)).drop("cost").join(t.features, "track_id")
    per = c.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(n).alias(n) for n in (*UNIT, "bpm")])
    label = md.cluster_label(*[F.col(n) for n in ("energy", "valence", "danceability", "acousticness", "instrumentalness", "bpm")])
    return md.distinct_labels(per.select("cluster", "size", label.alias("label"), F.col("bpm").alias("tempo")))


@query("pca_map")
def pca(t):
    z = vc.standardised(t.features, UNIT)
    axes, _ = vc.top_components(z, 2)
    from listenlab.functions.arrays import dot

    return z.select("track_id", *[dot(F.col("vec"), F.array(*[F.lit(float(x)) for x in a])).alias(n) for n, a in zip(("x", "y"), axes, strict=True)])


@query("taste_fit")
def taste(t):
    return md.taste(t.vectors.select("track_id", "vec"), st.thirds(t.play_counts.join(t.vectors.select("track_id"), "track_id", "left_semi")))


_W = [round(0.1 * (i % 7 - 3), 1) for i in range(64)]


@query("taste_apply", sql("vectors", f"SELECT track_id, round(1 / (1 + exp(-(list_inner_product(vec, {_W}::DOUBLE[]) + 0.25))), 6) AS score FROM vectors"))
def taste_apply(t):
    return md.apply_probe(t.vectors, _W, 0.25).select("track_id", R("score"))


@query("implicit_labels", sql("plays_ev tracks", "SELECT track_id, round(avg(o), 6)::DOUBLE AS value, round(least(count(*), 5) * 0.1, 6)::DOUBLE AS weight FROM (SELECT p.track_id, CASE WHEN skipped AND played_ms < 30000 THEN 0.0 WHEN played_ms >= 0.8 * duration_ms THEN 1.0 END AS o FROM plays_ev p JOIN tracks ON id = p.track_id) WHERE o IS NOT NULL GROUP BY 1"))
def implicit(t):
    p = t.plays_ev.join(t.tracks.select(F.col("id").alias("track_id"), "duration_ms"), "track_id")
    return md.implicit(p).select("track_id", R("value"), R("weight"))


@query("taste_head")
def taste_head(t):
    rows = t.labels.where("axis = 'quality'").join(t.vectors, "track_id").select("track_id", "vec", "value", F.lit(1.0).alias("w"))
    m = md.head(rows, True)
    return md.apply_probe(t.vectors, list(m.coefficients), m.intercept)


@query("suggest_labels")
def suggest(t):
    return md.suggested(md.apply_probe(t.vectors, _W, 0.0), t.vectors, 10)


@query("slop_fit")
def slop_fit(t):
    rows = t.features.where("error IS NULL").withColumn("label", (F.col("mode") == "major").cast("double"))
    m = md.calibrated(rows, UNIT)
    return md.contributions(t.features, UNIT, list(m.coefficients), m.intercept).select("track_id", "score")


@query("slop_contributions", sql("features", "SELECT track_id, round(1 / (1 + exp(-(0.5 * energy - 0.7 * valence + 0.1))), 6) AS score, round(0.5 * energy, 6) AS energy_part FROM features"))
def contributions(t):
    c = md.contributions(t.features, ["energy", "valence"], [0.5, -0.7], 0.1)
    return c.select("track_id", R("score"), F.round(F.element_at("contributions", "energy"), 6).alias("energy_part"))


@query("taste_picks", sql("vectors plays play_counts", "SELECT 'top' AS kind, track_id, round(score, 6) AS score, plays, row_number() OVER (ORDER BY score DESC, track_id)::INTEGER AS place FROM sc QUALIFY place <= 25 UNION ALL SELECT 'gem', track_id, round(score, 6), plays, row_number() OVER (ORDER BY score DESC, track_id)::INTEGER AS place FROM sc WHERE plays <= 2 QUALIFY place <= 15", f"sc AS (SELECT track_id, 1 / (1 + exp(-(list_inner_product(vec, {_W}::DOUBLE[]) + 0.25))) AS score, coalesce(plays, 0) AS plays FROM vectors LEFT JOIN (SELECT track_id, plays % 9 AS plays FROM play_counts) USING (track_id))"))
def taste_picks(t):  # ML5
    few = t.play_counts.withColumn("plays", F.col("plays") % 9)
    return md.picks(md.apply_probe(t.vectors, _W, 0.25), few).select("kind", "track_id", R("score"), "plays", "place")


@query("taste_drivers")
def taste_drivers(t):  # ML5
    z = vc.standardised(t.features, UNIT)
    rows = st.thirds(t.play_counts.join(z.select("track_id"), "track_id", "left_semi")).join(z, "track_id")
    m = md.probe(rows.withColumn("w", F.when(F.col("label") == 1, 1 + F.log1p(F.col("plays").cast("double")) / 3).otherwise(1.0)))
    return t.spark.createDataFrame(md.drivers(UNIT, list(m.coefficients)), "feature string, weight double, direction string")


@query("layer_profile")
def layer_profile(t):  # ML9: four layers of sixteen
    rows = t.vectors.join(t.features.select("track_id", (F.col("mode") == "major").cast("double").alias("value")), "track_id").withColumn("w", F.lit(1.0))
    found = md.layer_profile(rows, 4, {"low": (0, 1), "mid": (1, 3), "high": (3, 9)})
    return t.spark.createDataFrame(found, "band string, auc double")


@query("slop_validation")
def slop_validation(t):  # ML10
    rows = t.features.where("error IS NULL").select("track_id", F.array(*UNIT).alias("vec"), (F.col("mode") == "major").cast("double").alias("value"), F.lit(1.0).alias("w"))
    return t.spark.createDataFrame([(md.cross_validated(rows, 0.5),)], "auc double")
