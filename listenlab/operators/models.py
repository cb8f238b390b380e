"""Clusters, taste probes, active learning and calibration."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions.arrays import dot, unit

from .stats import auc


def clusters(rows: DataFrame, k: int = 4, seed: int = 0) -> DataFrame:
    """ML1: (track_id, cluster) by Lloyd's algorithm, at most 50 rounds."""
    data = rows.withColumn("features", array_to_vector("vec"))
    model = KMeans(k=k, seed=seed, maxIter=50, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("track_id", "cluster", F.lit(float(model.summary.trainingCost)).alias("cost"))


def cluster_label(e: Column, v: Column, d: Column, ac: Column, ins: Column, bpm: Column) -> Column:
    """C4: a name for a cluster's means, by the first rule that holds. The texts are fixed values."""
    fast, slow = bpm >= 130, bpm < 95
    return (
        F.when((ins > 0.6) & (e < 0.5), "Instrumental / ambient").when((ac > 0.55) & (e < 0.55) & slow, "Slow & acoustic").when((ac > 0.55) & (e < 0.55), "Acoustic / mellow")
        .when((e >= 0.6) & (v >= 0.55) & fast & (d >= 0.55), "Dancefloor bangers").when((e >= 0.6) & (v >= 0.55) & fast, "Feel-good & fast").when((e >= 0.6) & (v >= 0.55), "Upbeat & bright")
        .when((e >= 0.6) & fast, "Dark & driving").when(e >= 0.6, "Dark & energetic").when(v < 0.45, "Moody / introspective").when(slow, "Slow & warm").otherwise("Chill / easy")
    )


def distinct_labels(rows: DataFrame) -> DataFrame:
    """WN13: (label, size, tempo): a label met again, in order of size, gets its tempo."""
    w = Window.partitionBy("label").orderBy(F.col("size").desc(), "tempo")
    return rows.withColumn("name", F.when(F.row_number().over(w) > 1, F.concat("label", F.lit(" · "), F.col("tempo").cast("int"), F.lit(" BPM"))).otherwise(F.col("label")))


def probe(rows: DataFrame, reg: float = 0.01):
    """ML3, ML5: weighted logistic regression of (vec, label, w)."""
    data = rows.select(array_to_vector("vec").alias("features"), F.col("label").cast("double").alias("label"), F.col("w").cast("double").alias("w"))
    return LogisticRegression(regParam=reg, maxIter=100, weightCol="w").fit(data)


def apply_probe(rows: DataFrame, weights: list[float], offset: float) -> DataFrame:
    """ML6: (track_id, score) by fixed weights, without leaving the JVM."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return rows.select("track_id", (1 / (1 + F.exp(-(dot(F.col("vec"), w) + offset)))).alias("score"))


def taste(vectors: DataFrame, labelled: DataFrame, least: int = 40) -> DataFrame | None:
    """ML5: scores of all rows by a probe on three quarters of (track_id, label, plays); the rest is marked held out. None if there are too few."""
    if labelled.count() < least:
        return None
    rows = labelled.join(vectors, "track_id").withColumns(
        {"held": F.pmod(F.xxhash64("track_id"), F.lit(4)) == 0, "w": F.when(F.col("label") == 1, 1 + F.log1p(F.col("plays").cast("double")) / 3).otherwise(1.0)}
    )
    m = probe(rows.where("NOT held"))
    scored = apply_probe(vectors, list(m.coefficients), m.intercept)
    return scored.join(rows.select("track_id", "label", "held"), "track_id", "left")


def drivers(names: list[str], weights: list[float], k: int = 10) -> list[tuple[str, float, str]]:
    """ML5: the named features of most weight, and which way they pull. The texts are fixed values."""
    strongest = sorted(zip(names, weights, strict=True), key=lambda nw: (-abs(nw[1]), nw[0]))[:k]
    return [(n, float(w), "you like more" if w > 0 else "you like less") for n, w in strongest]


def picks(scored: DataFrame, plays: DataFrame, top: int = 25, gems: int = 15, rarely: int = 2) -> DataFrame:
    """ML5: (kind, place, track_id, score, plays): the tracks of highest score, and of those hardly ever played."""
    j = scored.join(plays, "track_id", "left").select("track_id", "score", F.coalesce("plays", F.lit(0)).alias("plays"))
    best = lambda rows, k, kind: rows.orderBy(F.col("score").desc(), "track_id").limit(k).select(F.lit(kind).alias("kind"), "track_id", "score", "plays")
    both = best(j, top, "top").unionByName(best(j.where(F.col("plays") <= rarely), gems, "gem"))
    return both.withColumn("place", F.row_number().over(Window.partitionBy("kind").orderBy(F.col("score").desc(), "track_id")))


def cross_validated(rows: DataFrame, c: float, folds: int = 5) -> float | None:
    """ML9, ML10: mean AUC over folds by hash of the id, each scored by a head that never saw it; None if a label has fewer rows than two folds."""
    rows = rows.withColumn("_fold", F.pmod(F.xxhash64("track_id"), F.lit(folds)))
    few = rows.groupBy("value").agg(F.count("*").alias("n")).agg(F.min("n").alias("n"), F.count("*").alias("kinds")).first()
    if few["kinds"] < 2 or few["n"] < 2 * folds:
        return None
    found = []
    for k in range(folds):
        m = head(rows.where(F.col("_fold") != k), True, c)
        held = rows.where(F.col("_fold") == k)
        scored = apply_probe(held, list(m.coefficients), m.intercept).join(held.select("track_id", F.col("value").cast("int").alias("label")), "track_id")
        found.append(auc(scored.select("label", "score")).first()["auc"])
    known = [x for x in found if x is not None]
    return sum(known) / len(known) if known else None


#: Bands of layers, first and behind the last.
BANDS = {"production": (0, 5), "performance": (5, 10), "structure": (10, 25)}


def layer_profile(rows: DataFrame, layers: int, bands: dict[str, tuple[int, int]] | None = None, c: float = 0.4) -> list[tuple[str, float | None]]:
    """ML9: cross-validated AUC of a label (track_id, vec, value, w) by the layers of each band of stacked vectors; bands behind the last layer are left out."""
    size = F.floor(F.size("vec") / layers).cast("int")
    out = []
    for name, (lo, hi) in (bands or BANDS).items():
        hi = min(hi, layers)
        if lo < hi:
            part = F.slice("vec", (lo * size + 1).cast("int"), ((hi - lo) * size).cast("int"))
            out.append((name, cross_validated(rows.withColumn("vec", unit(part)), c)))
    return out


def implicit(plays: DataFrame, done: float = 0.8, skip_ms: int = 30_000) -> DataFrame:
    """AG37: (track_id, value, weight) from plays (played_ms, skipped, duration_ms): early skips 0, plays nearly to the end 1, others say nothing."""
    outcome = F.when(F.col("skipped") & (F.col("played_ms") < skip_ms), 0.0).when(F.col("played_ms") >= done * F.col("duration_ms"), 1.0)
    per = plays.withColumn("o", outcome).where("o IS NOT NULL").groupBy("track_id").agg(F.avg("o").alias("value"), F.count("*").alias("n"))
    return per.select("track_id", "value", (F.least("n", F.lit(5)) * 0.1).alias("weight"))


def head(rows: DataFrame, binary: bool, c: float = 0.4):
    """ML7: taste head of (vec, value, w): balanced logistic regression for 0/1 labels, ridge for others."""
    data = rows.select(array_to_vector("vec").alias("features"), F.col("value").cast("double").alias("label"), F.col("w").cast("double").alias("w"))
    if not binary:
        return LinearRegression(regParam=1.0, elasticNetParam=0.0, weightCol="w").fit(data)
    n = data.groupBy("label").agg(F.count("*").alias("n"))
    total = data.count()
    data = data.join(F.broadcast(n), "label").withColumn("w", F.col("w") * total / (2.0 * F.col("n")))
    return LogisticRegression(regParam=1 / (c * max(total, 1)), weightCol="w", maxIter=100).fit(data)


def suggested(scored: DataFrame, vectors: DataFrame, n: int, most: float = 0.9) -> DataFrame:
    """ML8: the n most uncertain rows that aren't too alike; greedy over a pool of 6 n, so in one place."""
    pool = scored.orderBy(F.abs(F.col("score") - 0.5), "track_id").limit(6 * n).join(vectors.select("track_id", "vec"), "track_id").withColumn("g", F.lit(1))

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.assign(u=(p["score"] - 0.5).abs()).sort_values(["u", "track_id"])
        x = np.stack(p["vec"].to_numpy())
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
        out: list[int] = []
        for i in range(len(x)):
            if len(out) < n and (not out or (x[out] @ x[i]).max() <= most):
                out.append(i)
        return pd.DataFrame({"place": range(1, len(out) + 1), "track_id": p["track_id"].to_numpy()[out]})

    return pool.select("g", "track_id", "score", "vec").groupBy("g").applyInPandas(run, "place int, track_id long")


def calibrated(rows: DataFrame, names: list[str], c: float = 0.5, least: int = 20):
    """ML10: balanced logistic regression of labelled signals; None below ``least`` rows."""
    if rows.count() < least:
        return None
    return head(rows.select(F.array(*names).alias("vec"), F.col("label").alias("value"), F.lit(1.0).alias("w")), True, c)


def contributions(rows: DataFrame, names: list[str], weights: list[float], offset: float) -> DataFrame:
    """ML11: score and each signal's part of the logit."""
    parts = F.create_map(*[x for n, w in zip(names, weights, strict=True) for x in (F.lit(n), F.col(n) * float(w))])
    z = sum((F.col(n) * float(w) for n, w in zip(names, weights, strict=True)), F.lit(float(offset)))
    return rows.select("track_id", (1 / (1 + F.exp(-z))).alias("score"), parts.alias("contributions"))
