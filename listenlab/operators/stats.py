"""Play-weighted and plain statistics of measured features."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running

from .macro import counts


def weighted(features: DataFrame, plays: DataFrame, default: int = 1) -> DataFrame:
    """Analysed tracks with their plays as weight ``w``."""
    ok = features.where("error IS NULL")
    return ok.join(counts(plays), "track_id", "left").withColumn("w", F.coalesce("plays", F.lit(default)).cast("double")).drop("plays")


def weighted_mean(x: str) -> Column:
    """AG9: both sums over rows where x isn't null."""
    return F.sum(F.col(x) * F.col("w")) / F.sum(F.when(F.col(x).isNotNull(), F.col("w")))


def profile(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.agg(*[weighted_mean(n).alias(n) for n in names])


def taste_vector(rows: DataFrame, names: list[str]) -> DataFrame:
    """AG26: as AG9, over rows where no feature is null."""
    return profile(rows.dropna(subset=names), names)


def key_histogram(rows: DataFrame, k: int = 12) -> DataFrame:
    """AG10."""
    name = F.trim(F.concat_ws(" ", "key", "mode"))
    return rows.groupBy(name.alias("key")).agg(F.sum("w").cast("bigint").alias("plays")).where("key <> ''").orderBy(F.col("plays").desc(), "key").limit(k)


def histogram(rows: DataFrame, names: list[str]) -> DataFrame:
    """AG11: ten buckets of each feature from 0 to 1, 1 in the last."""
    long = rows.select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n))]).alias("feature", "v")).where("v IS NOT NULL")
    return long.groupBy("feature", F.least(F.floor(F.col("v") * 10), F.lit(9)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def mood_over_time(plays: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """AG13: means by month over plays; plays are counted by month and track before features are joined."""
    per = plays.groupBy(F.date_format("played_at", "yyyy-MM").alias("month"), "track_id").agg(F.count("*").cast("double").alias("w"))
    rows = per.join(features.where("error IS NULL"), "track_id")
    return rows.groupBy("month").agg(*[weighted_mean(n).alias(n) for n in names], F.sum("w").cast("bigint").alias("plays"))


def mood(e: Column, v: Column) -> Column:
    """C1: quadrant of energy and valence; null if either is missing. The texts are fixed values."""
    return (
        F.when(e.isNull() | v.isNull(), None).when((e >= 0.5) & (v >= 0.5), "Energetic & Happy (hype)").when(e >= 0.5, "Energetic & Tense (intense)").when(v >= 0.5, "Calm & Happy (chill)").otherwise("Calm & Sad (melancholic)")
    )


def feature_stats(features: DataFrame, names: list[str]) -> DataFrame:
    """AG20: population deviation and exact, interpolated percentiles."""
    long = features.where("error IS NULL").select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), F.col(n))]).alias("feature", "v"))
    return long.groupBy("feature").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.min("v").alias("min"), F.percentile("v", 0.25).alias("q25"), F.median("v").alias("median"), F.percentile("v", 0.75).alias("q75"), F.max("v").alias("max")
    )


def correlations(features: DataFrame, names: list[str]) -> DataFrame:
    """AG21: all pairs in one aggregation, one row for each."""
    pairs = list(combinations(names, 2))
    one = features.where("error IS NULL").agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.stack(F.lit(len(pairs)), *[x for a, b in pairs for x in (F.lit(a), F.lit(b), F.col(f"`{a}|{b}`"))]).alias("a", "b", "r"))


def signatures(rows: DataFrame, group: str, names: list[str], least: int = 1) -> DataFrame:
    """AG22: each group's feature farthest from the mean of all rows, in deviations."""
    all_ = rows.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    per = rows.groupBy(group).agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n")).where(F.col("n") >= least)
    z = per.crossJoin(F.broadcast(all_)).select(group, "n", F.array(*[F.struct(((F.col(n) - F.col(f"m_{n}")) / (F.col(f"s_{n}") + 1e-6)).alias("z"), F.lit(n).alias("feature")) for n in names]).alias("zs"))
    best = F.array_max(F.transform("zs", lambda x: F.struct(F.abs(x["z"]).alias("a"), x["feature"].alias("feature"), x["z"].alias("z"))))
    return z.select(group, "n", best["feature"].alias("feature"), best["z"].alias("z"))


def drift(rows: DataFrame, names: list[str], least: int = 2) -> DataFrame:
    """AG23: means by era, of eras with enough rows."""
    return rows.groupBy("era").agg(*[F.avg(n).alias(n) for n in names], F.count("*").alias("n")).where(F.col("n") >= least)


def first_last(rows: DataFrame, names: list[str]) -> DataFrame:
    """WN9: change from the first to the last era."""
    return rows.agg(F.min("era").alias("first_era"), F.max("era").alias("last_era"), *[(F.max_by(n, "era") - F.min_by(n, "era")).alias(n) for n in names])


def mode_bin(features: DataFrame, name: str, bins: int = 8) -> DataFrame:
    """AG24: the fullest of equally wide bins, the lower of equals."""
    rows = features.where(f"error IS NULL AND {name} IS NOT NULL")
    span = rows.agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(name) - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1)))
    per = rows.crossJoin(F.broadcast(span)).groupBy(b.cast("int").alias("bin"), (F.col("lo") + b * width).alias("low")).agg(F.count("*").alias("n"))
    return per.orderBy(F.col("n").desc(), "bin").limit(1)


def extremes(features: DataFrame, name: str) -> DataFrame:
    """AG25: the rows of least and most of a feature, smaller id first."""
    rows = features.where(f"error IS NULL AND {name} IS NOT NULL")
    return rows.agg(F.min(F.struct(name, "track_id")).alias("lo"), F.min(F.struct((-F.col(name)).alias("n"), "track_id")).alias("hi")).select(
        F.col("lo.track_id").alias("least_id"), F.col(f"lo.{name}").alias("least"), F.col("hi.track_id").alias("most_id"), (-F.col("hi.n")).alias("most")
    )


def percentiles(rows: DataFrame, name: str) -> DataFrame:
    """WN1, WN2: percent of known values that are strictly less, from running counts of each value."""
    known = rows.where(F.col(name).isNotNull())
    values = running(known.groupBy(name).agg(F.count("*").alias("k")), [F.col(name)], upto=F.col("k"))
    below = values.select(F.col(name).alias("v"), (F.col("upto") - F.col("k")).alias("below"))
    n = known.agg(F.count("*").alias("n"))
    return known.join(below, F.col(name) == F.col("v")).crossJoin(F.broadcast(n)).select("track_id", name, (100.0 * F.col("below") / F.col("n")).alias("percentile"))


def thirds(rows: DataFrame) -> DataFrame:
    """WN5, T15: top and bottom thirds by plays, then id, as labels 1 and 0."""
    r = running(rows, [F.col("plays"), F.col("track_id")]).withColumn("third", F.floor(F.col("total") / 3))
    top = F.col("pos") > F.col("total") - F.col("third")
    return r.where((F.col("pos") <= F.col("third")) | top).select("track_id", "plays", top.cast("int").alias("label"))


def auc(rows: DataFrame) -> DataFrame:
    """ML4: area under the curve of (label, score), ties by their average rank."""
    per = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos_n"), F.count_if(F.col("label") == 0).alias("neg_n"))
    t = running(per, [F.col("score")], upto=F.col("neg_n"))
    t = t.withColumn("won", F.col("pos_n") * (F.col("upto") - F.col("neg_n") / 2.0))
    return t.agg((F.sum("won") / F.nullif(F.sum("pos_n").cast("double") * F.sum("neg_n"), F.lit(0.0))).alias("auc"))


def contrast(rows: DataFrame, inside: Column, names: list[str]) -> DataFrame:
    """AG40, VC23: deviation of a set's mean from the rest, by feature, strongest first."""
    agg = []
    for n in names:
        x = F.col(n)
        agg += [F.avg(F.when(inside, x)).alias(f"i_{n}"), F.avg(F.when(~inside, x)).alias(f"o_{n}"), F.stddev_pop(F.when(~inside, x)).alias(f"s_{n}")]
    one = rows.agg(*agg)
    z = lambda n: (F.col(f"i_{n}") - F.col(f"o_{n}")) / (F.col(f"s_{n}") + 1e-6)
    return one.select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), z(n))]).alias("feature", "z"))
