"""Offline evaluation of retrieval."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions.arrays import unit

from .order import kept, previous
from .retrieve import diversified, explored, searched
from .stats import percentiles
from .vectors import corrected, popularity_direction


def session_pairs(plays: DataFrame, gap_s: int = 1800, by: list[str] | None = None) -> DataFrame:
    """JN17, WN7: successive different tracks at most ``gap_s`` seconds apart, the bound included.

    Of the whole log in one order, as of one listener, by range partitions; or by user, in windows.
    """
    order = [F.col("played_at"), F.col("event_id")]
    if by:
        w = Window.partitionBy(*by).orderBy(*order)
        t = plays.withColumns({"a": F.lag("track_id").over(w), "before": F.lag("played_at").over(w)})
    else:
        t = previous(plays, order, a=F.col("track_id"), before=F.col("played_at"))
    near = F.unix_seconds(F.col("played_at").cast("timestamp")) - F.unix_seconds(F.col("before").cast("timestamp")) <= gap_s
    return t.where(near & (F.col("a") != F.col("track_id"))).select("event_id", "a", F.col("track_id").alias("b"))


def novelty(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """MT11: (track_id, novelty): -log2 of (plays + 1) / (all plays + tracks) of every track; of one never played, plays are 0."""
    p = tracks.select("track_id").join(plays, "track_id", "left").select("track_id", F.coalesce("plays", F.lit(0)).alias("plays"))
    total = plays.agg(F.greatest(F.coalesce(F.sum("plays"), F.lit(0)), F.lit(1)).alias("s")).crossJoin(tracks.agg(F.count("*").alias("c")))
    return p.crossJoin(F.broadcast(total)).select("track_id", "plays", (-F.log2((F.col("plays") + 1) / (F.col("s") + F.col("c")))).alias("novelty"))


def spread(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """EV4: (a, diversity): 1 less the mean cosine of the pairs of a list (a, guess), from the length of the sum of its unit vectors; 0 for a list of one."""
    u = vectors.select(F.col("track_id").alias("guess"), F.posexplode(unit(F.col("vec"))).alias("i", "x"))
    s = lists.select("a", "guess").join(u, "guess").groupBy("a", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    one = s.groupBy("a").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.max("n").alias("n"))
    return one.select("a", F.when(F.col("n") > 1, 1 - (F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("diversity"))


def next_item(pairs: DataFrame, vectors: DataFrame, plays: DataFrame, k: int = 10, deep: int = 50, lists: DataFrame | None = None) -> DataFrame:
    """EV1: how well lists (a, guess, rank), by default the nearest tracks, foretell the next of ``pairs`` (event_id, a, b).

    Hits at k and deep, reciprocal rank, serendipity (hits played once at most), and over all that is shown:
    coverage, novelty, diversity within lists, share of tracks that are less played. Each pair counts.
    """
    seeds = pairs.select(F.col("a").alias("track_id")).distinct().join(vectors, "track_id")
    if lists is None:
        lists = searched(vectors.select("track_id", "vec"), seeds.select("track_id", "vec"), deep).select(F.col("query_id").alias("a"), F.col("track_id").alias("guess"), "rank")
    shown = kept(lists.where(F.col("rank") <= deep))
    asked = pairs.join(seeds.select(F.col("track_id").alias("a")), "a", "left_semi")
    tracks = kept(novelty(plays, vectors))
    below = percentiles(tracks, "plays").select("track_id", (F.col("percentile") / 100).alias("below"))
    known = kept(tracks.join(below, "track_id").withColumnRenamed("track_id", "guess"))
    hit = asked.join(shown, "a").where("guess = b").groupBy("event_id").agg(F.min("rank").alias("rank"), F.min("b").alias("guess")).join(known.select("guess", "plays"), "guess")
    flag = lambda test: F.avg(F.when(test, 1.0).otherwise(0.0))
    r = asked.join(hit.select("event_id", "rank", "plays"), "event_id", "left").agg(
        F.count("*").alias("queries"), flag(F.col("rank") <= k).alias("hit_k"), flag(F.col("rank").isNotNull()).alias("hit_deep"), F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"), flag(F.col("plays") <= 1).alias("serendipity")
    )
    per = shown.join(known, "guess").groupBy("a").agg(F.sum("novelty").alias("nov"), F.sum("below").alias("pop"), F.count("*").alias("n")).join(spread(shown, vectors), "a")
    w = asked.groupBy("a").agg(F.count("*").alias("w"))
    mean = lambda c: F.sum(F.col(c) * F.col("w")) / F.sum(F.col("n") * F.col("w"))
    m = per.join(w, "a").agg(mean("nov").alias("novelty"), mean("pop").alias("popularity_percentile"), (F.sum(F.col("diversity") * F.col("w")) / F.sum("w")).alias("diversity"))
    cover = shown.join(w, "a", "left_semi").agg(F.countDistinct("guess").alias("c")).crossJoin(vectors.agg(F.count("*").alias("t"))).select((F.col("c") / F.col("t")).alias("coverage"))
    return r.crossJoin(m).crossJoin(cover)


@dataclass(frozen=True)
class Setup:
    """What a recommender does: weights of its two spaces, correction, diversity and exploration."""

    one: float = 0.6
    two: float = 0.4
    debias: bool = True
    mmr: float = 0.72
    epsilon: float = 0.08


#: Names of the variants.
VARIANTS = {
    "full": Setup(),
    "no diversity rerank (mmr=1.0)": Setup(mmr=1.0),
    "no exploration (eps=0)": Setup(epsilon=0.0),
    "no popularity debias": Setup(debias=False),
    "MERT only": Setup(two=0.0),
    "CLAP only": Setup(one=0.0),
}


def recommended(seeds: DataFrame, spaces: tuple[DataFrame, DataFrame], plays: DataFrame, setup: Setup, deep: int = 50) -> DataFrame:
    """Lists (a, guess, rank) for seeds (track_id): search in the weighted spaces, diversity over three times as many, exploration of the tail."""
    pool = None
    for v, weight in zip(spaces, (setup.one, setup.two), strict=True):
        if weight:
            x = kept(corrected(v, popularity_direction(v, plays)) if setup.debias else v.select("track_id", "vec"))
            near = searched(x, x.join(seeds, "track_id", "left_semi"), 3 * deep).select("query_id", "track_id", (weight * F.col("score")).alias("s"))
            pool = near if pool is None else pool.unionByName(near)
    pool = pool.groupBy("query_id", "track_id").agg(F.sum("s").alias("score")).join(spaces[0].select("track_id", "vec", F.col("track_id").alias("artist")), "track_id")
    ranked = diversified(pool, 2 * deep, lam=setup.mmr, cap=99).withColumnRenamed("place", "rank")
    if setup.epsilon:
        tail = explored(ranked.join(plays, "track_id", "left"), deep, setup.epsilon)
        w = Window.partitionBy("query_id").orderBy("explored", F.coalesce("rank", F.lit(1 << 20)), "track_id")
        ranked = tail.join(ranked, ["query_id", "track_id"]).withColumn("rank", F.row_number().over(w))
    return ranked.select(F.col("query_id").alias("a"), F.col("track_id").alias("guess"), "rank")


def ablation(pairs: DataFrame, spaces: tuple[DataFrame, DataFrame], plays: DataFrame) -> DataFrame:
    """EV2: the figures of all variants, one row for each."""
    seeds = pairs.select(F.col("a").alias("track_id")).distinct()
    out = None
    for name, setup in VARIANTS.items():
        r = next_item(pairs, spaces[0], plays, lists=recommended(seeds, spaces, plays, replace(setup))).withColumn("variant", F.lit(name))
        out = r if out is None else out.unionByName(r)
    return out


def album_cohesion(vectors: DataFrame, least: int = 3) -> DataFrame:
    """EV3: (within, between, cohesion): mean cosine of an album's pairs, mean cosine of its rows with all rows, and their difference, over albums of enough rows."""
    u = vectors.select("album", F.posexplode(unit(F.col("vec"))).alias("i", "x"))
    s = u.groupBy("album", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    every = u.groupBy("i").agg(F.avg("x").alias("m"))
    per = s.join(F.broadcast(every), "i").groupBy("album").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("m")).alias("sm"), F.max("n").alias("n")).where(F.col("n") >= least)
    one = per.agg(F.avg((F.col("ss") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).alias("within"), F.avg(F.col("sm") / F.col("n")).alias("between"))
    return one.withColumn("cohesion", F.col("within") - F.col("between"))
