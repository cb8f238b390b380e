"""Retrieval: constraints, recall in one or two spaces, diversity, exploration."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions import music
from listenlab.functions.arrays import cosine, dot

from .vectors import neighbours


@dataclass(frozen=True)
class Constraints:
    """FLT10: what candidates must meet; None or () asks nothing."""

    exclude: tuple[int, ...] = ()
    has_features: bool = True
    min_duration_ms: int | None = None
    max_slop: float | None = None
    bpm: tuple[float, float] | None = None
    near_key: str | None = None
    key_steps: int = 2
    years: tuple[int, int] | None = None
    any_tags: tuple[str, ...] = ()
    exclude_artists: tuple[str, ...] = ()


def passing(rows: DataFrame, c: Constraints, heard: DataFrame | None = None) -> DataFrame:
    """Rows (track_id, error, duration_ms, slop, bpm, code, year, tags, artist as far as asked) that meet the constraints; ``heard`` tracks are left out."""
    test = F.lit(True)
    if c.exclude:
        test &= ~F.col("track_id").isin(*c.exclude)
    if c.has_features:
        test &= F.col("error").isNull()
    if c.min_duration_ms is not None:
        test &= F.col("duration_ms") >= c.min_duration_ms
    if c.max_slop is not None:
        test &= F.col("slop") <= c.max_slop
    if c.bpm:
        test &= music.half_double(F.col("bpm"), F.lit(c.bpm[0]), F.lit(c.bpm[1]))
    if c.near_key:
        test &= music.distance(F.col("code"), F.lit(c.near_key)) <= c.key_steps
    if c.years:
        test &= F.col("year").between(*c.years)
    if c.any_tags:
        test &= F.arrays_overlap("tags", F.array(*map(F.lit, c.any_tags)))
    if c.exclude_artists:
        test &= ~F.col("artist").isin(*c.exclude_artists)
    out = rows.where(test)
    return out if heard is None else out.join(heard.select("track_id"), "track_id", "left_anti")


def recall(vectors: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """JN19, VC3: the k most similar rows of each of a few queries (query_id, q), or all, without a rank; the query itself excluded.

    For queries of a bounded number, such as one request's; ``neighbours`` takes any number.
    """
    w = Window.partitionBy("query_id").orderBy(F.col("sim").desc(), "track_id")
    sims = vectors.join(F.broadcast(queries)).where(F.col("track_id") != F.col("query_id")).select("query_id", "track_id", cosine(F.col("vec"), F.col("q")).alias("sim"))
    return sims if k is None else sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def searched(vectors: DataFrame, queries: DataFrame, k: int, radius: DataFrame | None = None) -> DataFrame:
    """(query_id, track_id, score, rank): the k best of all rows for each row of ``queries``, by blocks; by CSLS if there are radii."""
    if radius is not None:
        vectors = vectors.join(radius, "track_id")
    near = neighbours(vectors, k, of=queries, less="radius" if radius is not None else None)
    out = near.select(F.col("a").alias("query_id"), F.col("b").alias("track_id"), F.col("s").alias("score"), "rank")
    if radius is None:
        return out
    own = radius.select(F.col("track_id").alias("query_id"), F.col("radius").alias("rq"))
    return out.join(own, "query_id").withColumn("score", F.col("score") - F.col("rq")).drop("rq")


def blended(spaces: list[tuple[DataFrame, DataFrame, float]], k: int) -> DataFrame:
    """VC15, SE6: search by space (vectors, queries, weight), put together; a space without the track adds nothing."""
    out = None
    for i, (vectors, queries, _) in enumerate(spaces):
        r = searched(vectors, queries, 3 * k).select("query_id", "track_id", F.col("score").alias(f"s{i}"))
        out = r if out is None else out.join(r, ["query_id", "track_id"], "full_outer")
    score = sum((w * F.coalesce(F.col(f"s{i}"), F.lit(0.0)) for i, (_, _, w) in enumerate(spaces)), F.lit(0.0))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "track_id")
    return out.select("query_id", "track_id", score.alias("score")).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def capped(rows: DataFrame, cap: int) -> DataFrame:
    """WN11 without re-ranking: at most ``cap`` rows of an artist for each query."""
    w = Window.partitionBy("query_id", "artist").orderBy(F.col("score").desc(), "track_id")
    return rows.withColumn("k", F.row_number().over(w)).where(F.col("k") <= cap).drop("k")


def diversified(pool: DataFrame, k: int, lam: float = 0.72, cap: int = 2, library_mode: bool = True, seed_artist: bool = False) -> DataFrame:
    """VC16: maximal marginal relevance with an artist cap, for pools (query_id, track_id, score, vec, artist) of bounded size.

    Two modes: the library's starts from no chosen row (similarity -1); the other takes the pool's best first.
    """

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["score", "track_id"], ascending=[False, True])
        x = np.stack(p["vec"].to_numpy())
        x = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
        score, artists, ids = p["score"].to_numpy(), p["artist"].tolist(), p["track_id"].tolist()
        near, left, used, out = np.full(len(p), -1.0 if library_mode else 0.0), list(range(len(p))), {}, []
        while left and len(out) < k:
            value = [lam * score[i] - (1 - lam) * near[i] for i in left]
            i = left.pop(0 if not library_mode and not out else int(np.argmax(value)))
            if used.get(artists[i], 0) >= cap:
                continue
            used[artists[i]] = used.get(artists[i], 0) + 1
            out.append(i)
            near = np.maximum(near, x @ x[i])
        return pd.DataFrame({"query_id": p["query_id"].iloc[0], "place": range(1, len(out) + 1), "track_id": [ids[i] for i in out]})

    rows = pool.where("artist <> seed_artist") if seed_artist else pool
    return rows.select("query_id", "track_id", "score", "vec", "artist").groupBy("query_id").applyInPandas(run, "query_id long, place int, track_id long")


def explored(rows: DataFrame, k: int, share: float, seed: int = 0) -> DataFrame:
    """VC17, ST9: the best k less a share, which is drawn from the tail, rarely played tracks first; by hash, so reruns agree.

    Rows (query_id, track_id, rank, plays).
    """
    n = max(1, round(k * share))
    u = (F.pmod(F.xxhash64("query_id", "track_id", F.lit(seed)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    key = -F.log(u) * (1 + F.coalesce("plays", F.lit(0)))
    w = Window.partitionBy("query_id").orderBy("key", "track_id")
    head = rows.where(F.col("rank") <= k - n).select("query_id", "track_id", F.lit(False).alias("explored"))
    tail = rows.where(F.col("rank") > k - n).withColumn("key", key).withColumn("i", F.row_number().over(w)).where(F.col("i") <= n)
    return head.unionByName(tail.select("query_id", "track_id", F.lit(True).alias("explored")))


def csls(sims: DataFrame, radius: DataFrame, query_radius: float | None = None) -> DataFrame:
    """VC11: 2 s - r(candidate) - r(query); the query's term is its own radius, or a constant."""
    out = sims.join(radius.select("track_id", F.col("radius").alias("rc")), "track_id")
    if query_radius is None:
        out = out.join(radius.select(F.col("track_id").alias("query_id"), F.col("radius").alias("rq")), "query_id")
    else:
        out = out.withColumn("rq", F.lit(query_radius))
    return out.select("query_id", "track_id", (2 * F.col("sim") - F.col("rc") - F.col("rq")).alias("score"))


def tags(vectors: DataFrame, bank: DataFrame, k: int = 8, floor: float = 0.05) -> DataFrame:
    """VC22, JN20: the nearest of a small bank (tag, q) of prompts for each row."""
    w = Window.partitionBy("track_id").orderBy(F.col("sim").desc(), "tag")
    sims = vectors.crossJoin(F.broadcast(bank)).select("track_id", "tag", dot(F.col("vec"), F.col("q")).alias("sim")).where(F.col("sim") > floor)
    return sims.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")
