"""Counts over plays: overviews, tops, calendars, discovery, concentration, recaps.

Fact tables are aggregated before they meet a dimension, so what is shuffled is one row for each key
and task, and every top-k has an id as its last sort key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import running

#: Stand-in length of a track of unknown length, in milliseconds.
DEFAULT_MS = 210_000


def since(plays: DataFrame, reference: str, days: int) -> DataFrame:
    """FLT3: plays of the ``days`` before a reference time."""
    return plays.where(F.col("played_at") >= F.lit(reference).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAY"))


def of_year(plays: DataFrame, year: int) -> DataFrame:
    """FLT4: plays of one year, as a range that reaches the scan."""
    return plays.where((F.col("played_at") >= F.lit(f"{year}-01-01").cast("timestamp_ntz")) & (F.col("played_at") < F.lit(f"{year + 1}-01-01").cast("timestamp_ntz")))


def counts(plays: DataFrame) -> DataFrame:
    """JN6: plays of each track."""
    return plays.groupBy("track_id").agg(F.count("*").alias("plays"))


def with_counts(tracks: DataFrame, plays: DataFrame, default: int) -> DataFrame:
    """Tracks with their plays; ``default`` (0 or 1 by the operator) for those never played."""
    return tracks.join(counts(plays).withColumnRenamed("track_id", "id"), "id", "left").withColumn("plays", F.coalesce("plays", F.lit(default)))


def overview(plays: DataFrame, tracks: DataFrame, features: DataFrame) -> DataFrame:
    """AG1, AG27: one row of totals. Hours come from counts by track, not from a join of all plays."""
    per = counts(plays).join(tracks, F.col("track_id") == F.col("id"))
    ms = F.sum(F.col("plays") * F.coalesce("duration_ms", F.lit(DEFAULT_MS)))
    totals = per.agg(F.sum("plays").alias("plays"), F.count("*").alias("played_tracks"), F.countDistinct("artist").alias("artists"), (ms / 3_600_000.0).alias("hours"))
    span = plays.agg(F.min("played_at").alias("first_play"), F.max("played_at").alias("last_play"))
    done = features.agg(F.count_if(F.col("error").isNull()).alias("analysed"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return totals.crossJoin(span).crossJoin(done)  # three single rows


def by_source(plays: DataFrame) -> DataFrame:
    return plays.groupBy("source").agg(F.count("*").alias("plays"))


def top_artists(plays: DataFrame, tracks: DataFrame, k: int = 25) -> DataFrame:
    """AG2."""
    per = counts(plays).join(tracks, F.col("track_id") == F.col("id"))
    return per.groupBy("artist").agg(F.sum("plays").alias("plays"), F.count("*").alias("tracks")).orderBy(F.col("plays").desc(), "artist").limit(k)


def top_tracks(plays: DataFrame, tracks: DataFrame, features: DataFrame, k: int = 25) -> DataFrame:
    """AG3: the top is cut before features are joined, as they only decorate it."""
    top = counts(plays).orderBy(F.col("plays").desc(), "track_id").limit(k)
    named = top.join(tracks, F.col("track_id") == F.col("id"))
    return named.join(features.select("track_id", "energy", "bpm"), "track_id", "left").select("track_id", "title", "artist", "plays", "energy", "bpm")


def top_genres(plays: DataFrame, tracks: DataFrame, k: int = 15) -> DataFrame:
    """AG8."""
    per = counts(plays).join(tracks.where("genre IS NOT NULL"), F.col("track_id") == F.col("id"))
    return per.groupBy("genre").agg(F.sum("plays").alias("plays")).orderBy(F.col("plays").desc(), "genre").limit(k)


def era(date: Column) -> Column:
    """PRJ2: decade of a date text; null if it is too short."""
    return F.when(F.length(date) >= 4, F.concat(F.substring(date, 1, 3), F.lit("0s")))


def eras(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    per = counts(plays).join(tracks.withColumn("era", era(F.col("release_date"))).where("era IS NOT NULL"), F.col("track_id") == F.col("id"))
    return per.groupBy("era").agg(F.sum("plays").alias("plays"))


def bucketed(plays: DataFrame, **parts: Column) -> DataFrame:
    """AG4-AG7, AG14: plays by parts of their time."""
    return plays.groupBy(*[c.alias(n) for n, c in parts.items()]).agg(F.count("*").alias("plays"))


def monthly(plays: DataFrame) -> DataFrame:
    """AG6."""
    return plays.groupBy(F.date_format("played_at", "yyyy-MM").alias("month")).agg(F.count("*").alias("plays"), F.countDistinct("track_id").alias("tracks"))


def busiest_day(plays: DataFrame) -> DataFrame:
    """AG14: the day of most plays, the earliest of equal ones, and the number of active days."""
    days = bucketed(plays, day=F.to_date("played_at"))
    best = F.min_by(F.struct("day", "plays"), F.struct((-F.col("plays")).alias("n"), "day"))
    return days.agg(best.alias("b"), F.count("day").alias("active_days")).select("b.day", "b.plays", "active_days")


def first_seen(plays: DataFrame, key: str) -> DataFrame:
    """AG15: how many keys were first played in each month."""
    first = plays.groupBy(key).agg(F.min("played_at").alias("first"))
    return first.groupBy(F.date_format("first", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))


def discovery_series(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """JN12: new tracks and new artists by month, months of either side kept."""
    # artists' first play comes from the tracks' first plays
    firsts = plays.groupBy("track_id").agg(F.min("played_at").alias("played_at"))
    artists = firsts.join(tracks, F.col("track_id") == F.col("id")).select("artist", "played_at")
    a = first_seen(firsts, "track_id").withColumnRenamed("n", "new_tracks")
    b = first_seen(artists, "artist").withColumnRenamed("n", "new_artists")
    return a.join(b, "month", "full_outer").select("month", F.coalesce("new_tracks", F.lit(0)).alias("new_tracks"), F.coalesce("new_artists", F.lit(0)).alias("new_artists"))


def ladder(x: Column, steps: list[tuple[float, str]], last: str, strict: bool = True) -> Column:
    """PRJ4: the name of the first step that x is above."""
    out = None
    for cut, name in steps:
        test = x > cut if strict else x >= cut
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.when(x.isNull(), None).otherwise(out.otherwise(last))


#: Texts of the ladders, and those below the last step.
EXPLORER = [(0.8, "Explorer — you rarely repeat, always seeking new"), (0.5, "Balanced — mix of new and familiar"), (0.3, "Comfort listener — you replay favourites a lot")]
LOYALIST = "Loyalist — you loop a tight set of songs"
CONCENTRATED = [(0.6, "Very concentrated — a few artists dominate"), (0.45, "Concentrated"), (0.3, "Fairly even")]
DIVERSE = "Very diverse spread"


def discovery_ratio(plays: DataFrame) -> DataFrame:
    """AG16: distinct tracks over plays; null without plays."""
    one = counts(plays).agg(F.count("*").alias("tracks"), F.coalesce(F.sum("plays"), F.lit(0)).alias("plays"))
    r = F.col("tracks") / F.nullif("plays", F.lit(0))
    return one.withColumn("ratio", r).withColumn("kind", ladder(F.col("ratio"), EXPLORER, LOYALIST))


def shares(plays: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays by artist."""
    return counts(plays).join(tracks, F.col("track_id") == F.col("id")).groupBy("artist").agg(F.sum("plays").alias("c"))


def concentration(groups: DataFrame) -> DataFrame:
    """AG17-AG19: Gini, HHI, and top-1/5/10 shares of rows (key, c)."""
    key = groups.columns[0]
    t = running(groups, [F.col("c"), F.col(key)])  # ranks by range partitions
    s, n = F.sum("c"), F.count("*")
    most = groups.orderBy(F.col("c").desc(), key).limit(10).agg(F.sort_array(F.collect_list("c"), False).alias("most"))
    gini = 2 * F.sum(F.col("pos") * F.col("c")) / (n * s) - (n + 1) / n
    one = t.agg(n.alias("keys"), F.when(n == 1, 0.0).otherwise(gini).alias("gini"), (F.sum(F.col("c") * F.col("c")) / (s * s)).alias("hhi"), s.alias("s")).crossJoin(most)
    top = lambda k: (F.aggregate(F.slice("most", 1, k), F.lit(0).cast("long"), lambda a, x: a + x) / F.col("s")).alias(f"top{k}")
    return one.select("keys", "gini", "hhi", top(1), top(5), top(10)).withColumn("kind", ladder(F.col("gini"), CONCENTRATED, DIVERSE))


def running_share(groups: DataFrame) -> DataFrame:
    """WN3: cumulative share of the keys, largest first."""
    key = groups.columns[0]
    t = running(groups, [F.col("c").desc(), F.col(key)], run=F.col("c"))
    total = groups.agg(F.sum("c").alias("s"))
    return t.crossJoin(F.broadcast(total)).select(key, "c", "pos", (F.col("run") / F.col("s")).alias("share"))


def entropy(plays: DataFrame) -> DataFrame:
    """AG12: entropy of the plays of tracks, over its largest value; n*ln(n) sums need no second pass."""
    c = F.col("plays")
    t = counts(plays).agg(F.sum("plays").alias("s"), F.sum(c * F.log(c.cast("double"))).alias("cl"), F.count("*").alias("n"))
    h = F.log(F.col("s").cast("double")) - F.col("cl") / F.col("s")
    return t.select(F.when(F.col("n") > 1, h / F.log(F.col("n").cast("double"))).otherwise(0.0).alias("entropy"))


def search(tracks: DataFrame, text: str, columns: tuple[str, ...] = ("title", "artist")) -> DataFrame:
    """FLT5, FLT6: every token must be found in some column, whatever its case; % and _ are ordinary characters."""
    out = tracks
    for token in text.split():
        literal = token.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
        test = F.lit(False)
        for c in columns:
            test = test | F.col(c).ilike(f"%{literal}%")
        out = out.where(test)
    return out


def recap(plays: DataFrame, tracks: DataFrame, year: int | None = None) -> DataFrame:
    """AG27: headline figures of a year, or of all time."""
    some = plays if year is None else of_year(plays, year)
    per = counts(some).join(tracks, F.col("track_id") == F.col("id"))
    ms = F.coalesce(F.sum(F.col("plays") * F.coalesce("duration_ms", F.lit(DEFAULT_MS))), F.lit(0))
    return per.agg(
        F.coalesce(F.sum("plays"), F.lit(0)).alias("plays"), F.count("*").alias("tracks"), F.countDistinct("artist").alias("artists"),
        (ms / 3_600_000.0).alias("hours"), (ms / 60_000.0).alias("minutes"),
    )


def peak_hour(plays: DataFrame) -> DataFrame:
    """AG28."""
    return bucketed(plays, hour=F.hour("played_at").cast("long")).orderBy(F.col("plays").desc(), "hour").limit(1)
