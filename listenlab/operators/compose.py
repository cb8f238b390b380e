"""Composites: playlist analysis, dossiers, findings, previews, tags and documents of tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions import music

from . import playlist as pl
from . import space as sx
from . import stats as st
from . import vectors as vc


def mood_label(e: Column, v: Column, bpm: Column) -> Column:
    """PL2: quadrant and tempo of a playlist's means. The texts are fixed values."""
    quad = F.when((e >= 0.5) & (v >= 0.5), "Bright & energetic").when(e >= 0.5, "Dark & intense").when(v >= 0.5, "Warm & mellow").otherwise("Moody & subdued")
    return F.concat(quad, F.lit(", "), F.when(bpm >= 120, "up-tempo").when(bpm >= 95, "mid-tempo").otherwise("slow"))


def playlist_analysis(items: DataFrame, names: list[str]) -> DataFrame:
    """PL2: one row for each playlist of items (playlist_id, position, track_id, title, artist, genre, and features, null if not analysed).

    Counts, means, tempo and its spread, cohesion, harmonic flow, outliers, repeated songs, main genre, use and mood. Values
    that need two analysed tracks are null below that.
    """
    known = items.where("bpm > 0 AND " + " AND ".join(f"{n} IS NOT NULL" for n in names))
    size = items.groupBy("playlist_id").agg(F.count("*").alias("n_tracks"))
    tempo = known.groupBy("playlist_id").agg(F.count("*").alias("n_analyzed"), F.avg("bpm").alias("bpm"), F.stddev_pop("bpm").alias("bpm_spread"))
    dna = pl.dna(known, names)
    flow = pl.flow(known).select("playlist_id", F.col("harmonic").alias("harmonic_score"), F.round(100 * F.col("good")).alias("harmonic_pct"))
    far = pl.outliers(known, names).groupBy("playlist_id").agg(F.count("*").alias("n_outliers"))
    again = pl.duplicates(items).groupBy("playlist_id").agg(F.count("*").alias("n_duplicates"))
    genre = pl.top_values(items.where("genre IS NOT NULL"), "genre", 1).select("playlist_id", F.col("genre").alias("top_genre"))
    out = size
    for part in (tempo, dna.drop("n"), flow, far, again, genre):
        out = out.join(part, "playlist_id", "left")
    enough = F.col("cohesion").isNotNull()
    use, mood = music.best_use()["use"], mood_label(F.col("energy"), F.col("valence"), F.col("bpm"))
    return out.withColumns({"use_case": F.when(enough, use), "mood_label": F.when(enough, mood)} | {n: F.coalesce(n, F.lit(0)) for n in ("n_analyzed", "n_outliers", "n_duplicates")})


def dossier(features: DataFrame, sonic: DataFrame, asked: DataFrame, names: list[str], k: int = 5, structure: DataFrame | None = None) -> DataFrame:
    """RP2: (track_id, part, name, value) of the tracks asked for (track_id): percentiles of their features in the library, their
    nearest siblings by the combined distance, and, with rows of ``signal.structured``, how much repeats and where the chorus is.

    A track that isn't analysed has no rows of the first two parts; a feature that isn't known has no percentile.
    """
    ok = features.where("error IS NULL")
    out = vc.siblings(sonic, sonic.join(asked, "track_id", "left_semi"), k).select(F.col("a").alias("track_id"), F.lit("similar").alias("part"), F.col("b").cast("string").alias("name"), F.round("sim", 3).alias("value"))
    for n in names:
        p = st.percentiles(ok, n).join(asked, "track_id", "left_semi")
        out = out.unionByName(p.select("track_id", F.lit("percentile").alias("part"), F.lit(n).alias("name"), F.round("percentile").alias("value")))
    if structure is not None:
        parts = {"repetition": "repetition_score", "chorus start": "chorus.start", "chorus end": "chorus.end"}
        rows = structure.join(asked, "track_id", "left_semi").select("track_id", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in parts.items()])))
        out = out.unionByName(rows.where("value IS NOT NULL").select("track_id", F.lit("structure").alias("part"), "name", "value"))
    return out


def axis_findings(features: DataFrame, names: list[str], least: int = 5) -> DataFrame:
    """RP3: (topic, text): how much of the variance the two main axes of the standardised features tell, and the first one's name; nothing below ``least`` analysed tracks."""
    found = sx.axes(features, names) if features.where("error IS NULL").count() >= least else []
    said = [("axes", f"Two latent dimensions explain {round(sum(p for _, _, p in found))}% of the sonic variance in your library. Axis 1 ({found[0][1]}) separates your music most strongly — it's the main fault line in your taste.")] if found else []
    return features.sparkSession.createDataFrame(said, "topic string, text string")


def signature_findings(named: DataFrame, plays: DataFrame, names: list[str], least: float = 1.2, k: int = 3) -> DataFrame:
    """RP3: (topic, text): of artists whose tracks stray by more than ``least`` deviations from the library's mean, the k most played (track_id, plays)."""
    heard = named.join(plays, "track_id", "left").groupBy("artist").agg(F.coalesce(F.sum("plays"), F.lit(0)).alias("plays"))
    z = F.round("z", 2)
    top = st.signatures(named, "artist", names).join(heard, "artist").where(F.abs(z) > least).orderBy(F.col("plays").desc(), "artist").limit(k)
    side = F.when(F.col("z") > 0, "higher ").otherwise("lower ")
    return top.select(F.lit("signature").alias("topic"), F.concat("artist", F.lit("'s sonic signature: markedly "), side, "feature", F.lit(" than your library baseline (z = "), F.format_number(z, 2), F.lit(").")).alias("text"))


def era_findings(named: DataFrame, louder: float = 2.0) -> DataFrame:
    """RP3: (topic, text): that the last era's tracks are louder than the first one's by more than ``louder`` dB; nothing below two eras of two tracks each."""
    rows = named.withColumn("era", F.when(F.substring("release_date", 1, 4).rlike("^[0-9]{4}$"), F.concat(F.substring("release_date", 1, 3), F.lit("0s")))).where("era IS NOT NULL")
    per = st.drift(rows, ["loudness_db"]).where("loudness_db IS NOT NULL").withColumn("db", F.round("loudness_db", 1))
    ends = per.agg(F.min("era").alias("a"), F.max("era").alias("b"), F.min_by("db", "era").alias("x"), F.max_by("db", "era").alias("y"))
    db = lambda c: F.format_number(c, 1)
    more = F.col("y") - F.col("x")
    text = F.concat(F.lit("The loudness war is visible in your library: your "), "b", F.lit(" tracks average "), db("y"), F.lit(" dB vs "), db("x"), F.lit(" dB in the "), "a", F.lit(" — "), db(more), F.lit(" dB louder, typically at the cost of dynamics."))
    return ends.where(more > louder).select(F.lit("era").alias("topic"), text.alias("text"))


def findings(features: DataFrame, sonic: DataFrame, tracks: DataFrame, names: list[str], plays: DataFrame | None = None, least: int = 5) -> DataFrame:
    """RP3, SF19: (topic, text): sentences on centre, outlier, correlations, signatures, eras, dynamics and tempo. The wording is fixed values.

    Signatures need plays (track_id, plays). With fewer than ``least`` analysed tracks there are no findings. ``axis_findings`` goes beside it.
    """
    ok = features.where("error IS NULL")
    enough = F.broadcast(ok.agg(F.count("*").alias("analysed")).where(F.col("analysed") >= least))
    named = ok.join(tracks.select(F.col("id").alias("track_id"), "title", "artist", "release_date"), "track_id")
    what = lambda t: F.concat(F.lit("“"), F.col(f"{t}.title"), F.lit("”"))
    row = F.struct("title", "artist", "dynamic_range")
    far = vc.mean_distances(sonic).withColumnRenamed("a", "track_id").join(named, "track_id")
    ends = far.agg(F.min_by(row, F.struct("m", "track_id")).alias("c"), F.max_by(row, F.struct("m", (-F.col("track_id")).alias("i"))).alias("o"))
    centre = ends.select(F.lit("centre").alias("topic"), F.concat(what("c"), F.lit(" by "), F.col("c.artist"), F.lit(" is the sonic centre of your library — the single track most representative of everything you play.")).alias("text"))
    outlier = ends.select(F.lit("outlier").alias("topic"), F.concat(F.lit("Your biggest outlier is "), what("o"), F.lit(" by "), F.col("o.artist"), F.lit(" — nothing else you listen to sounds like it.")).alias("text"))
    corr = st.correlations(ok, names).where(F.abs("r") >= 0.6).orderBy(F.abs("r").desc(), "a", "b").limit(5)
    rel = F.when(F.col("r") > 0, "rise and fall together").otherwise("are opposed")
    related = corr.select(F.lit("correlation").alias("topic"), F.concat(F.lit("In your taste, "), "a", F.lit(" and "), "b", F.lit(" "), rel, F.lit(" (r = "), F.format_number("r", 2), F.lit(").")).alias("text"))
    d = named.where("dynamic_range IS NOT NULL").agg(F.min_by(row, F.struct("dynamic_range", "title", "artist")).alias("lo"), F.max_by(row, F.struct("dynamic_range", "title", "artist")).alias("hi"))
    db = lambda t: F.format_number(F.col(f"{t}.dynamic_range"), 1)
    dynamics = d.select(F.lit("dynamics").alias("topic"), F.concat(F.lit("Most compressed master you play: "), what("lo"), F.lit(" ("), db("lo"), F.lit(" dB of dynamic range). Most dynamic: "), what("hi"), F.lit(" ("), db("hi"), F.lit(" dB).")).alias("text"))
    span = ok.where("bpm > 0").agg(F.min("bpm").alias("lo"), F.max("bpm").alias("hi"), F.count("*").alias("n")).where("n > 4")
    bins = ok.where("bpm > 0").crossJoin(F.broadcast(span)).withColumn("bin", F.least(F.floor((F.col("bpm") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 8), F.lit(7)))
    peak = bins.groupBy("bin", "lo", "hi", "n").agg(F.count("*").alias("c")).orderBy(F.col("c").desc(), "bin").limit(1)
    edge = lambda i: F.floor(F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("bin") + i) / 8).cast("string")
    tempo = peak.select(F.lit("tempo").alias("topic"), F.concat(F.lit("Your tempo sweet spot is "), edge(0), F.lit("–"), edge(1), F.lit(" BPM ("), F.col("c"), F.lit(" of "), F.col("n"), F.lit(" analyzed tracks live there).")).alias("text"))
    out = centre
    signs = [signature_findings(named, plays, names)] if plays is not None else []
    for part in (outlier, related, *signs, era_findings(named), dynamics, tempo):
        out = out.unionByName(part)
    return out.where("text IS NOT NULL").crossJoin(enough).select("topic", "text")


def dedupe_preview(clusters: DataFrame, eligible: DataFrame, tracks: DataFrame) -> DataFrame:
    """DD10: one row: clusters that would merge, rows that would go, plays they have, clusters left alone."""
    per = clusters.join(tracks.select("id", "plays"), "id").groupBy("root").agg(F.count("*").alias("n"), F.sum("plays").alias("plays")).where("n > 1")
    j = per.join(eligible.withColumn("ok", F.lit(True)), "root", "left")
    sums = lambda x: F.coalesce(F.sum(F.when(F.col("ok"), x)), F.lit(0))
    return j.agg(F.count("ok").alias("clusters"), sums(F.col("n") - 1).alias("rows_removed"), sums(F.col("plays")).alias("plays_affected"), F.count_if(F.col("ok").isNull()).alias("skipped"))


def top_tags(tags: DataFrame, n: int) -> DataFrame:
    """AX6: the heaviest tags (track_id, tag, weight) of each track."""
    w = Window.partitionBy("track_id").orderBy(F.col("weight").desc(), "tag")
    return tags.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)


def strongest(values: Column, n: int) -> Column:
    """AR10: the n largest entries of a map, as structs (key, value), largest first, then by key."""
    order = lambda a, b: F.when(a["value"] > b["value"], -1).when(a["value"] < b["value"], 1).when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0)
    return F.slice(F.array_sort(F.map_entries(values), order), 1, n)


def in_first_order(items: DataFrame, group: str, position: str, value: str) -> DataFrame:
    """SE5: (group, values): distinct values of each group in the order in which they first come."""
    lists = items.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(position, value))).alias("x"))
    return lists.select(group, F.array_distinct(F.transform("x", lambda s: s[value])).alias("values"))


#: Scores and signals of a track as they are stored.
DOCUMENT = "score double, confidence double, verdict string, mode string, signals map<string,double>"


def documents(scores: DataFrame) -> DataFrame:
    """AX7: (track_id, document): JSON of (score, confidence, verdict, mode, signals)."""
    return scores.select("track_id", F.to_json(F.struct("score", "confidence", "verdict", "mode", "signals")).alias("document"))


def read_documents(rows: DataFrame) -> DataFrame:
    """AX7: the documents' fields again; an unreadable one has nulls."""
    return rows.select("track_id", F.from_json("document", DOCUMENT).alias("d")).select("track_id", "d.*")
