"""Lyrics: words, richness, a small lexicon's sentiment, and how they fit the sound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Our own stop words and sentiment words.
STOP = "the a an and or of to in on for is are was it that this with as at be by not from have i you".split()
GOOD, BAD = "love happy joy light dance smile free bright sweet good".split(), "hate sad pain dark cry lonely lost broken cold bad trash stupid disgusting worthless".split()


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z']+)"), 1)


def counted(lyrics: DataFrame, top: int = 12, least: int = 5) -> DataFrame:
    """AG31: words, richness and the most frequent content words of each text with enough words."""
    rows = lyrics.select("track_id", words(F.col("text")).alias("w")).where(F.size("w") >= least)
    return rows.select("track_id", F.size("w").cast("long").alias("word_count"), (F.size(F.array_distinct("w")) / F.size("w")).alias("unique_ratio"), "w")


def _once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def frequent(w: Column, top: int) -> Column:
    """AR9: the most frequent entries of an array as structs (word, n), from runs of the sorted array; of equal counts the first in order."""

    def counted_runs(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (n > 0) & ((i == 0) | ~F.get(s, i).eqNullSafe(F.get(s, i - 1))))
        each = lambda p: F.transform(p, lambda x, i: F.struct((x - F.coalesce(F.get(p, i + 1), n)).alias("minus"), F.get(s, x).alias("word")))
        best = _once(starts, lambda p: F.slice(F.array_sort(each(p)), 1, top))
        return F.transform(best, lambda x: F.struct(x["word"].alias("word"), (-x["minus"]).cast("long").alias("n")))

    return _once(F.sort_array(w), counted_runs)


def top_words(lyrics: DataFrame, top: int = 12) -> DataFrame:
    """AG31, AR9: content words by count; a text is one row, so nothing is shuffled."""
    stop = F.array(*map(F.lit, STOP))
    content = F.filter(words(F.coalesce("text", F.lit(""))), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))
    return lyrics.select("track_id", F.inline(frequent(content, top)))


def cloud(tops: DataFrame, plays: DataFrame, k: int = 40) -> DataFrame:
    """AG30: sum of count times plays (1 if never played) by word."""
    per = tops.join(plays.groupBy("track_id").agg(F.count("*").alias("p")), "track_id", "left")
    return per.groupBy("word").agg(F.sum(F.col("n") * F.coalesce("p", F.lit(1))).alias("weight")).orderBy(F.col("weight").desc(), "word").limit(k)


def sentiment(text: Column) -> Column:
    """LY1: (good - bad) / (good + bad) words of the lexicon, 0 if there are none."""
    w = words(text)
    count = lambda lex: F.size(F.filter(w, lambda x: x.isin(*lex)))
    g, b = count(GOOD), count(BAD)
    return F.coalesce((g - b) / F.nullif(g + b, F.lit(0)), F.lit(0.0))


def compound(text: Column, lexicon: dict[str, float]) -> Column:
    """LY1: sum of a lexicon's valences over a text's words, x / sqrt(x^2 + 15); 0 without any. The lexicon is the caller's, as none is built in."""
    table = F.create_map(*[F.lit(x) for kv in lexicon.items() for x in (kv[0], float(kv[1]))])
    x = F.aggregate(words(F.coalesce(text, F.lit(""))), F.lit(0.0), lambda a, w: a + F.coalesce(F.try_element_at(table, w), F.lit(0.0)))
    return _once(x, lambda v: v / F.sqrt(v * v + 15))


def overview(lyrics: DataFrame) -> DataFrame:
    """AG29: one row: texts, mean words, richness and sentiment, and percent explicit, of (text, sentiment, explicit) with enough words; unknown sentiments don't count."""
    rows = lyrics.withColumn("w", words(F.col("text"))).where(F.size("w") >= 5)
    flag = F.when(F.coalesce("explicit", F.lit(False)), 100.0).otherwise(0.0)
    return rows.agg(F.count("*").alias("texts"), F.avg(F.size("w")).alias("words"), F.avg(F.size(F.array_distinct("w")) / F.size("w")).alias("richness"), F.avg("sentiment").alias("sentiment"), F.avg(flag).alias("explicit_pct"))


def mismatch(valence: Column, mood: Column) -> tuple[Column, Column]:
    """MT7: kind of mismatch (null if none) and its gap. The texts are fixed values."""
    kind = F.when((valence >= 0.55) & (mood <= -0.2), "happy sound, sad words").when((valence <= 0.4) & (mood >= 0.3), "dark sound, upbeat words")
    return kind, F.abs(valence - (mood + 1) / 2)
