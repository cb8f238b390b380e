"""LY1: sentiment of texts by a caller's lexicon and the published rules of VADER (Hutto and Gilbert, 2014).

Texts are dealt out once, by id; their tokens meet the lexicon where they are, and what a token's three neighbours before
it do to its valence is told by a window over the text. No Python is involved. Other idioms of several words
aren't looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How much a booster, capitals and a negation do to a valence; what distance leaves of a booster; weights before and behind "but"; marks.
BOOST, CAPITALS, NEGATED, NEVER_SO = 0.293, 0.733, -0.74, 1.25
FURTHER, BEFORE_BUT, BEHIND_BUT, SCALE = (1.0, 0.95, 0.9), 0.5, 1.5, 15
EXCLAMATION, MOST_EXCLAMATIONS, QUESTION, MANY_QUESTIONS = 0.292, 4, 0.18, 0.96
#: Words that negate, that strengthen, and that weaken.
NEGATIONS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't "
    "neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite"
).split()
STRONG = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin frackin fracking "
    "fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably so substantially "
    "thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly very"
).split()
WEAK = "almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly scarce scarcely slight slightly somewhat sorta sortof sort-of".split()
WEAK_PAIRS = ["just enough", "kind of", "sort of"]

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def tokens(text: Column) -> Column:
    """What stands between white space, without marks at its ends unless two characters or less would be left."""
    bare = lambda t: F.btrim(t, F.lit(PUNCTUATION))
    raw = F.filter(F.split(text, r"(?U)\s+"), lambda t: t != "")
    return F.transform(raw, lambda t: F.when(F.length(bare(t)) > 2, bare(t)).otherwise(t))


def _upper(t: Column) -> Column:
    return (F.upper(t) == t) & (F.lower(t) != t)


def _negates(w: Column) -> Column:
    return F.coalesce(w.isin(NEGATIONS) | F.contains(w, F.lit("n't")), F.lit(False))


def scored_tokens(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(track_id, i, w, valence) of the tokens of (track_id, text) that the lexicon (word, valence) has, as their neighbours leave them.

    A booster's own valence is 0. ``lexicon`` has small letters and one row a word; it joins by Spark's own choice.
    """
    rows = texts.select("track_id", "text").repartition("track_id").select("track_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("track_id", F.inline(F.array(F.struct(tokens(F.col("text")).alias("tokens")))))
    caps = F.size(F.filter("tokens", lambda t: _upper(t)))
    # told before the tokens are taken apart, so that no row carries them all
    rows = rows.select("track_id", "tokens", F.inline(F.array(F.struct(((caps > 0) & (caps < F.size("tokens"))).alias("mixed")))))
    rows = rows.select("track_id", "mixed", F.posexplode("tokens").alias("i", "t"))
    rows = rows.withColumns({"w": F.lower("t"), "caps": _upper(F.col("t")) & F.col("mixed")})
    rows = rows.join(lexicon.select(F.col("word").alias("w"), F.col("valence").cast("double").alias("v")), "w", "left")
    by = Window.partitionBy("track_id").orderBy("i")
    near = F.struct("w", "caps", F.col("v").isNotNull().alias("known"))
    rows = rows.withColumns({f"p{k}": F.lag(near, k).over(by) for k in (1, 2, 3)} | {"next": F.lead(near, 1).over(by), "but": F.min(F.when(F.col("w") == "but", F.col("i"))).over(Window.partitionBy("track_id"))})
    p = [F.col(f"p{k}") for k in (1, 2, 3)]
    word = lambda k: F.coalesce(p[k]["w"], F.lit(""))
    so = lambda k: word(k).isin("so", "this")
    doubt = lambda k: word(k) == "doubt"

    no = (word(0) == "no") | (word(1) == "no") | ((word(2) == "no") & word(0).isin("or", "nor"))
    start = F.when(no, F.col("v") * NEGATED).when((F.col("w") == "no") & F.coalesce(F.col("next.known"), F.lit(False)), 0.0).otherwise(F.col("v"))
    x = _let(start, lambda v: v + F.when(F.col("caps"), F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(0.0))

    def behind(v: Column, at: int) -> Column:
        """A valence behind its neighbour at a distance: boosted, then negated."""
        sign = F.when(v < 0, -1.0).otherwise(1.0)
        boost = F.when(word(at).isin(STRONG), BOOST * sign).when(word(at).isin(WEAK), -BOOST * sign).otherwise(0.0)
        boost = F.when(boost == 0, 0.0).otherwise(boost + F.when(p[at]["caps"], F.when(v > 0, CAPITALS).otherwise(-CAPITALS)).otherwise(0.0)) * FURTHER[at]
        never = F.lit(False) if at == 0 else (word(at) == "never") & (so(0) | so(at - 1))
        surely = F.lit(False) if at == 0 else (word(at) == "without") & (doubt(0) | doubt(at - 1))
        factor = F.when(never, NEVER_SO).when(surely, 1.0).when(_negates(word(at)), NEGATED).otherwise(1.0)
        changed = (v + boost) * factor
        if at == 2:
            pairs = [F.concat_ws(" ", word(2), word(1)), F.concat_ws(" ", word(1), word(0))]
            changed = changed - sum(F.when(x.isin(WEAK_PAIRS), BOOST).otherwise(0.0) for x in pairs)
        return F.when(p[at].isNotNull() & ~p[at]["known"], changed).otherwise(v)

    for at in range(3):
        x = _let(x, (lambda at: lambda v: behind(v, at))(at))
    least = p[0].isNotNull() & ~p[0]["known"] & (word(0) == "least") & ~word(1).isin("at", "very")
    x = _let(x, lambda v: F.when(least, v * NEGATED).otherwise(v))
    plain = F.col("w").isin(STRONG + WEAK) | ((F.col("w") == "kind") & (F.col("next.w") == "of"))
    x = F.when(F.coalesce(plain, F.lit(False)), 0.0).otherwise(x)
    weight = F.when(F.col("i") < F.col("but"), BEFORE_BUT).when(F.col("i") > F.col("but"), BEHIND_BUT).otherwise(1.0)
    return rows.where("v IS NOT NULL").select("track_id", "i", "w", (x * weight).alias("valence"))


def emphasis(text: Column) -> Column:
    """What exclamation and question marks add to a text's valence, whichever way it goes."""
    n = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\?"))
    asked = F.when(n > 3, MANY_QUESTIONS).when(n > 1, n * QUESTION).otherwise(0.0)
    return F.least(F.regexp_count(F.coalesce(text, F.lit("")), F.lit("!")), F.lit(MOST_EXCLAMATIONS)) * EXCLAMATION + asked


def compound(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(track_id, compound) of every text (track_id, text), from -1 to 1; 0 for one without a word of the lexicon. Ids are unique."""
    sums = scored_tokens(texts, lexicon).groupBy("track_id").agg(F.sum("valence").alias("s"))
    rows = texts.select("track_id", emphasis(F.col("text")).alias("marks")).join(sums, "track_id", "left")
    s = F.coalesce(F.col("s"), F.lit(0.0))
    whole = _let(s + F.signum(s) * F.col("marks"), lambda v: v / F.sqrt(v * v + SCALE))
    return rows.select("track_id", F.greatest(F.least(whole, F.lit(1.0)), F.lit(-1.0)).alias("compound"))
