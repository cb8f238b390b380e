"""Duplicate tracks: signatures, blocking, matching, components, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions import text as tx

from .order import kept

#: What tells a compilation.
COMPILATION = r"\b(jukebox|mashup|medley|non ?stop|mega ?mix|all songs|full album|audio songs|video songs|hits|playlist|\bmix\b|dance cover|reaction)\b"
#: A token in at most RARE titles is rare; a bucket of more rows isn't blocked on; a larger cluster isn't merged.
RARE, POSTING, CLUSTER, PASSES = 6, 300, 4, 6


def signed(tracks: DataFrame) -> DataFrame:
    """DD1: all, title and artist tokens, and whether the title names a compilation."""
    title, artist = tx.tokens(F.col("title")), tx.tokens(F.col("artist"))
    mix = F.regexp_like(F.lower(F.coalesce("title", F.lit(""))), F.lit(COMPILATION))
    return tracks.select("id", "title", "artist", title.alias("tt"), artist.alias("at"), F.array_union(title, artist).alias("toks"), mix.alias("mix"))


def frequency(signed: DataFrame) -> DataFrame:
    """DD2, AG39: in how many titles that aren't compilations a token stands."""
    return signed.where("NOT mix").select(F.explode("tt").alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def blocked(signed: DataFrame, most: int = POSTING) -> DataFrame:
    """DD3, JN14: pairs (a, b) that share a title token that isn't in too many rows."""
    post = signed.where("NOT mix").select("id", F.explode("tt").alias("token"))
    few = post.groupBy("token").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= most)).select("token")
    p = post.join(few, "token")
    return p.select("token", F.col("id").alias("a")).join(p.select("token", F.col("id").alias("b")), "token").where("a < b").select("a", "b").distinct()


def matched(signed: DataFrame, pairs: DataFrame, df: DataFrame) -> DataFrame:
    """DD4, JN15: two shared tokens, one title within the other's tokens, one of them rare, and a shared one outside the title."""
    side = lambda s: signed.select(F.col("id").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("tt", "toks")])
    j = pairs.join(side("a"), "a").join(side("b"), "b")
    both = F.array_intersect("toks_a", "toks_b")
    inside = lambda x, y: (F.size(x) > 0) & (F.size(F.array_except(x, y)) == 0)
    small = F.when(F.size("tt_a") <= F.size("tt_b"), F.col("tt_a")).otherwise(F.col("tt_b"))
    ok = j.where((F.size(both) >= 2) & (inside("tt_a", "toks_b") | inside("tt_b", "toks_a")) & (F.size(F.array_except(both, small)) >= 1) & ((F.size(small) > 1) | (F.length(F.get(small, 0)) >= 4)))
    rare = df.where(F.col("df") <= RARE).select("token")
    has = ok.select("a", "b", F.explode(both).alias("token")).join(rare, "token", "left_semi").select("a", "b").distinct()
    return has


def same_external(tracks: DataFrame, column: str) -> DataFrame:
    """DD5, JN16: star edges to the smallest id of each external id."""
    w = Window.partitionBy(column)
    return tracks.where(F.col(column).isNotNull()).select(F.min("id").over(w).alias("a"), F.col("id").alias("b")).where("a < b")


def components(edges: DataFrame) -> DataFrame:
    """DD6: (id, root): the smallest id that edges lead to.

    In each round every id hooks onto its smallest smaller neighbour, chains of hooks are halved until they
    end at roots, and only edges between different roots are left for the next round.
    """
    left = kept(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    ids = kept(left.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    found = ids.select("id", F.col("id").alias("root"))
    while not left.isEmpty():
        hooks = kept(left.groupBy("b").agg(F.min("a").alias("p")))
        while True:
            up = hooks.select(F.col("b").alias("p"), F.col("p").alias("pp"))
            halved = kept(hooks.join(up, "p", "left").select("b", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            hooks = halved.select("b", "p")
            if halved.where("moved").isEmpty():
                break
        to = lambda name: hooks.select(F.col("b").alias(name), F.col("p").alias(f"{name}_"))
        found = kept(found.join(to("root"), "root", "left").select("id", F.coalesce("root_", "root").alias("root")))
        ends = left.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_", "a").alias("x"), F.coalesce("b_", "b").alias("y"))
        left = kept(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    return found


def eligible(clusters: DataFrame, signed: DataFrame, df: DataFrame) -> DataFrame:
    """DD7, SE4: clusters small enough whose members all share a rare token; one never seen in a title isn't rare."""
    n = clusters.groupBy("root").agg(F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("n") <= CLUSTER))
    toks = clusters.join(n, "root").join(signed.select("id", F.explode("toks").alias("token")), "id").join(df, "token", "left").where(F.coalesce("df", F.lit(99)) <= RARE)
    return toks.groupBy("root", "token", "n").agg(F.countDistinct("id").alias("have")).where("have = n").select("root").distinct()


def canonical(clusters: DataFrame, tracks: DataFrame) -> DataFrame:
    """DD8: of each cluster the row with an external id, enriched, with a preview, without a pipe in the title, of most plays, of a shorter title, of a smaller id."""
    j = clusters.join(tracks, "id")
    rank = F.struct(F.col("external").isNotNull(), F.coalesce(F.col("enriched") == 1, F.lit(False)), F.col("preview").isNotNull(), ~F.contains(F.coalesce("title", F.lit("")), F.lit("|")), F.col("plays"), -F.length(F.coalesce("title", F.lit(""))), -F.col("id"))
    return j.groupBy("root").agg(F.max_by("id", rank).alias("canonical"), F.count("*").alias("n"))


def merged(tracks: DataFrame, plays: DataFrame, passes: int = PASSES) -> tuple[DataFrame, DataFrame, int]:
    """DD9, SNK14: (tracks, plays, merged clusters) after merging until no cluster is left, frequencies made anew each pass."""
    from .writes import repoint

    total = 0
    for _ in range(passes):
        s = kept(signed(tracks))
        df = kept(frequency(s))
        edges = matched(s, blocked(s), df).unionByName(same_external(tracks, "external"))
        c = components(edges)
        c = c.join(eligible(c, s, df), "root", "left_semi")
        best = kept(canonical(c, tracks))
        n = best.count()
        if not n:
            break
        total += n
        ids = kept(c.join(best, "root").where("id <> canonical").select(F.col("id").alias("dup"), "canonical"))
        plays = kept(repoint(plays, ids, "track_id", ["track_id", "played_at", "source"]))
        tracks = kept(tracks.join(ids.select(F.col("dup").alias("id")), "id", "left_anti"))
    return tracks, plays, total
