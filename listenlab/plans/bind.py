"""Logical tables of the library, bound to the driver's Parquet tables; the same bindings as DuckDB CTEs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from listenlab.session import table
from listenlab.sources import demo

#: Pitch names in order, and the twelve unit features in order.
KEYS = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]
UNIT = ["energy", "danceability", "valence", "acousticness", "brightness", "instrumentalness", "speechiness", "liveness"]


#: Titles and channels of every kind that the title rules tell apart; {n} is a name, {b} a brand.
SHAPES = [
    "{n} | {b} | Official Video", "Watched {n} (Lyric Video)", "{n} Trailer", "{n} #shorts #dance", "{n} EP 3 the end eng sub", "{n} 東京 - 歌", "{b} - {n} ft. Someone", "{n} Song: {n} of {b}",
    '{n} (From "The Film")', "Top 10 {n} @someone", "{n} full song 4K", "{n}’s own [Audio] it's {n}", "http://deleted.example/{n}", "THE {n} \U0001f3b5 LIVE AT {b}", "{n} workout podcast", "hd {n}",
]
CHANNELS = ["{b} - Topic", "T-Series", "games daily", "東 music", "{b}", "Think Music India", "someone of {n}"]


#: Titles, artists' fields and albums that each title rule is for, and what is to be told: song, performer, film, their rules, and gates.
TITLE_CASES = [
    ("{n} (From \"{b} Film\")", "Ann {b}", None, "{n}", "Ann {b}", "{b} Film", "whole title", "artist's field", "from", ""),
    ("{n} - a from here", "Ann", None, "{n}", "Ann", None, "before a subtitle", "artist's field", None, ""),
    ("far from {n}", "{b}", None, "far from {n}", "{b}", None, "whole title", "artist's field", None, ""),
    ("{n} [From {b}]", "Ann", "{n} (Original Score)", "{n}", "Ann", "{b}", "whole title", "artist's field", "from", ""),
    ("{n} Video Song | Someone, Other", "{b}", None, "{n}", "{b}", None, "part of the title", "artist's field", None, ""),
    ("{b} (1999) | Vidyasagar", "{n} Song", None, "{n}", None, "{b}", "field song words", None, "leads the title", ""),
    ("One, Two | Three", "{n} Video Song Ft {b}", None, "{n}", "{b}", None, "field song words", "beside the song", None, ""),
    ("{b} | one", "Full Video: {n}", None, "{n}", None, "{b}", "field noise: song", None, "leads the title", ""),
    ("something", "{n}: {b} Ft Nora", None, "{n}", "{b}", None, "field song: performers", "beside the song", None, ""),
    ("one two three four five | x", "{n} Video", None, "{n}", None, None, "field ends in video words", None, None, ""),
    ("{b} | x", "SOME LOUD NAME", None, "Some Loud Name", None, "{b}", "field in capitals or a song's script", None, "leads the title", ""),
    ("SOME NAME - {n}", "SOME NAME", None, "{n}", None, None, "behind its artist", None, None, ""),
    ("{n} - x", "itzy", None, "{n}", "itzy", None, "before a subtitle", "artist's field", None, ""),
    ("ITZY \"{n}\" M/V @ITZY", "JYP Entertainment", None, "{n}", "ITZY", None, "quoted", "before the quotes", None, ""),
    ("Zee Music '{n}' MV", "T-Series", None, "{n}", None, None, "quoted", None, None, ""),
    ("{n} - Remix", "Ann {b}", None, "{n} (Remix)", "Ann {b}", None, "version", "artist's field", None, ""),
    ("Ann {b} - {n}", "Ann {b}", None, "{n}", "Ann {b}", None, "behind its artist", "artist's field", None, ""),
    ("{n} - a poetic line", "Ann {b}", None, "{n}", "Ann {b}", None, "before a subtitle", "artist's field", None, ""),
    ("{b}: {n} | Official", "Ann", None, "{n}", "Ann", None, "part of the title", "artist's field", None, ""),
    ("Official Video // {n} // {b}", "Ann", None, "{n}", "Ann", None, "part of the title", "artist's field", None, ""),
    ("{n} (feat. {b}) [Tamil] (2019)", "Ann", None, "{n}", "Ann", None, "whole title", "artist's field", None, ""),
    ("here with {n} ft. {b}", "Ann", None, "here with {n}", "Ann", None, "whole title", "artist's field", None, ""),
    ("{n} \U0001f3b5 @someone", "@arrahman", None, "{n}", "A.R. Rahman", None, "whole title", "composer's handle", None, ""),
    ("{n}", "@nobody", None, "{n}", None, None, "whole title", None, None, ""),
    ("{n}", "{b} Records", "{b} (Original Motion Picture Soundtrack)", "{n}", None, "{b}", "whole title", None, "album of a film", ""),
    ("{n}", "Ann", "Music from the Motion Picture {b}", "{n}", "Ann", "{b}", "whole title", "artist's field", "film's album", ""),
    ("{n}", "Ann", "Nine {b}", "{n}", "Ann", None, "whole title", "artist's field", None, ""),
    ("BLUE SKY Lyrical", "Ann", None, "Blue Sky", "Ann", None, "whole title", "artist's field", None, ""),
    ("{n} #one #two", "Ann", None, "{n}", "Ann", None, "whole title", "artist's field", None, "short"),
    ("{n} trailer", "Ann", None, None, "Ann", None, "whole title", "artist's field", None, "other"),
    ("{n} ep 3 of it eng sub #shorts", "Ann", None, None, "Ann", None, "whole title", "artist's field", None, "other"),
    (None, None, None, None, None, None, "empty", None, None, ""),
    ("", "Ann", "", None, "Ann", None, "empty", "artist's field", None, ""),
]


def case_list(k: int) -> str:
    """One column of the title cases as a DuckDB list."""
    return "[" + ", ".join("NULL" if c[k] is None else "'" + c[k].replace("'", "''") + "'" for c in TITLE_CASES) + "]"


def clip01(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


class Tables:
    """Lazy access to the logical tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return table(self.spark, self.dir, name)

    @property
    def tracks(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("genre"),
            F.col("p_size").alias("popularity"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") * 10000).alias("duration_ms"),
            F.concat((F.col("p_partkey") % 70 + 1950).cast("string"), F.lit("-01-01")).alias("release_date"),
        )

    @property
    def plays(self) -> DataFrame:
        return self.raw("lineitem").select(F.col("l_partkey").alias("track_id"), F.col("l_shipdate").alias("played_at"), F.col("l_returnflag").alias("source")).distinct()

    @property
    def plays_ev(self) -> DataFrame:
        return self.raw("events").select(
            "event_id", F.get_json_object("props", "$.k").cast("bigint").alias("track_id"), F.col("ts").alias("played_at"), F.col("event_type").alias("source"),
            "user_id", (F.col("value") * 1000).cast("bigint").alias("played_ms"), (F.col("event_type") == "error").alias("skipped"),
        )

    @property
    def features(self) -> DataFrame:
        e = lambda i: F.get("embedding", F.lit(i)).cast("double")
        names = F.array(*map(F.lit, KEYS))
        return self.raw("embeddings").select(
            F.col("vec_id").alias("track_id"), *[clip01(e(i) + 0.5).alias(n) for i, n in enumerate(UNIT)],
            (60 + 120 * clip01(e(8) + 0.5)).alias("bpm"), (-35 + 30 * clip01(e(9) + 0.5)).alias("loudness_db"), (30 * clip01(e(10) + 0.5)).alias("dynamic_range"),
            F.transform(F.slice("embedding", 17, 13), lambda x: x.cast("double")).alias("mfcc"), F.get(names, F.col("label").cast("int")).alias("key"),
            F.when(F.col("vec_id") % 2 == 0, "major").otherwise("minor").alias("mode"), F.when(F.col("vec_id") % 17 == 0, "x").alias("error"),
        )

    @property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings").select(
            F.col("vec_id").alias("track_id"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").cast("long").alias("artist"), (F.col("vec_id") % 50).alias("album")
        )

    @property
    def playlist_tracks(self) -> DataFrame:
        return self.listed(self.raw("lineitem"))

    def listed(self, lines: DataFrame) -> DataFrame:
        """Lines with their positions; those of some lines are in the order of all."""
        w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
        return lines.select(F.col("l_orderkey").alias("playlist_id"), F.row_number().over(w).alias("position"), F.col("l_partkey").alias("track_id"))

    @property
    def playlists(self) -> DataFrame:
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("list "), F.col("o_orderkey")).alias("name"), F.col("o_orderstatus").alias("source"), F.col("o_orderdate").alias("created_at"))

    @property
    def lyrics(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("track_id"), "text")

    @property
    def labels(self) -> DataFrame:
        return self.raw("labels").select(F.col("doc_id").alias("track_id"), F.stack(F.lit(2), F.lit("quality"), F.col("quality"), F.lit("toxic"), F.col("toxic")).alias("axis", "value"))

    @property
    def titles_raw(self) -> DataFrame:
        return self.raw("pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("artist"), "url")

    @property
    def videos(self) -> DataFrame:
        filled = lambda forms, k: F.replace(F.replace(F.get(F.array(*map(F.lit, forms)), F.pmod(F.col("p_partkey"), F.lit(k)).cast("int")), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.col("p_brand"))
        return self.raw("part").select(
            F.col("p_partkey").alias("id"), filled(SHAPES, len(SHAPES)).alias("title"), filled(CHANNELS, len(CHANNELS)).alias("channel"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"),
            F.concat(F.when(F.col("p_partkey") % 13 == 0, "https://v.example/shorts/").otherwise("https://v.example/watch?v="), "p_partkey").alias("url"),
            F.when(F.col("p_partkey") % 9 != 0, F.col("p_size") * 5).alias("seconds"), (F.col("p_partkey") % 20).alias("category"),
        )

    @property
    def songs(self) -> DataFrame:
        """Every part twice, under two titles: what duplicate resolution is for."""
        p = self.raw("part")
        one = lambda i, title: p.select((F.col("p_partkey") * 2 + i).alias("id"), title.alias("title"), F.col("p_brand").alias("artist"), ((F.col("p_partkey") + i * 3) % 7).alias("plays"))
        name = F.concat("p_name", F.lit(" k"), "p_partkey")
        rows = one(0, name).unionByName(one(1, F.concat(name, F.lit(" (Official Video)"))))
        return rows.withColumns({"duration_ms": F.lit(None).cast("bigint"), "external": F.lit(None).cast("string"), "enriched": F.when(F.col("id") % 5 == 0, 1).otherwise(0), "preview": F.when(F.col("id") % 3 == 0, "x")})

    @property
    def top_items(self) -> DataFrame:
        w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
        return self.raw("customer").select(F.col("c_mktsegment").alias("source"), F.row_number().over(w).alias("rank"), F.col("c_name").alias("name"), F.col("c_custkey").alias("item_id"))

    def sounds(self, seconds: float) -> DataFrame:
        """A sound for each supplier; every eleventh has none. Made again wherever it is read, which costs less than to write and read it."""
        k = F.col("s_suppkey")
        rows = self.raw("supplier").select(k.alias("track_id"), F.when(k % 11 != 0, 80 + k % 9 * 10).alias("bpm"), (k % 12).alias("tonic"), F.when(k % 2 == 0, "major").otherwise("minor").alias("mode"), (0.001 + F.abs("s_acctbal") / 1e6).alias("noise"))
        # few rows a partition, as each of them becomes long
        return demo.recordings(rows.repartition(rows.count() // 25 + 1, "track_id"), seconds)

    @property
    def recordings(self) -> DataFrame:
        return self.sounds(4.0)

    @property
    def clips(self) -> DataFrame:
        return self.sounds(1.5)

    @property
    def play_counts(self) -> DataFrame:
        return self.plays.groupBy("track_id").agg(F.count("*").alias("plays"))


_LIST = lambda words: "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"
_FILL = lambda forms: f"replace(replace({_LIST(forms)}[p_partkey % {len(forms)} + 1], '{{n}}', p_name), '{{b}}', p_brand)"
_E = lambda i: f"embedding[{i + 1}]::DOUBLE"
_CLIP = lambda x: f"greatest(least({x}, 1.0::DOUBLE), 0.0::DOUBLE)"
CTE = {
    "tracks": "tracks AS (SELECT p_partkey AS id, p_name AS title, p_brand AS artist, p_type AS genre, p_size AS popularity, CASE WHEN p_size % 5 <> 0 THEN p_size * 10000 END AS duration_ms, concat(CAST(p_partkey % 70 + 1950 AS VARCHAR), '-01-01') AS release_date FROM part)",
    "plays": "plays AS (SELECT DISTINCT l_partkey AS track_id, l_shipdate AS played_at, l_returnflag AS source FROM lineitem)",
    "plays_ev": "plays_ev AS (SELECT event_id, CAST(props ->> '$.k' AS BIGINT) AS track_id, ts AS played_at, event_type AS source, user_id, CAST(trunc(value * 1000) AS BIGINT) AS played_ms, event_type = 'error' AS skipped FROM events)",
    "features": "features AS (SELECT vec_id AS track_id, "
    + ", ".join(f"{_CLIP(_E(i) + ' + 0.5')} AS {n}" for i, n in enumerate(UNIT))
    + f", 60 + 120 * {_CLIP(_E(8) + ' + 0.5')} AS bpm, -35 + 30 * {_CLIP(_E(9) + ' + 0.5')} AS loudness_db, 30 * {_CLIP(_E(10) + ' + 0.5')} AS dynamic_range, embedding[17:29]::DOUBLE[] AS mfcc, "
    + "['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][label + 1] AS key, CASE WHEN vec_id % 2 = 0 THEN 'major' ELSE 'minor' END AS mode, CASE WHEN vec_id % 17 = 0 THEN 'x' END AS error FROM embeddings)",
    "vectors": "vectors AS (SELECT vec_id AS track_id, embedding::DOUBLE[] AS vec, label::BIGINT AS artist, vec_id % 50 AS album FROM embeddings)",
    "playlist_tracks": "playlist_tracks AS (SELECT l_orderkey AS playlist_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS position, l_partkey AS track_id FROM lineitem)",
    "playlists": "playlists AS (SELECT o_orderkey AS id, concat('list ', o_orderkey) AS name, o_orderstatus AS source, o_orderdate AS created_at FROM orders)",
    "lyrics": "lyrics AS (SELECT doc_id AS track_id, text FROM documents)",
    "axis_labels": "axis_labels AS (SELECT doc_id AS track_id, 'quality' AS axis, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)",
    "titles_raw": "titles_raw AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS artist, url FROM pages)",
    "top_items": "top_items AS (SELECT c_mktsegment AS source, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank, c_name AS name, c_custkey AS item_id FROM customer)",
    "videos": f"videos AS (SELECT p_partkey AS id, {_FILL(SHAPES)} AS title, {_FILL(CHANNELS)} AS channel, p_name AS name, p_brand AS brand, CASE WHEN p_partkey % 13 = 0 THEN 'https://v.example/shorts/' ELSE 'https://v.example/watch?v=' END || p_partkey AS url, CASE WHEN p_partkey % 9 <> 0 THEN p_size * 5 END AS seconds, p_partkey % 20 AS category FROM part)",
    "songs": "songs AS (SELECT p_partkey * 2 + i AS id, p_name || ' k' || p_partkey || CASE WHEN i = 1 THEN ' (Official Video)' ELSE '' END AS title, p_brand AS artist, (p_partkey + i * 3) % 7 AS plays FROM part, (SELECT unnest([0, 1]) AS i))",
    "play_counts": "play_counts AS (SELECT track_id, count(*) AS plays FROM plays GROUP BY track_id)",
}


def sql(names: str, select: str, more: str = "") -> str:
    """Oracle text: the bindings named, further CTEs, and the final SELECT."""
    parts = [CTE[n] for n in names.split()] + ([more] if more else [])
    return f"WITH {', '.join(parts)} {select}"
