"""Queries over titles, histories and lyrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from listenlab.functions import text as tx
from listenlab.operators import etl
from listenlab.operators import sentiment as se
from listenlab.operators import titles as ti
from listenlab.operators import lyrics as ly

from .bind import TITLE_CASES, case_list, sql
from .registry import query

R = lambda n: F.round(n, 6).alias(n)
_WRDS = "regexp_extract_all(lower(text), '([a-z'']+)', 1)"


@query("title_clean", sql("titles_raw", f"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '(?i)^watched ', ''), '(?i)[(\\[][^)\\]]*\\b({tx.NOISE})\\b[^)\\]]*[)\\]]', ' ', 'g'), '(?i)[(\\[]\\s*(feat|ft|featuring)\\b[^)\\]]*[)\\]]', ' ', 'g'), '\\s+', ' ', 'g'), ' -–|') AS title FROM titles_raw"""))
def clean(t):
    return t.titles_raw.select("page_id", tx.clean_title(F.col("title")).alias("title"))


@query("plain_keys", sql("tracks", "SELECT id, regexp_replace(lower(title), '[^a-z0-9]', '', 'g') AS k FROM tracks"))
def plain(t):
    return t.tracks.select("id", tx.plain(F.col("title")).alias("k"))


@query("video_id", sql("titles_raw", "SELECT page_id, nullif(regexp_extract(url || '?v=abc_' || page_id || 'xyz', '[?&]v=([\\w-]{6,})', 1), '') AS video FROM titles_raw"))
def video(t):
    return t.titles_raw.select("page_id", tx.video_id(F.concat("url", F.lit("?v=abc_"), "page_id", F.lit("xyz"))).alias("video"))


@query("iso_duration", sql("tracks", "SELECT id, (id % 3) * 3600 + (id % 60) * 60 + id % 59 AS seconds FROM tracks"))
def iso(t):
    d = F.concat(F.lit("PT"), F.col("id") % 3, F.lit("H"), F.col("id") % 60, F.lit("M"), F.col("id") % 59, F.lit("S"))
    return t.tracks.select("id", tx.iso_seconds(d).cast("long").alias("seconds"))


@query("cjk_flag", sql("lyrics", "SELECT track_id, regexp_matches(text || CASE WHEN track_id % 7 = 0 THEN '東' ELSE '' END, '[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]') AS cjk FROM lyrics"))
def cjk(t):
    return t.lyrics.select("track_id", tx.has_cjk(F.concat("text", F.when(F.col("track_id") % 7 == 0, "東").otherwise(""))).alias("cjk"))


@query("caps_titles", sql("lyrics", "SELECT track_id, length(l) >= 3 AND upper(l) = l AND lower(l) <> l AS caps FROM (SELECT track_id, regexp_replace(split_part(text, chr(10), 2), '[^\\p{L}]', '', 'g') AS l FROM lyrics)"))
def caps(t):
    return t.lyrics.select("track_id", tx.all_caps(F.get(F.split("text", "\n"), 1)).alias("c")).select("track_id", F.coalesce("c", F.lit(False)).alias("caps"))


@query("junk_titles", sql("lyrics", "SELECT track_id FROM lyrics WHERE length(regexp_replace(split_part(text, '.', 2), '[^\\p{L}\\p{N}]', '', 'g')) < 2"))
def junk(t):
    return t.lyrics.where(tx.is_junk(F.get(F.split("text", "[.]"), 1))).select("track_id")


@query("messy_years", sql("tracks", "SELECT id, substr(release_date, 1, 4)::INTEGER AS year FROM tracks"))
def years(t):
    return t.tracks.select("id", tx.year_of(F.concat(F.lit("c. "), "release_date")).alias("year"))


@query("clock_times", sql("tracks", "SELECT id, lpad((duration_ms // 1000 // 60)::VARCHAR, 2, '0') || ':' || lpad((duration_ms // 1000 % 60)::VARCHAR, 2, '0') AS clock FROM tracks WHERE duration_ms IS NOT NULL"))
def clocks(t):
    return t.tracks.where("duration_ms IS NOT NULL").select("id", tx.clock(F.floor(F.col("duration_ms") / 1000)).alias("clock"))


@query("unescaped_titles")
def unescaped(t):
    return t.titles_raw.select("page_id", tx.nfkc(tx.unescape("title")).alias("title"))


@query("normalize_titles")
def normalized(t):  # ETL3, ETL4
    return ti.normalised(t.titles_raw.select("page_id", tx.unescape("title").alias("title"), "artist", F.lit(None).cast("string").alias("album")))


@query("normalize_stats")
def normal_stats(t):
    return ti.stats(ti.normalised(t.titles_raw.select("page_id", "title", "artist", F.lit(None).cast("string").alias("album"))))


def _cases(t):
    """Each part under one of the written title cases, by its key."""
    form = lambda k: F.replace(F.replace(F.get(F.array(*[F.lit(c[k]) for c in TITLE_CASES]), F.pmod("p_partkey", F.lit(len(TITLE_CASES))).cast("int")), F.lit("{n}"), F.col("p_name")), F.lit("{b}"), F.translate("p_brand", "#", ""))
    return t.raw("part").select(F.col("p_partkey").alias("id"), *[form(k).alias(n) for k, n in enumerate(("title", "artist", "album"))])


_ANSWERS = ["clean_title", "performer", "movie_album", "song_rule", "performer_rule", "film_rule"]
_ANSWER = "SELECT p_partkey AS id, " + ", ".join(f"replace(replace({case_list(3 + k)}[p_partkey % {len(TITLE_CASES)} + 1], '{{n}}', p_name), '{{b}}', replace(p_brand, '#', '')) AS {n}" for k, n in enumerate(_ANSWERS))
_ANSWER += f", [{', '.join(str('short' in c[9]).upper() for c in TITLE_CASES)}][p_partkey % {len(TITLE_CASES)} + 1] AS is_short, [{', '.join(str('other' in c[9]).upper() for c in TITLE_CASES)}][p_partkey % {len(TITLE_CASES)} + 1] AS is_non_music FROM part"


@query("title_rules", _ANSWER)
def title_rules(t):  # ETL3, ETL4: every rule, with the answers written beside the cases
    return ti.normalised(_cases(t)).select("id", *_ANSWERS, "is_short", "is_non_music")


@query("title_rule_counts", f"SELECT answer, rule, count(*) AS n FROM (SELECT unnest(['song', 'performer', 'film']) AS answer, unnest([song_rule, performer_rule, film_rule]) AS rule FROM ({_ANSWER})) GROUP BY ALL")
def title_rule_counts(t):
    return ti.rule_counts(ti.normalised(_cases(t)))


_CNT = "c AS (SELECT track_id, w, len(w) AS n FROM (SELECT track_id, regexp_extract_all(lower(text), '([a-z'']+)', 1) AS w FROM lyrics) WHERE len(w) >= 5)"


@query("word_counts", sql("lyrics", "SELECT track_id, n::BIGINT AS word_count, round(len(list_distinct(w)) / n::DOUBLE, 6) AS unique_ratio FROM c", _CNT))
def word_counts(t):
    return ly.counted(t.lyrics).select("track_id", "word_count", R("unique_ratio"))


_STOP = ", ".join(f"'{w}'" for w in ly.STOP)
_TOPW = f"tw AS (SELECT * FROM (SELECT track_id, word, n, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, word) AS k FROM (SELECT track_id, word, count(*) AS n FROM (SELECT track_id, unnest({_WRDS}) AS word FROM lyrics) WHERE length(word) > 2 AND word NOT IN ({_STOP}) GROUP BY 1, 2)) WHERE k <= 12)"


@query("top_words", sql("lyrics", "SELECT track_id, word, n FROM tw", _TOPW))
def top_words(t):
    return ly.top_words(t.lyrics)


@query("word_cloud", sql("lyrics plays", "SELECT word, sum(n * coalesce(p, 1))::BIGINT AS weight FROM tw LEFT JOIN (SELECT track_id, count(*) AS p FROM plays GROUP BY 1) USING (track_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 40", _TOPW))
def cloud(t):
    return ly.cloud(ly.top_words(t.lyrics), t.plays)


_LEX = lambda lex: "len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in lex) + ")))"
_SENT = f"s AS (SELECT track_id, coalesce((g - b) / nullif(g + b, 0)::DOUBLE, 0) AS mood FROM (SELECT track_id, {_LEX(ly.GOOD)} AS g, {_LEX(ly.BAD)} AS b FROM (SELECT track_id, {_WRDS} AS w FROM lyrics)))"


@query("lyric_sentiment", sql("lyrics", "SELECT track_id, round(mood, 6) AS mood FROM s", _SENT))
def sentiment(t):
    return t.lyrics.select("track_id", F.round(ly.sentiment(F.col("text")), 6).alias("mood"))


@query("mood_mismatch", sql("lyrics features", "SELECT track_id, CASE WHEN valence >= .55 AND mood <= -.2 THEN 'happy sound, sad words' ELSE 'dark sound, upbeat words' END AS kind, round(abs(valence - (mood + 1) / 2), 6) AS gap FROM s JOIN features USING (track_id) WHERE valence >= .55 AND mood <= -.2 OR valence <= .4 AND mood >= .3 ORDER BY abs(valence - (mood + 1) / 2) DESC, track_id LIMIT 10", _SENT))
def mismatch(t):
    j = t.features.select("track_id", "valence").join(t.lyrics.select("track_id", ly.sentiment(F.col("text")).alias("mood")), "track_id")
    kind, gap = ly.mismatch(F.col("valence"), F.col("mood"))
    return j.select("track_id", kind.alias("kind"), gap.alias("gap")).where("kind IS NOT NULL").orderBy(F.col("gap").desc(), "track_id").limit(10).select("track_id", "kind", R("gap"))


@query("lyrics_overview", sql("lyrics", "SELECT count(*) AS texts, round(avg(n), 6) AS words, round(avg(len(list_distinct(w)) / n::DOUBLE), 6) AS richness, round(avg(mood), 6) AS sentiment, round(avg(CASE WHEN toxic = 1 THEN 100 ELSE 0 END), 6) AS explicit_pct FROM c JOIN s USING (track_id) LEFT JOIN (SELECT doc_id AS track_id, max(toxic) AS toxic FROM labels GROUP BY 1) USING (track_id)", f"{_CNT}, {_SENT}"))
def lyrics_overview(t):  # AG29
    flag = t.raw("labels").groupBy(F.col("doc_id").alias("track_id")).agg((F.max("toxic") == 1).alias("explicit"))
    rows = t.lyrics.withColumn("sentiment", ly.sentiment(F.col("text"))).join(flag, "track_id", "left")
    return ly.overview(rows).select("texts", *map(R, ["words", "richness", "sentiment", "explicit_pct"]))


_VAL = {"the": 0.1, "and": -0.2, "that": 0.5, "in": -0.4, "la": 0.7, "de": -0.6}


@query("lexicon_sentiment", sql("lyrics", "SELECT track_id, round(x / sqrt(x * x + 15), 6) AS compound FROM (SELECT track_id, list_sum(list_concat([0.0::DOUBLE], list_transform(" + _WRDS + ", lambda w: CASE w " + " ".join(f"WHEN '{w}' THEN {v}" for w, v in _VAL.items()) + " ELSE 0 END::DOUBLE))) AS x FROM lyrics)"))
def lexicon(t):  # LY1
    return t.lyrics.select("track_id", F.round(ly.compound(F.col("text"), _VAL), 6).alias("compound"))



# patterns and words are the rules' fixed values; the SQL says on its own how they decide
_Q = lambda text: "'" + text.replace("'", "''") + "'"
_ANY = lambda column, words: "len(list_filter([" + ", ".join(map(_Q, words)) + f"], lambda w: contains(lower({column}), w))) > 0"
_CJK = "regexp_matches({}, '[\\x{{3040}}-\\x{{30FF}}\\x{{3400}}-\\x{{4DBF}}\\x{{4E00}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7AF}}]')"
_PART = "len(list_filter([" + ", ".join(map(_Q, etl.CJK_MARKS)) + "], lambda w: contains(title, w))) > 0"
_HINT = f"({_ANY('channel', etl.MUSIC_CHANNELS)} OR {_ANY('title', etl.MUSIC_TITLES)} OR {_CJK.format('title')} AND ({_CJK.format('channel')} OR contains(lower(channel), 'music') OR {_PART}))"
_MUSIC = f"mv AS (SELECT *, {_HINT} AS music FROM videos)"


def _hinted(t):
    return t.videos.withColumn("music", etl.music_hint(F.col("title"), F.col("channel")))


_SEPS = lambda part, last: " ".join(f"WHEN contains(title, '{x}') THEN {part.format(x=x, n=len(x))}" for x in tx.SEPARATORS) + f" ELSE {last}"


@query("artist_split", sql("videos", "SELECT id, CASE WHEN m THEN who " + _SEPS("trim(split_part(title, '{x}', 1))", "who") + " END AS artist, CASE WHEN m THEN trim(n, ' -–|:') " + _SEPS("trim(substr(title, strpos(title, '{x}') + {n}))", "title") + f" END AS song FROM (SELECT *, n <> '' AND NOT contains(n, ' - ') AS m FROM (SELECT *, regexp_extract(title, {_Q(tx.SONG_LABEL)}, 1) AS n, trim(regexp_replace(channel, ' - Topic$', '')) AS who FROM videos))"))
def artist_split(t):  # SF2
    artist, song = tx.split_artist(F.col("title"), F.col("channel"))
    return t.videos.select("id", artist.alias("artist"), song.alias("song"))


@query("music_flag", sql("videos", "SELECT id, music FROM mv", _MUSIC))
def flag(t):  # ETL5
    return _hinted(t).select("id", "music")


@query("direct_music", sql("videos", "SELECT id, music OR category = 10 AS music FROM mv", _MUSIC))
def direct(t):  # ETL6
    return t.videos.select("id", etl.direct(F.col("title"), F.col("channel"), F.col("category")).alias("music"))


@query("metadata_music", sql("videos", f"SELECT id, {_ANY('channel', etl.MUSIC_CHANNELS)} OR {_ANY('title', etl.MUSIC_TITLES)} AS music FROM videos"))
def metadata(t):  # AX15
    return t.videos.select("id", etl.metadata_music(F.col("title"), F.col("channel")).alias("music"))


@query("channel_share", sql("videos", "SELECT lower(channel) AS channel, count(*) AS n, count(*) FILTER (music) AS music FROM mv GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (music) / count(*)::DOUBLE >= .5", _MUSIC))
def share(t):
    return etl.channel_share(_hinted(t))


@query("propagate_music", sql("videos", "SELECT id, CASE WHEN music THEN 'direct' WHEN ch IS NOT NULL AND NOT regexp_matches(title, '(?i)\\b(trailer|interview|making of|behind the scenes|press meet|speech)\\b') THEN 'channel' END AS reason FROM mv LEFT JOIN g ON ch = lower(channel)",
 f"{_MUSIC}, g AS (SELECT lower(channel) AS ch FROM mv GROUP BY 1 HAVING count(*) >= 2 AND count(*) FILTER (music) / count(*)::DOUBLE >= .5)"))
def propagate(t):
    return etl.propagate(_hinted(t)).select("id", "reason")


@query("non_music_gate", sql("videos", f"SELECT id, regexp_matches(title, {_Q(etl.NOT_MUSIC)}) OR regexp_matches(title, {_Q(etl.DRAMA)}) OR regexp_matches(title, {_Q(etl.PROMO)}) AS gated FROM videos"))
def gate(t):  # ETL1
    return t.videos.select("id", etl.not_music(F.col("title")).alias("gated"))


@query("short_gate", sql("videos", f"SELECT id, (regexp_matches(title || ' ' || channel, {_Q(etl.SHORTS)}) OR len(regexp_extract_all(title, '#[^\\s#]+')) >= 2) AND NOT regexp_matches(title || ' ' || channel, {_Q(etl.DRAMA)}) AS short FROM videos"))
def shorts(t):  # ETL2
    return t.videos.select("id", etl.is_short(F.col("title"), F.col("channel")).alias("short"))


@query("short_clips", sql("videos", "SELECT id FROM mv WHERE regexp_matches(title, '(?i)#\\s*shorts?\\b') OR contains(url, '/shorts/') OR seconds > 0 AND seconds < 45 AND NOT music", _MUSIC))
def clips(t):  # ETL8
    v = _hinted(t)
    return v.where(etl.short_clip(F.col("title"), F.col("url"), F.col("seconds"), F.col("music"))).select("id")


_EXC = "ex AS (SELECT *, CASE WHEN id % 6 = 0 THEN 'deleted/private' ELSE 'Music' END AS cat, CASE WHEN id % 4 <> 0 THEN 'non-music' ELSE 'short' END AS reason FROM videos)"


@query("residual_candidates", sql("videos", "SELECT id FROM ex WHERE reason = 'non-music' AND cat <> 'deleted/private' AND NOT starts_with(title, 'http') AND NOT coalesce(seconds > 0 AND seconds < 60, false)", _EXC))
def residual(t):  # ETL12
    i = F.col("id")
    rows = t.videos.drop("category").withColumns({"category": F.when(i % 6 == 0, "deleted/private").otherwise("Music"), "reason": F.when(i % 4 != 0, "non-music").otherwise("short")})
    return etl.candidates(rows).select("id")


_WORDS = lambda c: f"list_distinct(list_filter(string_split_regex(lower({c}), '[^a-z0-9\\x{{AC00}}-\\x{{D7A3}}]+'), lambda w: length(w) >= 3))"
_TOLD = lambda artist, said: f"(contains(lower({said}), lower({artist})) OR len(list_intersect(list_filter({_WORDS(artist)}, lambda w: length(w) >= 4), {_WORDS(said)})) > 0)"


@query("rescue_matches", sql("videos", f"SELECT id FROM (SELECT *, {_WORDS('hit')} AS h, {_WORDS('title')} AS w FROM hv) WHERE len(h) > 0 AND len(list_intersect(h, w)) / len(h)::DOUBLE >= .45 AND {_TOLD('who', chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || channel')} AND NOT regexp_matches(title, {_Q(etl.RESCUE_VETO)})",
 "hv AS (SELECT *, name || CASE WHEN id % 3 = 0 THEN ' night long song' ELSE ' one' END AS hit, CASE WHEN id % 2 = 0 THEN brand ELSE 'nobody known' END AS who FROM videos)"))
def rescue(t):  # ETL13
    v = t.videos
    i = F.col("id")
    hits = v.select("id", F.concat("name", F.when(i % 3 == 0, " night long song").otherwise(" one (From the Film)")).alias("hit_title"), F.when(i % 2 == 0, F.col("brand")).otherwise("nobody known").alias("hit_artist"))
    return etl.rescue(v.select("id", "title", "channel"), hits).select("id")


@query("false_rescues", sql("videos", f"SELECT id FROM (SELECT *, CASE WHEN id % 2 = 0 THEN brand ELSE name || ' quartet' END AS who FROM videos) WHERE NOT {_TOLD('who', chr(39) + chr(39) + ' || title || ' + chr(39) + ' ' + chr(39) + ' || channel')}"))
def purged(t):  # ETL14
    rows = t.videos.select("id", F.when(F.col("id") % 2 == 0, F.col("brand")).otherwise(F.concat("name", F.lit(" quartet"))).alias("artist"), F.col("title").alias("original_video"), "channel")
    return etl.false_rescues(rows).select("id")


@query("category_added", sql("videos", "SELECT id AS video, seconds FROM mv WHERE NOT music AND category = 10 AND id % 7 <> 0", _MUSIC))
def added(t):  # ETL15, SRC15
    v = t.videos.withColumnRenamed("id", "video")
    return etl.by_category(v.select("video", "title", "channel"), v.where("video % 7 = 0").select("video"), v.select("video", "category", "seconds")).select("video", "seconds")


_RC = f"trim(regexp_replace(regexp_replace(regexp_replace({{}}, {_Q(tx.RESCUE_BRACKETS)}, '', 'g'), {_Q(tx.RESCUE_NOISE)}, '', 'g'), '[#@]\\w+', '', 'g'), ' -–—|·•\"' || chr(39))"


@query("rescue_titles", sql("videos", f"SELECT id, {_RC.format('title')} AS title FROM videos"))
def rescue_titles(t):  # AX16
    return t.videos.select("id", tx.rescue_clean(F.col("title")).alias("title"))


@query("search_variants", sql("videos", "SELECT id, array_to_string(list_filter(f, lambda x, i: list_position(list_transform(f, lambda y: lower(y)), lower(x)) = i), '~') AS forms FROM (SELECT id, list_filter([CASE WHEN length(regexp_replace(lower(h), '[^a-z0-9]', '', 'g')) >= 3 THEN h END, l, trim(substr(b, 1, 60))], lambda x: x IS NOT NULL AND length(regexp_replace(lower(x), '[^a-z0-9\\x{AC00}-\\x{D7A3}]', '', 'g')) >= 3) AS f FROM (SELECT id, b, trim(split_part(b, '|', 1)) AS h, CASE WHEN contains(b, ' - ') THEN "
 + _RC.format("list_extract(string_split(b, ' - '), -1)") + " END AS l FROM (SELECT id, " + _RC.format("title") + " AS b FROM videos)))"))
def variants(t):  # SF12
    return t.videos.select("id", F.array_join(tx.variants(F.col("title")), "~").alias("forms"))


_END = "[" + ", ".join(map(_Q, tx.END_NOISE)) + "]"


@query("song_cores", sql("videos", f"SELECT id, CASE WHEN length(c) >= 3 THEN c ELSE '' END AS core FROM (SELECT id, array_to_string(CASE WHEN len(g) > 0 THEN w[list_min(g):list_max(g)] ELSE [] END, ' ') AS c FROM (SELECT id, w, list_filter(range(1, len(w) + 1), lambda i: NOT list_contains({_END}, lower(w[i]))) AS g FROM (SELECT id, list_filter(string_split(trim(regexp_replace(string_split_regex(regexp_replace(title, '[(\\[{{][^)\\]}}]*[)\\]}}]', ' ', 'g'), {_Q(tx.CUT)})[1], '\\s+', ' ', 'g'), ' -–—|:\"'), ' '), lambda x: x <> '') AS w FROM videos)))"))
def cores(t):  # SF8
    return t.videos.select("id", tx.core(F.col("title")).alias("core"))


@query("long_words", sql("videos", f"SELECT id, array_to_string(list_sort({_WORDS('title')}), ' ') AS words FROM videos"))
def long_words(t):  # SF7
    return t.videos.select("id", F.array_join(F.sort_array(tx.long_words(F.col("title"))), " ").alias("words"))


@query("prompts", sql("videos", "SELECT id, CASE WHEN starts_with(l, 'this is') OR starts_with(l, 'a ') OR starts_with(l, 'an ') OR starts_with(l, 'the sound of') THEN b ELSE 'This is a recording of ' || b || '.' END AS prompt FROM (SELECT id, b, lower(b) AS l FROM (SELECT id, rtrim(trim(x), '.') AS b FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'A ' || name || '.' WHEN 1 THEN ' this is ' || name WHEN 2 THEN 'The sound of ' || name || '..' ELSE name || '.' END AS x FROM videos)))"))
def prompts(t):  # SF13
    i = F.col("id") % 5
    x = F.when(i == 0, F.concat(F.lit("A "), "name", F.lit("."))).when(i == 1, F.concat(F.lit(" this is "), "name")).when(i == 2, F.concat(F.lit("The sound of "), "name", F.lit(".."))).otherwise(F.concat("name", F.lit(".")))
    return t.videos.select("id", tx.prompt(x).alias("prompt"))


@query("scrubbed_titles", sql("videos", "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]', '', 'g'), '[#@][\\w.]+', '', 'g'), '(?i)\\bshorts?\\b', '', 'g'), '\\s+', ' ', 'g')) AS title FROM videos"))
def scrubbed(t):  # SF9
    return t.videos.select("id", tx.scrub(F.col("title")).alias("title"))


@query("title_cases", sql("videos", "SELECT id, CASE WHEN upper(x) = x AND lower(x) <> x THEN array_to_string(list_transform(string_split(lower(x), ' '), lambda w: upper(w[1]) || w[2:]), ' ') ELSE x END AS title FROM (SELECT id, CASE WHEN id % 2 = 0 THEN upper(name) ELSE name END AS x FROM videos)"))
def cases(t):  # SF17
    return t.videos.select("id", tx.title_case(F.when(F.col("id") % 2 == 0, F.upper("name")).otherwise(F.col("name"))).alias("title"))


@query("normalize_preview")
def previewed(t):  # ETL11
    return etl.preview(ti.normalised(t.videos.select("id", "title", F.col("channel").alias("artist"), F.lit(None).cast("string").alias("album"))))


# words of the benchmark with invented valences, and texts with negations, boosters, capitals and a "but" put in at fixed places
_LX = "lx AS (SELECT DISTINCT w AS word, ((ascii(w) * 7 + length(w) * 3) % 9 - 4)::DOUBLE AS valence FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark) WHERE w NOT IN ('not', 'very', 'but', 'least', 'kind', 'doubt', 'no', 'nor'))"
_TX = "tx AS (SELECT track_id, list_transform(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\r\\x0B\\f]+'), lambda t: t <> ''), lambda t, i: CASE WHEN i % 7 = 3 THEN 'not' WHEN i % 11 = 5 THEN 'very' WHEN i = 30 THEN 'but' WHEN i % 13 = 6 THEN upper(regexp_replace(t, '[^a-zA-Z]', '', 'g')) || 'X' ELSE regexp_replace(t, '[^a-zA-Z]', '', 'g') || 'x' END) AS w FROM lyrics)"
_TK = (
    "tk AS (SELECT track_id, len(list_filter(w, lambda t: regexp_matches(t, '^[A-Z]+$'))) AS c, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS i FROM tx), "
    "tv AS (SELECT tk.*, lower(t) AS l, c > 0 AND c < n AND regexp_matches(t, '^[A-Z]+$') AS caps, valence AS v FROM tk LEFT JOIN (SELECT word || 'x' AS word, valence FROM lx) ON word = lower(t)), "
    "tw AS (SELECT *, " + ", ".join(f"lag(l, {k}) OVER s AS l{k}, lag(caps, {k}) OVER s AS c{k}, lag(v IS NOT NULL, {k}) OVER s AS k{k}" for k in (1, 2, 3)) + ", min(CASE WHEN l = 'but' THEN i END) OVER (PARTITION BY track_id) AS b FROM tv WINDOW s AS (PARTITION BY track_id ORDER BY i)), "
    "t0 AS (SELECT *, v + CASE WHEN NOT caps THEN 0 WHEN v > 0 THEN 0.733 ELSE -0.733 END AS x0 FROM tw WHERE v IS NOT NULL), "
    + ", ".join(f"t{k} AS (SELECT *, CASE WHEN k{k} THEN x{k - 1} WHEN k{k} IS NULL THEN x{k - 1} WHEN l{k} = 'very' THEN x{k - 1} + {d} * CASE WHEN x{k - 1} < 0 THEN -0.293 ELSE 0.293 END + {d} * CASE WHEN NOT c{k} THEN 0 WHEN x{k - 1} > 0 THEN 0.733 ELSE -0.733 END WHEN l{k} = 'not' THEN -0.74 * x{k - 1} ELSE x{k - 1} END AS x{k} FROM t{k - 1})" for k, d in ((1, 1.0), (2, 0.95), (3, 0.9)))
)


@query("rule_sentiment", sql("lyrics", "SELECT track_id, round(coalesce(s, 0) / sqrt(coalesce(s, 0) ^ 2 + 15), 5)::DOUBLE AS compound FROM lyrics LEFT JOIN (SELECT track_id, sum(x3 * CASE WHEN i < b THEN .5 WHEN i > b THEN 1.5 ELSE 1 END)::DOUBLE AS s FROM t3 GROUP BY 1) USING (track_id)", f"{_LX}, {_TX}, {_TK}"))
def rule_sentiment(t):  # LY1
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), 0)).alias("w")
    lexicon = t.raw("benchmark").select(words).distinct().where("w NOT IN ('not', 'very', 'but', 'least', 'kind', 'doubt', 'no', 'nor')")
    lexicon = lexicon.select(F.concat("w", F.lit("x")).alias("word"), ((F.ascii("w") * 7 + F.length("w") * 3) % 9 - 4).cast("double").alias("valence"))
    letters = lambda x: F.regexp_replace(x, "[^a-zA-Z]", "")
    form = lambda x, i: F.when(i % 7 == 2, "not").when(i % 11 == 4, "very").when(i == 29, "but").when(i % 13 == 5, F.concat(F.upper(letters(x)), F.lit("X"))).otherwise(F.concat(letters(x), F.lit("x")))
    parts = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\n\r\x0B\f]+"), lambda x: x != "")
    return se.compound(t.lyrics.select("track_id", F.array_join(F.transform(parts, form), " ").alias("text")), lexicon).select("track_id", F.round("compound", 5).alias("compound"))
