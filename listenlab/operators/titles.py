"""ETL3, ETL4: songs, artists and films out of titles as they are found, by rules in order.

Each of the three answers has a table of rules (name, condition, answer); the first whose condition holds gives the answer,
and its name stays beside the row, so it can be counted which rule did what. All of it is expressions over columns; only the
folding of styled characters, which has no built-in form, is an Arrow function. What can't be told is null, not guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlab.functions import text as tx

from .etl import DRAMA, NOT_MUSIC, PROMO, SHORTS

#: Words of a title that aren't its song's, longest forms first.
NOISE = [
    "official music video", "official video", "music video", "lyric video", "lyrical video", "full video song", "video song", "video songs", "full video", "audio song", "official audio",
    "tamil hit song", "tamil movie", "movie songs", "m/v", "lyrical", "lyrics", "lyric", "tv size", "hdr", "4k", "8k", "hd", "song", "video", "audio", "explicit", "official",
]
_NOISE = r"(?<!\w)(" + "|".join(w.replace("/", r"\/") for w in NOISE) + r")(?!\w)"
#: Bands that are written in capitals, and composers by their handles.
BANDS = ["itzy", "bibi", "max", "illenium", "bts", "curv", "mamamoo", "twice", "iu", "exo", "nct", "aespa", "ive", "newjeans", "blackpink", "seventeen", "kda", "k/da"]
HANDLES = {"arrahman": "A.R. Rahman", "saiabhyankkar": "Sai Abhyankkar", "mcsai": "MC Sai", "anirudhofficial": "Anirudh Ravichander", "thisisdsp": "Devi Sri Prasad"}
#: Patterns of handles, tags and pictographs; years, languages and manners in a title; labels; films after a bracket or dash, and in albums' names; guests;
#: a quoted song behind its band; versions behind a dash; ends of a song's name in an artist's field; what parts performers; scripts that songs are written in.
HANDLE, TAG = r"@[\w.]+", r"#[^\s#]+"
PICTOGRAPH = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B00}-\x{2BFF}\x{FE00}-\x{FE0F}\x{2190}-\x{21FF}\x{2300}-\x{23FF}]"
YEAR, MANNER = r"\((?:19|20)\d{2}\)", r"\b(unplugged|instrumental|acoustic)\b"
LANGUAGE = r"[\(\[]\s*(tamil|telugu|hindi|kannada|malayalam|korean|japanese)\s*[\)\]]"
LABEL = (
    r"(entertainment|records?|recordz|studios?|media|musiq|vibes|labels?|channel|pictures|productions?|hit songs)\s*$"
    r"|^(1thek|hybe|jyp|sm entertainment|yg\b|stone music|starship|t-?series|sun music|ayngaran|yaam records|saregama|think music|sony music|divo|zee music|speed records)"
)
FROM = r"(?:[\(\[]|[-–—])\s*from\s+[\"“‘']?(.+?)[\"”’']?\s*(?:[\)\]]|$)"
ALBUM_FILM = r"^(.+?)\s*[\(\[]\s*(?:the\s+)?(?:original\s+)?(?:(?:motion\s+picture|television|tv|web\s+series)\s+)?(?:soundtrack|score|ost)\s*[\)\]]\s*$"
FILM_ALBUM = r"^(?:music\s+)?from\s+the\s+(?:motion\s+picture|film|movie)\s+[\"'“‘]?(.+?)[\"'”’]?\s*$"
GUESTS = r"\s*[\(\[]\s*(?:feat\.?|ft\.?|featuring|with|prod\.?)\b[^)\]]*[\)\]]?|\s+(?:feat\.?|ft\.?|featuring)\b[^)\]]*"
QUOTED = r"^(.+?)\s*['\"‘“]([^'\"’”]+)['\"’”]\s*(?:official\s*)?(?:m/?v|music\s*video)?"
VERSION = (
    r"\b(remaster(?:ed)?(?:\s+\d{4})?|tv size|instrumental|acoustic|unplugged|reprise|live(?:\s+at\s+.*)?|remix|re-?edit|.*\bmix"
    r"|(?:japanese|korean|tamil|telugu|hindi)(?:\s+version)?|full version|extended version|end title|slowed(?:\s*\+?\s*reverb)?)\b"
)
SONG_END = r"\b(?:full\s+)?(?:video\s+)?song\s*$|\blyric(?:al)?(?:\s+video)?\s*$|\bvideo\s*$|\(extended version\)\s*$"
SONG_WORD = r"^(.+?)\s+(?:full\s+)?(?:video\s+)?(?:song|lyric(?:al)?)\b(.*)$"
PARTED, BY = r"\s*(?:\bft\.?|\bfeat\.?|featuring|\||,|&)\s*", r"\b(?:ft\.?|feat\.?|featuring)\s+([^|,]+)"
SCRIPTS = r"[\x{0B80}-\x{0BFF}\x{0C00}-\x{0C7F}\x{0900}-\x{097F}\x{AC00}-\x{D7A3}]"
CREDITS = r"\b(singers?|music director|lyrics?|composed|feat\.?|ft\.?)\b"

_I = "(?iuU)"


def _has(x: Column, pattern: str) -> Column:
    return F.regexp_like(F.coalesce(x, F.lit("")), F.lit(_I + pattern))


def _cut(x: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(x, _I + pattern, by)


def _group(x: Column, pattern: str, k: int = 1) -> Column:
    return F.regexp_extract(x, _I + pattern, k)


def _trim(x: Column, chars: str = "") -> Column:
    return F.btrim(x, F.lit(chars)) if chars else F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def _squeeze(x: Column) -> Column:
    return _trim(F.regexp_replace(x, r"(?U)\s{2,}", " "))


def _told(x: Column) -> Column:
    """Null for an empty text."""
    return F.nullif(x, F.lit(""))


def scrubbed(title: Column) -> Column:
    return _squeeze(_cut(_cut(_cut(title, HANDLE), TAG), PICTOGRAPH))


def _film(x: Column) -> Column:
    return _told(F.regexp_replace(_trim(_trim(_cut(x, LANGUAGE, ""), " \"“”'‘’)]")), r"(?U)\s{2,}", " "))


def finished(song: Column) -> Column:
    """A song's name without noise, years, languages, manners, tags and empty brackets; names all in capitals get small letters."""
    for pattern in (_NOISE, YEAR, LANGUAGE, MANNER, HANDLE, TAG, PICTOGRAPH, r"[\(\[]\s*[\)\]]"):
        song = _cut(song, pattern)
    song = _squeeze(_trim(song, " \"“”'‘’|-–—_:•[]"))
    return _told(F.when((F.upper(song) == song) & (F.lower(song) != song), F.initcap(F.lower(song))).otherwise(song))


def _settled(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns as one generated row, so that what reads them, filters too, doesn't repeat the expressions behind them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _first(rules: list[tuple[str, Column, Column]]) -> tuple[Column, Column]:
    """The answer and the name of the first rule that holds."""
    answer = name = None
    for n, when, what in rules:
        answer = F.when(when, what) if answer is None else answer.when(when, what)
        name = F.when(when, F.lit(n)) if name is None else name.when(when, F.lit(n))
    return answer, name


def _field(a: Column) -> dict[str, Column]:
    """What an artist's field holds: a label, a handle, or a song in video words or before a colon."""
    before, after = _trim(F.substring_index(a, ":", 1)), _trim(F.regexp_replace(a, r"(?s)^[^:]*:", ""))
    colon, plain = F.contains(a, F.lit(":")), ~_has(a, LABEL) & ~F.startswith(a, F.lit("@"))
    many = _has(after, r"\b(ft\.?|feat|featuring|&)\b") | F.regexp_like(after, F.lit("[,| ]"))
    worded = (F.length(_group(a, SONG_WORD)) >= 3) & _has(a, SONG_WORD)
    performer = _told(_trim(F.get(F.split(after, _I + PARTED, 2), F.lit(0))))
    song, rule = _first(
        [
            ("field noise: song", plain & colon & (after != "") & (_trim(_cut(before, _NOISE, ""), " -–—|") == ""), after),
            ("field song: performers", plain & colon & F.length(before).between(3, 70) & many, before),
            ("field song words", plain & worded, _trim(_group(a, SONG_WORD))),
        ]
    )
    by = F.when(rule == "field song: performers", performer).when(rule == "field song words", _told(_trim(_group(_group(a, SONG_WORD, 2), BY))))
    return {"_inner": song, "_inner_rule": rule, "_inner_by": by}


def normalised(rows: DataFrame) -> DataFrame:
    """``rows`` (title, artist, album, ...) with clean_title, performer, movie_album, is_short, is_non_music, and the rule that each answer came by.

    The raw columns stay as they are; null ones are empty. A row that isn't music has no clean title. Whoever has no album
    gives a null one. Expressions only, so nothing is shuffled.
    """
    c = F.col
    text = lambda n: F.coalesce(c(n), F.lit(""))
    rows = _settled(rows, {"_t": text("title"), "_a": _trim(text("artist")), "_blob": tx.nfkc(F.concat(text("title"), F.lit(" "), text("artist")))})
    rows = _settled(rows, {"_p": scrubbed(c("_t")), "_drama": _has(c("_blob"), DRAMA), "_label": _has(c("_a"), LABEL), "_handle": F.startswith("_a", F.lit("@")), "_end": _has(c("_a"), SONG_END), **_field(c("_a"))})
    letters = F.regexp_replace("_a", "[^A-Za-z]", "")
    capitals = (F.length(letters) >= 3) & (F.upper(letters) == letters) & ~F.lower("_a").isin(BANDS)
    lead = F.when(F.contains("_p", F.lit(" - ")), F.lower(_trim(F.substring_index("_p", " - ", 1)))).otherwise("")
    leads = (c("_a") != "") & (lead != "") & ((lead == F.lower("_a")) | ((F.length(lead) >= 4) & F.contains(F.lower("_a"), lead)))
    bare = ~(F.contains("_p", F.lit("|")) | F.contains("_p", F.lit(" - ")) | _has(c("_p"), _NOISE))
    rows = _settled(rows, {"_odd": capitals | F.regexp_like("_a", F.lit(SCRIPTS)), "_from": _has(c("_t"), FROM)})
    strong = c("_inner").isNotNull() | (c("_end") & ~c("_label"))
    swapped = strong | (c("_odd") & ~c("_end") & ~c("_label") & ~leads & ~bare)
    rows = _settled(rows, {"_swapped": swapped, "_w": F.when(c("_from"), _trim(_cut(c("_p"), FROM))).otherwise(c("_p"))})

    # the film: behind a mark, leading a title whose song is in the other field, or the album's
    head = _trim(F.substring_index("_w", "|", 1))
    leading = _film(_trim(_trim(_cut(_cut(head, _NOISE), YEAR)), " -–—|"))
    held = F.coalesce("_inner", F.when(c("_swapped"), _cut(c("_a"), SONG_END, "")))
    fits = c("_swapped") & F.contains("_w", F.lit("|")) & (F.length(leading) > 2) & ~F.contains(head, F.lit(",")) & (F.size(F.split(head, r"(?U)\s+")) <= 4)
    fits = fits & (F.lower(leading) != F.lower(_trim(F.coalesce(held, F.lit(""))))) & ~_has(head, CREDITS)
    marked, album = _film(_group(c("_t"), FROM)), _trim(text("album"))
    film, film_rule = _first(
        [
            ("from", marked.isNotNull(), marked),
            ("leads the title", F.coalesce(fits, F.lit(False)), leading),
            ("album of a film", _has(album, ALBUM_FILM), _film(_group(album, ALBUM_FILM))),
            ("film's album", _has(album, FILM_ALBUM), _film(_group(album, FILM_ALBUM))),
        ]
    )

    # the song: in the artist's field, or a part of the title
    after_guests = _trim(_cut(c("_w"), GUESTS))
    prefixed = (F.instr(after_guests, ":") > 0) & (F.instr(after_guests, "|") > F.instr(after_guests, ":"))
    rows = _settled(rows, {"_held": held, "_film": film, "film_rule": film_rule, "_s": F.when(prefixed, F.regexp_replace(after_guests, r"(?s)^[^:]*:", "")).otherwise(after_guests)})
    core = lambda s: _trim(_cut(s, _NOISE, ""), " -–—_:")
    parts = F.filter(F.transform(F.split("_s", r"\||//"), lambda s: _trim(s)), lambda s: s != "")
    good = F.filter(F.transform(parts, lambda s: core(s)), lambda s: (s != "") & ~_has(s, "^" + HANDLE) & (F.length(F.regexp_replace(s, r"[^A-Za-z\x{AC00}-\x{D7A3}]", "")) >= 2))
    tail = F.substring_index("_s", " - ", -1)
    stem = F.expr("left(_s, greatest(length(_s) - length(substring_index(_s, ' - ', -1)) - 3, 0))")
    mine = F.lower(_trim(stem))
    by_head = (c("_a") != "") & ((mine == F.lower("_a")) | ((F.length(mine) >= 4) & F.contains(F.lower("_a"), mine)))
    dashed = F.contains("_s", F.lit(" - ")) & ~c("_from")
    song, song_rule = _first(
        [
            ("artist's field", c("_swapped"), c("_held")),
            ("empty", c("_w") == "", F.lit(None).cast("string")),
            ("quoted", _has(c("_w"), QUOTED), _trim(_group(c("_w"), QUOTED, 2))),
            ("part of the title", F.regexp_like("_s", F.lit(r"\||//")), F.coalesce(F.get(good, F.lit(0)), F.get(parts, F.lit(0)), c("_s"))),
            ("version", dashed & _has(tail, VERSION), F.concat(_trim(stem), F.lit(" ("), _trim(F.regexp_substr(tail, F.lit(_I + VERSION))), F.lit(")"))),
            ("behind its artist", dashed & by_head, _trim(tail)),
            ("before a subtitle", dashed, _trim(stem)),
            ("whole title", F.lit(True), c("_s")),
        ]
    )

    # the performer: the field, unless it holds something else
    known = F.create_map(*[F.lit(x) for pair in HANDLES.items() for x in pair])
    handles = F.transform(F.regexp_extract_all("_a", F.lit("(?U)" + HANDLE), 0), lambda h: F.try_element_at(known, F.lower(F.substring(h, 2, 1000))))
    composer = F.get(F.filter(handles, lambda h: h.isNotNull()), F.lit(0))
    quoting = _group(c("_w"), QUOTED)
    band = F.when(~_has(quoting, LABEL), _told(_trim(_trim(quoting), " -–—|_")))
    other = c("_label") | c("_handle") | c("_swapped") | c("_end") | c("_odd")
    performer, performer_rule = _first(
        [
            ("beside the song", c("_swapped") & c("_inner_by").isNotNull(), c("_inner_by")),
            ("artist's field", ~other & (c("_a") != ""), c("_a")),
            ("composer's handle", other & composer.isNotNull(), composer),
            ("before the quotes", other & band.isNotNull(), band),
        ]
    )
    tags = F.size(F.regexp_extract_all("_t", F.lit("(?U)" + TAG), 0))
    rows = _settled(
        rows,
        {
            "_song": song, "song_rule": F.when(song_rule == "artist's field", F.coalesce("_inner_rule", F.when(c("_end"), F.lit("field ends in video words")).otherwise("field in capitals or a song's script"))).otherwise(song_rule),
            "performer": performer, "performer_rule": performer_rule, "movie_album": c("_film"),
            "is_non_music": _has(c("_blob"), NOT_MUSIC) | c("_drama") | _has(c("_blob"), PROMO), "is_short": (_has(c("_blob"), SHORTS) | (tags >= 2)) & ~c("_drama"),
        },
    )
    rows = _settled(rows, {"clean_title": F.when(~c("is_non_music"), finished(c("_song")))})
    return rows.drop(*[n for n in rows.columns if n.startswith("_") and n in _WORK])


_WORK = {"_t", "_a", "_blob", "_p", "_drama", "_label", "_handle", "_end", "_inner", "_inner_rule", "_inner_by", "_odd", "_from", "_swapped", "_w", "_held", "_film", "_s", "_song"}


def rule_counts(rows: DataFrame) -> DataFrame:
    """How often each rule answered: (answer, rule, n); a null rule gave none."""
    each = F.inline(F.array(*[F.struct(F.lit(n.removesuffix("_rule")).alias("answer"), F.col(n).alias("rule")) for n in ("song_rule", "performer_rule", "film_rule")]))
    return rows.select(each).groupBy("answer", "rule").agg(F.count("*").alias("n"))


def stats(rows: DataFrame) -> DataFrame:
    """AG44: one row of counts over normalised rows."""
    renamed = F.col("clean_title").isNotNull() & (F.col("clean_title") != F.coalesce("title", F.lit("")))
    return rows.agg(F.count("*").alias("seen"), F.count_if(renamed).alias("renamed"), F.count("movie_album").alias("movies"), F.count_if("is_short").alias("shorts"), F.count_if("is_non_music").alias("non_music"))
