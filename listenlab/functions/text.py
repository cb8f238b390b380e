"""Title, artist and identifier functions on text columns."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words in brackets that say nothing about a song; our own list.
NOISE = "official|video|audio|lyric|lyrics|lyrical|hd|4k|full song|visualizer|remastered|teaser|promo"
#: Words that don't tell titles apart; words cut off at the ends of a search text; what a search text is cut at.
TOKEN_NOISE = (
    "song songs official video audio lyric lyrics lyrical full hd 4k 8k 60 fps mv visualizer visualiser feat ft featuring from movie the reprise cover version ost soundtrack theme "
    "title track presents presenting release records music entertainment ver extended promo teaser tamil telugu hindi with and exclusive new single remix"
).split()
END_NOISE = "official music video audio lyric lyrical full hd 4k 8k song songs new presenting presents the from feat ft cover".split()
CUT = r"(?i)\s*(?:\||[-–—]| video| song| official| lyric| promo| teaser| from | ft\.?| feat\.?| with lyrics| 4k| 8k| hd)\b"
#: Starts of a text that is a caption already.
CAPTIONS = ["this is", "a ", "an ", "the sound of"]
#: What parts artist and song, first come first; and a song's name before the word song.
SEPARATORS = [" - ", " – ", " — ", " | "]
SONG_LABEL = r"(?i)^(.+?)\s+(?:full\s+)?(?:video\s+|lyric(?:al)?\s+|audio\s+)?song\b\s*(?:[:|\-–—(]|$)"


def clean_title(t: Column) -> Column:
    """SF1: drops a leading Watched, bracketed noise and bracketed guests, and trims marks at the ends."""
    t = F.regexp_replace(t, "(?iu)^watched ", "")
    t = F.regexp_replace(t, f"(?iu)[(\\[][^)\\]]*\\b({NOISE})\\b[^)\\]]*[)\\]]", " ")
    t = F.regexp_replace(t, "(?iu)[(\\[]\\s*(feat|ft|featuring)\\b[^)\\]]*[)\\]]", " ")
    return F.btrim(F.regexp_replace(t, "\\s+", " "), F.lit(" -–|"))


def split_artist(title: Column, channel: Column) -> tuple[Column, Column]:
    """SF2: (artist, song): the channel and what stands before the word song, unless that is parted itself; else by the first separator found; else channel and title.

    A channel goes without its topic mark; an empty one is Unknown.
    """
    named = F.regexp_extract(title, SONG_LABEL, 1)
    marked = (named != "") & ~F.contains(named, F.lit(" - "))
    by = F.trim(F.regexp_replace(F.coalesce(channel, F.lit("")), " - Topic$", ""))
    by = F.when(by == "", "Unknown").otherwise(by)
    artist, song = F.when(marked, by), F.when(marked, F.btrim(named, F.lit(" -–|:")))
    for sep in SEPARATORS:
        at = F.instr(title, sep)
        artist = artist.when(at > 0, F.trim(F.substring_index(title, sep, 1)))
        song = song.when(at > 0, F.trim(F.substring(title, at + len(sep), F.length(title))))
    return artist.otherwise(by), song.otherwise(title)


def fold(t: Column) -> Column:
    """SF4: lower case, straight apostrophes, single spaces."""
    return F.regexp_replace(F.translate(F.lower(F.trim(t)), "’`´", "'''"), "\\s+", " ")


def plain(t: Column) -> Column:
    """SF5: only the letters a-z and digits."""
    return F.regexp_replace(F.lower(t), "[^a-z0-9]", "")


def tokens(t: Column, least: int = 2, noise: list[str] | None = None) -> Column:
    """SF6: distinct words outside brackets, of letters of several scripts and digits, long enough and not noise; apostrophes join what they part."""
    low = F.regexp_replace(F.translate(F.lower(F.coalesce(t, F.lit(""))), "'’", ""), "[(\\[{][^)\\]}]*[)\\]}]", " ")
    words = F.split(low, "[^a-z0-9\\x{0900}-\\x{097F}\\x{AC00}-\\x{D7A3}\\x{3040}-\\x{30FF}]+")
    kept = F.filter(words, lambda w: F.length(w) >= least)
    return F.array_except(F.array_distinct(kept), F.array(*map(F.lit, TOKEN_NOISE if noise is None else noise)))


def long_words(t: Column, least: int = 3, stop: list[str] | None = None) -> Column:
    """SF7: distinct words of a-z, digits and Hangul of at least so many characters, less a stop list."""
    words = F.split(F.lower(F.coalesce(t, F.lit(""))), "[^a-z0-9\\x{AC00}-\\x{D7A3}]+")
    kept = F.array_distinct(F.filter(words, lambda w: F.length(w) >= least))
    return F.array_except(kept, F.array(*map(F.lit, stop))) if stop else kept


def scrub(t: Column) -> Column:
    """SF9: without emoji, hashtags, handles and the word shorts."""
    t = F.regexp_replace(t, "[\\x{1F000}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{FE0F}]", "")
    t = F.regexp_replace(t, "[#@][\\w.]+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "(?i)\\bshorts?\\b", ""), "\\s+", " "))


def is_junk(t: Column) -> Column:
    """SF10: fewer than two letters or digits."""
    return F.length(F.regexp_replace(F.coalesce(t, F.lit("")), "[^\\p{L}\\p{N}]", "")) < 2


def has_cjk(t: Column) -> Column:
    """SF11."""
    return F.regexp_like(t, F.lit("[\\x{3040}-\\x{30FF}\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{AC00}-\\x{D7AF}]"))


def core(t: Column) -> Column:
    """SF8: a title outside brackets up to the first marker, without noise words at its ends; empty if under three characters are left."""
    head = F.get(F.split(F.regexp_replace(F.coalesce(t, F.lit("")), "[(\\[{][^)\\]}]*[)\\]}]", " "), CUT, 2), 0)
    words = F.filter(F.split(F.btrim(F.regexp_replace(head, "\\s+", " "), F.lit(' -–—|:"')), " "), lambda w: w != "")
    noise = F.array(*map(F.lit, END_NOISE))
    good = F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: ~F.array_contains(noise, F.lower(F.coalesce(F.get(words, i - 1), F.lit("the")))))
    out = F.array_join(F.slice(words, F.coalesce(F.array_min(good), F.lit(1)), F.coalesce(F.array_max(good) - F.array_min(good) + 1, F.lit(0))), " ")
    return F.when(F.length(out) >= 3, out).otherwise("")


#: Brackets and phrases that a rescue search leaves out.
RESCUE_BRACKETS = r"(?i)\((?:from|feat|ft|with|prod|out now|audio|video|lyric\w*|official|4k|hd)[^)]*\)"
RESCUE_NOISE = (
    r"(?i)\b(official music video|official video|official audio|music video|lyric\w* video|video song|full video|title track|dance (?:practice|cover|performance)|"
    r"choreography|live performance|4k|hd|out now)\b"
)


def rescue_clean(t: Column) -> Column:
    """AX16."""
    for pattern in (RESCUE_BRACKETS, RESCUE_NOISE, "[#@]\\w+"):
        t = F.regexp_replace(t, pattern, "")
    return F.btrim(t, F.lit(" -–—|·•\"'"))


def variants(title: Column) -> Column:
    """SF12: up to three distinct search texts: before a pipe, behind the last " - ", and the first 60 characters; whatever their case, of three letters or digits at least."""
    base = rescue_clean(title)
    head = F.trim(F.substring_index(base, "|", 1))
    letters = lambda x, more="": F.length(F.regexp_replace(F.lower(x), f"[^a-z0-9{more}]", ""))
    tail = F.when(F.contains(base, F.lit(" - ")), rescue_clean(F.substring_index(base, " - ", -1)))
    forms = F.filter(F.array(F.when(letters(head) >= 3, head), tail, F.trim(F.substring(base, 1, 60))), lambda x: x.isNotNull() & (letters(x, "\\x{AC00}-\\x{D7A3}") >= 3))
    low = F.transform(forms, lambda x: F.lower(x))
    return F.filter(forms, lambda x, i: F.array_position(low, F.lower(x)) == i + 1)


def prompt(t: Column) -> Column:
    """SF13: a caption of a text without its final dots; one that is a caption already stays. The words are fixed values."""
    bare = F.regexp_replace(F.trim(t), "[.]+$", "")
    known = F.lit(False)
    for start in CAPTIONS:
        known = known | F.startswith(F.lower(bare), F.lit(start))
    return F.when(known, bare).otherwise(F.concat(F.lit("This is a recording of "), bare, F.lit(".")))


def video_id(url: Column) -> Column:
    """SF14: null if there is none."""
    return F.nullif(F.regexp_extract(url, "[?&]v=([\\w-]{6,})", 1), F.lit(""))


def title_case(t: Column) -> Column:
    """SF17: initial capitals for a text all in capitals."""
    return F.when((F.upper(t) == t) & (F.lower(t) != t), F.initcap(t)).otherwise(t)


def all_caps(t: Column) -> Column:
    """SF18: at least three letters, none small."""
    letters = F.regexp_replace(t, "[^\\p{L}]", "")
    return (F.length(letters) >= 3) & (F.upper(letters) == letters) & (F.lower(letters) != letters)


@F.pandas_udf(StringType())
def unescape(t: pd.Series) -> pd.Series:
    """SF15: HTML references decoded; no built-in does that."""
    return t.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def nfkc(t: pd.Series) -> pd.Series:
    """SF16: Unicode compatibility form; no built-in does that."""
    return t.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def iso_seconds(d: Column) -> Column:
    """DT4: seconds of an ISO 8601 duration of days, hours, minutes and seconds; null if it isn't one."""
    part = lambda x: F.coalesce(F.regexp_extract(d, f"^P(?:[0-9]+D)?T?(?:[0-9]+[HM])*?([0-9]+){x}", 1).try_cast("int"), F.lit(0))
    days = F.coalesce(F.regexp_extract(d, "^P([0-9]+)D", 1).try_cast("int"), F.lit(0))
    return F.when(F.regexp_like(d, F.lit("^P(?=.)([0-9]+D)?(T([0-9]+H)?([0-9]+M)?([0-9]+S)?)?$")), days * 86_400 + part("H") * 3600 + part("M") * 60 + part("S"))


def year_of(d: Column) -> Column:
    """DT7: the first four digits of a messy date."""
    return F.substring(F.regexp_replace(d, "[^0-9]", ""), 1, 4).try_cast("int")


def minute_stamp(t: Column) -> Column:
    """DT5: 'YYYY-MM-DD HH:MM' as an ISO time of UTC; others as they are."""
    return F.when(F.length(t) == 16, F.concat(F.replace(t, F.lit(" "), F.lit("T")), F.lit(":00Z"))).otherwise(t)


def clock(seconds: Column) -> Column:
    """DT8: mm:ss."""
    s = seconds.cast("int")
    return F.format_string("%02d:%02d", F.floor(s / 60).cast("int"), F.pmod(s, F.lit(60)))


def human_time(t: Column) -> Column:
    """DT2: 'Jan 5, 2024, 3:04:05 PM CET' in either day order; the zone name is dropped, unreadable texts are null."""
    bare = F.regexp_replace(F.translate(F.trim(t), " ", " "), " [A-Z]{2,5}$", "")
    bare = F.when(F.regexp_like(F.trim(t), F.lit("[AP]M$")), F.translate(F.trim(t), " ", " ")).otherwise(bare)
    return F.coalesce(F.try_to_timestamp(bare, F.lit("MMM d, yyyy, h:mm:ss a")), F.try_to_timestamp(bare, F.lit("d MMM yyyy, HH:mm:ss")))


def epoch(t: Column, fallback: Column) -> Column:
    """DT6: seconds since 1970 of an ISO time, of one without a zone as of UTC, or of its first 19 characters; the fallback for what isn't one."""
    whole = F.try_to_timestamp(F.replace(F.trim(t), F.lit("Z"), F.lit("+00:00")))
    first = F.try_to_timestamp(F.substring(F.trim(t), 1, 19))
    return F.coalesce(F.unix_micros(F.coalesce(whole, first)) / 1e6, fallback)


def leading_int(t: Column) -> Column:
    """AX12: the number before a slash."""
    return F.get(F.split(t, "/"), 0).try_cast("int")


def display(title: Column, artist: Column, stem: Column) -> Column:
    """AX13."""
    return F.concat(F.coalesce(artist, F.lit("Unknown")), F.lit(" — "), F.coalesce(title, stem))
