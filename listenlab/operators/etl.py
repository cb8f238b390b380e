"""Text classification of watch histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listenlab.functions import text as tx

#: Words of music channels and of music titles.
MUSIC_CHANNELS = [
    "vevo", " - topic", "music", "records", "recordz", "soundtrack", "t-series", "saregama", "think music", "sony music", "aditya", "lahari", "divo", "junglee", "u1 records",
    "zee music", "speed records", "tips", "sun tv", "sony music south", "muzik247", "east coast", "trend music", "entertainment", "1thek", "smtown", "hybe", "bighit", "jyp", "yg ",
    "ygex", "stone music", "kakao", "genie", "starship", "pledis", "cube", "ador", "ani-one", "muse asia", "muse india", "aniplex", "sme", "avex", "lantis", "pony canyon",
    "flyingdog", "universal music", "warner music", "sacra music", "stone", "kozentertain", "ka:me",
]
MUSIC_TITLES = [
    "official music video", "official video", "official audio", "official m/v", "lyric video", "lyrics video", "lyrical", "lyric", "(audio)", "audio)", "music video", " m/v",
    "(m/v", "mv)", "[mv]", " mv ", "|mv", "video song", "full song", "full video", "title track", "theme song", " ost", "ost ", "ost)", "ost]", "(ost", "soundtrack",
    "original sound", "opening", "ending", "op)", "ed)", "character song", "insert song", "unplugged", "acoustic", "(cover", "cover)", "feat.", " ft.", "audiotrack", "song |",
    "| song", "song)", "jukebox", "tv size", "full ver", "live performance", "live at", "afterhours", "after hours", "waterbomb", "unplugged live", "concert", "remix", "mashup",
    "prod.", "prod ", "hd song", "hd songs", "video songs", "pieces album", "audio track", "singles",
]
CJK_MARKS = [" - ", " – ", " — ", "│", " | ", "~"]
#: Patterns of what isn't music (collections and talk; drama episodes; advertising), of shorts, of what a rescue leaves out, and of a channel's veto.
NOT_MUSIC = (
    r"(?i)\b(full set|full concert|dj set|club set|cookout session|mix ?tape|mix playlist|party mix|mashup|jukebox|workout|no equipment|reaction|vlog|trailer|gameplay|game ?play|podcast|"
    r"interview|behind the scenes|live[- ]action|documentary|unboxing|prank|tutorial|how to|news|full album|audio jukebox|special collections?|birthday special|hits? collection|"
    r"\[?\s*playlist\s*\]?|top\s+\d+|most anticipated|best of\s+(?:19|20)\d{2})\b"
)
DRAMA = r"(?i)\bep\s?\d+\b.*\b(eng\s?sub|dubbed)\b|【[^】]*drama[^】]*】"
PROMO = r"(?i)\b(auto[- ]?apply|custom resume|job search|ai agent|jobright)\b"
SHORTS = (
    r"(?i)(?:^|\W)#?shorts?\b|#ytshorts|/shorts/|#(?:dance(?:challenge)?|trend(?:ing)?|tiktok|viral(?:video)?|fyp|reels?)\b|\bdance challenge\b|\bdc[-\s]|\bby @\w+|\bchallenge\b"
)
SHORT_TAG = r"(?i)#\s*shorts?\b"
RESCUE_VETO = (
    r"(?i)\b(workout|glute|abs|hourglass|snowcam|snowboard|webcam|ski area|gameplay|patch \d|tier list|walkthrough|tutorial|recipe|unboxing|how to|\bcourse\b|davinci|resolve|"
    r"money method|star citizen|league of legends|build is|cargo|trading|automation|timberborn|co-?op|exercise|challenge day|gym|deadlift|squat|highlights|full match|patch notes)\b"
)
VETO = "(?iu)\\b(trailer|interview|making of|behind the scenes|press meet|speech)\\b"
#: Types of session items that are songs, and music videos.
SONGS = ["MUSIC_VIDEO_TYPE_ATV", "MUSIC_VIDEO_TYPE_UGC"]
MUSIC_VIDEOS = ["MUSIC_VIDEO_TYPE_OMV", "MUSIC_VIDEO_TYPE_OFFICIAL_SOURCE_MUSIC"]


def _like(t: Column, pattern: str) -> Column:
    return F.regexp_like(F.coalesce(t, F.lit("")), F.lit(pattern))


def not_music(t: Column) -> Column:
    """ETL1: any of three families of patterns in a title (and artist)."""
    return _like(t, NOT_MUSIC) | _like(t, DRAMA) | _like(t, PROMO)


def is_short(title: Column, artist: Column) -> Column:
    """ETL2: by pattern in title and artist, or two hashtags in the title; drama episodes never are."""
    both = F.concat_ws(" ", title, artist)
    return (_like(both, SHORTS) | (F.size(F.regexp_extract_all(F.coalesce(title, F.lit("")), F.lit("#[^\\s#]+"), 0)) >= 2)) & ~_like(both, DRAMA)


def _some(c: Column, words: list[str]) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))


def music_hint(title: Column, channel: Column, header: Column | None = None) -> Column:
    """ETL5: the header, words in channel or title, CJK script in both (or with "music" in the channel), or a CJK title that is parted like artist and song."""
    cjk = lambda c: F.coalesce(tx.has_cjk(c), F.lit(False))
    parted = F.exists(F.array(*map(F.lit, CJK_MARKS)), lambda m: F.contains(F.coalesce(title, F.lit("")), m))
    out = _some(channel, MUSIC_CHANNELS) | _some(title, MUSIC_TITLES) | (cjk(title) & (cjk(channel) | _some(channel, ["music"]) | parted))
    return out if header is None else out | F.coalesce(header == "YouTube Music", F.lit(False))


def direct(title: Column, channel: Column, category: Column) -> Column:
    """ETL6: by words, or by category 10."""
    return music_hint(title, channel) | F.coalesce(category == 10, F.lit(False))


def short_clip(title: Column, url: Column, seconds: Column, music: Column, least: int = 45) -> Column:
    """ETL8: a tag, an address of shorts, or a clip under so many seconds that isn't music; an unknown or zero length is none."""
    return _like(title, SHORT_TAG) | F.contains(F.coalesce(url, F.lit("")), F.lit("/shorts/")) | (F.coalesce((seconds > 0) & (seconds < least), F.lit(False)) & ~music)


def metadata_music(title: Column, channel: Column) -> Column:
    """AX15: music by the words of title or channel alone."""
    return _some(channel, MUSIC_CHANNELS) | _some(title, MUSIC_TITLES)


def channel_share(rows: DataFrame) -> DataFrame:
    """AG38: channels with at least two videos, half of them music."""
    per = rows.groupBy(F.lower("channel").alias("channel")).agg(F.count("*").alias("n"), F.count_if("music").alias("music"))
    return per.where((F.col("n") >= 2) & (F.col("music") / F.col("n") >= 0.5))


def propagate(rows: DataFrame) -> DataFrame:
    """ETL6, ETL7: music directly, or by one hop from a music channel unless the title vetoes it."""
    good = channel_share(rows).select(F.col("channel").alias("ch"), F.lit(True).alias("by_channel"))
    j = rows.join(good, F.lower("channel") == F.col("ch"), "left")
    hop = F.coalesce("by_channel", F.lit(False)) & ~F.regexp_like(F.coalesce("title", F.lit("")), F.lit(VETO))
    return j.withColumn("reason", F.when(F.col("music"), "direct").when(hop, "channel")).drop("ch", "by_channel")


def liked(rows: DataFrame, lo: int = 75, hi: int = 900) -> DataFrame:
    """ETL10: items of music length that aren't junk, in the music category or from a music channel."""
    return rows.where(F.col("seconds").between(lo, hi) & ~tx.is_junk(F.col("title")) & ((F.col("category") == 10) | music_hint(F.col("title"), F.col("channel"))))


def session_kind(rows: DataFrame) -> Column:
    """ETL9: song, music_video or nonmusic, of rows (episode, video_type, seconds, artist, album): by type, else by length and attribution."""
    kind = F.upper(F.coalesce("video_type", F.lit("")))
    talk = F.col("episode").isNotNull() | F.contains(kind, F.lit("PODCAST")) | F.contains(kind, F.lit("EPISODE"))
    nobody = F.col("artist").isNull()
    return (
        F.when(talk, "nonmusic").when(kind.isin(MUSIC_VIDEOS), "music_video").when(kind.isin(SONGS), "song")
        .when(nobody & ((F.col("seconds") > 1200) | F.col("album").isNull()), "nonmusic").otherwise("song")
    )


def preview(rows: DataFrame) -> DataFrame:
    """ETL11: what normalisation would change: (id, before, after, and what was told) of rows whose title or gates change."""
    changed = ~F.col("title").eqNullSafe(F.col("clean_title")) | F.col("is_short") | F.col("is_non_music")
    return rows.where(changed).select("id", F.col("title").alias("before"), F.col("clean_title").alias("after"), "movie_album", "is_short", "is_non_music")


def candidates(excluded: DataFrame, least: int = 60) -> DataFrame:
    """ETL12: excluded videos (title, category, seconds, reason) worth another look: non-music, not deleted or private, and not shorter than so many seconds."""
    gone = (F.col("category") == "deleted/private") | F.startswith("title", F.lit("http"))
    return excluded.where((F.col("reason") == "non-music") & ~gone & ~F.coalesce((F.col("seconds") > 0) & (F.col("seconds") < least), F.lit(False)))


def _artist_told(artist: Column, said: Column) -> Column:
    """Whether an artist, or a word of four letters of theirs, is in a text."""
    words = F.filter(tx.long_words(artist), lambda w: F.length(w) >= 4)
    return F.contains(F.lower(said), F.lower(artist)) | F.arrays_overlap(words, tx.long_words(said))


def rescue(candidates: DataFrame, hits: DataFrame, share: float = 0.45) -> DataFrame:
    """ETL13: candidates (id, title, channel) that most of the words of a catalogue hit (id, hit_title, hit_artist) are in, the artist told by title or channel; vetoed titles left out."""
    j = candidates.where(~_like(F.col("title"), RESCUE_VETO)).join(hits, "id")
    hit = tx.long_words(F.regexp_replace("hit_title", tx.RESCUE_BRACKETS, ""))
    part = F.size(F.array_intersect(hit, tx.long_words(F.col("title")))) / F.nullif(F.size(hit), F.lit(0))
    return j.where((part >= share) & _artist_told(F.col("hit_artist"), F.concat_ws(" ", "title", "channel")))


def false_rescues(recovered: DataFrame) -> DataFrame:
    """ETL14: recovered rows (artist, original_video, channel) whose artist neither title nor channel tells; to be purged by anti joins."""
    return recovered.where(~F.coalesce(_artist_told(F.col("artist"), F.concat_ws(" ", "original_video", "channel")), F.lit(False)))


def by_category(watches: DataFrame, known: DataFrame, categories: DataFrame) -> DataFrame:
    """ETL15, SRC15: watches (video, title, channel) that aren't known and that words don't tell as music, but their landed category (video, category, seconds) does."""
    rest = watches.where(~music_hint(F.col("title"), F.col("channel"))).join(known.select("video").distinct(), "video", "left_anti")
    return rest.join(categories.where("category = 10"), "video")
