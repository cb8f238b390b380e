"""Drivers of a library of files: ingest, analysis of landed arrays, and where embeddings are to be taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import signal as sg
from .audio import FALLBACK, excerpts
from .order import kept
from .writes import replaced

#: Seconds taken for a track of unknown length.
DEFAULT_S = 180.0


def ingest(files: DataFrame, library: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AX1: (library, summary) after files (path, digest, title, artist, duration_s, error) as they were probed.

    A file replaces the row of its content; of equal contents the first path counts; rows with an error are counted
    only. The summary has one row: scanned, ingested, failed, and rows that are new.
    """
    good = files.where("error IS NULL AND digest IS NOT NULL")
    one = kept(good.groupBy("digest").agg(F.min_by(F.struct("path", "title", "artist", "duration_s"), "path").alias("f")).select("digest", "f.*"))
    scanned = files.agg(F.count("*").alias("scanned"), F.count_if(F.col("error").isNotNull() | F.col("digest").isNull()).alias("failed"))
    added = one.join(library.select("digest"), "digest", "left_anti").agg(F.count("*").alias("added"))
    summary = scanned.crossJoin(one.agg(F.count("*").alias("ingested"))).crossJoin(added)
    return replaced(library, one, ["digest"]), summary.select("scanned", "ingested", "failed", "added")


def analysed(tracks: DataFrame, done: DataFrame, count: int = 2, seconds: float = 20.0) -> DataFrame:
    """AX2: (track_id, microtiming_ms, swing, key_stability, sections, excerpts) of tracks that aren't done: beats' chroma, timbre, times and loudness, onsets, duration_s.

    Sections are written before excerpts are taken from them, so each function reads plain columns.
    """
    todo = tracks.join(done.select("track_id"), "track_id", "left_anti")
    first = kept(todo.select("track_id", "duration_s", sg.groove("onsets", "times").alias("g"), sg.key_stability("chroma", F.lit(16)).alias("key_stability"), sg.segmented(*map(F.col, ("chroma", "timbre", "times", "loudness"))).alias("sections")))
    length = F.coalesce("duration_s", F.lit(DEFAULT_S))
    return first.select("track_id", "g.microtiming_ms", "g.swing", "key_stability", "sections", excerpts(F.col("sections"), length, F.lit(count), F.lit(seconds)).alias("excerpts"))


def fallback_starts(duration_s: Column, seconds: float, count: int = len(FALLBACK)) -> Column:
    """AX3: where windows of an embedding start without sections: about fixed places, within the track."""
    d = F.coalesce(F.nullif(duration_s, F.lit(0.0)), F.lit(DEFAULT_S))
    return F.array(*[F.greatest(F.least(d * p - seconds / 2, F.greatest(d - seconds, F.lit(0.0))), F.lit(0.0)) for p in FALLBACK[:count]])
