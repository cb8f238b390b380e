"""Playlist analysis: flow, character, duplicates, outliers, order."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions import music


def _in_order() -> Window:
    return Window.partitionBy("playlist_id").orderBy("position")


def flow(items: DataFrame) -> DataFrame:
    """WN6: transitions and tempo steps between neighbours of (playlist_id, position, code, bpm), by playlist."""
    nxt = items.withColumns({"code2": F.lead("code").over(_in_order()), "bpm2": F.lead("bpm").over(_in_order())}).where("code2 IS NOT NULL OR bpm2 IS NOT NULL")
    score = music.transition(F.col("code"), F.col("code2"))
    return nxt.groupBy("playlist_id").agg(F.count("*").alias("steps"), F.avg(score).alias("harmonic"), F.avg(F.when(score >= 0.85, 1.0).otherwise(0.0)).alias("good"), F.avg(F.abs(F.col("bpm2") - F.col("bpm"))).alias("bpm_step"))


def dna(items: DataFrame, names: list[str], least: int = 2) -> DataFrame:
    """AG32, C5: means, and cohesion as 1 less the mean deviation, cut to 0 and 1; of playlists with enough analysed tracks."""
    per = items.groupBy("playlist_id").agg(F.count("*").alias("n"), *[F.avg(n).alias(n) for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names]).where(F.col("n") >= least)
    raw = 1 - sum((F.col(f"s_{n}") for n in names), F.lit(0.0)) / len(names)
    label = F.when(raw > 0.85, "Very tight / single vibe").when(raw > 0.7, "Cohesive").when(raw > 0.5, "Varied").otherwise("All over the place")  # fixed values
    return per.select("playlist_id", "n", *names, F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)).alias("cohesion"), label.alias("kind"))


def duplicates(items: DataFrame) -> DataFrame:
    """WN10: later rows of a title and artist already met in the playlist, letters and digits compared."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    w = Window.partitionBy("playlist_id", plain("title"), plain("artist")).orderBy("position")
    return items.withColumn("k", F.row_number().over(w)).where("k > 1").drop("k")


def outliers(items: DataFrame, names: list[str], k: int = 3, least: float = 0.35) -> DataFrame:
    """VC20: the tracks farthest from their playlist's centre."""
    centre = items.groupBy("playlist_id").agg(*[F.avg(n).alias(f"c_{n}") for n in names])
    d = F.sqrt(sum((F.pow(F.col(n) - F.col(f"c_{n}"), F.lit(2)) for n in names), F.lit(0.0)))
    w = Window.partitionBy("playlist_id").orderBy(F.col("distance").desc(), "position")
    far = items.join(centre, "playlist_id").withColumn("distance", d).where(F.col("distance") > least)
    return far.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).select("playlist_id", "position", "track_id", "distance")


def top_values(items: DataFrame, column: str, k: int = 5) -> DataFrame:
    """AG33: the most frequent values of each playlist."""
    per = items.groupBy("playlist_id", column).agg(F.count("*").alias("n"))
    w = Window.partitionBy("playlist_id").orderBy(F.col("n").desc(), column)
    return per.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k).drop("k")


def _wheel(code: str | None) -> tuple[int, str] | None:
    return (int(code[:-1]), code[-1]) if code else None


def _fit(a: str | None, b: str | None) -> float | None:
    x, y = _wheel(a), _wheel(b)
    if x is None or y is None:
        return None
    d = min((x[0] - y[0]) % 12, (y[0] - x[0]) % 12)
    if d == 0:
        return 1.0 if x[1] == y[1] else 0.9
    return {1: 0.85, 2: 0.5}.get(d, 0.15) if x[1] == y[1] else 0.15


#: Rows, about, of the playlists that are put in order together, so that a task doesn't handle one tiny group at a time.
PACK_ROWS = 50_000


def _ordered(rows: DataFrame, choose: Callable[[np.ndarray, dict], np.ndarray]) -> DataFrame:
    """(playlist_id, place, track_id) of rows (playlist_id, position, track_id, energy, code, ...), as ``choose`` orders them.

    Playlists of one length are chosen from together: ``choose`` gets a line of row numbers in order of their positions for each
    of them, and the columns; code is a place in ``codes``. A playlist must fit a task.
    """

    def put(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        columns = {n: t.column(n).to_numpy() for n in t.column_names if n != "code"}
        code = t.column("code").combine_chunks().dictionary_encode()
        columns["codes"] = [*code.dictionary.to_pylist(), None]
        columns["code"] = code.indices.fill_null(len(code.dictionary)).to_numpy()
        starts = np.flatnonzero(np.r_[True, columns["playlist_id"][1:] != columns["playlist_id"][:-1]])
        sizes = np.diff(np.r_[starts, t.num_rows])
        order = np.empty(t.num_rows, int)
        for n in np.unique(sizes):
            lines = starts[sizes == n][:, None] + np.arange(n)[None]
            order[lines] = lines if n == 1 else choose(lines, columns)
        place = np.arange(t.num_rows) - np.repeat(starts, sizes) + 1
        return pa.RecordBatch.from_arrays([t.column("playlist_id").combine_chunks(), pa.array(place, pa.int32()), pa.array(columns["track_id"][order])], ["playlist_id", "place", "track_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count, last = 0, None
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_numpy()
            if count >= PACK_ROWS:
                # the last playlist may go on
                ends = int(np.searchsorted(ids, last, "right"))
                if ends < b.num_rows:
                    yield put([*held, b.slice(0, ends)])
                    held, count, b = [], 0, b.slice(ends)
            held.append(b)
            count, last = count + b.num_rows, ids[-1]
        if held:
            yield put(held)

    kinds = "playlist_id long, place int, track_id long"
    rows = rows.where("playlist_id IS NOT NULL").withColumns({"playlist_id": F.col("playlist_id").cast("long"), "track_id": F.col("track_id").cast("long")})
    return rows.repartition("playlist_id").sortWithinPartitions("playlist_id", "position").mapInArrow(run, kinds)


def _between(codes: list[str | None], value: Callable) -> np.ndarray:
    """``value`` of every pair of a few codes."""
    return np.array([[value(a, b) for b in codes] for a in codes])


def reorder(items: DataFrame) -> DataFrame:
    """VC19: an order of each playlist's tracks, from the lowest energy on always to the best next one.

    Greedy, so one playlist is one task's work; a playlist is of bounded length.
    """

    def fit(a: str | None, b: str | None) -> float:
        f = _fit(a, b)
        return 0.6 * (0.3 if f is None else f)

    def choose(lines: np.ndarray, columns: dict) -> np.ndarray:
        energy, code, every = columns["energy"][lines], columns["code"][lines], np.arange(len(lines))
        fits, left, out = _between(columns["codes"], fit), np.ones(lines.shape, bool), []
        at = energy.argmin(1)
        for _ in range(lines.shape[1]):
            out.append(lines[every, at])
            left[every, at] = False
            score = fits[code[every, at][:, None], code] + 0.4 * (1 - np.abs(energy[every, at][:, None] - energy))
            at = np.where(left, score, -np.inf).argmax(1)
        return np.stack(out, 1)

    rows = items.where("energy IS NOT NULL").select("playlist_id", "position", "track_id", "energy", "code")
    return _ordered(rows, choose)


def sequence(items: DataFrame, kind: str = "rise") -> DataFrame:
    """VC18: a set's order by tempo step / 12, wheel distance / 2 and distance from the arc, twice; fewer than three stay as they are."""
    target = {"rise": lambda x: 0.35 + 0.5 * x, "fall": lambda x: 0.85 - 0.5 * x, "peak": lambda x: 0.35 + 0.55 * math.sin(math.pi * x), "flat": lambda x: 0.6}[kind]

    def apart(a: str | None, b: str | None) -> float:
        x, y = _wheel(a), _wheel(b)
        gap = 99 if x is None or y is None else min((x[0] - y[0]) % 12, (y[0] - x[0]) % 12) + (x[1] != y[1])
        return min(gap, 7) / 2

    def choose(lines: np.ndarray, columns: dict) -> np.ndarray:
        n = lines.shape[1]
        if n < 3:
            return lines
        energy, bpm, code, every = columns["energy"][lines], columns["bpm"][lines], columns["code"][lines], np.arange(len(lines))
        gaps, left, out, at = _between(columns["codes"], apart), np.ones(lines.shape, bool), [], None
        for k in range(n):
            cost = 2 * np.abs(energy - target(k / max(1, n - 1)))
            if at is not None:
                cost = cost + (np.abs(bpm[every, at][:, None] - bpm) / 12 + gaps[code[every, at][:, None], code])
            # a missing tempo comes last
            at = np.where(left, np.nan_to_num(cost, nan=np.finfo(float).max), np.inf).argmin(1)
            out.append(lines[every, at])
            left[every, at] = False
        return np.stack(out, 1)

    rows = items.where("energy IS NOT NULL").select("playlist_id", "position", "track_id", "energy", "bpm", "code")
    return _ordered(rows, choose)
