"""Key wheel, tempo and mood functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Wheel numbers of the pitch classes, major (letter B) and minor (letter A).
MAJOR = {"B": 1, "F#": 2, "C#": 3, "G#": 4, "D#": 5, "A#": 6, "F": 7, "C": 8, "G": 9, "D": 10, "A": 11, "E": 12}
MINOR = {"G#": 1, "D#": 2, "A#": 3, "F": 4, "C": 5, "G": 6, "D": 7, "A": 8, "E": 9, "B": 10, "F#": 11, "C#": 12}


def squash(x: Column, lo: float, hi: float) -> Column:
    """MT1: x from lo to hi put on 0 to 1."""
    return F.greatest(F.least((x - lo) / (hi - lo), F.lit(1.0)), F.lit(0.0))


def wheel(key: Column, mode: Column) -> Column:
    """MT2: wheel code such as 8B; null for an unknown key or mode."""
    table = F.create_map(*[F.lit(x) for d, m, c in ((MAJOR, "major", "B"), (MINOR, "minor", "A")) for k, n in d.items() for x in (f"{k} {m}", f"{n}{c}")])
    return F.try_element_at(table, F.concat_ws(" ", key, mode))


def number(code: Column) -> Column:
    """AX11: the number of a code, null if it is malformed or out of range."""
    n = F.regexp_extract(F.trim(code), "^([0-9]{1,2})[ABab]$", 1).try_cast("int")
    return F.when(n.between(1, 12), n)


def letter(code: Column) -> Column:
    return F.when(number(code).isNotNull(), F.upper(F.right(F.trim(code), F.lit(1))))


def step(a: Column, b: Column) -> Column:
    """Steps round the wheel between two numbers."""
    return F.least(F.pmod(a - b, F.lit(12)), F.pmod(b - a, F.lit(12)))


def transition(a: Column, b: Column) -> Column:
    """MT3: how well code b follows code a; null if either is malformed."""
    d, same = step(number(a), number(b)), letter(a) == letter(b)
    return (
        F.when(number(a).isNull() | number(b).isNull(), None).when((d == 0) & same, 1.0).when(d == 0, 0.9).when((d == 1) & same, 0.85).when((d == 2) & same, 0.5).otherwise(0.15)
    )


def distance(a: Column, b: Column) -> Column:
    """MT4: steps round the wheel, one more if the letters differ; 99 if either is unknown."""
    d = step(number(a), number(b)) + F.when(letter(a) == letter(b), 0).otherwise(1)
    return F.coalesce(F.when(number(a).isNull() | number(b).isNull(), None).otherwise(d), F.lit(99))


def compatible(code: Column) -> Column:
    """MT5: the code itself, its two neighbours, and its other letter."""
    n, c = number(code), letter(code)
    at = lambda x: F.pmod(x - 1, F.lit(12)) + 1
    other = F.when(c == "A", "B").otherwise("A")
    return F.when(n.isNotNull(), F.array(F.concat(n, c), F.concat(at(n + 1), c), F.concat(at(n - 1), c), F.concat(n, other)))


def half_double(bpm: Column, lo: Column, hi: Column) -> Column:
    """FLT11: whether a tempo, its double or its half lies in a window."""
    return F.exists(F.array(bpm, bpm * 2, bpm / 2), lambda x: x.between(lo, hi))


def cadence(bpm: Column, steps: float, tolerance: float) -> Column:
    """FLT12: whether a tempo fits steps a minute."""
    return half_double(bpm, F.lit(steps * (1 - tolerance)), F.lit(steps * (1 + tolerance)))


#: Names and weights of the six uses; bpm counts as bpm / 180, a leading minus as 1 - x.
USES = {
    "Workout / Hype": {"energy": 0.5, "danceability": 0.3, "bpm": 0.2},
    "Party / Dance": {"danceability": 0.5, "energy": 0.3, "valence": 0.2},
    "Focus / Study": {"instrumentalness": 0.5, "-energy": 0.3, "-speechiness": 0.2},
    "Chill / Relax": {"-energy": 0.4, "acousticness": 0.3, "valence": 0.3},
    "Sleep / Ambient": {"-energy": 0.5, "acousticness": 0.3, "instrumentalness": 0.2},
    "Sad / Introspective": {"-valence": 0.5, "acousticness": 0.3, "-energy": 0.2},
}


def use_score(use: str) -> Column:
    total = F.lit(0.0)
    for name, w in USES[use].items():
        x = F.col(name.lstrip("-"))
        total = total + w * (x / 180 if name == "bpm" else 1 - x if name[0] == "-" else x)
    return total


def best_use() -> Column:
    """MT6: the use of highest score, the first listed of equals, with its score."""
    scores = [F.struct(use_score(u).alias("score"), F.lit(-i).alias("i"), F.lit(u).alias("use")) for i, u in enumerate(USES)]
    return F.array_max(F.array(*scores))


def energy_of_lufs(x: Column) -> Column:
    """MT10."""
    return squash(x, -26.0, -8.0)


def arc(kind: str, at: Column) -> Column:
    """C14: target energy at a place from 0 to 1 of a set."""
    return {"rise": 0.35 + 0.5 * at, "fall": 0.85 - 0.5 * at, "peak": 0.35 + 0.55 * F.sin(at * F.pi()), "flat": F.lit(0.6)}[kind]


#: Signals and weights of the synthetic-audio prior, and its bias.
SLOP = {
    "phase_incoherence": 1.9, "spectral_checkerboard": 1.7, "hf_cliff_unexplained": 1.5, "hf_noise_flatness": 1.1, "edge_truncation": 0.9,
    "grid_rigidity": 0.8, "loop_rigidity": 0.7, "static_dynamics": 0.5, "stereo_degenerate": 0.4,
}
SLOP_BIAS = -2.4


def slop_prior(signals: dict[str, Column], seconds: Column) -> tuple[Column, Column]:
    """MT14: probability from the signals, and confidence: the share of signals known, less for a track under a minute."""
    z, seen = F.lit(SLOP_BIAS), F.lit(0)
    for name, w in SLOP.items():
        if name in signals:
            z = z + w * F.coalesce(signals[name], F.lit(0.0))
            seen = seen + signals[name].isNotNull().cast("int")
    return 1 / (1 + F.exp(-z)), seen / len(SLOP) * (0.6 + 0.4 * F.least(seconds / 60, F.lit(1.0)))


def verdict(score: Column, confidence: Column) -> Column:
    """MT13. The texts are fixed values."""
    return (
        F.when(confidence < 0.35, "unclear").when(score >= 0.65, "likely generated").when(score <= 0.30, "likely human-performed").otherwise("machine-produced, origin unclear")
    )
