"""Feature and embedding spaces: assembly, choice, diagnostics, search by prompt, names of axes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vectors import corrected, leakage, popularity_direction, standardised, top_components

#: Coefficients of timbre; rows from which on an embedding space is used; R2 above which a space is mostly popularity.
TIMBRE, LEAST, ALARM = 13, 20, 0.15


def timbre(text: Column) -> Column:
    """AR1: numbers of a JSON array; zeros unless it holds TIMBRE of them."""
    x = F.from_json(text, "array<double>")
    return F.when(F.size(x) == TIMBRE, x).otherwise(F.array_repeat(F.lit(0.0), TIMBRE))


def assembled(features: DataFrame, names: list[str], mfcc: Column | None = None, no_range: float = 8.0) -> DataFrame:
    """PRJ3, AX10: (track_id, vec): unit features, tempo / 200, (loudness + 35) / 35, dynamics / 30, and timbre; rows that lack a unit feature are left out.

    A tempo or a range that is missing or 0 is taken as 120 or 8, a missing loudness as -12. ``no_range`` is for a range of 0 alone.
    """
    ok = features.where(" AND ".join(f"{n} IS NOT NULL" for n in names))
    value = lambda n, default: F.coalesce(F.nullif(F.col(n), F.lit(0.0)), F.lit(default))
    dynamics = F.when(F.col("dynamic_range") == 0, no_range).otherwise(F.coalesce("dynamic_range", F.lit(8.0)))
    more = F.array(value("bpm", 120.0) / 200, (F.coalesce("loudness_db", F.lit(-12.0)) + 35) / 35, dynamics / 30)
    vec = F.concat(F.array(*names), more)
    return ok.select("track_id", (vec if mfcc is None else F.concat(vec, mfcc)).alias("vec"))


def sonic(features: DataFrame, names: list[str], mfcc: Column) -> DataFrame:
    """VC4: (track_id, vec) for the combined distance: z-scores of features, and half those of timbre."""
    flat = features.select("track_id", "error", *names, *[F.get(mfcc, F.lit(i)).alias(f"_m{i}") for i in range(TIMBRE)])
    z = standardised(flat, [*names, *[f"_m{i}" for i in range(TIMBRE)]])
    return z.select("track_id", F.transform("vec", lambda x, i: F.when(i < len(names), x).otherwise(0.5 * x)).alias("vec"))


def best_space(embeddings: DataFrame, features: DataFrame) -> tuple[DataFrame, str]:
    """VC2: the embedding space if it has at least LEAST rows, else the features."""
    return (embeddings, "embedding") if len(embeddings.limit(LEAST).collect()) >= LEAST else (features, "dsp")


def diagnostics(vectors: DataFrame, plays: DataFrame, components: int = 1) -> dict:
    """VC13: popularity R2 before and after correction, and what it says. The texts are fixed values."""
    before = leakage(vectors, plays)
    direction = popularity_direction(vectors, plays)
    axes, _ = top_components(corrected(vectors, direction), components)
    after = leakage(corrected(vectors, direction, [[float(x) for x in a] for a in axes]), plays)
    said = "Your raw 'similar' list was substantially a popularity chart" if before > ALARM else "Popularity bias was modest"
    return {"before": before, "after": after, "verdict": f"{said} — debiasing cut it from {round(before * 100)}% to {round(after * 100)}%."}


def axis_name(axis: np.ndarray, names: list[str]) -> str:
    """ML2: the two strongest loadings of an axis with their signs."""
    strongest = np.argsort(-np.abs(axis), kind="stable")[:2]
    return " / ".join(("+" if axis[i] > 0 else "−") + names[i] for i in strongest)


def axes(features: DataFrame, names: list[str], k: int = 2) -> list[tuple[int, str, float]]:
    """ML2: (axis, name, percent of variance) of the main axes of standardised features."""
    found, share = top_components(standardised(features, names), k)
    return [(i, axis_name(a, names), round(100 * float(s), 1)) for i, (a, s) in enumerate(zip(found, share, strict=True))]
