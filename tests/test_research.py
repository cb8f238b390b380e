"""Findings, dossiers, explanations and catalogue matches on planted tables, against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from listenlab.operators import compose, recommend, vectors

NAMES = ["energy", "valence", "danceability"]
FEATURES = "track_id long, energy double, valence double, danceability double, bpm double, loudness_db double, dynamic_range double, error string"


def _library(spark, n=40, louder=6.0):
    """Artist a is far above in energy; energy and valence rise together; the last era is louder."""
    rng = random.Random(3)
    rows, tracks = [], []
    for i in range(n):
        e = 0.95 if i % 8 == 0 else 0.3 + 0.2 * rng.random()
        rows.append((i, e, e * 0.9 + 0.02 * rng.random(), rng.random(), 100.0 + i, -20.0 + (louder if i % 2 else 0.0), float(i), "x" if i == n - 1 else None))
        tracks.append((i, f"song {i}", "abcdefgh"[i % 8], ("2010" if i % 2 else "1970") + "-01-01" if i != 5 else None))
    return spark.createDataFrame(rows, FEATURES), spark.createDataFrame(tracks, "id long, title string, artist string, release_date string")


def _sonic(features):
    return features.where("error IS NULL").select("track_id", F.array(*NAMES).alias("vec"))


def test_findings_tell_signatures_and_eras(spark):
    f, tracks = _library(spark)
    plays = spark.createDataFrame([(0, 9), (1, 3), (99, 4)], "track_id long, plays long")
    got = {}
    for r in compose.findings(f, _sonic(f), tracks, NAMES, plays).collect():
        got.setdefault(r.topic, []).append(r.text)
    assert len(got["signature"]) == 1 and got["signature"][0].startswith("a's sonic signature: markedly higher ")
    z = float(got["signature"][0].split("z = ")[1].rstrip(")."))
    x = np.array([[r[n] for n in NAMES] for r in f.where("error IS NULL").orderBy("track_id").collect()])
    each = (x[np.arange(len(x)) % 8 == 0].mean(0) - x.mean(0)) / x.std(0)
    assert z == pytest.approx(each[np.abs(each).argmax()], abs=0.006)
    assert got["era"] == ["The loudness war is visible in your library: your 2010s tracks average -14.0 dB vs -20.0 dB in the 1970s — 6.0 dB louder, typically at the cost of dynamics."]
    assert "energy and valence rise and fall together" in got["correlation"][0]
    assert {"centre", "outlier", "dynamics", "tempo"} <= set(got)


def test_findings_need_five_tracks_and_louder_eras(spark):
    f, tracks = _library(spark, louder=1.5)
    assert "era" not in {r.topic for r in compose.findings(f, _sonic(f), tracks, NAMES).collect()}
    few = f.where("track_id < 4")
    assert compose.findings(few, _sonic(few), tracks, NAMES).count() == compose.axis_findings(few, NAMES).count() == 0
    none = f.where("false")
    assert compose.findings(none, _sonic(none), tracks, NAMES).count() == compose.axis_findings(none, NAMES).count() == 0


def test_axes_are_those_of_the_correlations(spark):
    f, _ = _library(spark)
    x = np.array([[r[n] for n in NAMES] for r in f.where("error IS NULL").collect()])
    values, axes = np.linalg.eigh(np.corrcoef(x.T))
    text = compose.axis_findings(f, NAMES).first().text
    assert f"explain {round(100 * values[1:].sum() / values.sum())}%" in text
    first = axes[:, 2] * np.sign(axes[np.abs(axes[:, 2]).argmax(), 2])
    assert {n for n in NAMES if n in text.split("(")[1]} == {NAMES[i] for i in np.argsort(-np.abs(first))[:2]}


def test_siblings_and_dossiers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 3))
    x[7] = x[3]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "track_id long, vec array<double>")
    got = {(r.a, r["rank"]): (r.b, r.sim) for r in vectors.siblings(rows, rows.where("track_id IN (0, 3)"), 4).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    for a in (0, 3):
        near = [b for b in np.lexsort((np.arange(60), d[a])) if b != a][:4]
        assert [got[a, k + 1][0] for k in range(4)] == near
        assert [got[a, k + 1][1] for k in range(4)] == pytest.approx([1 - d[a, b] / d[a].max() for b in near], abs=1e-6)
    f, _ = _library(spark)
    structure = spark.createDataFrame([(0, (1.5, 9.0), 0.25), (1, None, 0.0), (8, (0.0, 2.0), 1.0)], "track_id long, chorus struct<start double, end double>, repetition_score double")
    asked = spark.createDataFrame([(0,), (1,), (39,), (77,)], "track_id long")
    got = {(r.track_id, r.part, r.name): r.value for r in compose.dossier(f, _sonic(f), asked, NAMES, 5, structure).collect()}
    assert {k: v for k, v in got.items() if k[1] == "structure"} == {(0, "structure", "repetition"): 0.25, (0, "structure", "chorus start"): 1.5, (0, "structure", "chorus end"): 9.0, (1, "structure", "repetition"): 0.0}
    values = [r.danceability for r in f.where("error IS NULL").collect()]
    mine = f.where("track_id = 1").first().danceability
    assert got[1, "percentile", "danceability"] == round(100 * sum(v < mine for v in values) / len(values))
    assert sum(k[1] == "similar" for k in got) == 10 and not any(k[0] in (39, 77) for k in got)


def test_pairs_beside_each_other(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, 5.0), (3, None)], "track_id long, bpm double")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 9)], "query_id long, track_id long")
    assert {tuple(r[c] for c in ("query_id", "track_id", "a_bpm", "bpm")) for r in vectors.beside(rows, pairs, ["bpm"]).collect()} == {(1, 2, 2.0, 5.0), (1, 3, 2.0, None), (2, 1, 5.0, 2.0)}


def test_catalogue_matches_by_beginnings(spark):
    rng = random.Random(8)
    words = ["", "La", "la ", "la nuit", "lanterne", "Élan", "élan vital", "so", "song", "song two"]
    rows = [(i, rng.choice(words) + rng.choice(["", "x", " y"]), rng.choice(["hot", "hot", "hot", "b", None]), "more") for i in range(300)] + [(None, "la", "hot", "m"), (400, None, "hot", "m"), (5, "la", "hot", "m")]
    df = spark.createDataFrame(rows, "id long, title string, artist string, lead string")
    want = {}
    for i, t, a, _ in rows:
        hits = [j for j, u, b, _ in rows if None not in (i, t, a, j, u, b) and b == a and j != i and u.lower().startswith(t.lower())]
        if hits:
            want[i] = min([want.get(i, 1 << 60), *hits])
    assert {r.wanted: r.found for r in recommend.matched(df, df).collect()} == want
    assert recommend.matched(df.where("false"), df).count() == recommend.matched(df, df.where("false")).count() == 0
