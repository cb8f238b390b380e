"""Rules and invariants that SQL can't check."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from listenlab import config
from listenlab.functions import music, text
from listenlab.operators import audio, etl, models, order, playlist, resolve, retrieve, signal, space, stats, titles, writes
from listenlab.operators import vectors as vc
from listenlab.plans.bind import TITLE_CASES
from listenlab.sources import demo, importers, landed, sinks
from listenlab.streaming import plays as sp


@pytest.fixture(scope="module")
def library(spark):
    """12 artists with 8 tracks each around a centre."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 24))
    rows = [(a * 8 + k, [float(x) for x in centres[a] + rng.normal(0, 0.1, 24)], a, a) for a in range(12) for k in range(8)]
    return spark.createDataFrame(rows, "track_id long, vec array<double>, artist long, album long").cache()


def _pool(spark, library):
    q = library.where("track_id = 17").select(F.col("track_id").alias("query_id"), F.col("vec").alias("q"))
    return retrieve.recall(library, q, 95).withColumnRenamed("sim", "score").join(library, "track_id")


def test_nearest_are_of_the_same_artist(library):
    r = vc.nearest_artist(library).first()
    assert r.rate == 1.0 and r.lift == pytest.approx(12)


def test_neighbours_of_several_blocks(library, monkeypatch):
    one = sorted(map(tuple, vc.neighbours(library, 3).select("a", "b", "rank").collect()))
    monkeypatch.setattr(vc, "BLOCK", 10)
    assert sorted(map(tuple, vc.neighbours(library, 3).select("a", "b", "rank").collect())) == one


def test_diversity_and_caps(spark, library):
    pool = _pool(spark, library)
    plain = retrieve.diversified(pool, 20, 1.0, 20).orderBy("place").collect()
    top = pool.orderBy(F.col("score").desc(), "track_id").limit(20).collect()
    assert [r.track_id for r in plain] == [r.track_id for r in top]
    for mode in (True, False):
        got = retrieve.diversified(pool, 20, 0.6, 2, mode).join(library, "track_id").groupBy("artist").count()
        assert got.agg(F.max("count")).first()[0] <= 2
    listed = lambda rows: vc.intra_list_diversity(spark.createDataFrame([(1, r.track_id) for r in rows], "list_id long, track_id long"), library).first().diversity
    assert listed(retrieve.diversified(pool, 20, 0.3, 2).collect()) > listed(plain)


def test_exploration_is_of_the_asked_share_and_repeats(spark, library):
    pool = _pool(spark, library).withColumn("plays", F.lit(1))
    a, b = (sorted(map(tuple, retrieve.explored(pool, 25, 0.12).collect())) for _ in range(2))
    assert a == b and len(a) == 25 and sum(r[2] for r in a) == 3


def test_correction_removes_leakage(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 32))
    p = np.arange(400) % 200
    x[:, 3] += 0.9 * (np.log1p(p) - np.log1p(p).mean()) / np.log1p(p).std()
    v = spark.createDataFrame([(i, [float(z) for z in r]) for i, r in enumerate(x)], "track_id long, vec array<double>")
    plays = spark.createDataFrame([(i, int(n)) for i, n in enumerate(p)], "track_id long, plays long")
    before = vc.leakage(v, plays)
    fixed = vc.corrected(v, vc.popularity_direction(v, plays))
    assert before > 0.15 and vc.leakage(fixed, plays) < before / 2
    assert abs(float(np.linalg.norm(fixed.first().vec)) - 1) < 1e-6


def test_components_are_orthonormal(library):
    axes, share = vc.top_components(library, 4)
    assert np.allclose(axes @ axes.T, np.eye(4)) and (np.diff(share) <= 1e-12).all() and share.sum() <= 1


def test_key_rules(spark):
    code = lambda x: F.lit(x)
    one = spark.range(1)
    assert one.select(music.transition(code("8B"), code("8A")), music.transition(code("12A"), code("1A")), music.transition(code("1A"), code("8A")), music.transition(code("xx"), code("8A"))).first()[:] == (0.9, 0.85, 0.15, None)
    assert one.select(music.distance(code("8B"), code("8A")), music.distance(code("1A"), code("7A")), music.distance(code(None), code("7A"))).first()[:] == (1, 6, 99)
    assert one.select(music.compatible(code("12B"))).first()[0] == ["12B", "1B", "11B", "12A"]


def test_orders_keep_all_tracks(spark):
    rng = np.random.default_rng(3)
    rows = [(p, i + 1, p * 100 + i, float(rng.random()), float(60 + 100 * rng.random()), f"{rng.integers(1, 13)}{'AB'[rng.integers(0, 2)]}") for p in range(3) for i in range(9)]
    items = spark.createDataFrame(rows, "playlist_id long, position int, track_id long, energy double, bpm double, code string")
    for out in (playlist.reorder(items), playlist.sequence(items, "rise")):
        got = out.collect()
        assert {(r.playlist_id, r.track_id) for r in got} == {(r[0], r[2]) for r in rows}
        assert sorted(r.place for r in got if r.playlist_id == 1) == list(range(1, 10))
    first = playlist.reorder(items).where("place = 1").join(items, "track_id").collect()
    lowest = {r.playlist_id: r.e for r in items.groupBy("playlist_id").agg(F.min("energy").alias("e")).collect()}
    assert len(first) == 3 and {round(r.energy, 9) for r in first} == {round(e, 9) for e in lowest.values()}


TITLES = [
    ("Watched Blue Sky (Official Video) [feat. Ann]", "Blue Sky"),
    ("  Night – Day | ", "Night – Day"),
]


@pytest.mark.parametrize(("raw", "clean"), TITLES)
def test_clean_titles(spark, raw, clean):
    assert spark.range(1).select(text.clean_title(F.lit(raw))).first()[0] == clean


def test_normal_titles(spark):
    """The cases of the rules as they are written, and titles that used to go wrong."""
    filled = lambda x: x.replace("{n}", "small ring").replace("{b}", "Brand7") if isinstance(x, str) else x
    cases = [tuple(map(filled, c)) for c in TITLE_CASES] + [
        ("Far From Home", "Ann", None, "Far From Home", "Ann", None, "whole title", "artist's field", None, ""),
        ("Singari (From \"Dude\")", "Sai Abhyankkar", None, "Singari", "Sai Abhyankkar", "Dude", "whole title", "artist's field", "from", ""),
        ("Ethirum Puthirum (1999) | Vidyasagar | Tamil Hit Song", "Thottu Thottu Pesum Sulthana Song", None, "Thottu Thottu Pesum Sulthana", None, "Ethirum Puthirum", "field song words", None, "leads the title", ""),
        ("\U0001d401\U0001d425\U0001d42e\U0001d41e TRAILER", "\U0001d413\U0001d428\U0001d429 10", None, None, "\U0001d413\U0001d428\U0001d429 10", None, "whole title", "artist's field", None, "other"),
        ("x" * 50_000, "y" * 50_000, "z" * 50_000, "x" * 50_000, "y" * 50_000, None, "whole title", "artist's field", None, ""),
    ]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, title string, artist string, album string")
    got = {r.i: (r.clean_title, r.performer, r.movie_album, r.song_rule, r.performer_rule, r.film_rule, r.is_short, r.is_non_music) for r in titles.normalised(df).collect()}
    for i, c in enumerate(cases):
        assert got[i] == (*c[3:9], "short" in c[9], "other" in c[9]), c[0]
    met = {x for g in got.values() for x in g[3:6]}
    assert met >= {"field noise: song", "field song: performers", "field song words", "field ends in video words", "field in capitals or a song's script", "quoted", "part of the title", "version", "behind its artist", "before a subtitle", "whole title", "empty"}
    assert met >= {"beside the song", "composer's handle", "before the quotes", "from", "leads the title", "album of a film", "film's album"}
    assert titles.normalised(df).columns[:4] == df.columns


def test_durations_and_times(spark):
    d = spark.createDataFrame([("PT1H2M3S",), ("PT45S",), ("P1DT2H",), ("PT4M",), ("x",), (None,)], "d string")
    assert [r[0] for r in d.select(text.iso_seconds(F.col("d"))).collect()] == [3723, 45, 93600, 240, None, None]
    t = spark.createDataFrame([("Jan 5, 2024, 3:04:05 PM CET",), ("5 Jan 2024, 15:04:05 UTC",), ("soon",)], "t string")
    assert [str(r[0]) for r in t.select(text.human_time(F.col("t")).cast("string")).collect()] == ["2024-01-05 15:04:05"] * 2 + ["None"]
    assert [r[0] for r in spark.createDataFrame([("3/12",), ("x",)], "v string").select(text.leading_int(F.col("v"))).collect()] == [3, None]


def test_writes_twice_are_once(spark):
    old = spark.createDataFrame([("a", "x", None), ("b", "y", "g")], "title string, artist string, genre string")
    new = spark.createDataFrame([(" a ", "x", "h"), ("b", "y", "z"), ("", "q", "n"), ("c", "z", None)], "title string, artist string, genre string")
    one = writes.upsert_fill(old, new, ["title", "artist"], ["genre"])
    want = [("a", "x", "h"), ("b", "y", "g"), ("c", "z", None)]
    assert sorted(map(tuple, one.collect())) == want
    assert sorted(map(tuple, writes.upsert_fill(one, new, ["title", "artist"], ["genre"]).collect())) == want
    again = writes.append_once(old, old, ["title", "artist"])
    assert again.count() == 2


def test_imports(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([
        {"ts": "2024-01-05T10:00:00Z", "master_metadata_track_name": "Song", "master_metadata_album_artist_name": "Ann", "ms_played": 40000},
        {"endTime": "2024-01-05 11:00", "artistName": "Bob", "trackName": "Tune", "msPlayed": 29999},
        {"endTime": "2024-01-05 11:00", "artistName": "Bob", "trackName": "Tune", "msPlayed": 30000},
        {"ts": "bad", "master_metadata_track_name": None, "ms_played": 90000},
    ]))
    got = importers.read_streaming_history(spark, str(tmp_path / "a.json")).orderBy("title").collect()
    assert [(r.title, r.artist, r.played_ms) for r in got] == [("Song", "Ann", 40000), ("Tune", "Bob", 30000)] and all(r.played_at for r in got)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "d.csv").write_text("﻿Track Description,Play Count,Date Played\nAnn - Song,3,20240105\nno artist,0,20240106\nx - y,2,bad\n")
    (tmp_path / "c" / "e.csv").write_text("Song Name,Album Name\nTune,First\n")
    plays, albums = landed.read_csv_folder(spark, str(tmp_path / "c"))
    daily = plays.collect()
    assert [(r.title, r.album) for r in albums.collect()] == [("Tune", "First")]
    assert sorted((r.artist or "", r.title) for r in daily) == [("", "no artist")] + [("Ann", "Song")] * 3
    assert importers.csv_kind(["Song Name", "Album Name"]) == "activity" and importers.csv_kind(["Title"]) == "generic"
    page = '<div class="content-cell a">Watched <a href="https://x/watch?v=abcdef1&amp;t=1">A &amp; B</a><br><a href="https://x/c">Chan</a><br>Jan 5, 2024, 3:04:05 PM CET</div>'
    r = importers.watch_html(spark.createDataFrame([(page,)], "value string")).first()
    assert (r.video, r.title, r.channel, str(r.played_at)) == ("abcdef1", "A & B", "Chan", "2024-01-05 15:04:05")


def test_propagation(spark):
    rows = spark.createDataFrame([(1, "C", "a", True), (2, "c", "b", False), (3, "C", "the interview", False), (4, "D", "e", False)], "id long, channel string, title string, music boolean")
    # two of three videos of C are no music, so it isn't a music channel until one more is
    assert {r.id: r.reason for r in etl.propagate(rows).collect()} == {1: "direct", 2: None, 3: None, 4: None}
    more = rows.unionByName(spark.createDataFrame([(5, "C", "f", True)], rows.schema))
    assert {r.id: r.reason for r in etl.propagate(more).collect()} == {1: "direct", 2: "channel", 3: None, 4: None, 5: "direct"}


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (205, 201)]
    got = {r.id: r.root for r in resolve.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100, 205: 201, 201: 201}


def test_merge_converges(spark):
    s = "id long, title string, artist string, enriched int, preview string, external string, plays long"
    rows = [(1, "Blue Sky Song", "Ann Lee", 1, None, None, 5), (2, "Blue Sky", "Ann Lee", None, "p", None, 2), (3, "Jukebox Blue Sky", "Ann Lee", None, None, None, 1), (4, "Other Thing", "Bob", None, None, "e", 1), (5, "Unlike", "Cy", None, None, "e", 9)]
    plays = spark.createDataFrame([(1, "t1", "a"), (2, "t1", "a"), (2, "t2", "a"), (4, "t1", "b")], "track_id long, played_at string, source string")
    tracks, moved, n = resolve.merged(spark.createDataFrame(rows, s), plays)
    assert 1 in {r.id for r in tracks.collect()} and 2 not in {r.id for r in tracks.collect()} and n >= 1
    assert moved.where("track_id = 1").count() == 2 and moved.where("track_id = 2").count() == 0


def test_models(spark, library):
    labelled = library.where("artist IN (0, 1, 5, 6)").select("track_id", (F.col("artist") < 2).cast("int").alias("label"), F.lit(3).alias("plays"))
    assert models.taste(library.select("track_id", "vec"), labelled.limit(10)) is None
    scored = models.taste(library.select("track_id", "vec"), labelled, least=20)
    auc = stats.auc(scored.where("label IS NOT NULL").select("label", "score")).first().auc
    assert auc > 0.8
    one, two = (sorted((r.track_id, r.cluster) for r in models.clusters(library, 4).collect()) for _ in range(2))
    assert one == two and len({r[1] for r in one}) == 4
    picks = models.suggested(scored.select("track_id", "score"), library, 5)
    assert picks.count() <= 5


def test_keys_of_chroma(spark):
    scale = [5.0 if i in (0, 2, 4, 5, 7, 9, 11) else 0.05 for i in range(12)]
    scale[0] += 3
    rows = [(t, scale[-t:] + scale[:-t] if t else scale) for t in range(12)]
    got = spark.createDataFrame(rows, "t int, c array<double>").select("t", audio.key(F.col("c")).alias("k"), audio.key_confidence(F.col("c")).alias("conf")).collect()
    assert all((r.k.tonic, r.k.mode) == (r.t, "major") and 0 <= r.conf <= 1 for r in got)


def test_sections(spark):
    rows = [(0.0, 30.0, 0, 0.2), (30.0, 35.0, 1, 0.9), (35.0, 60.0, 0, 0.25), (60.0, 90.0, 1, 0.95), (90.0, 95.0, 2, 0.5)]
    s = spark.createDataFrame([(rows,)], f"s {audio.SECTIONS}")
    merged = s.select(audio.merge_short(F.col("s")).alias("m")).first().m
    assert [(x.start, x.stop) for x in merged] == [(0, 35), (35, 60), (60, 95)] and merged[0].energy == pytest.approx((0.2 * 30 + 0.9 * 5) / 35)
    # five spans: one of the two strongest labels each, within the usable span, apart, in order
    spans = [(0.0, 30.0, 0, 0.2), (30.0, 60.0, 1, 0.9), (60.0, 90.0, 0, 0.25), (90.0, 120.0, 1, 0.95), (120.0, 150.0, 2, 0.5)]
    five = spark.createDataFrame([(spans,), ([],)], f"s {audio.SECTIONS}")
    got, none = (r.e for r in five.select(audio.excerpts(F.col("s"), F.lit(150.0), F.lit(2), F.lit(20.0)).alias("e")).collect())
    assert [(x.start, x.source) for x in got] == [(65.0, "section:0"), (95.0, "section:1")]
    assert [(x.start, x.source) for x in none] == [(27.5, "fallback:0.25"), (65.0, "fallback:0.50")]
    one = five.limit(1).select(audio.excerpts(F.col("s"), F.lit(150.0), F.lit(3), F.lit(20.0)).alias("e")).first().e
    assert [x.source for x in one] == ["section:0", "section:1", "section:2"]


def test_report_and_playlist(spark, tmp_path):
    page = sinks.report({"title": "A <b>", "artist": "Ann"}, {"energy": 0.5, "none": None})
    assert "A &lt;b&gt;" in page and "energy" in page and "none" not in page
    items = spark.createDataFrame([(2, 61.0, "B", "t2", "/b"), (1, 60.0, "A", "t1", "/a")], "position int, seconds double, artist string, title string, path string")
    sinks.write_m3u(items, str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["#EXTM3U", "#EXTINF:60,A - t1", "/a", "#EXTINF:61,B - t2", "/b"]


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 10:00:00", "a", 7), (1, "2024-01-01 10:00:00", "a", 7), (2, "2024-01-01 10:30:00", "a", 7), (1, "2024-01-02 10:00:00", "b", 8)]
    plays = spark.createDataFrame(rows, "track_id long, played_at string, source string, user_id long").withColumn("played_at", F.to_timestamp("played_at"))
    plays.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: sp.read(spark, str(tmp_path / "in"), plays.schema.simpleString()[7:-1].replace(":", " ").replace(",", ", "))
    got = []
    sp.available(sp.once(stream()), str(tmp_path / "c1"), lambda df, _: got.extend(df.collect()))
    assert len(got) == 3
    sp.available(sp.once(stream()), str(tmp_path / "c1"), lambda df, _: got.extend(df.collect()))
    assert len(got) == 3  # nothing new
    last = {}
    sp.available(sp.running_counts(stream()), str(tmp_path / "c2"), lambda df, _: last.update({r.track_id: r.plays for r in df.collect()}), "complete")
    assert last == {1: 3, 2: 1}
    days = {}
    sp.available(sp.daily(stream()), str(tmp_path / "c3"), lambda df, _: days.update({str(r.w.start)[:10]: r.plays for r in df.collect()}), "update")
    assert days == {"2024-01-01": 3, "2024-01-02": 1}
    w = {}
    sp.available(sp.sessions(stream()), str(tmp_path / "c4"), lambda df, _: w.update({(r.user_id, str(r.w.start)): r.plays for r in df.collect()}), "append")
    assert sum(w.values()) in (0, 3, 4)  # closed sessions only


def test_entry_without_the_optional_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['listenlab.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'top_tracks' in q and not any(n.startswith('op') and n[2].isdigit() for n in q); print(len(q))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 2)[0]).stdout) > 100


def test_every_query_is_searched(spark, tmp_path):
    from listenlab.plans import catalogue

    rng = np.random.default_rng(5)
    x = rng.normal(size=(260, 64))
    rows = [(i, [float(v) for v in x[i]], i % 9) for i in range(260)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    spark.createDataFrame([(1, "2020-01-01", "N")], "l_partkey long, l_shipdate string, l_returnflag string").write.parquet(str(tmp_path / "lineitem.parquet"))
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for name, size in (("mmr_rerank", 18), ("similar_tracks", 12), ("explore_tail", 25)):
        got = catalogue.QUERIES[name](spark, str(tmp_path)).toPandas().groupby("query_id")["track_id"].agg(set)
        assert sorted(got.index) == [0, 50, 100, 150, 200, 250]
        for q, ids in got.items():
            order = [i for i in np.argsort(-(u @ u[q]), kind="stable").tolist() if i != q]
            assert len(ids) == size and ids <= set(order[:200 if name == "mmr_rerank" else 96 if name == "similar_tracks" else 100])
            if name == "mmr_rerank":
                assert order[0] in ids
            elif name == "explore_tail":
                assert set(order[:22]) <= ids
            else:
                assert all(i % 9 != q % 9 for i in ids)


def test_all_rows_count_without_a_rank(spark, monkeypatch):
    monkeypatch.setattr(vc, "BLOCK", 16)
    x = np.random.default_rng(6).normal(size=(50, 4))
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)], "track_id long, vec array<double>")
    got = {r.a: r.m for r in vc.mean_distances(v).collect()}
    d = np.linalg.norm(x[:, None] - x[None], axis=2).sum(1) / 49
    assert [got[i] for i in range(50)] == pytest.approx(d.tolist())
    q = v.where("track_id = 3").select(F.col("track_id").alias("query_id"), F.col("vec").alias("q"))
    every = retrieve.recall(v, q, None)
    assert every.count() == 49 and "rank" not in every.columns


def test_signals(spark):
    beats = [0.5 * i for i in range(20)]
    tight, loose = [0.5 * i for i in range(16)], [0.5 * i + 0.04 * (-1) ** i for i in range(16)]
    g = spark.createDataFrame([(tight, beats), (loose, beats), ([0.0], beats), (None, None)], "o array<double>, b array<double>").select(signal.groove("o", "b").alias("g"))
    assert [round(r.g.microtiming_ms, 3) for r in g.collect()] == [0.0, 40.0, 0.0, 0.0]
    x = np.sin(np.arange(400) * 0.1)
    up = signal._resampled(x, 3, 2)
    assert len(up) == 600 and np.abs(up[60:540] - np.sin(np.arange(600) * 0.2 / 3)[60:540]).max() < 0.01
    assert np.array_equal(signal._resampled(x, 5, 5), x)
    assert spark.range(1).select(signal.runs(F.array(*map(F.lit, [1, 1, 2, 2, 2, 1])))).first()[0] == [0, 2, 5]
    one = spark.createDataFrame([([0.5] * 30,)], "x array<double>").select(signal.resampled("x", F.lit(4), F.lit(2)).alias("y"), signal.true_peak("x").alias("p")).first()
    assert len(one.y) == 15 and 0.49 < one.p < 0.7
    # a steady tone with soft ends, a click at each end, and silence
    t = np.arange(20_000) / 8000
    tone = np.sin(2 * np.pi * 440 * t) * np.minimum(1, np.minimum(t, t[::-1]) * 5)
    click = tone.copy()
    click[0] = click[-1] = 1.0
    s = spark.createDataFrame([(tone.tolist(),), (click.tolist(),), ([0.0] * 20_000,), (None,)], "x array<double>").select(signal.sample_signals("x", F.lit(8000)).alias("s")).collect()
    assert [r.s.edge_truncation for r in s] == [0.0, 1.0, 0.0, 0.0] and all(0 <= v <= 1 for r in s for v in r.s)


def test_segments_follow_the_music(spark):
    rng = np.random.default_rng(3)
    kind = np.repeat([0, 1, 0, 1], 20)
    chroma = np.where(np.arange(12)[None] % 2 == kind[:, None], 1.0, 0.1) + rng.normal(0, 0.02, (80, 12))
    timbre = kind[:, None] * 2.0 + rng.normal(0, 0.05, (80, 5))
    row = (chroma.tolist(), timbre.tolist(), [0.5 * i for i in range(80)], (0.2 + 0.5 * kind).tolist())
    s = spark.createDataFrame([row, ([], [], [], [])], "c array<array<double>>, m array<array<double>>, t array<double>, l array<double>").select(signal.segmented(*map(F.col, "cmtl")).alias("s")).select("s", signal.repetition(F.col("s")).alias("again")).collect()
    assert [(x.start, x.stop) for x in s[0].s] == [(0.0, 10.0), (10.0, 20.0), (20.0, 30.0), (30.0, 39.5)] and s[1].s == []
    assert s[0].s[0].label == s[0].s[2].label != s[0].s[1].label == s[0].s[3].label
    assert s[0].again == 1.0 and s[1].again == 0.0


def test_settings(tmp_path):
    assert config.load(None, {}) == config.Config(root=config.os.path.expanduser("~/.listenlab"))
    (tmp_path / "a.toml").write_text("root = '/x'\nepsilon = 'many'\nunknown = 1\n[retrieval]\nmmr_lambda = 0.5\ndebias_popularity = false\n")
    got = config.load(str(tmp_path / "a.toml"), {"LISTENLAB_EPSILON": "0.2", "LISTENLAB_SESSION_GAP_S": "x"})
    assert (got.root, got.epsilon, got.mmr_lambda, got.debias_popularity, got.session_gap_s) == ("/x", 0.2, 0.5, False, 1800)
    (tmp_path / "b.toml").write_text("not toml at all")
    assert config.load(str(tmp_path / "b.toml"), {"LISTENLAB_ROOT": "/y"}).root == "/y"


def test_demo_plays(spark):
    one = sorted(map(tuple, demo.plays(spark, spark.range(36)).collect()))
    assert one == sorted(map(tuple, demo.plays(spark, spark.range(36).repartition(5)).collect()))
    assert 1000 < len(one) < 2600 and {r[2] for r in one} == set(demo.SOURCES) and len({r[0] for r in one}) > 30
    evening = sum(17 <= r[1].hour <= 21 for r in one)
    assert evening > 2 * sum(r[1].hour < 6 for r in one)


def test_ordered_runs(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(x), None if i % 9 == 0 else float(i % 4)) for i, x in enumerate(rng.integers(0, 40, 500))]
    df = spark.createDataFrame(rows, "id long, v long, w double").repartition(5)
    got = sorted((r.id, r.pos, r.total, r.s) for r in order.running(df, [F.col("v"), F.col("id")], s=F.col("w")).collect())
    want, total = [], 0.0
    for pos, (i, _, w) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        total += w or 0.0
        want.append((i, pos, 500, total))
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in sorted(want)]
    assert all((x[3] if x[3] is not None else 0.0) == pytest.approx(y[3]) for x, y in zip(got, sorted(want), strict=True))
    before = {r.id: r.p for r in order.previous(df, [F.col("v"), F.col("id")], p=F.col("id")).collect()}
    ids = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    assert before == dict(zip(ids, [None, *ids[:-1]], strict=True))
    assert order.running(df.where("false"), [F.col("v")]).count() == 0


def test_axes_and_diagnostics(spark, library):
    rows = spark.createDataFrame([(i, None, float(i), float(2 * i + i % 2), float(i % 3)) for i in range(40)], "track_id long, error string, a double, b double, c double")
    (_, first, share), (_, second, _) = space.axes(rows, ["a", "b", "c"])
    x = np.array([[r.a, r.b, r.c] for r in rows.collect()])
    z = (x - x.mean(0)) / x.std(0)
    assert set(first.replace(" / ", "").replace("−", "+").split("+")[1:]) == {"a", "b"} and "c" in second
    assert share == pytest.approx(100 * np.linalg.eigvalsh(z.T @ z)[-1] / 3 / 40, abs=0.1)
    plays = library.select("track_id", (F.col("track_id") % 50).alias("plays"))
    d = space.diagnostics(library.select("track_id", "vec"), plays)
    assert 0 <= d["after"] <= 1 and d["verdict"].endswith("%.")
