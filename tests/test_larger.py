"""Queries over keys and rows that the small tables don't have, against DuckDB or plain forms."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracles import SF, _rows

from listenlab.operators import space
from listenlab.plans.catalogue import ORACLE, QUERIES


def same(spark, folder, table, name):
    """The query gives DuckDB's rows over one table of a folder."""
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet/*.parquet'")
    rel, df = c.sql(ORACLE[name]), QUERIES[name](spark, str(folder))
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    """Parts with keys beyond the seconds of a day, and of seven digits."""
    to = tmp_path_factory.mktemp("parts")
    one = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey < 60")
    shifted = [one.withColumn("p_partkey", F.col("p_partkey") + k) for k in (0, 86_390, 999_970, 1_000_030)]
    shifted[0].union(shifted[1]).union(shifted[2]).union(shifted[3]).write.parquet(f"{to}/part.parquet")
    return to


def test_session_items_of_more_than_a_day(spark, parts):
    same(spark, parts, "part", "session_history")


@pytest.mark.parametrize("name", ["authoritative_import", "watch_json"])
def test_videos_of_seven_digits(spark, parts, name):
    same(spark, parts, "part", name)


def test_ranges_of_nothing(spark, tmp_path):
    """Tempo, loudness and range at the ends of what they are cut to."""
    rows = [(i, [0.01 * i] * 8 + [x, y, z] + [0.1] * 53, i % 12) for i, (x, y, z) in enumerate((x, y, z) for x in (-0.7, 0.0, 0.9) for y in (-0.7, 0.1) for z in (-0.7, -0.5, 0.2, 0.9))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(spark, tmp_path, "embeddings", "feature_vectors")
    ranges = spark.createDataFrame([(0, 1.0, 0.0, -1.0, 0.0), (1, 1.0, None, None, None)], "track_id long, x double, bpm double, loudness_db double, dynamic_range double")
    assert [r.vec[3] for r in space.assembled(ranges, ["x"]).orderBy("track_id").collect()] == [8 / 30, 8 / 30]


def test_catalogue_matches_broadcast_nothing(spark, parts):
    """A small file may hold many rows: 1.2 million parts of 5 MB, and twelve times as many beginnings of titles."""
    same(spark, parts, "part", "catalogue_match")
    plan = QUERIES["catalogue_match"](spark, str(parts))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "WindowGroupLimit" in plan


def test_orders_of_playlists_by_plain_forms(spark, monkeypatch):
    """Playlists of 1 to 40 tracks, over the ends of packs and batches, and one call of Python for many of them."""
    import math
    import random

    from listenlab.operators import playlist as pl

    monkeypatch.setattr(pl, "PACK_ROWS", 30)
    rng, wheel = random.Random(3), [f"{n}{c}" for n in range(1, 13) for c in "AB"] + [None]
    rows = [(p, i, rng.randrange(500), rng.choice([0.1, 0.3, rng.random()]), rng.choice([100.0, 128.0, 90 + 50 * rng.random()]), rng.choice(wheel)) for p in range(60) for i in range(1, 1 + rng.choice([1, 1, 2, 3, 5, 40]))]
    items = spark.createDataFrame(rows, "playlist_id long, position int, track_id long, energy double, bpm double, code string")
    want: dict[str, dict] = {"reorder": {}, "sequence": {}}
    for p in range(60):
        mine = [r for r in rows if r[0] == p]
        left, out = sorted(mine, key=lambda r: (r[3], r[1])), []
        while left:
            f = lambda r: 0.3 if (fit := pl._fit(out[-1][5], r[5])) is None else fit
            out.append(left.pop(0) if not out else left.pop(max(range(len(left)), key=lambda i: (0.6 * f(left[i]) + 0.4 * (1 - abs(out[-1][3] - left[i][3])), -left[i][1]))))
        want["reorder"][p] = [r[2] for r in out]
        left, out = list(mine), []
        while left and len(mine) > 2:
            goal = 0.35 + 0.55 * math.sin(math.pi * len(out) / (len(mine) - 1))

            def cost(r, goal=goal, out=out):
                c = 2 * abs(r[3] - goal)
                if out:
                    x, y = pl._wheel(out[-1][5]), pl._wheel(r[5])
                    gap = 99 if x is None or y is None else min((x[0] - y[0]) % 12, (y[0] - x[0]) % 12) + (x[1] != y[1])
                    c += abs(out[-1][4] - r[4]) / 12 + min(gap, 7) / 2
                return c, r[1]

            out.append(left.pop(min(range(len(left)), key=lambda i: cost(left[i]))))
        want["sequence"][p] = [r[2] for r in out or mine]
    for name, df in (("reorder", pl.reorder(items)), ("sequence", pl.sequence(items, "peak"))):
        got: dict[int, list] = {}
        for r in df.orderBy("playlist_id", "place").collect():
            got.setdefault(r.playlist_id, []).append(r.track_id)
            assert r.place == len(got[r.playlist_id])
        assert got == want[name]
    plan = pl.reorder(items)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan and pl.reorder(items.where("false")).count() == 0


def test_running_median_sorts_runs_once(monkeypatch):
    import numpy as np

    from listenlab.operators import sound

    rng = np.random.default_rng(4)
    cases = [(x, a) for shape in ((40, 50), (1, 70), (3, 4), (93, 200)) for x in (rng.normal(size=shape).astype(np.float32), rng.integers(0, 4, shape).astype(np.float32)) for a in (0, 1)]
    want = [np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, [(15, 15) if i == a else (0, 0) for i in (0, 1)], mode="symmetric"), 31, axis=a), axis=-1) for x, a in cases]
    # a selection for each window by itself took three quarters of a track's time
    monkeypatch.setattr(np, "partition", None)
    assert all(np.array_equal(sound.running_median(x, a), w) for (x, a), w in zip(cases, want, strict=True))


def test_blocks_weighted_together_and_phases_apart(monkeypatch):
    import numpy as np

    from listenlab.operators import signal, sound

    x = np.random.default_rng(6).normal(size=(3, 24_000))
    assert np.allclose(sound.weighted(x, 8000), [np.convolve(y, sound.weighting(8000))[:24_000] for y in x], atol=1e-9)
    for up, down in ((4, 1), (3, 2), (1, 4), (2, 7)):
        for n in (1, 2, 5, 1000):
            got = signal._resampled(x[0, :n], up, down)
            monkeypatch.setattr(signal, "FEW_PHASES", 0)
            assert np.array_equal(got, signal._resampled(x[0, :n], up, down))
            monkeypatch.undo()


def test_isolated_rows_keep_arrays(spark):
    """Samples reach the work as they lie, without a Python object for each, and spectra need no more than two fields."""
    import numpy as np
    from pyspark.sql.types import BooleanType, StringType, StructField, StructType

    from listenlab.operators import sound
    from listenlab.operators.isolate import isolated

    rows = spark.createDataFrame([(1, [0.5, None], ["a"], None), (2, [], None, [1.0])], "k long, x array<float>, w array<string>, y array<double>")
    kind = StructType([StructField("array", BooleanType()), StructField("kinds", StringType())])
    got = {r.k: (r.array, r.kinds) for r in isolated(rows, ["k"], lambda r: {"array": isinstance(r["x"], np.ndarray) and len(r["x"]) == 4 - 2 * r["k"], "kinds": f"{type(r['w']).__name__} {type(r['y']).__name__}"}, kind).collect()}
    assert got == {1: (True, "list NoneType"), 2: (True, "NoneType ndarray")}
    x = np.random.default_rng(7).normal(size=20_000)
    whole, part = sound.measured(x, 8000), sound.shape(x, 8000)
    assert sorted(part) == ["centroid", "flatness"] and all(np.array_equal(whole[n], part[n]) for n in part)


@pytest.mark.parametrize("name", ["track_loudness", "isolated_spectra", "track_features"])
def test_sounds_are_not_written(spark, name, tmp_path, monkeypatch):
    """Sounds are far longer than the rows that they are made from."""
    from pathlib import Path

    from listenlab.operators import order

    monkeypatch.setattr(order, "shared_dir", lambda _: str(tmp_path))
    df = QUERIES[name](spark, SF)
    assert not list(Path(tmp_path).rglob("*.parquet")) and df.where("track_id < 0").count() == 0
