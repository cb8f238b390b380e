"""As-of joins, replayed plays, and session successors as a stream."""

import random
from datetime import datetime, timedelta

import duckdb
from pyspark.sql import functions as F

from listenlab.operators import asof, evaluate
from listenlab.streaming import plays as sp
from listenlab.streaming import successors as su

START = datetime(2024, 1, 1)


def test_cached_lookups(spark):
    rng = random.Random(1)
    at = lambda: START + timedelta(seconds=rng.randrange(0, 5000))
    # one key has a third of all rows
    name = lambda: "hot" if rng.random() < 0.33 else rng.choice([*"abcdefgh", None])
    asked = [(i, name(), at() if i % 20 else None) for i in range(600)]
    lookups = [(name(), at(), rng.choice(["x", "y", "z", None])) for _ in range(300)] + [("hot", START, "x"), ("hot", START, "y"), ("a", None, "z")]
    left = spark.createDataFrame(asked, "id long, key string, asked_at timestamp").repartition(5)
    right = spark.createDataFrame(lookups, "key string, fetched_at timestamp, value string").repartition(3)
    got = {r.id: (r.value, r.state) for r in asof.cached_lookups(left, right, 600).collect()}
    for i, k, t in asked:
        old = [(f, v is not None, v or "") for key, f, v in lookups if k is not None and key == k and t and f and f <= t]
        if not old:
            want = (None, "missing")
        else:
            f, known, v = max(old)
            want = (v if known else None, "fresh") if (t - f).total_seconds() <= 600 else (None, "expired")
        assert got[i] == want, (i, k, t)
    assert {s for _, s in got.values()} == {"fresh", "expired", "missing"}
    assert asof.cached_lookups(left.limit(0), right, 1).count() == 0
    assert {r.state for r in asof.cached_lookups(left, right.limit(0), 1).collect()} == {"missing"}


def test_replayed(spark):
    plays = spark.createDataFrame([(1, "t1", "a"), (1, "t1", "a"), (1, "t2", "b"), (2, "t1", "a"), (3, "t1", "a"), (None, "t1", "a")], "track_id long, played_at string, source string")
    copied = spark.createDataFrame([(1, 10), (3, 30)], "id long, library_id long")
    known = spark.createDataFrame([(10, "t2", "b")], "track_id long, played_at string, context string")
    assert sorted(map(tuple, asof.replayed(plays, copied, known).collect())) == [(10, "t1", "a"), (30, "t1", "a")]


def test_streamed_successors(spark, tmp_path):
    """Shuffled and repeated plays over several micro-batches, a restart between them, give the batch operator's pairs."""
    rng, rows, clock = random.Random(2), [], {}
    for i in range(400):
        user = rng.randrange(6)
        clock[user] = clock.get(user, START) + timedelta(seconds=rng.choice([1, 600, 1799, 1800, 1801, 4000]))
        rows.append((i, user, rng.randrange(5), clock[user]))
    schema = "event_id long, user_id long, track_id long, played_at timestamp"
    plays = spark.createDataFrame(rows, schema)
    want = sorted((r.event_id, r.a, r.b) for r in evaluate.session_pairs(plays, by=["user_id"]).collect())
    late = rows + rng.sample(rows, 60)
    late.sort(key=lambda r: r[3] + timedelta(seconds=rng.randrange(0, 20_000)))
    found = []

    def take(df, _):
        found.extend((r.user_id, r.event_id, r.a, r.b) for r in df.collect())

    def land(k, part):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}.parquet")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        sp.available(su.successors(stream, late="12 hours"), f"{tmp_path}/ck", take)

    size = len(late) // 3
    land(0, late[:size])
    land(1, late[size : 2 * size])
    run()
    land(2, late[2 * size :])
    # a play of nobody, long after, lets all others pass
    land(3, [(10**6, -1, 0, START + timedelta(days=400))])
    run()
    assert sorted(f[1:] for f in found) == want and len(want) > 50


def test_asof_is_duckdbs(spark):
    rng = random.Random(4)
    left = [(i, rng.choice("abc"), rng.randrange(1000)) for i in range(200)]
    right = [(rng.choice("abcd"), t, t * 2) for t in rng.sample(range(1000), 60)]
    got = asof.asof(spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, f long, v long"), "k", "t", "f", ["v"])
    con = duckdb.connect()
    con.sql("CREATE TABLE l (id BIGINT, k VARCHAR, t BIGINT)")
    con.sql("CREATE TABLE r (k VARCHAR, f BIGINT, v BIGINT)")
    con.executemany("INSERT INTO l VALUES (?, ?, ?)", left)
    con.executemany("INSERT INTO r VALUES (?, ?, ?)", right)
    want = con.sql("SELECT l.*, f, v FROM l ASOF LEFT JOIN r ON l.k = r.k AND l.t >= r.f ORDER BY id").fetchall()
    assert [tuple(r) for r in got.orderBy("id").collect()] == want
    assert got.where(F.col("found_at") > F.col("t")).count() == 0


