"""Vector spaces: exact search, neighbours, and corrections for popularity, anisotropy and hubs.

All-pairs work is dealt out as a grid: rows fall into groups of about GROUP by a hash, and each pair of
groups is one task's work, which returns the k best or a sum for each row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from listenlab.functions.arrays import dot, norm, project_out, unit
from listenlab.functions.music import distance

#: Rows of a group; rows of one side that are compared at a time.
GROUP, BLOCK = 8192, 512


def _grid(left: DataFrame, right: DataFrame, less: Column, of: Callable, schema: str) -> DataFrame:
    """``of(ids, x, ids, y, less)`` for every pair of groups of left and right rows (track_id, vec); yields arrays by the schema."""

    def parts(df: DataFrame) -> int:
        return max(1, -(-df.count() // GROUP))

    m, n = parts(left), parts(right)
    group = lambda k: F.pmod(F.xxhash64("track_id"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.select(group(m).alias("i"), every(n).alias("j"), F.lit(True).alias("asks"), "track_id", "vec", F.lit(0.0).alias("less"))
    b = right.select(every(m).alias("i"), group(n).alias("j"), F.lit(False).alias("asks"), "track_id", "vec", less.alias("less"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(t: pa.Table) -> pa.Table:
        asks, ids = t.column("asks").to_numpy(zero_copy_only=False), t.column("track_id").to_numpy()
        vec = t.column("vec").combine_chunks()
        x = vec.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(ids), -1)
        p, q = np.flatnonzero(asks), np.flatnonzero(~asks)
        p, q = p[np.argsort(ids[p], kind="stable")], q[np.argsort(ids[q], kind="stable")]
        out = [[] for _ in names]
        if len(p) and len(q):
            for s in range(0, len(p), BLOCK):
                part = p[s : s + BLOCK]
                for held, values in zip(out, of(ids[part], x[part], ids[q], x[q], t.column("less").to_numpy()[q]), strict=True):
                    held.append(values)
        kinds = [pa.int64() if k.endswith("long") else pa.float64() for k in schema.split(", ")]
        return pa.table({n: pa.array(np.concatenate(h) if h else [], k) for n, h, k in zip(names, out, kinds, strict=True)})

    return a.unionByName(b).groupBy("i", "j").applyInArrow(run, schema)


def neighbours(vectors: DataFrame, k: int, cosine: bool = True, of: DataFrame | None = None, less: str | None = None) -> DataFrame:
    """JN13, VC3: (a, b, s, rank) the k most similar (or nearest) other rows of every row, or of the rows ``of``, ties to the smaller id.

    With a column ``less`` of the rows, s is twice the similarity less that. Each pair of groups returns at
    most k rows for each row that asks.
    """

    def best(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, minus: np.ndarray) -> tuple:
        if cosine:
            s = (x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)) @ (y / (np.linalg.norm(y, axis=1, keepdims=True) + 1e-9)).T
        else:
            s = -np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
        if less:
            s = 2 * s - minus
        s[a[:, None] == b[None]] = -np.inf
        floor = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), -np.inf)
        r, c = np.nonzero((s >= floor[:, None]) & np.isfinite(s))
        order = np.lexsort((b[c], -s[r, c], r))
        r, c = r[order], c[order]
        near = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[near], c[near]
        return a[r], b[c], s[r, c]

    side = vectors.select("track_id", "vec", *([less] if less else []))
    found = _grid(vectors if of is None else of, side, F.col(less) if less else F.lit(0.0), best, "a long, b long, s double")
    w = Window.partitionBy("a").orderBy(F.col("s").desc(), "b")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def mean_distances(vectors: DataFrame) -> DataFrame:
    """VC6: (a, m) the mean distance of every row to all others; each pair of groups returns one sum for each of its rows."""

    def sums(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, _: np.ndarray) -> tuple:
        d = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))
        other = a[:, None] != b[None]
        return a, (d * other).sum(1), other.sum(1)

    rows = _grid(vectors, vectors, F.lit(0.0), sums, "a long, d double, n long").groupBy("a").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    return rows.where("n > 0").select("a", (F.col("d") / F.col("n")).alias("m"))


def siblings(vectors: DataFrame, of: DataFrame, k: int) -> DataFrame:
    """VC5: (a, b, rank, sim) the k nearest other rows of the rows ``of``; sim is 1 less the distance as a share of the row's farthest."""

    def farthest(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray, _: np.ndarray) -> tuple:
        return a, np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0)).max(1)

    far = _grid(of, vectors, F.lit(0.0), farthest, "a long, m double").groupBy("a").agg(F.max("m").alias("m"))
    near = neighbours(vectors, k, cosine=False, of=of).join(far, "a")
    return near.select("a", "b", "rank", (1 + F.col("s") / F.when(F.col("m") > 0, F.col("m")).otherwise(1.0)).alias("sim"))


def knn_graph(vectors: DataFrame, k: int = 2, most: int | None = None) -> DataFrame:
    """VC6: edges of the k-nearest graph that go from a smaller id to a larger, with their distance; the ``most`` lightest of them."""
    e = neighbours(vectors, k, cosine=False).where("a < b").select("a", "b", (-F.col("s")).alias("d"))
    return e if most is None else e.orderBy("d", "a", "b").limit(most)


def radius(vectors: DataFrame, k: int = 10) -> DataFrame:
    """VC10: mean similarity to the k nearest."""
    return neighbours(vectors, k).groupBy(F.col("a").alias("track_id")).agg(F.avg("s").alias("radius"))


def standardised(features: DataFrame, names: list[str]) -> DataFrame:
    """VC1, PRJ3: z-scores of features, by population deviation, as one array."""
    ok = features.where("error IS NULL")
    st = ok.agg(*[F.avg(n).alias(f"m_{n}") for n in names], *[F.stddev_pop(n).alias(f"s_{n}") for n in names])
    return ok.crossJoin(F.broadcast(st)).select("track_id", F.array(*[(F.col(n) - F.col(f"m_{n}")) / (F.col(f"s_{n}") + 1e-6) for n in names]).alias("vec"))


def centroid(vectors: DataFrame, by: list[str]) -> DataFrame:
    """AR6: mean vector of each group, one row for each group and dimension on the way."""
    e = vectors.select(*by, F.posexplode("vec").alias("i", "x")).groupBy(*by, "i").agg(F.avg("x").alias("x"))
    out = e.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return out.select(*by, F.transform("p", lambda s: s["x"]).alias("vec"))


def fused(a: DataFrame, b: DataFrame) -> DataFrame:
    """AR5: unit vectors of two spaces averaged, and made unit again."""
    j = a.join(b.select("track_id", F.col("vec").alias("v2")), "track_id")
    return j.select("track_id", unit(F.zip_with(unit(F.col("vec")), unit(F.col("v2")), lambda x, y: (x + y) / 2)).alias("vec"))


def popularity_direction(vectors: DataFrame, plays: DataFrame) -> DataFrame:
    """VC7: one row, the unit direction along which centred vectors follow z-scored log plays."""
    p = vectors.join(plays, "track_id", "left").withColumn("p", F.log1p(F.coalesce("plays", F.lit(0)).cast("double")))
    st = p.agg(F.avg("p").alias("mp"), F.stddev_pop("p").alias("sp"))
    rows = p.crossJoin(F.broadcast(st)).select(((F.col("p") - F.col("mp")) / (F.col("sp") + 1e-9)).alias("z"), F.posexplode("vec").alias("i", "x"))
    # sum (x - mean x) z / n = mean xz - mean x mean z, in one pass
    e = rows.groupBy("i").agg((F.avg(F.col("x") * F.col("z")) - F.avg("x") * F.avg("z")).alias("c"))
    one = e.agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("p")).select(F.transform("p", lambda s: s["c"]).alias("d"))
    return one.select(unit(F.col("d")).alias("dir"))


def corrected(vectors: DataFrame, direction: DataFrame, components: list[list[float]] | None = None) -> DataFrame:
    """VC9: centred, without the direction and the components, made unit."""
    mean = centroid(vectors.withColumn("_g", F.lit(1)), ["_g"]).select(F.col("vec").alias("mean"))
    v = vectors.crossJoin(F.broadcast(mean)).crossJoin(F.broadcast(direction))
    x = project_out(F.zip_with("vec", "mean", lambda a, b: a - b), F.col("dir"))
    rows = v.select("track_id", x.alias("vec"))
    for c in components or []:
        rows = rows.withColumn("vec", project_out(F.col("vec"), F.array(*map(F.lit, c))))
    return rows.select("track_id", unit(F.col("vec")).alias("vec"))


def gram(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, second moments and count; the moments are d x d, summed where the rows are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, g = 0, 0.0, 0.0
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float)
            if len(x):
                n, s, g = n + len(x), s + x.sum(0), g + x.T @ x
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([s.tobytes()]), pa.array([g.tobytes()])], ["n", "s", "g"])

    rows = vectors.select("vec").mapInArrow(run, "n long, s binary, g binary").collect()  # one d x d matrix for each task
    n = sum(r["n"] for r in rows)
    s = sum(np.frombuffer(r["s"]) for r in rows)
    return s / n, sum(np.frombuffer(r["g"]) for r in rows).reshape(len(s), len(s)), n


def top_components(vectors: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """VC8, ML2: the k main axes of the centred rows, and their shares of variance; an axis' largest part is positive."""
    mean, g, n = gram(vectors)
    values, axes = np.linalg.eigh(g / n - np.outer(mean, mean))
    axes, values = axes[:, ::-1].T[:k], values[::-1]
    axes = axes * np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]
    return axes, values[:k] / values.sum()


def leakage(vectors: DataFrame, plays: DataFrame) -> float:
    """VC12: R2 of ridge regression (0.01 n) of z-scored log plays on the vectors."""
    p = vectors.join(plays, "track_id", "left").select(F.concat("vec", F.array(F.log1p(F.coalesce("plays", F.lit(0)).cast("double")))).alias("vec"))
    mean, g, n = gram(p)
    c = g / n - np.outer(mean, mean)
    xx, xy, yy = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    if yy <= 0:
        return 0.0
    w = np.linalg.solve(xx + 0.01 * np.eye(len(xx)), xy)
    return float(1 - (yy - 2 * w @ xy + w @ xx @ w) / yy)


def intra_list_diversity(items: DataFrame, vectors: DataFrame) -> DataFrame:
    """EV4: 1 less the mean cosine of a list's pairs; from the sum of unit vectors, so no pairs are made."""
    u = items.join(vectors.select("track_id", unit(F.col("vec")).alias("vec")), "track_id")
    e = u.select("list_id", "track_id", F.posexplode("vec").alias("i", "x"))
    sums = e.groupBy("list_id", "i").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    one = sums.groupBy("list_id").agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"), F.max("n").alias("n")).where("n > 1")
    return one.select("list_id", (1 - (F.col("ss") - F.col("qq")) / (F.col("n") * (F.col("n") - 1))).alias("diversity"))


def nearest_artist(vectors: DataFrame) -> DataFrame:
    """EV3: how often the nearest neighbour is of the same artist, what chance gives, and the lift."""
    nn = neighbours(vectors.select("track_id", "vec"), 1)
    a = vectors.select(F.col("track_id").alias("a"), F.col("artist").alias("x"))
    b = vectors.select(F.col("track_id").alias("b"), F.col("artist").alias("y"))
    rate = nn.join(a, "a").join(b, "b").agg(F.avg((F.col("x") == F.col("y")).cast("double")).alias("rate"))
    per = vectors.groupBy("artist").agg(F.count("*").alias("n"))
    chance = per.agg((F.sum(F.col("n") * F.col("n")) / F.pow(F.sum("n"), F.lit(2))).alias("chance"))
    return rate.crossJoin(chance).withColumn("lift", F.col("rate") / F.col("chance"))


def beside(rows: DataFrame, pairs: DataFrame, names: list[str]) -> DataFrame:
    """Both rows of pairs (query_id, track_id): the track's columns, and the query's with a_ before their names."""
    one = rows.select(F.col("track_id").alias("query_id"), *[F.col(n).alias(f"a_{n}") for n in names])
    return pairs.join(one, "query_id").join(rows.select("track_id", *names), "track_id")


def explained(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """VC24, MT12: for pairs (query_id, track_id) of rows (track_id, vec, bpm, code, lufs, centroid, microtiming, harmonic, tags): similarity, differences, and tags that both have."""
    both = beside(rows, pairs, ["vec", "bpm", "code", "lufs", "centroid", "microtiming", "harmonic", "tags"])
    diff = lambda n, places: F.round(F.col(n) - F.col(f"a_{n}"), places)
    cosine = dot(unit(F.col("vec")), unit(F.col("a_vec")))
    return both.select(
        "query_id", "track_id", F.round(cosine, 6).alias("similarity"), diff("bpm", 1).alias("bpm_delta"), distance(F.col("a_code"), F.col("code")).cast("int").alias("camelot_distance"), diff("lufs", 1).alias("lufs_delta"),
        F.round(F.col("centroid") / F.greatest("a_centroid", F.lit(1e-6)), 2).alias("centroid_ratio"), diff("microtiming", 1).alias("microtiming_delta"), diff("harmonic", 2).alias("harmonic_delta"), F.array_intersect("a_tags", "tags").alias("shared"),
    )
