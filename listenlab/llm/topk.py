"""Exact top-k search by inner product with a pivot-distance index.

Each vector is keyed by its nearest pivot and its distance to it; a pivot's vectors, in order of
distance, are cut into annuli of equal counts. For a query q and an annulus of pivot p, distances lo to
hi, the triangle inequality bounds the inner products with its vectors x:

    q.x = q.p + q.(x - p) <= q.p + |q| hi      and      |q - x| >= gap = max(lo - |q - p|, |q - p| - hi, 0),
    so that q.x = (|q|^2 + |x|^2 - |q - x|^2) / 2 <= (|q|^2 + max |x|^2 - gap^2) / 2.

A query visits annuli in falling order of the smaller bound, in rounds that grow; after each round its
k-th best score is higher, and it stops where the bounds fall below that.

Annuli and queries of neighbouring pivots travel together, in blocks and packs; a block's annuli are still
visited one by one, each by the queries whose bounds lead there, in one product of matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors from which pivots are chosen; pivots at most, and annuli of a pivot at most.
SAMPLE, PIVOTS, RINGS = 2000, 256, 256
#: Vectors of an annulus, about, until all pivots have RINGS; of a block, which takes in annuli or, of larger ones, a part; queries of a pack.
ANNULUS, BLOCK, PACK = 128, 4096, 1024
#: Queries whose best scores a task remembers.
MET = 50_000
#: After so many annuli of each query a round ends; the last round has no end.
ROUNDS = (4, 16, 64)
#: Stands for the k-th best score of a query that has met fewer.
NONE = -(1 << 63)


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) with v = floor(256 * x); vectors that are null, empty or hold a null or non-finite component are left out."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND size(e) > 0")
    return rows.where(F.forall("e", fine)).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("e", lambda x: F.floor(x * 256)).alias("v"))


def _matrix(rows: list, width: int) -> np.ndarray:
    """Rows of equal width; what a vector lacks counts as 0."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _unpacked(lists: pa.ListArray, width: int) -> np.ndarray:
    """An Arrow column of lists as rows of equal width; what a vector lacks counts as 0."""
    sizes = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy()
    return out


def _choose(x: np.ndarray, n: int) -> np.ndarray:
    """Pivots far from each other: always the vector farthest from those chosen."""
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < n and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0))


def _chain(pivots: np.ndarray) -> list[int]:
    """The pivots in an order in which each is followed by the nearest of those left."""
    order, left = [0], np.ones(len(pivots), bool)
    while len(order) < len(pivots):
        left[order[-1]] = False
        rest = np.flatnonzero(left)
        order.append(int(rest[((pivots[rest] - pivots[order[-1]]) ** 2).sum(1).argmin()]))
    return order


def _filled(counts: list[int], most: int) -> list[tuple[int, int]]:
    """(bin, parts) for counts in order: neighbours share a bin of ``most`` at most; a larger count has a bin for itself, in parts."""
    out, bin_, held = [], -1, most
    for n in counts:
        if held + n > most:
            bin_, held = bin_ + 1, 0
        held += n
        out.append((bin_, max(1, -(-n // most))))
    return out


def _ints(spark: SparkSession, names: str, rows: list[tuple]) -> DataFrame:
    """A small table of whole numbers; through Arrow, as rows would start Python workers."""
    return spark.createDataFrame(pa.table([pa.array(c, pa.int32()) for c in zip(*rows)], names.split()))


def _narrow(most: int) -> str:
    """The smallest integers that hold all components."""
    return "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"


def search(vectors: DataFrame, queries: str = "vec_id % 50 = 0", k: int = 5, report: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row that meets ``queries``.

    Scores are integer inner products; ties go to the smaller vec_id. Fewer rows than k give all. Each row
    counts by itself, also where a vec_id or a vector is repeated: only a query's own row is left out. What
    a shorter vector lacks counts as 0. Null ids are left out; other columns are ignored. ``report`` gets the
    number of annuli, of queries, and the share of all (query, annulus) pairs that was visited.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score long"
    table = written(integers(vectors).withColumn("row", F.monotonically_increasing_id()), "vectors")
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    n, width, longest, most = table.agg(F.count("*"), F.max(F.size("v")), F.max(norm), largest).first()
    if not n:
        return spark.createDataFrame([], schema)
    h = F.xxhash64("vec_id", "v")
    picked = table.where(F.pmod(h, F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * 1.5 * SAMPLE / n) + 1)).orderBy(h).limit(SAMPLE).select("v").collect()
    pivots = _choose(_matrix([r[0] for r in picked] or [table.first()["v"]], width), min(PIVOTS, max(1, int(math.sqrt(n) / 2))))
    # whole numbers below 2 ** 24 and 2 ** 52 are exact as floats, and no sum of products is above the largest square
    kind, packed = np.float32 if longest < 2**24 else np.float64 if longest < 2**52 else np.int64, _narrow(int(most))
    place = {p: i for i, p in enumerate(_chain(pivots))}

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for s in range(0, whole.num_rows, 2048):
                b = whole.slice(s, 2048)
                x = _unpacked(b.column(2), width)
                d = _distances(x, pivots)
                near = d.argmin(1)
                data = [r.tobytes() for r in x.astype(packed)]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near]), pa.array((x * x).sum(1)), pa.array(data, pa.binary())], ["vec_id", "row", "pivot", "dist", "norm", "data"]
                )

    keys = written(table.select("vec_id", "row", "v").mapInArrow(keyed, "vec_id long, row long, pivot int, dist double, norm double, data binary"), "keys")
    # cuts of equal counts: at most RINGS - 1 of each pivot
    at = [i / RINGS for i in range(1, RINGS)]
    cuts = {}
    for r in keys.groupBy("pivot").agg(F.count("*").alias("n"), F.percentile_approx("dist", at, 10_000).alias("cuts")).collect():
        step = max(1, RINGS // max(1, r["n"] // ANNULUS))
        cuts[r["pivot"]] = np.unique(np.array(r["cuts"][step - 1 :: step]))

    def placed_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, dist = b.column("pivot").to_numpy(), b.column("dist").to_numpy()
            ring = np.zeros(len(pivot), np.int32)
            for p in np.unique(pivot):
                mine = pivot == p
                ring[mine] = np.searchsorted(cuts[int(p)], dist[mine], "left")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot * RINGS + ring)], [*b.schema.names, "cell"])

    # annuli are told again where they are asked for, as a copy of all vectors costs more
    placed = lambda *names: (t := keys.select("pivot", "dist", *names)).mapInArrow(placed_in, f"{', '.join(f'{c} {d}' for c, d in t.dtypes)}, cell int")
    cells = placed("norm").groupBy("cell").agg(F.count("*"), F.min("dist"), F.max("dist"), F.max("norm")).collect()
    cells.sort(key=lambda c: (place[c[0] // RINGS], c[0]))
    count, low, high, square = (np.array([c[i] for c in cells], float) for i in (1, 2, 3, 4))
    home = np.array([c[0] for c in cells]) // RINGS
    # blocks of annuli that follow each other: the first annulus of each, and where the last one ends
    laid = _filled([c[1] for c in cells], BLOCK)
    edges = np.searchsorted([b for b, _ in laid], np.arange(laid[-1][0] + 2))
    slots = [(int(c[0]), int(b), int(i - edges[b]), int(edges[b + 1] - edges[b]), m) for i, (c, (b, m)) in enumerate(zip(cells, laid))]
    parts = _ints(spark, "cell block slot slots parts", slots)

    def blocked(t: pa.Table) -> pa.Table:
        """A block's vectors by annulus and vec_id, with the ends of its annuli."""
        ids, rows, slot = (t.column(name).to_numpy() for name in ("vec_id", "row", "slot"))
        order = np.lexsort((rows, ids, slot))
        ends = np.searchsorted(slot[order], np.arange(t.column("slots")[0].as_py()), "right")
        binary = lambda x: pa.array([x if isinstance(x, bytes) else x.astype(np.int64).tobytes()], pa.binary())
        data = b"".join(t.column("data").take(pa.array(order)).to_pylist())
        return pa.table({"block": t.column("block")[:1], "ids": binary(ids[order]), "rows": binary(rows[order]), "ends": binary(ends), "data": binary(data)})

    split = placed("vec_id", "row", "data").drop("pivot", "dist").join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("row"), F.col("parts"))).drop("parts")
    blocks = written(split.groupBy("block", "part").applyInArrow(blocked, "block int, ids binary, rows binary, ends binary, data binary"), "blocks")
    asked = keys.where(queries).select("pivot", "row", F.col("vec_id").alias("query_id"), "data")
    # queries of pivots that follow each other go together, PACK of them
    sizes = sorted(((r["pivot"], r["n"]) for r in asked.groupBy("pivot").agg(F.count("*").alias("n")).collect()), key=lambda r: place[r[0]])
    if not sizes:
        return spark.createDataFrame([], schema)
    many = _ints(spark, "pivot pack many", [(p, *x) for (p, _), x in zip(sizes, _filled([n for _, n in sizes], PACK))])
    asked = written(asked.join(F.broadcast(many), "pivot").withColumn("no", F.pmod(F.xxhash64("row"), F.col("many"))).drop("many", "pivot"), "queries")
    # packs are few bytes but much work, so they are dealt out by number
    tasks = min(-(-sum(m for _, m in sizes) // PACK), int(spark.conf.get("spark.sql.shuffle.partitions")))

    # what floats may lose of distances whose squares aren't whole numbers below 2 ** 53
    rough = 0.0 if longest < 2**51 else 1e-6 * math.sqrt(longest)

    def bounds(q: np.ndarray) -> np.ndarray:
        d = _distances(q, pivots)[:, home]
        size = (q * q).sum(1)[:, None]
        slack = 1e-6 * (1 + d) + rough
        gap = np.maximum(np.maximum(d - high, low - d) - slack, 0)
        least = np.minimum((q @ pivots.T)[:, home] + np.sqrt(size) * (high * (1 + 1e-9) + rough) + slack, (size + square - gap * gap) / 2)
        return least + 1e-9 * np.abs(least) + 1 + rough * rough

    def goes(first: int, last: int | None):
        """For a pack, a row for each block where some of its queries visit annuli in this round, with these queries."""

        def run(t: pa.Table) -> pa.Table:
            out = {"block": [], "pack": [], "no": [], "size": [], "visits": [], "q_at": [], "q_rows": [], "q_ids": [], "q_data": [], "taus": [], "went": []}
            rows, ids, data = t.column("row").to_numpy(), t.column("query_id").to_numpy(), t.column("data").to_pylist()
            tau = t.column("bound").to_numpy()
            go = np.zeros((len(rows), len(home)), bool)
            for s in range(0, len(rows), 32):
                e = min(s + 32, len(rows))
                bound = bounds(np.stack([np.frombuffer(x, packed) for x in data[s:e]]).astype(np.float64))
                turn = np.argsort(-bound, axis=1, kind="stable")[:, first:last]
                np.put_along_axis(go[s:e], turn, np.take_along_axis(bound, turn, 1) >= tau[s:e, None], 1)
            for b in np.unique(np.searchsorted(edges, np.flatnonzero(go.any(0)), "right") - 1):
                went = go[:, edges[b] : edges[b + 1]]
                who = np.flatnonzero(went.any(1))
                out["block"].append(int(b))
                out["pack"].append(t.column("pack")[0].as_py())
                out["no"].append(t.column("no")[0].as_py())
                out["size"].append(len(rows))
                out["visits"].append(int(went.sum()))
                out["q_at"].append(who.astype(np.int64).tobytes())
                out["q_rows"].append(rows[who].astype(np.int64).tobytes())
                out["q_ids"].append(ids[who].astype(np.int64).tobytes())
                out["q_data"].append(b"".join(data[i] for i in who))
                out["taus"].append(tau[who].astype(np.int64).tobytes())
                out["went"].append(np.packbits(went[who]).tobytes())
            return pa.table(out, schema=pa.schema([*((x, pa.int32()) for x in ("block", "pack", "no")), *((x, pa.int64()) for x in ("size", "visits")), *((x, pa.binary()) for x in ("q_at", "q_rows", "q_ids", "q_data", "taus", "went"))]))

        return run

    def looked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The k best of a block for each query that goes there, none below the query's bound or the k best that this task has met."""
        met: dict[tuple, np.ndarray] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {name: b.column(name)[i].as_py() for name in b.schema.names}
                ids, rows, ends, q_at, q_rows, q_ids, tau = (np.frombuffer(r[c], np.int64) for c in ("ids", "rows", "ends", "q_at", "q_rows", "q_ids", "taus"))
                x, q = (np.frombuffer(r[c], packed).reshape(-1, width).astype(kind) for c in ("data", "q_data"))
                went = np.unpackbits(np.frombuffer(r["went"], np.uint8), count=len(q) * len(ends)).reshape(len(q), -1)
                name = r["pack"], r["no"]
                if name not in met and sum(map(len, met.values())) + r["size"] > MET:
                    met.clear()
                best = met.setdefault(name, np.full((r["size"], k), NONE, kind))
                least = np.maximum(tau.astype(kind), best[q_at, -1])
                js, cs, ss = [], [], []
                for a, (start, end) in enumerate(zip((0, *ends[:-1]), ends)):
                    who = np.flatnonzero(went[:, a])
                    if not len(who) or start == end:
                        continue
                    s = q[who] @ x[start:end].T
                    fit = s >= least[who, None]
                    for y in np.flatnonzero(fit.sum(1) > 4 * (k + 1)):
                        # one more than k, as the query's own row may be among them; columns ascend by vec_id
                        c = np.flatnonzero(fit[y])
                        fit[y] = False
                        fit[y, c[np.argsort(-s[y, c], kind="stable")[: k + 1]]] = True
                    j, c = np.nonzero(fit)
                    js.append(who[j])
                    cs.append(c + start)
                    ss.append(s[j, c])
                if not js:
                    continue
                j, c, s = (np.concatenate(y) for y in (js, cs, ss))
                other = rows[c] != q_rows[j]
                j, c, s = j[other], c[other], s[other]
                order = np.lexsort((rows[c], ids[c], -s, j))
                j, c, s = j[order], c[order], s[order]
                rank = np.arange(len(j)) - np.searchsorted(j, j)
                j, c, s, rank = (y[rank < k] for y in (j, c, s, rank))
                if not len(j):
                    continue
                new = np.full((len(q), k), NONE, kind)
                new[j, rank] = s
                some = np.unique(j)
                best[q_at[some]] = np.sort(np.concatenate([best[q_at[some]], new[some]], axis=1), axis=1)[:, : -k - 1 : -1]
                yield pa.RecordBatch.from_arrays([pa.array(y.astype(np.int64)) for y in (q_rows[j], q_ids[j], ids[c], rows[c], s)], ["q_row", "query_id", "vec_id", "row", "score"])

    order = Window.partitionBy("q_row").orderBy(F.col("score").desc(), "vec_id", "row")
    best, visits = None, 0
    for first, last in zip((0, *ROUNDS), (*ROUNDS, None)):
        if first >= len(home):
            break
        known = asked if best is None else asked.join(best.where(F.col("rank") == k).select(F.col("q_row").alias("row"), F.col("score").alias("bound")), "row", "left")
        bound = known.withColumn("bound", F.lit(NONE) if best is None else F.coalesce("bound", F.lit(NONE)))
        trips = written(bound.repartition(tasks, "pack", "no").groupBy("pack", "no").applyInArrow(goes(first, last), "block int, pack int, no int, size long, visits long, q_at binary, q_rows binary, q_ids binary, q_data binary, taus binary, went binary"), "trips")
        visits += trips.agg(F.sum("visits")).first()[0] or 0
        # a row of blocks and queries is small, so Arrow's bound on the bytes of a batch holds
        found = trips.drop("visits").join(blocks, "block").mapInArrow(looked, "q_row long, query_id long, vec_id long, row long, score long")
        both = found if best is None else found.unionByName(best.drop("rank"))
        best = written(both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
    if report is not None:
        queried = asked.count()
        report.update(annuli=len(home), queries=queried, visited=visits / (queried * len(home)))
    return best.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH e AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id::BIGINT AS vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM e q JOIN e c ON q.rid <> c.rid WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
