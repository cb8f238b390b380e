"""Exact Jaccard join of shingle sets by universe partitioning and the pigeonhole principle.

Texts of equal sets are one node. Sizes fall into bands so wide that linked sets lie in one band or in
neighbouring ones. For the sets that meet in a band, the universe of shingles is hashed into m
segments; linked sets differ in at most h shingles, so with m + u > h, where u of the segments are
also indexed with all their one-deletion neighbours, they agree in some segment, or differ by one
deletion in one of the u. m and u are those of least cost: rows to deal out, and tiny segments that
many sets share by chance. A few segments more than needed are made, so that a set may leave out its
empty segments and those that very many sets share; only sets that would have to leave out too many
stay in such a bucket.

Buckets tie nodes into groups. Within a bucket, only nodes are tied whose counts of shingles by hash
class leave room for a link; such counts never rule out a true one. A bucket gives a spanning forest
of its ties, fewer rows than it has nodes. Groups are then verified exactly on their whole sets, large
ones in pairs of slices of the same or neighbouring size bands.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, shingle_hashes, small_arrow_batches, written
from .components import components

#: Nodes in a bucket above which sets that can do without it leave it.
HOT = 64
#: Nodes and shingles of a group that are verified in one step; larger groups are cut into slices of about that many.
SLICE, SLICE_TOKENS = 512, 150_000
#: Price of a segment with at most one shingle, in rows.
TINY = 3
#: Bytes up to which a table of candidates is broadcast; beyond, an ordinary join.
BROADCAST_BYTES = 32 << 20
#: Sets that a task remembers so as to send copies once; rows of a sketch cell from which its buckets count as possibly very common.
SEEN, COMMON = 500_000, 20_000
#: Cells of the sketch that finds very common buckets.
CELLS = 1 << 16


@dataclass(frozen=True)
class Rule:
    """Sets of ``shingle`` words link if 100 * intersection >= percent * union."""

    shingle: int = 3
    percent: int = 90

    def links(self, both: np.ndarray, total: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (total - both)


@cache
def bands(percent: int) -> np.ndarray:
    """Smallest size of each band: a set linked to one in band b is in b - 1, b or b + 1."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // percent)))
    return np.array(out, np.int64)


@cache
def plan(percent: int, band: int) -> tuple[int, int]:
    """(m, u) for the sets that meet in a band; (0, 0) if linked ones are equal there."""
    top = int(bands(percent)[band + 1]) - 1
    h = top * (100 - percent) // percent
    if not h:
        return 0, 0
    best = None
    size = (int(bands(percent)[band]) + top) / 2
    u = 0
    while True:
        m = h + 3 - u
        for _ in range(3):  # room for the segments expected to be empty
            empty = m * math.exp(-size / m) if m > 0 else 0
            m = h + 1 + 2 + math.ceil(empty + 2 * math.sqrt(empty)) - u
        if m < max(u, 1):
            break
        z = size / m
        cost = m + u * z + TINY * m * math.exp(-z) * (1 + z)
        if best is None or cost < best[0]:
            best = cost, m, u
        elif u > 8 and cost > 1.5 * best[0]:
            break
        u = u + 1 if u < 8 else u + u // 4
    return best[1:]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _name(sums: np.ndarray, counts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Signature of a segment from the sum of its shingles' hashes, their number, and which segment it is."""
    return _mix(_mix(sums + counts.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ places)


def signatures(nodes: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, node, tag) rows of some sets, given one behind the other.

    tag = 8 * slack + 2 * weight + lower: how many segments the set may still leave out (-1: too many
    are left out already), how many this row stands for, and whether it is for the band below the set's own.
    """
    start = bands(percent)
    band = np.searchsorted(start, sizes, "right") - 1
    which, low = [], []
    for lower in (0, 1):
        b = band - lower
        ok = (sizes > 0) & (b >= 0)
        if lower:  # a linked set in the band below is at least percent of this one
            ok &= 100 * (start[np.maximum(band, 0)] - 1) >= percent * sizes
        ok[ok] = [plan(percent, int(x))[0] > 0 for x in b[ok]]
        which.append(np.flatnonzero(ok))
        low.append(np.full(len(which[-1]), lower))
    doc, lower = np.concatenate(which), np.concatenate(low)
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = band[doc] - lower
    mu = np.array([plan(percent, int(x)) for x in space], np.int64)
    m, u = mu[:, 0], mu[:, 1]
    n = sizes[doc]
    # the most shingles in which this set can differ from one that it meets there
    most = np.where(lower == 0, n * (100 - percent) // percent, (n + start[space + 1] - 1) * (100 - percent) // (100 + percent))
    first = np.cumsum(m) - m
    total = int(m.sum())
    owner = np.repeat(np.arange(len(doc)), m)
    place = np.arange(total) - first[owner]
    deep = place < u[owner]
    # tokens of every (set, band) pair
    token_start = np.cumsum(sizes) - sizes
    pair = np.repeat(np.arange(len(doc)), n)
    at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + token_start[doc][pair]
    value = _mix(tokens[at].view(np.uint64) + np.uint64(0x632BE59BD9B4E019))
    segment = first[pair] + ((_mix(value) >> np.uint64(20)) % m[pair].astype(np.uint64)).astype(np.int64)
    sums, counts = np.zeros(total, np.uint64), np.bincount(segment, minlength=total)
    np.add.at(sums, segment, value)
    places = _mix(space[owner].astype(np.uint64) * np.uint64(1 << 32) + place.astype(np.uint64) + np.uint64(1))
    # what can't be used: empty segments, and in the u, the empty neighbours of single shingles
    lost = np.bincount(owner, np.where(counts == 0, 1 + deep, (counts == 1) & deep), minlength=len(doc)).astype(np.int64)
    slack = np.maximum(m + u - (most + 1) - lost, -1)
    short = slack[owner] < 0
    kept = np.flatnonzero((counts > 0) | short)
    weight = 1 + deep.astype(np.int64)
    sig = [_name(sums[kept], counts[kept], places[kept])]
    own, tag = [owner[kept]], [weight[kept]]
    cut = np.flatnonzero(deep[segment])
    s = segment[cut]
    keep = (counts[s] > 1) | short[s]
    cut, s = cut[keep], s[keep]
    sig.append(_name(sums[s] - value[cut], counts[s] - 1, places[s]))
    own.append(owner[s])
    tag.append(np.ones(len(s), np.int64))
    o, w = np.concatenate(own), np.concatenate(tag)
    return np.concatenate(sig).view(np.int64), nodes[doc[o]], 8 * slack[o] + 2 * w + lower[o]


def sets(docs: DataFrame, rule: Rule, *keep: str) -> DataFrame:
    """(doc_id, n, node, tokens) and the columns to keep; node is a hash of the whole set, null if it is empty."""
    t = docs.select("doc_id", *keep, shingle_hashes(F.col("text"), rule.shingle).alias("tokens"))
    return t.select("doc_id", *keep, F.size("tokens").cast("long").alias("n"), _node(F.col("tokens")).alias("node"), "tokens")


def _node(tokens: Column) -> Column:
    both = F.aggregate(tokens, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.xxhash64(x)))
    return F.when(F.size(tokens) > 0, F.xxhash64(both, F.size(tokens)))


def _width(n: np.ndarray) -> np.ndarray:
    """Hash classes that a set of n shingles is counted by: a power of two from n / 8 on, 8 at least."""
    return 1 << np.ceil(np.log2(np.maximum(n / 8, 8))).astype(np.int64)


def class_counts(sizes: np.ndarray, tokens: np.ndarray) -> list[bytes]:
    """For each set, how many of its shingles fall into each hash class, one byte a class, 255 at most."""
    width = _width(sizes)
    first = np.cumsum(width) - width
    owner = np.repeat(np.arange(len(sizes)), sizes)
    h = _mix(tokens.view(np.uint64) ^ np.uint64(0xD6E8FEB86659FD93)).astype(np.int64) & (width[owner] - 1)
    counts = np.minimum(np.bincount(first[owner] + h, minlength=int(width.sum())), 255).astype(np.uint8)
    data = counts.tobytes()
    return [data[s : s + w] for s, w in zip(first.tolist(), width.tolist(), strict=True)]


def _apart(a: bytes, b: bytes) -> int:
    """At least so many shingles are in one set only. Counts of the longer list are folded to the shorter one's classes."""
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    w = min(len(x), len(y))
    if len(x) != len(y) and max(x.max(), y.max()) == 255:
        return 0  # a folded count would be too low
    return int(np.abs(x.reshape(-1, w).sum(0) - y.reshape(-1, w).sum(0)).sum())


def _members(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, n, node, th, counts) of every document; th: a hash of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(4)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(class_counts(sizes, lists.flatten().to_numpy()), pa.binary())], ["doc_id", "n", "node", "th", "counts"])

    small_arrow_batches(docs.sparkSession)
    t = sets(docs.withColumn("th", F.xxhash64("text")), rule, "th").select(F.col("doc_id").cast("long").alias("doc_id"), "n", "node", "th", "tokens")
    return t.mapInArrow(run, "doc_id long, n long, node long, th long, counts binary")


def _buckets(docs: DataFrame, rule: Rule) -> DataFrame:
    """(sig, node, tag, size): rows of the buckets that more than one node share, bucket by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            nodes = b.column(0).fill_null(0).to_numpy()
            # copies that a task met lately are sent once; empty sets not at all
            if len(seen) > SEEN:
                seen.clear()
            index = np.flatnonzero([n > 0 and x not in seen and not seen.add(x) for x, n in zip(nodes.tolist(), sizes.tolist(), strict=True)])
            if not len(index):
                continue
            lists = lists.take(pa.array(index))
            sig, node, tag = signatures(nodes[index], sizes[index], lists.flatten().to_numpy(), rule.percent)
            for s in range(0, len(sig), 200_000):
                e = s + 200_000
                yield pa.RecordBatch.from_arrays([pa.array(sig[s:e]), pa.array(node[s:e]), pa.array(tag[s:e])], ["sig", "node", "tag"])

    small_arrow_batches(docs.sparkSession)
    rows = written(sets(docs, rule).select("node", "tokens").mapInArrow(run, "sig long, node long, tag long"), "signatures")
    # a bucket of very many rows is never sorted in one task: cells of a sketch tell which buckets can be that large
    cell = F.pmod("sig", F.lit(CELLS)).cast("int")
    sketch = rows.groupBy(cell.alias("cell")).agg(F.count("*").alias("rows"))
    full = [r["cell"] for r in sketch.where(F.col("rows") > F.greatest(F.lit(COMMON), F.lit(8 * rows.count() // CELLS))).select("cell").collect()]
    by = Window.partitionBy("sig")

    def shared(some: DataFrame) -> DataFrame:
        once = some.withColumn("before", F.lag("node").over(by.orderBy("node"))).where("before IS NULL OR before <> node").drop("before")
        return once.withColumn("size", F.count("*").over(by)).where("size > 1")

    if not full:
        return shared(rows)
    marks = docs.sparkSession.createDataFrame([(c,) for c in full], "full int")
    common = rows.join(F.broadcast(marks), cell == F.col("full"), "left_semi").groupBy("sig", "node").agg(F.min("tag").alias("tag"))
    sizes = written(common.groupBy(F.col("sig").alias("of")).agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    hot = common.join(_hint(sizes), F.col("sig") == F.col("of")).select("sig", "node", "tag", "size")
    return shared(rows.join(F.broadcast(marks), cell == F.col("full"), "left_anti")).unionByName(hot)


def _tied(cool: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that span, within buckets of at most HOT nodes, what pairs whose counts leave room for a link tie together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[int, int], bool] = {}
        told: set[tuple[int, int]] = set()

        def edges(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int]] = []
            _ties(rows, rule, known, told, out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

        rest: list[tuple] = []
        for b in batches:
            rows = rest + list(zip(*(c.to_pylist() for c in b.columns), strict=True))
            cut = len(rows)
            while cut and rows[cut - 1][0] == rows[-1][0]:
                cut -= 1
            rest = rows[cut:]
            yield from edges(rows[:cut])
        yield from edges(rest)

    spark = cool.sparkSession
    small_arrow_batches(spark)
    side = nodes.select(F.col("node").alias("of"), "n", "counts")
    j = cool.select("sig", "node").join(_hint(side), F.col("node") == F.col("of")).select("sig", "node", "n", "counts")
    return j.repartition("sig").sortWithinPartitions("sig").mapInArrow(run, "a long, b long")


def _ties(rows: list[tuple], rule: Rule, known: dict, told: set, out: list) -> None:
    """Of rows (sig, node, n, counts), bucket by bucket, a spanning forest of the pairs that may link: at most a row for each node.

    ``known`` has what was found of pairs met lately, ``told`` the edges given lately.
    """
    start = 0
    while start < len(rows):
        end = start + 1
        while end < len(rows) and rows[end][0] == rows[start][0]:
            end += 1
        group = sorted(rows[start:end], key=lambda r: r[1])
        start = end
        root = list(range(len(group)))
        for i, (_, x, n, c) in enumerate(group):
            for j in range(i):
                if root[i] == root[j]:
                    continue
                _, y, k, d = group[j]
                may = known.get((y, x))
                if may is None:
                    if len(known) > 50_000:
                        known.clear()
                    may = 100 * min(n, k) >= rule.percent * max(n, k) and _apart(c, d) * (100 + rule.percent) <= (n + k) * (100 - rule.percent)
                    known[y, x] = may
                if may:  # at most HOT nodes, so roots are kept up for all of them
                    low, high = sorted((root[i], root[j]))
                    root = [low if r == high else r for r in root]
        for i, r in enumerate(root):
            edge = (group[r][1], group[i][1])
            if r != i and edge not in told:
                if len(told) > 50_000:
                    told.clear()
                told.add(edge)
                out.append(edge)


def _candidates(buckets: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Edges (a, b) that tie together the nodes of each bucket that need it; in hot buckets by stars, never by pairs."""
    cool = _tied(buckets.where(F.col("size") <= HOT), nodes, rule)
    hot = buckets.where(F.col("size") > HOT)
    lower, weight, slack = F.pmod("tag", F.lit(2)), F.floor(F.pmod("tag", F.lit(8)) / 2), F.floor(F.col("tag") / 8)
    # sets that can't leave all their hot buckets
    bound = (
        hot.groupBy("node", lower.alias("lower")).agg(F.sum(weight).alias("lost"), F.min(slack).alias("slack")).where("lost > slack")
        .select(F.col("node").alias("n"), F.col("lower").alias("l"))
    )
    bound = written(bound, "bound")
    stay = hot.join(_hint(bound), (F.col("node") == F.col("n")) & (lower == F.col("l"))).select("sig", "node")
    stay = written(stay, "hot")
    centers = written(stay.groupBy("sig").agg(F.min("node").alias("a")), "centers")
    warm = stay.join(_hint(centers), "sig").select("a", F.col("node").alias("b"))
    return cool.unionByName(warm).where("a <> b").distinct()


def _hint(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if its values take few bytes."""
    size = F.lit(16)
    for name, kind in df.dtypes:
        size = size + (F.coalesce(F.octet_length(name), F.lit(0)) if kind in ("binary", "string") else F.lit(8))
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= BROADCAST_BYTES else df


def _verify(table: pa.Table, rule: Rule) -> pa.Table:
    """Of one group's rows: each linked node, the smallest node it is tied to here, and its number of links here."""
    roots, ends, counts = [], [], []
    blob = table.column("blob").to_numpy()
    node, slice_ = table.column("node").to_numpy(), table.column("slice").to_numpy()
    cross = table.column("cross").to_numpy(zero_copy_only=False)
    lists = table.column("tokens").combine_chunks()
    offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    for one in np.split(order := np.argsort(blob, kind="stable"), np.flatnonzero(np.diff(blob[order])) + 1):
        _, first = np.unique(node[one], return_index=True)
        rows = one[first]
        k = len(rows)
        if k < 2:
            continue
        sizes = (offsets[rows + 1] - offsets[rows]).astype(np.int64)
        tokens = np.concatenate([flat[offsets[r] : offsets[r + 1]] for r in rows])
        owner = np.repeat(np.arange(k), sizes)
        _, name, often = np.unique(tokens, return_inverse=True, return_counts=True)
        shared = often[name] > 1
        name, owner = np.unique(name[shared], return_inverse=True)[1], owner[shared]
        both, width = np.zeros((k, k)), int(name.max(initial=-1)) + 1
        by = np.argsort(name, kind="stable")
        name, owner = name[by], owner[by]
        for s in range(0, width, 4096):
            lo, hi = np.searchsorted(name, [s, s + 4096])
            m = np.zeros((k, min(4096, width - s)), np.float32)
            m[owner[lo:hi], name[lo:hi] - s] = 1
            both += m @ m.T
        links = rule.links(both.round().astype(np.int64), sizes[:, None] + sizes[None])
        np.fill_diagonal(links, False)
        if cross[rows[0]]:
            links &= slice_[rows][:, None] != slice_[rows][None]
        label, number = np.arange(k), links.sum(1)
        while True:
            low = np.minimum(label, np.where(links, label[None], k).min(1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        hit = np.flatnonzero(number)
        roots.append(node[rows][label[hit]])
        ends.append(node[rows][hit])
        counts.append(number[hit])
    pick = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64())
    return pa.table({"a": pick(roots), "b": pick(ends), "links": pick(counts)})


def joined(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links, node) of every document; node is null for an empty set.

    n_shingles: size of its set; component_id: the smallest doc_id reachable by links, its own included;
    n_links: linked sets other than its own. Equal sets are linked. A null text, or one without words, has
    an empty set and no links. Repeated rows are kept; documents of null id take part, but lend no id to a
    component that has another. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    members = written(_members(docs, rule), "members")
    pick = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("pick")
    nodes = members.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("counts").alias("counts"), pick)
    nodes = written(nodes.select("node", "rep", "copies", "n", "counts", "pick.th"), "nodes")
    edges = written(_candidates(written(_buckets(docs, rule), "buckets"), nodes, rule), "candidates")
    blobs = components(edges)
    roots = edges.select(F.col("a").alias("node")).join(blobs, "node", "left_anti").distinct().withColumn("root", F.col("node"))
    blobs = written(blobs.unionByName(roots).select("node", F.col("root").alias("blob")), "blobs")
    place = blobs.join(nodes.select("node", "rep", "th", F.col("n").alias("size")), "node")
    edge = F.lit(",".join(str(x) for x in bands(rule.percent).tolist()))
    place = written(place.withColumn("band", F.size(F.filter(F.split(edge, ",").cast("array<bigint>"), lambda x: x <= F.col("size"))).cast("int")), "place")
    whole = place.groupBy("blob").agg(F.count("*").alias("nodes"), F.sum("size").alias("tokens")).where((F.col("nodes") > SLICE) | (F.col("tokens") > 4 * SLICE_TOKENS))
    whole = written(whole.where("nodes > 1").select(F.col("blob").alias("large")), "large")
    packs = max(1, (place.agg(F.sum("size")).first()[0] or 0) // (2 * SLICE_TOKENS))
    # large groups: slices by size band; a band's sets meet their own band's and the neighbouring ones'
    band = place.join(_hint(whole), F.col("blob") == F.col("large"), "left_semi").groupBy("blob", "band").agg(F.count("*").alias("nodes"), F.sum("size").alias("tokens"))
    band = written(band.select("blob", "band", F.ceil(F.greatest(F.col("nodes") / SLICE, F.col("tokens") / SLICE_TOKENS)).cast("int").alias("slices")), "bands")
    near = lambda step, name: band.select("blob", (F.col("band") - step).alias("band"), F.col("slices").alias(name))
    band = band.join(near(1, "above"), ["blob", "band"], "left").join(near(-1, "below"), ["blob", "band"], "left").fillna(0, ["above", "below"])
    band = written(band.select(F.col("blob").alias("large"), F.col("band").alias("at"), "slices", "above", "below"), "slices")
    place = written(place.join(_hint(band), (F.col("blob") == F.col("large")) & (F.col("band") == F.col("at")), "left").drop("large", "at", "size"), "placed")
    # of each node's documents one, whose whole text gives the set again
    chosen = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(_hint(place), F.col("id").eqNullSafe(F.col("rep")) & F.xxhash64("text").eqNullSafe(F.col("th")))
    full = chosen.select("node", "blob", "band", "slices", "above", "below", shingle_hashes(F.col("text"), rule.shingle).alias("tokens"))
    full = full.withColumn("slice", F.pmod(F.xxhash64("node"), F.coalesce("slices", F.lit(1))).cast("int"))

    def meets(count: str, step: int) -> Column:
        """Pairs of slices, the lower band first, in which a set meets those of its band + step."""
        mine = lambda: (F.col("band"), F.col("slice"))
        each = F.when(F.col(count) > 0, F.sequence(F.lit(0), F.col(count) - 1)).otherwise(F.array().cast("array<int>"))
        if not step:
            return F.transform(each, lambda o: F.xxhash64("blob", "band", F.least("slice", o), "band", F.greatest("slice", o)))
        other = F.col("band") + step
        return F.transform(each, lambda o: F.xxhash64("blob", *((*mine(), other, o) if step > 0 else (other, o, *mine()))))

    alone = F.array(F.xxhash64(F.pmod(F.xxhash64("blob"), F.lit(packs))))
    keys = F.when(F.col("slices").isNull(), alone).otherwise(F.concat(meets("slices", 0), meets("above", 1), meets("below", -1)))
    dealt = full.withColumn("key", F.explode(keys))
    # in a key of two slices only sets of different slices are compared; the key of a slice with itself is its own
    own = F.xxhash64("blob", "band", "slice", "band", "slice")
    dealt = dealt.select("key", "blob", F.xxhash64("band", "slice").alias("slice"), (F.col("slices").isNotNull() & (F.col("key") != own)).alias("cross"), "node", "tokens")
    links = written(dealt.groupBy("key").applyInArrow(lambda t: _verify(t, rule), "a long, b long, links long"), "links")
    classes = components(links.select("a", "b"))
    number = links.groupBy(F.col("b").alias("node")).agg(F.sum("links").alias("n_links"))
    # nodes whose documents don't simply keep their own id
    tied = written(nodes.join(classes, "node", "left").withColumn("root", F.coalesce("root", "node")), "tied")
    least = written(tied.groupBy("root").agg(F.min("rep").alias("least"), F.sum("copies").alias("docs")).where("docs > 1"), "least")
    final = tied.join(least, "root").join(number, "node", "left").select(F.col("node").alias("of"), "least", "n_links")
    final = written(final, "final")
    return members.join(_hint(final), F.col("node") == F.col("of"), "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "node"
    )


def representatives(docs: DataFrame, rule: Rule) -> DataFrame:
    """The documents that stay if one of each component does: the one whose id is its component's; columns as they are.

    Documents with an empty set all stay, as do those of null id in a component without any id. Of
    repeated rows with equal sets one stays.
    """
    kept = written(joined(docs, rule).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_id"), F.col("node").alias("_set")), "kept")
    keys = written(kept.groupBy("_id", "_set").agg(F.count("*").alias("_rows")), "keys")
    rows = docs.withColumn("_node", _node(shingle_hashes(F.col("text"), rule.shingle)))
    rows = rows.join(keys, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("_node").eqNullSafe(F.col("_set"))).drop("_id", "_set")
    again = (F.col("_rows") > 1) & F.col("_node").isNotNull()
    once = rows.where(~again).drop("_rows", "_node")
    if keys.where("_rows > 1 AND _set IS NOT NULL").isEmpty():
        return once
    return once.unionByName(rows.where(again).dropDuplicates(["doc_id", "_node"]).drop("_rows", "_node"))
