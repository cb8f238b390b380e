"""A trie of the prefixes of conversations.

Every turn is a number, and every prefix the polynomial of its turns' numbers modulo two primes, summed up by numpy
scans over range partitions. Prefixes of one length and fingerprint are a candidate group, and its smallest
conversation stands for it. The last turns of all members are compared with the representative's by grouping on whole
texts; if they and their numbers agree in all groups, so do all prefixes, from the first turn on. Where texts differ,
those unlike the representative's get other numbers, and the groups are formed anew.

A conversation is the smallest member of all nodes from some depth on: its own branch, which hangs on a node of the one
that represents the depth before. Sums over subtrees add up branches at each node that their conversation passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches, written
from .scans import scanned

#: Two primes below 2 ** 31, and the bases of the polynomials.
PRIMES, BASES = (2147483647, 2147483629), (1092341723, 741276533)
#: Keys of more rows than this share of all are joined by themselves; there are fewer of them than its inverse.
HOT = 1 / 1000
#: Ids of one piece of a node's list of ends.
PIECE = 8192


def turn_number(role: Column, text: Column) -> Column:
    return F.xxhash64(role, text)


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text) with turns numbered from 0 in each conversation.

    By turn, null first; turns of one number by role, then text; repeated rows are turns of their own. A null role or
    text is empty. Rows without a conv_id belong to no conversation.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1).cast("long").alias("pos")
    )
    small_arrow_batches(rows.sparkSession)
    # the first characters are enough to deal out a turn's ties; they are sorted by whole texts
    order = [F.col("turn").asc_nulls_first(), F.substring("role", 1, 20), F.substring("text", 1, 100)]
    return scanned(rows, "conv_id", order, {"pos": None}, then=["role", "text"]).select("conv_id", (F.col("pos") - 1).alias("pos"), "role", "text")


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its hundred."""
    return (F.crc32(conv_id.cast("string")) % 6).cast("int")


def rebuilt(turns: DataFrame, number: Callable[[Column, Column], Column] = turn_number) -> DataFrame:
    """(c, d, src, pos, v, n): the turns of every rebuilt conversation, d from 1; a row of depth 0 for each, which has no turn.

    ``src`` and ``pos`` tell where a turn's text stands, ``v`` is its number, ``n`` its code points.
    """
    short = turns.select("conv_id", "pos", number(F.col("role"), F.col("text")).alias("v"), F.char_length("text").cast("long").alias("n"))
    short = written(short, "turns")
    convs = short.where("pos = 0").select(F.col("conv_id").alias("c"), shared_turns(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("src"))
    # five turns at most of each donor
    heads = short.where("pos < 5 and conv_id % 100 = 0").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "v", "n"))).alias("head")).withColumnRenamed("conv_id", "src")
    given = written(convs.where("h > 0").join(heads, "src", "left").withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos:bigint,v:bigint,n:bigint>>")), F.lit(1), F.col("h"))), "heads")
    gaps = given.where(F.size("head") < F.col("h")).select("c", (F.col("h") - F.size("head")).alias("gap"))
    own = short.withColumnRenamed("conv_id", "c").where(F.col("pos") >= shared_turns(F.col("c"))).join(gaps, "c", "left")
    own = own.select("c", (F.col("pos") + 1 - F.coalesce("gap", F.lit(0))).alias("d"), F.col("c").alias("src"), "pos", "v", "n")
    taken = given.select("c", "src", F.explode("head").alias("t")).select("c", (F.col("t.pos") + 1).alias("d"), "src", "t.pos", "t.v", "t.n")
    zero = F.lit(0).cast("long")
    roots = convs.select("c", zero.alias("d"), F.col("c").alias("src"), F.lit(-1).cast("long").alias("pos"), zero.alias("v"), zero.alias("n"))
    return roots.unionByName(own).unionByName(taken)


def _powers(base: int, to: np.ndarray, prime: int) -> np.ndarray:
    out, b, e = np.ones(len(to), np.int64), base, to.astype(np.int64)
    while e.any():
        out = np.where(e & 1, out * b % prime, out)
        b, e = b * b % prime, e >> 1
    return out


def fingerprinted(rows: DataFrame) -> DataFrame:
    """Adds ``fp``, the fingerprint of the turns of a conversation up to a row, to (c, d, v, ...)."""
    names = ["_f0", "_f1"]

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d, v = (b.column(k).to_numpy(zero_copy_only=False) for k in ("d", "v"))
            of = [(v ^ (v >> 32) * k) % p * _powers(base, d, p) % p for k, (base, p) in enumerate(zip(BASES, PRIMES, strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns, *map(pa.array, of)], [*b.schema.names, *names])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    each = rows.mapInArrow(terms, kinds + "".join(f", {n} long" for n in names))
    return scanned(each, "c", [F.col("d")], dict(zip(names, PRIMES, strict=True))).withColumn("fp", F.col("_f0") * (1 << 31) + F.col("_f1")).drop(*names)


def _told(rows: DataFrame, groups: DataFrame, keys: list[str], total: int, size: str) -> DataFrame:
    """``rows`` with the columns of their group; groups of very many rows, which are few, are joined apart."""
    most = int(total * HOT) + 1
    hot = F.broadcast(groups.where(F.col(size) > most).withColumn("_hot", F.lit(True)))
    some = rows.join(hot, keys, "left")
    rest = some.where("_hot is null").select(*rows.columns).join(groups.where(F.col(size) <= most), keys)
    return some.where("_hot").drop("_hot").unionByName(rest)


def _unlike(members: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members' last turns with their texts, and the classes (d, fp, role, text, v) that aren't the representative's."""
    each = members.groupBy("d", "fp", "src", "pos", "v").agg(F.max(F.col("c") == F.col("rep")).alias("first"))
    each = each.join(turns.withColumnRenamed("conv_id", "src"), ["src", "pos"])
    kinds = each.groupBy("d", "fp", "role", "text", "v").agg(F.max("first").alias("first"))
    return each, written(kinds.where("not first").drop("first"), "unlike")


def grouped(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(c, d, src, pos, v, n, rep, n_convs): for each prefix the smallest conversation that has it too, and how many do."""
    k = 0
    while True:
        marked = fingerprinted(rows)
        sizes = written(marked.groupBy("d", "fp").agg(F.min("c").alias("rep"), F.count("*").alias("n_convs")), "groups")
        members = written(_told(marked, sizes, ["d", "fp"], marked.count(), "n_convs"), "members")
        shared, wrong = _unlike(members.where("n_convs > 1 and d > 0"), turns)
        if wrong.isEmpty():
            return members.drop("fp")
        # the same text and number in one group is the same change for all
        other = F.xxhash64(F.lit(k), "v", F.sha2(F.concat("role", F.lit("\0"), "text"), 256))
        changed = shared.join(wrong, ["d", "fp", "role", "text", "v"]).select("d", "fp", "src", "pos", "v", other.alias("_other"))
        rows = members.join(changed, ["d", "fp", "src", "pos", "v"], "left").select("c", "d", "src", "pos", F.coalesce("_other", "v").alias("v"), "n")
        rows, k = written(rows, "rows"), k + 1


def ends_digests(ends: DataFrame) -> DataFrame:
    """(rep, d, ends_sha256): the digest of the ascending ids c of (rep, d, c), joined by commas.

    Ids come in range partitions, as pieces of text; a node's pieces are hashed one after another, none is put together.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, held = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"rep": node[0], "d": node[1], "first": held[0], "ids": ",".join(map(str, held))}], schema=pa.schema([("rep", pa.int64()), ("d", pa.int64()), ("first", pa.int64()), ("ids", pa.string())]))

        for b in batches:
            for rep, d, c in zip(*(b.column(k).to_pylist() for k in ("rep", "d", "c")), strict=True):
                if held and ((rep, d) != node or len(held) >= PIECE):
                    yield out()
                    held = []
                node = (rep, d)
                held.append(c)
        if held:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, done = None, None, []
        for b in batches:
            for rep, d, ids in zip(*(b.column(k).to_pylist() for k in ("rep", "d", "ids")), strict=True):
                if (rep, d) != node:
                    if sha:
                        done.append((*node, sha.hexdigest()))
                    node, sha = (rep, d), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _rows(done)
            done = []
        if sha:
            yield _rows([(*node, sha.hexdigest())])

    # nodes where one conversation ends need no list
    per = ends.groupBy("rep", "d").agg(F.count("*").alias("n"), F.min("c").alias("c"))
    one = per.where("n = 1").select("rep", "d", F.sha2(F.col("c").cast("string"), 256).alias("ends_sha256"))
    many = ends.join(per.where("n > 1").select("rep", "d"), ["rep", "d"], "left_semi")
    text = many.repartitionByRange("rep", "d", "c").sortWithinPartitions("rep", "d", "c").mapInArrow(pieces, "rep long, d long, first long, ids string")
    return one.unionByName(text.repartition("rep", "d").sortWithinPartitions("rep", "d", "first").mapInArrow(digests, "rep long, d long, ends_sha256 string"))


def _rows(done: list[tuple]) -> pa.RecordBatch:
    rep, d, sha = zip(*done) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(d, pa.int64()), pa.array(sha, pa.string())], ["rep", "d", "ends_sha256"])


def prefix_trie(conversations: DataFrame, number: Callable[[Column, Column], Column] = turn_number) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    A node is named by its smallest member and its depth. A conversation without turns, once rebuilt, ends at the root.
    An empty table has no nodes, not even a root. Other columns are ignored; repeated rows are repeated turns.
    """
    turns = written(ordered(conversations), "ordered")
    rows = grouped(rebuilt(turns, number), turns)
    own = F.col("c") == F.col("rep")
    worth = (F.col("n_convs") - 1) * F.col("n")
    before = F.when(~own, F.struct("d", "rep"))  # the deepest of these is where the branch hangs
    branch = rows.groupBy("c").agg(F.max("d").alias("len"), F.max_by("rep", "d").alias("end"), F.max(before).alias("on"), F.sum(F.when(own, worth).otherwise(0)).alias("worth"))
    branch = written(branch.select("c", "len", "end", F.col("on.rep").alias("on_rep"), F.col("on.d").alias("on_d"), "worth"), "branches")
    # a conversation whose every prefix is another's has no branch
    hung = branch.where((F.col("end") == F.col("c")) & F.col("on_rep").isNotNull()).groupBy(F.col("on_rep").alias("rep"), F.col("on_d").alias("d")).agg(F.count("*").alias("hung"))
    hung = written(hung, "hung")
    tips = hung.select(F.col("rep").alias("c"), F.col("d").alias("len"), F.lit(True).alias("_more"))
    branch = branch.join(tips, ["c", "len"], "left").withColumn("tip", ((F.col("end") == F.col("c")) & F.col("_more").isNull()).cast("long")).drop("_more")
    branch = written(branch, "tips")

    passing = rows.where(~own).select("c", "rep", "d").join(branch.where("worth <> 0 or tip <> 0").select("c", "worth", "tip"), "c")
    digests = ends_digests(branch.select(F.col("end").alias("rep"), F.col("len").alias("d"), "c"))
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("string")
    sums = passing.select("rep", "d", "worth", "tip", zero.alias("hung"), none.alias("ends_sha256"))
    sums = sums.unionByName(hung.select("rep", "d", zero.alias("worth"), zero.alias("tip"), "hung", none.alias("ends_sha256")))
    sums = sums.unionByName(digests.select("rep", "d", zero.alias("worth"), zero.alias("tip"), zero.alias("hung"), "ends_sha256"))
    sums = sums.groupBy("rep", "d").agg(F.sum("worth").alias("others"), F.sum("tip").alias("tips"), F.sum("hung").alias("hung"), F.max("ends_sha256").alias("ends_sha256"))

    nodes = rows.where(own).select("c", "d", "n_convs", worth.alias("own"), worth.alias("so_far"))
    nodes = scanned(nodes, "c", [F.col("d")], {"so_far": None}).join(branch, "c")
    nodes = nodes.join(sums.withColumnRenamed("rep", "c"), ["c", "d"], "left")
    parent = F.when(F.col("d") == 0, None).when(F.col("d") - 1 == F.col("on_d"), F.col("on_rep")).otherwise(F.col("c"))
    return nodes.select(
        F.col("c").alias("conv_id"),
        F.col("d").alias("depth"),
        parent.alias("parent_conv_id"),
        "n_convs",
        (F.coalesce("hung", F.lit(0)) + (F.col("d") < F.col("len")).cast("long")).alias("n_children"),
        (F.coalesce("tips", F.lit(0)) + F.col("tip")).alias("n_leaves"),
        (F.coalesce("others", F.lit(0)) + F.col("worth") - F.col("so_far") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )
