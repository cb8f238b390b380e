"""A Merkle manifest of a dataset: digests of rows, trees of a group's digests, proofs.

Built bottom-up: consecutive nodes of a group become their parent's digest, until one is left. A row of a persisted
table holds several levels of a stretch of nodes, and its topmost digest is a node of the next table. Proofs are
pushed top-down: tables of children join the tables of their parents, and each child puts its own siblings before the
proof that its parent has handed down. Groups of any size are spread over as many rows as they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, let, written
from .scans import scanned

#: Children of a node; levels of a stretch held by one row of a table.
RUN, LEVELS = 2, 8
#: Group of the tree over the groups' own roots.
ALL = "all"


def field(value: Column) -> Column:
    """``-`` for a null, else the bytes' count, a colon, and the value; so no two rows of values look alike."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*values: Column) -> Column:
    """The digest of a row of values."""
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def group_key(value: Column) -> Column:
    """A name of a group that is never null and keeps the order of the values' bytes, null first."""
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.lit("="), value.cast("string")))


def _parents(nodes: Column, run: int) -> Column:
    count = F.ceil(F.size(nodes) / run).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.sha2(F.array_join(F.slice(nodes, i * run + 1, F.lit(run)), ""), 256))


def _levels(nodes: Column, n: Column, run: int, most: int) -> Column:
    """The levels above some nodes, themselves first: ``most`` of them, or up to the root if the stretch is its whole group."""

    def up(levels: Column, _: Column) -> Column:
        top = F.element_at(levels, -1)
        done = (n <= run**most) & (F.size(top) == 1)
        return F.when(done, levels).otherwise(F.concat(levels, F.array(_parents(top, run))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), F.array(nodes), up)


def _proofs(levels: Column, at: Column, above: Column, run: int) -> Column:
    """What folds node ``at`` of a stretch up to the root: for each level its place in its run and the run's others."""

    def step(level: Column, k: Column) -> Column:
        place = F.floor(at / F.pow(F.lit(float(run)), k)).cast("int")
        first = place - place % run
        others = F.concat(F.slice(level, first + 1, place % run), F.slice(level, place + 2, F.lit(run - 1) - place % run))
        return F.struct((place % run).alias("at"), others.alias("siblings"))

    own = F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), step)
    return F.concat(own, above)


def folded(node: Column, proof: Column) -> Column:
    """The root that a node and its proof lead to."""
    return F.aggregate(
        proof, node, lambda x, p: F.sha2(F.concat(F.array_join(F.slice(p["siblings"], F.lit(1), p["at"]), ""), x, F.array_join(F.slice(p["siblings"], p["at"] + 1, F.size(p["siblings"])), "")), 256)
    )


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's to the root's children's, each run's from left to right."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda p: p["siblings"])), ""), 256)


class Tree:
    """The persisted tables of the trees over rows (grp, pos, digest, ...), bottom first.

    A row of a table is a stretch of a group: (grp, block, n, levels, kept), where n is how many nodes the group has at
    the stretch's lowest level and kept holds the other columns of its lowest nodes.
    """

    def __init__(self, nodes: DataFrame, run: int = RUN, levels: int = LEVELS):
        if run < 2 or levels < 1:
            raise ValueError("a node has two children at least, and a table one level")
        self.run, self.width, self.tables = run, run**levels, []
        self.extra = [c for c in nodes.columns if c not in ("grp", "pos", "digest")]
        # a stretch is at most `width` rows, so no group is ever in one place
        sizes = nodes.groupBy("grp").agg(F.count("*").alias("n"))
        rows = nodes.groupBy("grp", F.floor(F.col("pos") / self.width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", *self.extra))).alias("kept"))
        rows = rows.join(few(written(sizes, "sizes")), "grp")
        while True:
            digests = F.transform("kept", lambda x: x["digest"])
            table = written(rows.select("grp", "block", "n", let(digests, lambda d: _levels(d, F.col("n"), run, levels)).alias("levels"), "kept"), "merkle")
            self.tables.append(table)
            if table.where(F.col("n") > self.width).isEmpty():
                break
            tops = table.where(F.col("n") > self.width).select("grp", F.col("block").alias("pos"), F.ceil(F.col("n") / self.width).alias("n"), F.element_at(F.element_at("levels", -1), 1).alias("digest"))
            rows = tops.groupBy("grp", F.floor(F.col("pos") / self.width).alias("block")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest"))).alias("kept"), F.first("n").alias("n"))

    def roots(self) -> DataFrame:
        """(grp, root) of each group."""
        each = [t.where(F.col("n") <= self.width).select("grp", F.element_at(F.element_at("levels", -1), 1).alias("root")) for t in self.tables]
        out = each[0]
        for x in each[1:]:
            out = out.unionByName(x)
        return out

    def nodes(self) -> DataFrame:
        """(grp, level, pos, digest) of every node, level 0 being the leaves; roots stand on their group's topmost level."""
        out, base = None, 0
        for k, t in enumerate(self.tables):
            each = t.select("grp", "block", F.posexplode("levels").alias("l", "digests")).where((F.col("l") > 0) | F.lit(k == 0))
            each = each.select("grp", "block", "l", F.posexplode("digests").alias("i", "digest"))
            wide = F.pow(F.lit(float(self.run)), F.col("l"))
            each = each.select("grp", (F.col("l") + base).cast("int").alias("level"), (F.floor(F.lit(self.width) / wide) * F.col("block") + F.col("i")).cast("long").alias("pos"), "digest")
            out = each if out is None else out.unionByName(each)
            base += _log(self.width, self.run)
        return out

    def proofs(self, above: DataFrame | None = None) -> DataFrame:
        """(grp, pos, digest, proof, ...) of every lowest node; ``above`` (grp, proof, ...), a written table, goes on from the groups' roots, and its other columns come along."""
        none = F.array().cast("array<struct<at:int,siblings:array<string>>>")
        parents = None
        for table in reversed(self.tables):
            whole = table.where(F.col("n") <= self.width)
            if above is None:
                rows = whole.withColumn("_above", none)
            else:
                rows = whole.join(above.select("grp", F.col("proof").alias("_above")), "grp")
            if parents is not None:
                down = parents.select("grp", F.col("pos").alias("block"), F.col("proof").alias("_above"))
                rows = rows.unionByName(table.where(F.col("n") > self.width).join(down, ["grp", "block"]))
            lowest = table is self.tables[0]
            told = [c for c in above.columns if c not in ("grp", "proof")] if lowest and above is not None else []
            if told:
                rows = rows.join(few(above.select("grp", *told)), "grp")
            each = rows.select("grp", *told, "levels", "_above", F.posexplode("kept").alias("_i", "_x"))
            parents = each.select("grp", F.col("_x.pos").alias("pos"), F.col("_x.digest").alias("digest"), _proofs(F.col("levels"), F.col("_i"), F.col("_above"), self.run).alias("proof"), *told, *[F.col(f"_x.{c}").alias(c) for c in self.extra if lowest])
            if not lowest:
                parents = written(parents, "proofs")
        return parents


def _log(n: int, base: int) -> int:
    k = 0
    while n > 1:
        n, k = n // base, k + 1
    return k


class Manifest:
    """Trees over the rows of each group, and one over their roots in the groups' order."""

    def __init__(self, leaves: DataFrame, order: list[str], run: int = RUN, levels: int = LEVELS):
        """``leaves``: (grp, digest, ...); ``grp`` as made by `group_key`, nodes of a group in the order of the columns named, then of their digests."""
        nodes = scanned(leaves.withColumn("pos", F.lit(1).cast("long")), "grp", [F.col(c).asc_nulls_first() for c in (*order, "digest")], {"pos": None})
        self.groups = Tree(nodes.withColumn("pos", F.col("pos") - 1), run, levels)
        roots = self.groups.roots().select(F.lit(ALL).alias("grp"), F.lit(1).cast("long").alias("pos"), F.col("root").alias("digest"), F.col("grp").alias("group"))
        self.top = Tree(scanned(roots, "grp", [F.col("group")], {"pos": None}).withColumn("pos", F.col("pos") - 1), run, levels)

    def proofs(self) -> DataFrame:
        """(grp, pos, digest, subroot, root, proof, ...) of every leaf."""
        # the one root of all is a single row
        subroots = self.top.proofs().join(F.broadcast(self.top.roots()), "grp")
        return self.groups.proofs(written(subroots.select(F.col("group").alias("grp"), F.col("digest").alias("subroot"), "root", "proof"), "subroots"))


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def tampered() -> Column:
    """Whether a document's manifest is tried with a changed row."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))


def manifest(docs: DataFrame, run: int = RUN, levels: int = LEVELS) -> Manifest:
    """The manifest of ``documents``, grouped by lang; ``tried`` is the leaf that a document would have after tampering.

    Leaves of one lang ascend by doc_id, null ids first, rows of one id by their digests; so repeated rows are leaves
    of their own. Null langs are a group before the others. Columns other than the five of the leaf are ignored.
    """
    c = {x: F.col(x) for x in COLUMNS}
    other = leaf(*[F.col(x) + 1 if x == "n_chars" else F.col(x) for x in COLUMNS])
    leaves = docs.select(*COLUMNS).select(group_key(c["lang"]).alias("grp"), c["doc_id"].cast("long").alias("doc_id"), leaf(*c.values()).alias("digest"), F.when(tampered(), other).alias("tried"))
    return Manifest(leaves.withColumn("tried", F.coalesce("tried", "digest")), ["doc_id"], run, levels)


def verified(docs: DataFrame, run: int = RUN, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) of each row of ``documents``.

    Null and empty texts are leaves like others, and texts of any length are hashed whole. An empty table gives no rows.
    """
    rows = manifest(docs, run, levels).proofs()
    rows = rows.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.col("tried"), F.col("proof")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
