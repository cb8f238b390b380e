"""The prefix trie, the Merkle manifest and the pair tree against brute force, DuckDB and the tokenizers library."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import duckdb
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from listenlab.llm import merkle, oracles, pairtree, trie
from listenlab.llm.scans import scanned

JSON = P.path("byte_bpe_50k.json")
CODEC = pairtree.codec(JSON, P.PATTERN)
LIBRARY = Tokenizer.from_file(JSON)


def sha(*x):
    return hashlib.sha256("".join(x).encode()).hexdigest()


# --- scans


def test_scans(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(40)}", i, rng.randrange(1000), rng.randrange(97)) for i in range(5000)]
    df = spark.createDataFrame(rows, "k string, i long, a long, m long").repartition(7)
    got = {r.i: (r.a, r.m) for r in scanned(df, "k", [F.col("i")], {"a": None, "m": 97}).collect()}
    sums = defaultdict(lambda: [0, 0])
    for k, i, a, m in rows:
        s = sums[k]
        s[0], s[1] = s[0] + a, (s[1] + m) % 97
        assert got[i] == tuple(s)
    assert scanned(df.limit(0), "k", [F.col("i")], {"a": None}).count() == 0


# --- prefix trie


def brute_trie(rows):
    conv = defaultdict(list)
    for c, t, r, x, *_ in rows:
        if c is not None:
            conv[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in conv.items()}
    paths = {}
    for c in turns:
        h, b = zlib.crc32(str(c).encode()) % 6, c - int(math.fmod(c, 100))
        paths[c] = tuple(turns.get(b, [])[:h] + turns[c][h:])
    members = defaultdict(list)
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members[paths[c][:d]].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    for k, m in members.items():
        for d in range(len(k) + 1):
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1]) if k else 0
            leaves[k[:d]] += children[k] == 0
    ends = {k: ",".join(str(c) for c in m if paths[c] == k) for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), children[k], leaves[k], saved[k], sha(ends[k])) for k, m in members.items())


def nodes(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def talks(spark):
    """Shared first turns, nulls and ties in every column, absent donors, one conversation of very many turns, empty and very long texts."""
    rng, rows = random.Random(3), []
    for c in [*range(40), *range(95, 130), 100_000_000_000, -7, 300]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 40])):
            rows.append((c, rng.choice([None, t, t, t]), rng.choice(["u", "a", None]), rng.choice(["x", "yy", "zzz", None, "", "long " * 3000]), 1, "k"))
    rows += [(None, 1, "u", "x", None, None), (200, None, None, None, None, None)] + [(7, 1, "u", "x", 1, "k")] * 3
    rows += [(9, i, "u", f"turn {i % 7}", 1, "k") for i in range(900)]
    rows += [(c, t, "u", "the same", 1, "k") for c in range(1000, 1100) for t in range(4)]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, d int, rep string").repartition(5)


def test_trie(talks):
    rows, df = talks
    assert nodes(trie.prefix_trie(df)) == brute_trie(rows)


def test_trie_collisions(talks):
    # numbers that most turns share, whatever they say
    rows, df = talks
    rows = [r for r in rows if r[0] is None or r[0] < 130 and r[0] != 9]
    few = df.where("conv_id is null or conv_id < 130 and conv_id <> 9")
    assert nodes(trie.prefix_trie(few, number=lambda role, text: F.char_length(text).cast("long") % 3)) == brute_trie(rows)


def test_trie_without_rows(talks):
    assert trie.prefix_trie(talks[1].limit(0)).count() == 0
    assert trie.prefix_trie(talks[1].where("conv_id is null")).count() == 0


def test_long_lists_of_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    rows = [(1, 2, c) for c in range(40)] + [(5, 0, 9), (1, 3, 7), (1, 3, 70)]
    got = {(r.rep, r.d): r.ends_sha256 for r in trie.ends_digests(spark.createDataFrame(rows, "rep long, d long, c long").repartition(4)).collect()}
    assert got == {(1, 2): sha(",".join(map(str, range(40)))), (5, 0): sha("9"), (1, 3): sha("7,70")}


def test_trie_oracle(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    con = duckdb.connect()
    con.sql("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert nodes(trie.prefix_trie(df)) == sorted(tuple(-1 if v is None else v for v in r) for r in con.sql(oracles.TRIE).fetchall())


# --- Merkle manifest


def brute_tree(leaves, run):
    levels = [leaves]
    while len(levels[-1]) > 1:
        x = levels[-1]
        levels.append([sha(*x[i : i + run]) for i in range(0, len(x), run)])
    return levels


def brute_proof(levels, i, run):
    out = []
    for x in levels[:-1]:
        a = i // run * run
        out.append((i % run, [y for j, y in enumerate(x[a : a + run], a) if j != i]))
        i //= run
    return out


def brute_manifest(rows, run=2):
    def digest(r, more=0):
        vals = (r.doc_id, r.source, r.lang, r.n_chars if r.n_chars is None else r.n_chars + more, r.text)
        return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in vals))

    groups = defaultdict(list)
    for r in rows:
        tried = digest(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0)
        groups[r.lang is not None, (r.lang or "").encode()].append(((r.doc_id is not None, r.doc_id or 0), digest(r), tried, r.doc_id))
    order = sorted(groups)
    trees = {k: brute_tree([x[1] for x in sorted(groups[k])], run) for k in order}
    top = brute_tree([trees[k][-1][0] for k in order], run)
    out = []
    for a, k in enumerate(order):
        for i, (_, leaf, x, doc_id) in enumerate(sorted(groups[k])):
            proof = brute_proof(trees[k], i, run) + brute_proof(top, a, run)
            for at, s in proof:
                x = sha(*s[:at], x, *s[at:])
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], sha(*[y for _, s in proof for y in s]), x, x == top[-1][0]))
    return sorted(out, key=str)


def check(df, run=2, levels=8):
    assert sorted(map(tuple, merkle.verified(df, run, levels).collect()), key=str) == brute_manifest(df.collect(), run)


def test_manifest(docs, none):
    check(docs)
    assert merkle.verified(none).count() == 0


@pytest.mark.parametrize("run, levels", [(2, 1), (2, 3), (3, 2), (5, 8)])
def test_shapes(spark, run, levels):
    # one group of a third of all rows, groups of one row, rows alike, and a null lang
    rows = [(i, f"t{i}", None if i % 9 == 0 else "en" if i % 3 else f"l{i % 20}", "s", i) for i in range(150)] + [(4, "t", "en", "s", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(6)
    check(df, run, levels)
    m = merkle.manifest(df, run, levels)
    got = {(r.grp, r.level, r.pos): r.digest for r in m.groups.nodes().collect()}
    leaves = [r.digest for r in m.proofs().where("grp = '=en'").orderBy("pos").collect()]
    for level, x in enumerate(brute_tree(leaves, run)):
        assert [got["=en", level, i] for i in range(len(x))] == x
    assert ("=en", level + 1, 0) not in got


def test_manifest_oracle(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert sorted(map(tuple, merkle.verified(df).collect())) == sorted(con.sql(oracles.MERKLE).fetchall())


# --- pair tree


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,the ing123ÄßéZ  "), st.characters(codec="utf-8")), max_size=60))
def test_texts(text):
    ids = CODEC.encode(text)
    assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
    assert CODEC.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abtheing ", min_size=2, max_size=400))
def test_trees(text):
    """At every step the root is the leftmost pair of the lowest rank."""
    m = CODEC.merges
    tree, plain = pairtree.PairTree(m, [m.bytes[b] for b in text.encode()]), [m.bytes[b] for b in text.encode()]
    while (at := tree.best()) >= 0:
        rank, i = min((m.ranks[a][b], i) for i, (a, b) in enumerate(zip(plain, plain[1:])) if b in m.ranks.get(a, {}))
        plain[i : i + 2] = [m.into[rank >> pairtree.PLACE]]
        tree.merge()
        assert [t for t in tree.token if t >= 0] == plain
    assert not any(b in m.ranks.get(a, {}) for a, b in zip(plain, plain[1:]))


def test_long_pieces():
    for text in ("a" * 20_001, "abcdefgh" * 3000, "é日" * 4000, "-" * 9999, "ing" * 1):
        assert CODEC.encode(text) == LIBRARY.encode(text, add_special_tokens=False).ids


def test_added_tokens_and_odd_ids():
    for text in ("a<|endoftext|>b", "<|endoftext|>", " x  <|endoftext|> y <|endoftext|><|endoftext|>\n", "<|endoftext |>", "  \n\n<|endoftext|>  "):
        ids = CODEC.encode(text)
        assert ids == LIBRARY.encode(text, add_special_tokens=False).ids
        assert CODEC.decode(ids) == text == LIBRARY.decode(ids, skip_special_tokens=False)
    rng = random.Random(5)
    for _ in range(300):
        ids = [rng.randrange(50_300) for _ in range(rng.randrange(12))]
        assert CODEC.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_pair_tree_rows(docs, none):
    got = sorted(map(tuple, pairtree.round_trip(docs, JSON, P.PATTERN).collect()), key=str)
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(LIBRARY.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want, key=str)
    assert pairtree.round_trip(none, JSON, P.PATTERN).count() == 0
    both = pairtree.decode(pairtree.encode(docs, JSON, P.PATTERN), JSON, P.PATTERN)
    assert sorted(r.text for r in both.collect()) == sorted(r.text or "" for r in docs.collect())
