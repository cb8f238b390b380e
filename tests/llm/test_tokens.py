"""BPE against the reference libraries, and token files read back."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from listenlab.llm import bpe, tokenstore

RANKS = P.path("byte_bpe_50k.tiktoken")
CODEC = bpe.codec(RANKS, P.PATTERN)
PLAIN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'.,the ing123ÄßéZ  "), st.characters(codec="utf-8")), max_size=60))
def test_texts(text):
    packed = CODEC.encode(text)
    assert np.frombuffer(packed, "<u4").tolist() == PLAIN.encode_ordinary(text)
    assert CODEC.decode(packed) == text.encode()


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=40), st.integers(0, 40), st.integers(0, 10), st.binary(max_size=10))
def test_prefix_tables(data, at, gone, new):
    v = CODEC.vocabulary
    t = bpe.PrefixTable(v, data)
    assert t.ids() == v.merged(data)
    t.append(new)
    assert t.ids() == v.merged(data + new)
    at = min(at, len(t.data))
    t.edit(at, min(at + gone, len(t.data)), new)
    assert t.last == bpe.PrefixTable(v, t.data).last and t.ids() == v.merged(t.data)


def test_long_edit():
    v = CODEC.vocabulary
    t = bpe.PrefixTable(v, b"the water and the river " * 80)
    t.edit(50, 53, b"lake side")
    assert t.ids() == v.merged(t.data)


def test_round_trip(docs, none):
    got = {(r.doc_id, r.n_tokens): r for r in bpe.round_trip(docs, RANKS, P.PATTERN).collect()}
    for r in docs.collect():
        ids = PLAIN.encode_ordinary(r.text or "")
        g = got[r.doc_id, len(ids)]
        assert g.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.round_trip(none, RANKS, P.PATTERN).count() == 0
    both = bpe.decode(bpe.encode(docs, RANKS, P.PATTERN), RANKS, P.PATTERN)
    assert sorted(bytes(r.data) for r in both.collect()) == sorted((r.text or "").encode() for r in docs.collect())


def test_token_files(spark, docs, none, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    tokenstore.write(docs, P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "a"))
    got = sorted(tokenstore.read(spark, str(tmp_path / "a")).collect(), key=lambda r: r.start)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id))
    at = 0
    for r, g in zip(rows, got, strict=True):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 2]
        assert (g.doc_id, g.start, g.n_tokens) == (r.doc_id, at, len(ids))
        assert g.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and np.frombuffer(g.ids, "<u4").tolist() == ids
        at += len(ids)
    tokenstore.write(none, P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "b"))
    assert tokenstore.read(spark, str(tmp_path / "b")).count() == 0


def test_added_tokens(spark, tmp_path):
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " x  <|endoftext|> y <|endoftext|><|endoftext|>\n", "<|endoftext |>", "no end"]
    tokenstore.write(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / "a"))
    got = {r.doc_id: np.frombuffer(r.ids, "<u4").tolist() for r in tokenstore.read(spark, str(tmp_path / "a")).collect()}
    assert got == {i: [*t.encode(x, add_special_tokens=False).ids, 2] for i, x in enumerate(texts)}
    assert got[0] == [64, 50256, 65, 2]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), min_size=1, max_size=60), st.integers(6, 12))
def test_code_lengths(counts, most):
    lengths = tokenstore.code_lengths(np.array(counts), most)
    used = lengths[lengths > 0]
    assert (lengths > 0).sum() == np.count_nonzero(counts) and used.max(initial=0) <= most
    if len(used) > 1:
        assert (2.0**-used).sum() == 1


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=1, max_size=1200))
def test_bits(ids):
    x = np.array(ids)
    lengths = tokenstore.code_lengths(np.bincount(x))
    bits, offsets = tokenstore.pack_bits(x, lengths, tokenstore.canonical(lengths))
    assert (tokenstore.Decoder(lengths).read(bits, offsets, len(x)) == x).all()


def test_chunks_are_the_librarys():
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encode = tokenstore._encoder(P.path("byte_bpe_50k.json"), P.PATTERN)
    rng = random.Random(1)
    parts = ["a", "word", " ", "\n", "\t", "\r", "é", "1", "23", ".", ",", "'s", "'", "日本", "\u00a0", "\x0b", "😀", "!?", "-", "X", "ʰ", "²", "\x00"]
    for _ in range(20_000):
        text = "".join(rng.choices(parts, weights=[3, 6, 8, 6, *[1] * (len(parts) - 4)], k=rng.randint(0, 14)))
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_order_of_one_id(spark, tmp_path):
    rows = [(1, f"text {i % 5}") for i in range(40)] + [(0, "zero"), (2, None)]
    starts = []
    for k, df in enumerate((rows, rows[::-1])):
        tokenstore.write(spark.createDataFrame(df, "doc_id long, text string").repartition(5), P.path("byte_bpe_50k.json"), P.PATTERN, str(tmp_path / str(k)))
        starts.append(sorted(map(tuple, tokenstore.read(spark, str(tmp_path / str(k)), ids=False).collect())))
    assert starts[0] == starts[1]
