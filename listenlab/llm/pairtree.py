"""Byte-level BPE by a segment tree over the ranks of adjacent pairs.

A piece's bytes are linked in a chain. The leaf of a position holds the rank of the pair that its token forms with the
next one, together with the position; inner nodes hold the smaller of their two children, so the root is the leftmost
pair of the lowest rank. A merge changes three leaves at most, each in logarithmic time, and the work ends when the root
says that no pair is left to merge.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder
from .common import small_arrow_batches

#: Bits of a position; ranks stand above them.
PLACE = 36
PLACE_MASK = (1 << PLACE) - 1
#: No pair: above any rank.
NONE = 1 << 62


def byte_letters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else the next one from 256 on."""
    out, extra = {}, 256
    for b in range(256):
        seen = 33 <= b <= 126 or 161 <= b <= 172 or b >= 174
        out[b] = chr(b if seen else extra)
        extra += not seen
    return out


class Merges:
    """Ids of the single bytes, for each pair of ids its rank above a position's bits, and for each rank the id that its pair becomes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if spec.get("normalizer") or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("not a plain byte-level vocabulary")
        if model.get("dropout") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
            raise ValueError("a kind of merging that isn't known here")
        letters = byte_letters()
        back = {c: b for b, c in letters.items()}
        vocabulary = model["vocab"]
        self.bytes = [vocabulary[letters[b]] for b in range(256)]
        self.ranks: dict[int, dict[int, int]] = {}
        self.into: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            # of a pair that is listed twice the later rank holds
            self.ranks.setdefault(vocabulary[a], {})[vocabulary[b]] = rank << PLACE
            self.into.append(vocabulary[a + b])
        self.added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec.get("added_tokens", [])):
            raise ValueError("an added token that takes in what is beside it")
        tokens = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocabulary.items()}
        tokens |= {i: t.encode() for t, i in self.added.items()}
        # ids that there aren't stand for nothing
        self.tokens = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.decimals = list(map(str, range(max(tokens) + 1)))


class PairTree:
    """The pairs of a chain of tokens, and the tree of their ranks.

    Node i's children are 2 i and 2 i + 1; leaves begin at the number of pairs. Behind the last token stands a mark that
    no pair has.
    """

    def __init__(self, merges: Merges, tokens: list[int]):
        self.merges, self.token = merges, [*tokens, -1]
        n = len(tokens)
        self.next, self.before = list(range(1, n + 2)), list(range(-1, n))
        ranks, none = merges.ranks, _NO_RANKS
        leaves = [ranks.get(a, none).get(b, NONE) | i for i, (a, b) in enumerate(zip(tokens, tokens[1:]))] or [NONE]
        self.tree = tree = [NONE] * len(leaves) + leaves
        for i in range(len(leaves) - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b

    def best(self) -> int:
        """The position of the leftmost pair of the lowest rank, or -1."""
        top = self.tree[1]
        return -1 if top >= NONE else top & PLACE_MASK

    def merge(self) -> None:
        """Merges the pair at the root; the token behind it goes."""
        tree, token, after, before, ranks = self.tree, self.token, self.next, self.before, self.merges.ranks
        top, leaf = tree[1], len(tree) >> 1
        at = top & PLACE_MASK
        gone = after[at]
        token[gone] = -1
        token[at] = new = self.merges.into[top >> PLACE]
        to = after[at] = after[gone]
        before[to] = at
        left = before[at]
        # past the end and before the start there is nothing to change
        changed = [(at, ranks.get(new, _NO_RANKS).get(token[to], NONE) | at)]
        if gone < leaf:
            changed.append((gone, NONE))
        if left >= 0:
            changed.append((left, ranks.get(token[left], _NO_RANKS).get(new, NONE) | left))
        for i, value in changed:
            i += leaf
            tree[i] = value
            while i > 1:
                other = tree[i ^ 1]
                if other < value:
                    value = other
                i >>= 1
                if tree[i] == value:
                    break
                tree[i] = value

    def ids(self) -> list[int]:
        """Merges until the root holds no pair, and gives the tokens that are left."""
        while self.tree[1] < NONE:
            self.merge()
        return [t for t in self.token if t >= 0]


_NO_RANKS: dict[int, int] = {}


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker."""
    return Codec(path, pattern)


class Codec:
    """Ids of a text, and the text of ids."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.merges = Merges(path)
        self._chunks = ChunkEncoder(regex.compile(pattern).findall, self._piece).encode
        # of two that begin at one place the library takes the longer
        names = sorted(self.merges.added, key=len, reverse=True)
        self._split = re.compile("(" + "|".join(map(re.escape, names)) + ")").split if names else None

    def _piece(self, piece: str) -> list[int]:
        tokens = [self.merges.bytes[b] for b in piece.encode()]
        return PairTree(self.merges, tokens).ids() if len(tokens) > 1 else tokens

    def encode(self, text: str) -> list[int]:
        """Added tokens' strings are their ids; what stands between them is split and merged."""
        out = array("I")
        for k, part in enumerate(self._split(text) if self._split else [text]):
            if k % 2:
                out.append(self.merges.added[part])
            elif part:
                out.frombytes(self._chunks(part))
        return out.tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of all tokens' bytes; ids that there aren't are passed over, bytes that aren't UTF-8 become U+FFFD."""
        tokens = self.merges.tokens
        if max(ids, default=0) >= len(tokens):
            ids = [i for i in ids if i < len(tokens)]
        return b"".join(map(tokens.__getitem__, ids)).decode("utf-8", "replace")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each whole text encoded, and its ids decoded again.

    The ids' digest is that of their decimal forms joined by commas. Null and empty texts have no ids. Rows are kept as
    they are, null and repeated ids too; other columns are ignored. No shuffle; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        decimals = c.merges.decimals.__getitem__
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        for b in batches:
            n, ids, decoded = [], [], []
            for t in b.column(1).to_pylist():
                got = c.encode(t or "")
                n.append(len(got))
                ids.append(sha(",".join(map(decimals, got))))
                decoded.append(sha(c.decode(got)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids) of each whole text; a null or empty text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.encode(t or "") for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids); null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    small_arrow_batches(encoded.sparkSession)
    return encoded.select(encoded["doc_id"].cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
