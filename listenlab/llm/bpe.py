"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece's bytes there is exactly one token that can come last in the prefix's
encoding: the token whose own left neighbour, the last token of the shorter prefix, forms a valid
pair with it. A pair is valid if merging its bytes gives the pair back. Storing that last token for
each prefix lets bytes be appended without looking back, and lets an edit keep what is before it and
rejoin what is after it.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .chunks import ChunkEncoder
from .common import small_arrow_batches

#: Pairs whose validity, and first bytes whose table, a worker remembers.
PAIRS, HEADS = 400_000, 100_000
#: Bytes of a piece whose table is kept for other pieces that begin with them.
HEAD = 6


class Vocabulary:
    """Tokens and ranks of a file of lines "base64 rank"; every single byte is a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        self.longest = max(map(len, self.ids))
        self._after: list[dict[int, bool]] = [{} for _ in self.tokens]
        self._pairs = 0

    def merged(self, data: bytes) -> list[int]:
        """Plain merging, lowest rank first, leftmost first: the definition of the encoding."""
        rank, none = self.ids.get, 1 << 60
        parts = [data[i : i + 1] for i in range(len(data))]
        ranks = [rank(data[i : i + 2], none) for i in range(len(data) - 1)]
        while ranks and (low := min(ranks)) != none:
            i = ranks.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], none)
        return [self.ids[p] for p in parts]

    def valid(self, a: int, b: int) -> bool:
        """Whether tokens a and b stay as they are when they stand side by side."""
        got = self._after[a].get(b)
        if got is None:
            if self._pairs >= PAIRS:
                self._after, self._pairs = [{} for _ in self.tokens], 0
            got = self._after[a][b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
            self._pairs += 1
        return got

    def fill(self, data: bytes, last: list[int], end: int) -> None:
        """Appends to ``last``, the last tokens of the shorter prefixes of ``data``, those of the prefixes up to ``end``."""
        token, valid = self.ids.get, self.valid
        for to in range(len(last) + 1, end + 1):
            at = to - 1
            while (t := token(data[at:to])) is None or at and not (
                ok if (ok := self._after[before := last[at - 1]].get(t)) is not None else valid(before, t)
            ):
                at -= 1
            last.append(t)

    def back(self, last: list[int]) -> list[int]:
        """The encoding, read from the last token of the whole to that of its shortest prefix."""
        out, at, tokens = [], len(last), self.tokens
        while at:
            out.append(t := last[at - 1])
            at -= len(tokens[t])
        out.reverse()
        return out


class PrefixTable:
    """The last token of every prefix of some bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last = vocabulary, b"", []
        self.append(data)

    def append(self, data: bytes) -> None:
        """Adds bytes; what is stored for the prefixes so far stays as it is."""
        self.data += data
        self.vocabulary.fill(self.data, self.last, len(self.data))

    def edit(self, start: int, end: int, data: bytes) -> None:
        """Replaces bytes [start, end).

        Prefixes before the edit keep their tokens. Behind the new bytes, filling stops once the last
        tokens have agreed with the old ones over the length of the longest token, as nothing further
        on can look back beyond that.
        """
        old, shift = self.last, len(data) - (end - start)
        self.data, self.last = self.data[:start] + data + self.data[end:], old[:start]
        self.vocabulary.fill(self.data, self.last, start + len(data))
        agree = 0
        while len(self.last) < len(self.data):
            if agree >= self.vocabulary.longest:
                self.last += old[len(self.last) - shift :]
                return
            self.vocabulary.fill(self.data, self.last, len(self.last) + 1)
            agree = agree + 1 if self.last[-1] == old[len(self.last) - 1 - shift] else 0

    def ids(self) -> list[int]:
        return self.vocabulary.back(self.last)


@cache
def codec(path: str, pattern: str) -> Codec:
    """One codec for each vocabulary and worker."""
    return Codec(path, pattern)


class Codec:
    """Encodes texts into packed little-endian unsigned 32-bit ids and back."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.vocabulary = Vocabulary(path)
        self._heads: dict[bytes, list[int]] = {}
        self.encode = ChunkEncoder(regex.compile(pattern).findall, lambda piece: self._ids(piece.encode())).encode

    def _ids(self, data: bytes) -> list[int]:
        """Encodes a piece, going on from the stored table of its first HEAD bytes."""
        v = self.vocabulary
        if (one := v.ids.get(data)) is not None:
            return [one]
        head = data[:HEAD]
        known = self._heads.get(head)
        if known is None:
            if len(self._heads) >= HEADS:
                self._heads.clear()
            v.fill(head, known := [], len(head))
            self._heads[head] = known
        last = known.copy()
        v.fill(data, last, len(data))
        return v.back(last)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _texts(batch: pa.RecordBatch) -> list[str]:
    return ["" if t is None else t for t in batch.column(1).to_pylist()]


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each whole text, ids as little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Rows are kept as they are, repeated ones too; other columns are
    ignored. No shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            ids = [c.encode(t) for t in _texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, data) with the bytes that the ids of (doc_id, ids) stand for; null ids give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        for b in batches:
            data = [c.decode(i or b"") for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], ["doc_id", "data"])

    small_arrow_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            n, ids, decoded = [], [], []
            for t in _texts(b):
                packed = c.encode(t)
                n.append(len(packed) // 4)
                ids.append(sha(packed))
                decoded.append(sha(c.decode(packed)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
