"""Token ids in files of canonical length-limited Huffman codes.

Texts are dealt into ranges of ascending doc_id and encoded once; the ids go to a first table with
each range's counts. From the counts of all ids come code lengths of at most LONGEST bits, and from
these the canonical codes. Each row of the files is a block of whole documents: ids and lengths of
its documents, where it starts in its range, the code bits, and the bit offset of every STRIDE-th
id, at which a reader can start. Blocks are read independently, by table look-up, all stretches
between offsets of a block at once.
"""

from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import ChunkEncoder
from .common import shared_dir, small_arrow_batches

#: Bits of the longest code; ids between two offsets; ids after which a block ends with its document.
LONGEST, STRIDE, BLOCK = 20, 128, 131_072
END = 2

IDS = "part int, seq long, start long, doc_ids array<bigint>, lens array<bigint>, n long, ids binary, counts binary"
BLOCKS = "part int, seq long, start long, doc_ids array<bigint>, lens array<bigint>, n long, bits binary, offsets array<bigint>"


def _byte_letters() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can be seen, else one behind the first 256."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in seen]
    return {b: b for b in seen} | {b: 256 + i for i, b in enumerate(rest)}


@cache
def _encoder(path: str, pattern: str) -> Callable[[str], bytes]:
    """Packed ids of a text. Pieces are split here, once each, and encoded by the library's model; texts with added tokens by the library as a whole."""
    import regex
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    run, letters = t.model.tokenize, _byte_letters()
    space = chr(letters[32])
    # the model is the tokenizer's own; t keeps it alive

    def ids(piece: str, t: Tokenizer = t) -> list[int]:
        # ASCII characters that can be seen stand for themselves
        plain = piece.replace(" ", space) if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(letters)
        return [x.id for x in run(plain)]

    chunks = ChunkEncoder(regex.compile(pattern).findall, ids).encode
    added = [x.content for x in t.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if any(x in text for x in added):
            return array("I", t.encode(text, add_special_tokens=False).ids).tobytes()
        return chunks(text)

    return encode


def tokenized(docs: DataFrame, path: str, pattern: str, end: int = END) -> DataFrame:
    """Blocks of ids, by range of doc_id, each range's blocks in order; its counts in a row with seq -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path, pattern)
        part, schema = TaskContext.get().partitionId(), _schema(IDS)
        counts, total, seq, stop = np.zeros(0, np.int64), 0, 0, np.array([end], "<u4").tobytes()
        docs_, lens, held, n = [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal counts, total, seq, docs_, lens, held, n
            ids = np.frombuffer(b"".join(held), "<u4")
            more = np.bincount(ids)
            if len(more) > len(counts):
                counts = np.pad(counts, (0, len(more) - len(counts)))
            counts[: len(more)] += more
            out = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "start": total, "doc_ids": docs_, "lens": lens, "n": n, "ids": _narrow(ids), "counts": None}], schema)
            total, seq, docs_, lens, held, n = total + n, seq + 1, [], [], [], 0
            return out

        for b in batches:
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for i, packed in zip(b.column(0).to_pylist(), map(encode, texts), strict=True):
                packed += stop
                docs_.append(i)
                lens.append(len(packed) // 4)
                held.append(packed)
                n += lens[-1]
                if n >= BLOCK:
                    yield block()
        if n:
            yield block()
        if total:
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pylist([{"part": part, "seq": -1, "start": 0, "doc_ids": [], "lens": [], "n": 0, "ids": None, "counts": np.stack([at, counts[at]]).astype("<i8").tobytes()}], schema)

    spark = docs.sparkSession
    small_arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows of one id lie in one range; a hash of the text orders them
    rows = docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64("text").alias("th")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "th")
    return rows.select("doc_id", "text").mapInArrow(run, IDS)


def _few(batches: Iterator[pa.RecordBatch], rows: int = 16) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as each is a whole block."""
    for b in batches:
        for s in range(0, b.num_rows, rows):
            yield b.slice(s, rows)


def _narrow(ids: np.ndarray) -> bytes:
    """Two bytes an id if that is enough; the first byte tells the width."""
    wide = 2 if not len(ids) or ids.max() < 65_536 else 4
    return bytes([wide]) + ids.astype(f"<u{wide}").tobytes()


def _wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.strip().split(" ") for x in ddl.split(", "))])


def code_lengths(counts: np.ndarray, most: int = LONGEST) -> np.ndarray:
    """Lengths of the optimal prefix codes of at most ``most`` bits, by package-merge; 0 for a count of 0."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids need codes of more than {most} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    coins = counts[used].astype(np.float64)
    row, kinds = coins, []
    for _ in range(most):
        kinds.append(is_coin := np.ones(len(row), bool) if not kinds else merged_kind)
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([coins, pairs])
        order = np.argsort(both, kind="stable")
        row, merged_kind = both[order], order < len(coins)
    take, lengths = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for is_coin in reversed(kinds):
        k = int(is_coin[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[used] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        most = int(lengths.max())
        step = 1 << (most - lengths[order])
        codes[order] = (np.cumsum(step) - step) >> (most - lengths[order])
    return codes


def pack_bits(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The codes of some ids, one after another, first bit highest, and the bit offset of every STRIDE-th."""
    size = lengths[ids]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ids) else 0
    at = ends - size
    # each code lies in the 64 bits that start at its 32-bit word
    shifted = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    word = at >> 5
    first = np.flatnonzero(np.diff(word, prepend=-1))
    sums = np.add.reduceat(shifted, first) if len(ids) else np.zeros(0, np.uint64)
    words = np.zeros(total // 32 + 3, np.uint64)
    w = word[first]
    words[w] += sums >> np.uint64(32)
    words[w + 1] += sums & np.uint64(0xFFFFFFFF)
    return words.astype(">u4").tobytes(), at[::STRIDE]


class Decoder:
    """Look-up table of all LONGEST-bit prefixes."""

    def __init__(self, lengths: np.ndarray):
        self.most = max(1, int(lengths.max(initial=0)))
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        each = 1 << (self.most - lengths[order])
        self.ids, self.sizes = np.zeros(1 << self.most, np.int32), np.ones(1 << self.most, np.int8)
        n = int(each.sum())
        self.ids[:n], self.sizes[:n] = np.repeat(order, each), np.repeat(lengths[order], each)

    def read(self, bits: bytes, offsets: np.ndarray, n: int) -> np.ndarray:
        """The n ids of a block; its stretches are read side by side."""
        words = np.frombuffer(bits, ">u4").astype(np.uint64)
        at, out = offsets.astype(np.int64).copy(), np.zeros((STRIDE, len(offsets)), np.int32)
        for k in range(min(STRIDE, n)):
            lanes = slice(None) if k < (n - 1) % STRIDE + 1 else slice(0, len(at) - 1)  # the last stretch may be short
            a = at[lanes]
            if not len(a):
                break
            w = a >> 5
            window = (words[w] << np.uint64(32)) | words[w + 1]
            top = ((window << (a & 31).astype(np.uint64)) >> np.uint64(64 - self.most)).astype(np.int64)
            out[k, lanes] = self.ids[top]
            at[lanes] = a + self.sizes[top]
        return out.T.reshape(-1)[:n].astype(np.uint32)


def write(docs: DataFrame, path: str, pattern: str, to: str, end: int = END) -> None:
    """Writes the ids of all whole texts to ``to``: its folder ``codes`` has the lengths, ``blocks`` the ids.

    A null or empty text is the end id alone. Null ids come first; repeated rows are kept, rows of one
    id in order of a hash of their text. More than 2 ** LONGEST distinct ids raise an error.
    """
    spark = docs.sparkSession
    first = f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    tokenized(docs, path, pattern, end).write.option("compression", "zstd").parquet(first)
    rows = spark.read.schema(IDS).parquet(first)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for c in b.column(0).to_pylist():
                pairs = np.frombuffer(c, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["id", "n"])

    counts = rows.where("seq = -1").select("counts").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    size = int(counts["id"].max()) + 1 if len(counts) else 1
    all_ = np.zeros(size, np.int64)
    all_[counts["id"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    lengths = code_lengths(all_)
    at = np.flatnonzero(lengths)
    spark.createDataFrame(list(zip(at.tolist(), lengths[at].tolist())), "id long, length int").coalesce(1).write.parquet(f"{to}/codes")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, schema = canonical(lengths), _schema(BLOCKS)
        for b in _few(batches):
            bits, offsets = [], []
            for data in b.column("ids").to_pylist():
                x, y = pack_bits(_wide(data), lengths, codes)
                bits.append(x)
                offsets.append(y)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in ("part", "seq", "start", "doc_ids", "lens", "n")), pa.array(bits, pa.binary()), pa.array(offsets, pa.list_(pa.int64()))], schema=schema)

    small_arrow_batches(spark)
    rows.where("seq >= 0").drop("counts").mapInArrow(coded, BLOCKS).write.option("compression", "none").parquet(f"{to}/blocks")


def read(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of every document in the files at ``path``, from the files alone; on demand without the last."""
    codes = spark.read.schema("id long, length int").parquet(f"{path}/codes").toPandas()
    lengths = np.zeros(int(codes["id"].max()) + 1 if len(codes) else 1, np.int64)
    lengths[codes["id"].to_numpy(np.int64)] = codes["length"].to_numpy(np.int64)

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for b in _few(batches):
            for r in b.to_pylist():
                all_ = memoryview(decoder.read(r["bits"], np.array(r["offsets"], np.int64), r["n"]).astype("<u4")).cast("B")
                ends = np.cumsum(r["lens"])
                starts = ends - r["lens"]
                packed = [all_[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                out = [pa.array([r["part"]] * len(ends), pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(starts + r["start"], pa.int64()), pa.array(r["lens"], pa.int64()), pa.array(map(zlib.crc32, packed), pa.int64())]
                if ids:
                    out.append(pa.array(map(bytes, packed), pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    # one number for each range: what the ranges before it hold
    sizes = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect())
    base, sum_ = [], 0
    for part, n in sizes:
        base.append((part, sum_))
        sum_ += n
    before = spark.createDataFrame(base, "part int, before long")
    small_arrow_batches(spark)
    docs = blocks.mapInArrow(run, schema).join(F.broadcast(before), "part")
    return docs.withColumn("start", F.col("start") + F.col("before")).select(*names[1:])
