"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Its features, and those of its neighbours, give it a score; neighbouring
labels have a score of their own. Forward and backward messages give each line's probability of
being good, and the document's quality is their mean, weighted by length, put through a logistic
curve. Lines learn from the label of their document, in a bounded sample of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches
from .samples import fold, sample

#: Labelled documents that training sees at most, and passes over them.
TRAIN_DOCS, EPOCHS = 4000, 6
FOLDS, HELD_OUT, CUT = 5, 0, 0.3
#: Longer stretches without a line end are cut into lines of this many characters.
LINE = 2000
ODD = re.compile(r"[^\w\s.,;:'\"()?-]")
ENDS = re.compile(r"[.!?:;,\"')\]]$")
PLAIN = 9


def lines(text: str | None) -> list[str]:
    """A text's lines, long ones cut; at least one."""
    out = []
    for line in (text or "").split("\n"):
        out += [line[i : i + LINE] for i in range(0, len(line), LINE)] or [""]
    return out


def measure(line: str) -> tuple[float, ...]:
    """PLAIN numbers from 0 to 1 about one line."""
    w = line.split()
    n = len(w)
    if not n:
        return (0.0,) * (PLAIN - 1) + (1.0,)
    odd = len(ODD.findall(line))
    return (
        sum(map(str.isupper, w)) / n,
        min(1.0, odd / n),
        min(1.0, 4 * odd / len(line)),
        1 - len(set(w)) / n,
        sum(map(eq, w, w[1:])) / n,
        sum(map(str.isalpha, w)) / n,
        min(1.0, n / 64),
        1.0 if ENDS.search(line) else 0.0,
        0.0,
    )


def features(rows: list[tuple[float, ...]], ends: np.ndarray) -> np.ndarray:
    """Features of all lines of some documents: their own, and those of the lines before and after."""
    plain = np.array(rows, np.float64).reshape(-1, PLAIN)
    own = np.concatenate([plain, plain[:, : PLAIN - 2] > 0.1, plain[:, : PLAIN - 2] > 0.4, plain[:, : PLAIN - 2] > 0.8], 1)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    starts = np.concatenate([[0], ends[:-1]]).astype(int)
    before[starts], after[ends - 1] = 0, 0
    return np.concatenate([own, before, after, np.ones((len(own), 1))], 1)


WIDTH = 3 * (PLAIN + 3 * (PLAIN - 2)) + 1


def marginals(emit: np.ndarray, ends: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of good for every line, and the probabilities (4) of every pair of neighbours, last lines excepted.

    emit: log odds by the line alone. trans[a, b]: score of label b after label a, 1 is good. All
    documents go forward and backward together, line by line.
    """
    sizes = np.diff(ends, prepend=0)
    starts, order = ends - sizes, np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], starts[order]

    def sent(a: np.ndarray, t: np.ndarray) -> np.ndarray:
        return np.logaddexp(a + t[1, 1], t[0, 1]) - np.logaddexp(a + t[1, 0], t[0, 0])

    fore, back = emit.copy(), np.zeros_like(emit)
    longest, active = int(sizes.max(initial=0)), len(sizes)
    for k in range(1, longest):
        active = int(np.searchsorted(-sizes, -k, "left")) if sizes[active - 1] <= k else active
        at = starts[:active] + k
        fore[at] += sent(fore[at - 1], trans)
    for k in range(1, longest):
        n = int(np.searchsorted(-sizes, -k, "left"))
        at = starts[:n] + sizes[:n] - 1 - k
        back[at] = sent(back[at + 1] + emit[at + 1], trans.T)
    inner = np.setdiff1d(np.arange(len(emit)), ends - 1, assume_unique=True)
    a, b = fore[inner], (emit + back)[inner + 1]
    z = np.stack([np.full_like(a, trans[0, 0]), b + trans[0, 1], a + trans[1, 0], a + b + trans[1, 1]], 1)
    z = np.exp(z - z.max(1, keepdims=True))
    return fore + back, z / z.sum(1, keepdims=True)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Field:
    weights: np.ndarray
    trans: np.ndarray
    slope: float = 1.0
    offset: float = 0.0

    def lines(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every line's probability of being good, its length, and where each document's lines end."""
        split = [lines(t) for t in texts]
        ends = np.cumsum([len(s) for s in split]) if split else np.zeros(0, int)
        flat = [x for s in split for x in s]
        emit = features([measure(x) for x in flat], ends) @ self.weights if flat else np.zeros(0)
        odds, _ = marginals(emit, ends, self.trans)
        return _sigmoid(odds), np.array([len(x) + 1 for x in flat], float), ends

    def raw(self, texts: list[str | None]) -> np.ndarray:
        """Length-weighted mean of the lines' probabilities."""
        p, size, ends = self.lines(texts)
        if not len(ends):
            return np.zeros(0)
        starts = np.concatenate([[0], ends[:-1]]).astype(int)
        return np.add.reduceat(p * size, starts) / np.add.reduceat(size, starts)

    def score(self, texts: list[str | None]) -> np.ndarray:
        return _sigmoid(self.slope * self.raw(texts) + self.offset)


def train(texts: list[str | None], good: list[int], seed: int = 3) -> Field:
    """Maximises the likelihood of the lines' labels, then fits the curve to the documents' labels."""
    rng, y_doc = np.random.default_rng(seed), np.array(good, float)
    field = Field(np.zeros(WIDTH), np.zeros((2, 2)))
    split = [lines(t) for t in texts]
    rows = [[measure(x) for x in s] for s in split]
    m, v, t = [np.zeros(WIDTH), np.zeros((2, 2))], [np.zeros(WIDTH), np.zeros((2, 2))], 0
    rare = len(y_doc) / (2 * np.maximum(1, np.array([(y_doc == 0).sum(), (y_doc == 1).sum()])))
    for _ in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 50)):
            if not len(batch):
                continue
            ends = np.cumsum([len(rows[i]) for i in batch])
            x = features([r for i in batch for r in rows[i]], ends)
            y = np.repeat(y_doc[batch], [len(rows[i]) for i in batch])
            # every document counts the same, but for the rarer label
            w = np.repeat(rare[y_doc[batch].astype(int)] / [len(rows[i]) for i in batch], [len(rows[i]) for i in batch])
            odds, pairs = marginals(x @ field.weights, ends, field.trans)
            inner = np.setdiff1d(np.arange(len(y)), ends - 1, assume_unique=True)
            same = np.zeros((len(inner), 4))
            same[np.arange(len(inner)), (y[inner] * 3).astype(int)] = 1
            grads = [x.T @ ((y - _sigmoid(odds)) * w) / len(batch) - 1e-4 * field.weights, ((same - pairs) * w[inner][:, None]).sum(0).reshape(2, 2) / len(batch) - 1e-3 * field.trans]
            t += 1
            for a, g, ma, va in zip([field.weights, field.trans], grads, m, v, strict=True):
                ma += 0.1 * (g - ma)
                va += 0.001 * (g * g - va)
                a += 0.03 * (ma / (1 - 0.9**t)) / (np.sqrt(va / (1 - 0.999**t)) + 1e-8)
    raw = np.concatenate([field.raw(texts[i : i + 200]) for i in range(0, len(texts), 200)])
    a, b = 4.0, -2.0
    for _ in range(200):  # Newton's method, kept from running off by a small penalty
        p = _sigmoid(a * raw + b)
        r, s = y_doc - p, np.maximum(p * (1 - p), 1e-6)
        h = np.array([[(s * raw * raw).sum() + 0.05, (s * raw).sum()], [(s * raw).sum(), s.sum() + 0.05]])
        step = np.linalg.solve(h, [(r * raw).sum() - 0.05 * a, r.sum() - 0.05 * b])
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
    field.slope, field.offset = float(a), float(b)
    return field


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Field | None:
    """Learns from the texts and quality labels of at most ``most`` rows outside the held-out fold; None if there are none.

    A document of clashing labels counts as bad. The rows are those of smallest hashes, the same on every run.
    """
    known = labels.select("doc_id", "quality").where(F.col("quality").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT))
    # few rows of the labels are needed: those of smallest id hash, so few that they can be broadcast
    n = known.count()
    scale = 1 << 20
    few = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(scale)) < min(scale, int(scale * 1.5 * most / max(n, 1)) + 1))
    few = few.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * most)
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    got = sample(rows, most)
    return train([r["text"] for r in got], [int(r["quality"]) for r in got]) if got else None


def score(docs: DataFrame, field: Field | None, keep: list[str] | None = None) -> DataFrame:
    """Adds score and predicted to the columns in ``keep`` (doc_id if None), one row for each row.

    A null text counts as empty, and an empty one as one empty line. Without anything learned, 0.5.
    """
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add("score", "double").add("predicted", "integer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            s = field.score(texts) if field else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(s), pa.array((s >= CUT).astype(np.int32))], [*keep, "score", "predicted"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document, with a field fitted on the same tables."""
    out = score(docs, fit(docs, labels))
    return out.select("doc_id", (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
