"""Language ID by a byte convolutional network.

A window of WINDOW bytes is embedded byte by byte; filters of several widths run over it, each
filter's largest response is kept, and a softmax layer gives the languages. The network is trained
in numpy on a bounded sample of labelled texts. A whole text is cut into windows, and its languages'
probabilities are those of its windows, weighted by their bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_arrow_batches
from .samples import fold, sample

#: Documents that training sees at most, windows of each, and passes over them.
TRAIN_DOCS, TRAIN_WINDOWS, EPOCHS = 2000, 3, 6
WINDOW, EMBED, WIDTHS, FILTERS = 192, 8, (2, 3, 4), 16
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
LETTER = re.compile(r"[^\W\d_]")


def _windows(data: bytes) -> np.ndarray:
    """A text's bytes as rows of WINDOW, the last one padded with zeros."""
    n = -(-len(data) // WINDOW)
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, WINDOW)


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray
    kernels: list[np.ndarray]  # (width, EMBED, FILTERS)
    biases: list[np.ndarray]
    dense: np.ndarray
    offset: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, ...]]:
        """Each filter's response to single bytes and byte pairs: the convolution as look-ups."""
        out = []
        for k in self.kernels:
            one = [self.embed @ k[j] for j in range(len(k))]
            pair = [(one[j][:, None] + one[j + 1][None]).reshape(65_536, FILTERS) for j in range(0, len(k) - 1, 2)]
            out.append((*pair, *one[len(pair) * 2 :]))
        return out

    def predict(self, rows: np.ndarray, tables: list[tuple[np.ndarray, ...]]) -> np.ndarray:
        """Probabilities of windows."""
        pairs = rows[:, :-1].astype(np.int32) << 8 | rows[:, 1:]
        pooled = []
        for k, t, bias in zip(self.kernels, tables, self.biases, strict=True):
            n, at = WINDOW - len(k) + 1, 0
            total = None
            for table in t:
                index = pairs if len(table) > 256 else rows
                got = table.take(index[:, at : at + n].reshape(-1), axis=0)
                total = got if total is None else np.add(total, got, out=total)
                at += 2 if len(table) > 256 else 1
            pooled.append(np.maximum(total.reshape(len(rows), n, FILTERS).max(1) + bias, 0))
        return _softmax(np.concatenate(pooled, 1) @ self.dense + self.offset)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Network:
    """Fits the network by Adam on windows from all over the texts, some of them cut short."""
    rng = np.random.default_rng(seed)
    names = sorted(set(langs))
    rows, goal = [], []
    for text, lang in zip(texts, langs, strict=True):
        w = _windows(text.encode())
        for i in rng.permutation(len(w))[:TRAIN_WINDOWS]:
            row = w[i].copy()
            if rng.random() < 0.3:
                row[rng.integers(8, WINDOW) :] = 0
            rows.append(row)
            goal.append(names.index(lang))
    x, y = np.array(rows, np.uint8).reshape(-1, WINDOW), np.array(goal, np.int64)
    f = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
    p = [f(256, EMBED, scale=0.5), *(f(w, EMBED, FILTERS, scale=0.3) for w in WIDTHS), *(np.zeros(FILTERS, np.float32) for _ in WIDTHS), f(FILTERS * len(WIDTHS), len(names), scale=0.2), np.zeros(len(names), np.float32)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    share = np.bincount(y, minlength=len(names)) / max(1, len(y))
    weight, k, t = 1 / np.maximum(share * len(names), 1e-9), len(WIDTHS), 0
    for epoch in range(EPOCHS):
        for batch in np.array_split(rng.permutation(len(x)), max(1, len(x) // 64)):
            if not len(batch):
                continue
            b, g = x[batch], [np.zeros_like(a) for a in p]
            e, pooled, where = p[0][b], [], []
            for i, w in enumerate(WIDTHS):
                n = WINDOW - w + 1
                cols = np.concatenate([e[:, j : j + n] for j in range(w)], 2)
                z = cols @ p[1 + i].reshape(-1, FILTERS) + p[1 + k + i]
                at = z.argmax(1)
                where.append(at)
                pooled.append(np.maximum(np.take_along_axis(z, at[:, None], 1)[:, 0], 0))
            h = np.concatenate(pooled, 1)
            d = _softmax(h @ p[-2] + p[-1])
            d[np.arange(len(batch)), y[batch]] -= 1
            d *= weight[y[batch]][:, None] / len(batch)
            g[-2], g[-1] = h.T @ d, d.sum(0)
            dh = (d @ p[-2].T) * (h > 0)
            for i, w in enumerate(WIDTHS):
                part, at = dh[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                g[1 + k + i] = part.sum(0)
                for j in range(w):  # only the place of the largest response counts
                    byte = b[np.arange(len(batch))[:, None], at + j]
                    g[1 + i][j] = np.einsum("nfe,nf->ef", p[0][byte], part)
                    np.add.at(g[0], byte, part[..., None] * p[1 + i][j].T[None])
            t += 1
            rate = 0.01 * (0.5**epoch if epoch > 2 else 1)
            for a, da, ma, va in zip(p, g, m, v, strict=True):
                ma += 0.1 * (da - ma)
                va += 0.001 * (da * da - va)
                a -= (rate * (ma / (1 - 0.9**t)) / (np.sqrt(va / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(names, p[0], p[1 : 1 + k], p[1 + k : 1 + 2 * k], p[-2], p[-1])


def fit(docs: DataFrame, most: int = TRAIN_DOCS) -> Network | None:
    """Learns from the text and lang of at most ``most`` rows outside the held-out fold; None if there are none."""
    rows = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    got = [r for r in sample(rows, most) if LETTER.search(r["text"])]
    return train([r["text"] for r in got], [r["lang"] for r in got]) if got else None


def held_out(doc_id: Column) -> Column:
    return fold(doc_id, FOLDS) == HELD_OUT


def predictor(net: Network | None):
    """A function of a list of texts, to (languages, scores)."""
    tables = net.tables() if net else None

    def predict(texts: list[str | None]) -> tuple[list[str], list[float]]:
        known = [i for i, t in enumerate(texts) if net and t and LETTER.search(t)]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        data = {i: texts[i].encode() for i in known}
        total = {i: np.zeros(len(net.langs)) for i in known}
        # windows of many texts are run together, at most 512 at a time; long texts are cut up
        held, owner, sizes = [], [], []

        def flush() -> None:
            if held:
                p = net.predict(np.concatenate(held), tables) * np.array(sizes)[:, None]
                for i, q in zip(owner, p, strict=True):
                    total[i] += q
                held.clear(), owner.clear(), sizes.clear()

        step = WINDOW * 512
        for i in known:
            for s in range(0, len(data[i]), step):
                w = _windows(data[i][s : s + step])
                held.append(w)
                owner += [i] * len(w)
                sizes += [WINDOW] * (len(w) - 1) + [len(data[i][s : s + step]) - WINDOW * (len(w) - 1)]
                if len(owner) >= 512:
                    flush()
        flush()
        for i in known:
            p = total[i] / total[i].sum()
            k = int(p.argmax())
            langs[i], scores[i] = net.langs[k], float(p[k])
        return langs, scores

    return predict


def identify(docs: DataFrame, net: Network | None, keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred and score to the columns in ``keep`` (doc_id if None), one row for each row.

    ``und`` with score 0 for a null text, one without a letter, or if nothing could be learned.
    """
    keep = keep or ["doc_id"]
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = predictor(net)
        for b in batches:
            langs, scores = predict(b.column(b.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    small_arrow_batches(docs.sparkSession)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, schema)


def identified(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, with a network fitted on the same table."""
    out = identify(docs, fit(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
