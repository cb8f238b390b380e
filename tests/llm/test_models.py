"""Language ID and quality: edge cases and accuracy on rows that training never saw."""

import pytest
from pyspark.sql import functions as F

from listenlab.llm import langid, quality

SF = "/root/testdata/sf0.01"


def test_language(spark, docs, none):
    rows = spark.read.parquet(f"{SF}/documents.parquet")
    net = langid.fit(rows)
    got = langid.identify(rows, net, ["doc_id", "lang"]).withColumn("held", langid.held_out(F.col("doc_id"))).where("held").collect()
    assert len(got) > 200 and sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)
    odd = {r.doc_id: r for r in langid.identify(docs, net).collect()}
    assert odd[4].lang_pred == odd[5].lang_pred == odd[6].lang_pred == "und" and odd[4].score == 0
    assert langid.identify(docs, net).count() == docs.count()
    assert langid.identified(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}


def test_held_out_rows_are_not_learned_from(spark):
    rows = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    assert langid.fit(rows.where(langid.held_out(F.col("doc_id")))) is None


def test_quality(spark, docs, none):
    rows, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality.scored(rows, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 50 and sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    field = quality.fit(rows, labels)
    odd = quality.score(docs, field).collect()
    assert len(odd) == docs.count() and all(0 <= r.score <= 1 for r in odd)
    assert quality.scored(none, labels).count() == 0
    assert quality.scored(docs, labels.where("false")).count() == docs.count()


def test_marginals_against_all_labellings():
    from itertools import product

    import numpy as np

    rng = np.random.default_rng(0)
    emit, trans, ends = rng.normal(size=9), rng.normal(size=(2, 2)), np.array([4, 5, 9])
    odds, pairs = quality.marginals(emit, ends, trans)
    start, k = 0, 0
    for end in ends:
        e = emit[start:end]
        weights = {y: np.exp(sum(a * b for a, b in zip(e, y)) + sum(trans[a, b] for a, b in zip(y, y[1:]))) for y in product((0, 1), repeat=len(e))}
        z = sum(weights.values())
        for i in range(len(e)):
            p = sum(w for y, w in weights.items() if y[i]) / z
            assert 1 / (1 + np.exp(-odds[start + i])) == pytest.approx(p)
        for i in range(len(e) - 1):
            p = sum(w for y, w in weights.items() if y[i] and y[i + 1]) / z
            assert pairs[k][3] == pytest.approx(p)
            k += 1
        start = end


def _plain_language(net, text):
    """Window by window: embed every byte, convolve with each filter, take the largest response, and the softmax."""
    import numpy as np

    if not text or not langid.LETTER.search(text):
        return "und", 0.0
    data, total = text.encode(), np.zeros(len(net.langs))
    for s in range(0, len(data), langid.WINDOW):
        part = data[s : s + langid.WINDOW]
        e = net.embed[np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)]
        pooled = []
        for k, b in zip(net.kernels, net.biases):
            z = [sum(e[i + j] @ k[j] for j in range(len(k))) + b for i in range(len(e) - len(k) + 1)]
            pooled.append(np.maximum(np.max(z, axis=0), 0))
        z = np.concatenate(pooled) @ net.dense + net.offset
        p = np.exp(z - z.max())
        total += p / p.sum() * len(part)
    p = total / total.sum()
    return net.langs[int(p.argmax())], float(p.max())


def test_language_query_against_plain_convolution(spark, docs):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").unionByName(docs.where("doc_id < 12").select("doc_id", "text", "lang", "source", "n_chars"))
    net = langid.fit(rows)
    got = langid.identified(rows).withColumnRenamed("doc_id", "id").collect()
    texts = {}
    for r in rows.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    for r in got:
        if all(len(t or "") > 20_000 for t in texts[r.id]):
            continue  # the plain form takes a second for each 10,000 bytes
        want = [_plain_language(net, t) for t in texts[r.id]]
        assert any(r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-4) for lang, score in want)


def _plain_quality(field, text):
    """One document by itself: forward and backward sums of exponentials over two labels, line after line."""
    import numpy as np

    split = quality.lines(text)
    emit = quality.features([quality.measure(x) for x in split], np.array([len(split)])) @ field.weights
    score = lambda i, y: emit[i] * y
    fore, back = [[score(0, y) for y in (0, 1)]], [[0.0, 0.0]]
    for i in range(1, len(split)):
        fore.append([score(i, y) + np.logaddexp(*(fore[-1][x] + field.trans[x, y] for x in (0, 1))) for y in (0, 1)])
    for i in range(len(split) - 1, 0, -1):
        back.insert(0, [np.logaddexp(*(back[0][y] + score(i, y) + field.trans[x, y] for y in (0, 1))) for x in (0, 1)])
    good = [1 / (1 + np.exp(f[0] + b[0] - f[1] - b[1])) for f, b in zip(fore, back)]
    size = [len(x) + 1 for x in split]
    return 1 / (1 + np.exp(-(field.slope * sum(p * n for p, n in zip(good, size)) / sum(size) + field.offset)))


def test_quality_query_against_plain_sums(spark):
    rows, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    field = quality.fit(rows, labels)
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = quality.scored(rows, labels).collect()
    assert len(got) == len(texts)
    for r in got:
        want = _plain_quality(field, texts[r.doc_id])
        assert r.score == pytest.approx(want, abs=1e-6) and r.predicted == int(r.score >= 0.3)


def test_samples_are_bounded_and_the_same(spark, monkeypatch):
    from listenlab.llm import samples

    rows = spark.createDataFrame([(i, "x" * (i % 100)) for i in range(3000)] + [(None, None)], "doc_id long, text string")
    one = [r.doc_id for r in samples.sample(rows, 500)]
    assert len(one) == 500 and one == [r.doc_id for r in samples.sample(rows.repartition(7), 500)]
    monkeypatch.setattr(samples, "MOST_BYTES", 1000)
    long = rows.where("length(text) > 0").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.repeat("text", F.lit(1001))).otherwise(F.col("text")).alias("text"))
    assert {r.doc_id % 3 for r in samples.sample(long, 500)} == {0}
    few = samples.sample(rows, 500)
    assert 10 < len(few) < 60 and sum(len(r.text or "") for r in few) <= 1000


def test_clashing_labels_are_settled(spark):
    rows = spark.createDataFrame([(i, ("good line.\n" if i % 2 else "### $$$ !!!\n") * 3) for i in range(200)], "doc_id long, text string")
    both = [(i, i % 2) for i in range(200)]
    labels = spark.createDataFrame(both + [(i, 1 - i % 2) for i in range(0, 200, 3)], "doc_id long, quality int")
    a, b = (quality.fit(rows, labels.repartition(n)) for n in (2, 5))
    assert (a.weights == b.weights).all() and (a.slope, a.offset) == (b.slope, b.offset)
