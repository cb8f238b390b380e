"""The stages' decisions, and the whole run."""

import hashlib
from collections import Counter

import corpus_pipeline as cp
import numpy as np
import public_tokenizers as P
from test_joins import _brute, _near
from test_tokens import PLAIN

from listenlab.llm import langid, mixing, quality

SF = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in cp.STAGES][0] == "language ID" and len(cp.STAGES) == 5
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(cp.STAGES[:4]):
        out = stage(spark, docs, SF)
        assert out.columns == cp.COLUMNS
        docs = spark.createDataFrame(out.collect(), out.schema)
        ids = [r.doc_id for r in docs.select("doc_id").collect()]
        assert set(ids) <= seen and (k == 3 or len(ids) == len(set(ids)))
        seen = set(ids)
    assert len(seen) > 600


def test_run(spark):
    out = cp.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 600


def test_stages_take_anything(spark, docs, none):
    """Nulls in any column, empty and very long texts, repeated rows, clashing extra columns, empty tables."""
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = base.unionByName(docs.select(*cp.COLUMNS))
    kept = {k: stage(spark, odd, SF).collect() for k, (_, stage) in enumerate(cp.STAGES)}
    assert not {4, 5, 6} & {r.doc_id for r in kept[0] if r.text in (None, "", " \t\n")}
    for k, (_, stage) in enumerate(cp.STAGES):
        assert stage(spark, docs, SF).count() <= 3 * docs.count()
        assert stage(spark, none, SF).count() == 0
        rows = {(r.doc_id, getattr(r, "text", 0)) for r in kept[k]}
        assert k == 4 or rows <= {(r.doc_id, r.text) for r in odd.collect()}


def test_distinct_against_brute_force(spark):
    rows = _near(9, 25, 6)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    want = sorted({c for _, _, c, _ in _brute(rows, 5, 80)})
    assert sorted(r.doc_id for r in cp.distinct(spark, df, SF).collect()) == want


def test_run_against_plain_stages(spark, tmp_path):
    """The whole run against each stage done by plain means on the same rows."""
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    odd = [(900, None, None, None, None), (901, "", "en", "src1", 0), (None, "a text that has no id but some words in it", "en", None, 1)]
    spark.createDataFrame([*map(tuple, base.collect()), *odd], base.schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = (spark.read.parquet(str(tmp_path / f"{n}.parquet")) for n in ("documents", "labels"))
    rows = docs.collect()
    langs, scores = langid.predictor(langid.fit(docs))([r.text for r in rows])
    rows = [r for r, lang, s in zip(rows, langs, scores, strict=True) if lang != "und" and s >= cp.LEAST_CERTAIN]
    field = quality.fit(spark.createDataFrame(rows, docs.schema), labels)
    rows = [r for r, s in zip(rows, field.score([r.text for r in rows]), strict=True) if s >= quality.CUT]
    first = {c for _, _, c, _ in _brute([(r.doc_id, r.text) for r in rows], 5, 80)}
    rows = [r for r in rows if r.doc_id in first]
    taken = {r.doc_id: r.taken // r.size for r in mixing.mixed(spark.createDataFrame(rows, docs.schema)).collect() if r.size}
    want = Counter()
    for r in rows:
        ids = PLAIN.encode_ordinary(r.text)
        want[r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest()] += taken.get(r.doc_id, 0)
    got = Counter(map(tuple, cp.run(spark, str(tmp_path)).collect()))
    assert got == +want and P.PATTERN
