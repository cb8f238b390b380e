"""A corpus pipeline of five stages over ``documents``; each stage works on all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listenlab.llm import bpe, jaccard, langid, mixing, quality
from listenlab.llm.common import shared_dir, word_count, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document of less language certainty goes; und has none.
LEAST_CERTAIN = 0.4
#: Near-duplicates: five words, likeness 0.8 or more.
NEAR = jaccard.Rule(shingle=5, percent=80)


def _columns(docs: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the network tells with some certainty; those without a letter go.

    So do null and empty texts. Each row is judged by its own text, whatever its id, lang or source; repeated
    rows stay repeated. Without a row to learn from, or without rows, nothing is kept.
    """
    rows = langid.identify(docs, langid.fit(docs), _columns(docs))
    return rows.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_CERTAIN)).select(*_columns(docs))


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the line-labelling field predicts to be good.

    A null text counts as empty, and an empty one as one empty line. Rows of null or repeated ids are judged
    by their own texts; only labelled ids are learned from. Without labels every score is 0.5, and all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score(docs, quality.fit(docs, labels), _columns(docs)).where("predicted = 1").select(*_columns(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest doc_id, of each group of near-duplicates.

    Documents without words all stay; of repeated rows one stays; those of null id stay if nothing with an id is like them.
    """
    return jaccard.representatives(docs, NEAR).select(*_columns(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the mix doesn't take, and repeats those that it takes several times.

    Null sources are a source of their own, null texts have no words. Rows of one id are taken alike. An empty table stays empty.
    """
    size = word_count(F.col("text"))
    sizes = written(docs.select("doc_id", "source", size.alias("size")), "sizes")
    plan = mixing.plan(sizes.select("source", "size", mixing.doc_hash(F.col("doc_id")).alias("h")))
    taken = plan.apply(docs, F.col("doc_id"), F.col("source"), size)
    return taken.where("_times > 0").withColumn("_", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(*_columns(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every document that is left, decodes it again, and returns the digests of both.

    A null or empty text has no ids; rows are kept as they are, null and repeated ids too.
    """
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language),
    ("quality classifier", good),
    ("n-gram Jaccard join", distinct),
    ("mixing sources to target weights", mix),
    ("byte-level BPE encoding and decoding", tokens),
]

#: Trained models and the join can't be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; what each returns is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    to = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{to}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{to}/{k}")
    return docs
