"""The queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from listenlab.session import table

from . import bpe, fingerprints, html, jaccard, langid, licenses, merkle, mixing, oracles, pairtree, quality, tokenstore, topk, trie
from .common import shared_dir


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprinted(table(spark, sf_dir, "documents"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents")).drop("node")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(table(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extracted(table(spark, sf_dir, "pages"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    tokenstore.write(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, to)
    return tokenstore.read(spark, to, ids=False)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def op13_pair_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairtree.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_bpe": op2_bpe,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_language": op4_language,
        "op5_html": op5_html,
        "op6_token_store": op6_token_store,
        "op7_quality": op7_quality,
        "op8_top_k": op8_top_k,
        "op9_mixing": op9_mixing,
        "op10_licenses": op10_licenses,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_merkle": op12_merkle,
        "op13_pair_tree": op13_pair_tree,
    }


def oracle_sql() -> dict[str, str]:
    return {"op8_top_k": topk.ORACLE, "op9_mixing": mixing.ORACLE, "op10_licenses": licenses.ORACLE, "op11_prefix_trie": oracles.TRIE, "op12_merkle": oracles.MERKLE}
