"""Registered queries of the corpus operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam as _decontam
from . import embed_dup as _embed_dup
from . import langid as _langid
from . import licences as _licences
from . import lm_diff as _lm_diff
from . import mixing as _mixing
from . import near_dup as _near_dup
from . import quality as _quality
from . import runs as _runs
from . import substrings as _substrings
from . import tokens as _tokens
from . import toxicity as _toxicity
from . import trie as _trie
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _near_dup.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _langid.predict_language(docs, *_langid.fit_language_model(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _toxicity.grade_toxicity(docs, _toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _licences.licences(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _quality.score_quality(docs, _quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _embed_dup.embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixing.mixed(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents labelled good are the target, all documents the background."""
    target = table(spark, sf_dir, "labels").where("quality = 1")
    return _lm_diff.cross_entropy_difference(table(spark, sf_dir, "documents"), target)


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _trie.conversation_trie(table(spark, sf_dir, "conversations"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _substrings.removal_digests(_substrings.without_repeats(table(spark, sf_dir, "documents")))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents, those that the contract changes included."""
    return _runs.run_digests(_runs.periodic_runs(_runs.with_planted_runs(table(spark, sf_dir, "documents"))))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup, op2_language_id, op3_toxicity, op4_licence_scan, op5_token_counts, op6_quality,
        op7_benchmark_decontamination, op8_embedding_near_dedup, op9_source_mixing, op10_lm_scoring, op11_conversation_trie, op12_substring_dedup,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op1_minhash_near_dedup": _near_dup.SQL,
    "op4_licence_scan": _licences.SQL,
    "op7_benchmark_decontamination": _decontam.SQL,
    "op9_source_mixing": _mixing.SQL,
    "op12_substring_dedup": _substrings.SQL,
}
