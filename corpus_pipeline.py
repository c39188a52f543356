"""A training corpus from documents: good ones, each once, mixed to weights and packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs. All but the last keep the columns of
documents. Tables that a stage has staged for its result are deleted when the next stage
over the same folder begins: by then the result has been written. The stages lower the
session's batches for Python, also for what runs when their results are written.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from cmdlog_spark.functions.staging import delete, discard, owned, stage
from cmdlog_spark.llm import exact_dedup, mixing, ngram_join, packing, quality
from cmdlog_spark.llm.common import use_small_batches
from cmdlog_spark.llm.queries import table, vocabulary

# Near-duplicates share 80 % of their runs of five words.
NEAR = ngram_join.Settings(size=5, percent=80)


_LEFT: dict[tuple, list] = {}


def _tidy(function: Callable) -> Callable:
    """A stage that deletes what the stage before it has left and keeps Python's batches small."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        place = (threading.get_ident(), spark.sparkContext.applicationId, sf_dir)
        if function is not good_documents.__wrapped__:
            delete(_LEFT.pop(place, []))
        use_small_batches(spark)
        with owned() as made:
            result = function(spark, docs, sf_dir)
        _LEFT[place] = made
        return result

    return run_stage


@_tidy
def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@_tidy
def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_exact_firsts(docs)


@_tidy
def dissimilar_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return ngram_join.keep_component_firsts(docs, NEAR)


@_tidy
def mixed_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs, doc_weight=mixing.length_band)


@_tidy
def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences, with their token ids."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_classifier", good_documents),
    ("exact_dedup", distinct_documents),
    ("jaccard_join", dissimilar_documents),
    ("mix_sources", mixed_documents),
    ("pack", packed_sequences),
]

# A fitted classifier and token ids are not SQL; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), []
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
        discard(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
