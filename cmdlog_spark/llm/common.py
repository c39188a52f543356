"""Helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlog_spark.functions.staging import discard, stage

__all__ = ["beside", "discard", "is_held_out", "pick", "short_lived_shuffles", "slices", "small_batches", "stage", "text_or_empty", "without"]

# Rows whose texts a Python worker unfolds at a time.
SLICE = 1_000
# Rows and bytes that Spark hands to a Python worker at a time, in memory of both.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": SLICE, "spark.sql.execution.arrow.maxBytesPerBatch": 4 << 20}

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, cast to the given types.

    Other columns, also those that differ in case alone or repeat a name, play no
    part; the first column with exactly the name counts.
    """
    names = df.columns
    places = {name: names.index(name) for name in kinds}
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    return plain.select(*(F.col(f"c{places[k]}").cast(kind).alias(k) for k, kind in kinds.items()))


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pd.DataFrame], rows: int = SLICE) -> Iterator[pd.DataFrame]:
    """The same rows in smaller batches."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.iloc[start : start + rows].reset_index(drop=True)


def use_small_batches(spark: SparkSession) -> dict[str, str]:
    """Lower the session's batches to BATCH and return what was set; lower settings stay."""
    before = {key: spark.conf.get(key) for key in BATCH}
    for key, most in BATCH.items():
        now = int(before[key].removesuffix("b")) if before[key].removesuffix("b").isdigit() else 0
        if now <= 0 or now > most:  # 0 and less: no limit; a size with another unit is set anew
            spark.conf.set(key, str(most))
    return before


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside hand small batches to Python: rows may be whole texts or sets."""
    before = use_small_batches(spark)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


@contextmanager
def short_lived_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffles of jobs that run inside are deleted when their job ends, not when the driver
    happens to collect its garbage."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def is_held_out(doc_id: Column) -> Column:
    """A quarter of the ids, on which no classifier here learns; a null id counts as ''."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(4)) == 2


def beside(docs: DataFrame, key) -> DataFrame:
    """All columns under safe names, with x_doc_id and x_key, key(text), beside them."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text"))
    text = F.coalesce(text.cast("string"), F.lit(""))
    return plain.select("*", doc_id.cast("long").alias("x_doc_id"), key(text).alias("x_key"))


def without(docs: DataFrame, gone: DataFrame, key) -> DataFrame:
    """The documents with all their columns, less those that ``gone`` names.

    ``gone`` has one row (doc_id, key, one_stays) for each id and key of which rows go:
    all of them, or all but one.
    """
    rows = beside(docs, key)
    same = F.col("x_doc_id").eqNullSafe(gone["doc_id"]) & (F.col("x_key") == gone["key"])
    # Sorted and merged at any size: whole texts are shuffled once.
    kept = rows.join(gone.hint("merge"), same, "left_anti")
    again = gone.filter("one_stays")
    if not again.isEmpty():  # rows that are alike in id and text, of which one stays
        alike = rows.join(again, same, "left_semi")
        kept = kept.unionAll(alike.dropDuplicates(["x_doc_id", "x_key"]))
    return kept.drop("x_doc_id", "x_key").toDF(*docs.columns)
