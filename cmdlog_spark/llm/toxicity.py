"""Toxicity scores from a factorisation machine over hashed terms."""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from cmdlog_spark.llm import fm

THRESHOLD = 0.3
SETTINGS = fm.Settings()
# Word beginnings stand for their inflected and compounded forms.
PREFIXES = (4, 5)
# ASCII letters in lower case; other ASCII characters separate words.
LETTERS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms(texts: list[str], buckets: int = SETTINGS.buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, 1.0) for the distinct words of each whole text and their beginnings."""
    rows, codes = [], []
    short, long = PREFIXES
    for row, text in enumerate(texts):
        words = set(text.encode("utf-8", "replace").translate(LETTERS).split())
        found = {crc32(w) for w in words}
        found.update([crc32(w[:short], 1) for w in words if len(w) > short])
        found.update([crc32(w[:long], 2) for w in words if len(w) > long])
        rows.append(len(found))
        codes.extend(found)
    lengths = np.array(rows, np.int64)
    keys = np.repeat(np.arange(len(texts)), lengths) * buckets
    keys = np.unique(keys + np.array(codes, np.int64) % buckets)
    return keys // buckets, keys % buckets, np.ones(len(keys), np.float32)


def learn(docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS) -> fm.Model:
    return fm.fit(docs, labels, "toxic", lambda texts: terms(texts, settings.buckets), 0, settings)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    The machine learns from at most ``settings.sample`` labelled documents that are
    not held out; weights of single terms and of pairs (an insult next to the mention
    of a group) are fitted together. Every row is scored by its whole text, repeated
    ids row by row. Null and empty texts have no terms and get the score of the bias.
    Labels that are null or neither 0 nor 1 are left out; without both classes all
    scores are 0.5. An empty table gives no rows.
    """
    model = learn(docs, labels, settings)
    score = fm.scorer(docs.sparkSession, model, lambda texts: terms(texts, settings.buckets))
    return fm.scored(docs, score, threshold)
