"""Quality scores from a factorisation machine over words, structure and metadata."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm import fm
from cmdlog_spark.llm.toxicity import LETTERS

THRESHOLD = 0.7
SETTINGS = fm.Settings()
# Shares are cut into so many steps, the finer the nearer to 0.
STEPS = 16
NAMES = (
    "punctuation", "capitals", "digits", "bars", "distinct", "stutter", "word_length",
    "lines", "length", "sentence_ends", "repeated_lines",
)
DENSE = len(NAMES) * STEPS
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def _share(part: float, whole: float) -> int:
    return min(STEPS - 1, int((part / whole) ** 0.5 * STEPS)) if whole else 0


def _magnitude(n: float) -> int:
    return min(STEPS - 1, int(np.log2(n + 1)))


def structure(data: bytes, words: list[bytes]) -> list[int]:
    """One step per name of NAMES, from the whole text."""
    size, n = len(data), len(words)
    solid = size - data.count(b" ") - data.count(b"\n")
    lines = data.split(b"\n")
    stutter = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    return [
        _share(size - len(data.translate(None, MARKS)), solid),
        _share(size - len(data.translate(None, UPPER)), solid),
        _share(size - len(data.translate(None, DIGITS)), solid),
        _share(data.count(b"|"), n),
        _share(len(set(words)), n),
        _share(stutter, n),
        min(STEPS - 1, int(sum(map(len, words)) / n)) if n else 0,
        _magnitude(len(lines)),
        _magnitude(size / 8),
        _share(data.count(b"."), n),
        _share(len(lines) - len(set(lines)), len(lines)),
    ]


def features(texts: list[str], buckets: int = SETTINGS.buckets) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): hashed words by the log of their count, then one step per statistic."""
    data = [t.encode("utf-8", "replace") for t in texts]
    words = [d.translate(LETTERS).split() for d in data]
    rows, codes, counts = fm.hashed_counts(words, buckets)
    lengths = np.maximum(1, np.bincount(rows, counts, len(texts)))
    values = np.log1p(counts) / np.sqrt(np.log1p(lengths))[rows]
    steps = np.array([structure(d, w) for d, w in zip(data, words, strict=True)], np.int64)
    steps = steps.reshape(len(texts), len(NAMES)) + np.arange(len(NAMES)) * STEPS + buckets
    rows = np.concatenate([rows, np.repeat(np.arange(len(texts)), len(NAMES))])
    codes = np.concatenate([codes, steps.ravel()])
    values = np.concatenate([values, np.ones(steps.size)]).astype(np.float32)
    order = np.argsort(rows, kind="stable")
    return rows[order], codes[order], values[order]


def learn(docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS) -> fm.Model:
    return fm.fit(
        docs, labels, "quality", lambda texts: features(texts, settings.buckets), DENSE, settings
    )


def _scorer(docs: DataFrame, labels: DataFrame, settings: fm.Settings):
    model = learn(docs, labels, settings)
    return fm.scorer(docs.sparkSession, model, lambda texts: features(texts, settings.buckets))


def score_quality(
    docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS, threshold: float = THRESHOLD
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Terms are hashed words, structure (marks, capitals, digits, bars, repetition,
    word length, lines) and metadata of the text (its length); weights of single
    terms and of pairs are fitted together on at most ``settings.sample`` labelled
    documents that are not held out. Every row is scored by its whole text, repeated
    ids row by row. Null texts count as empty; empty texts have structure only.
    Labels that are null or neither 0 nor 1 are left out; without both classes all
    scores are 0.5. An empty table gives no rows.
    """
    return fm.scored(docs, _scorer(docs, labels, settings), threshold)


def keep_good(
    docs: DataFrame, labels: DataFrame, settings: fm.Settings = SETTINGS, threshold: float = THRESHOLD
) -> DataFrame:
    """The documents with all their columns whose score reaches the threshold."""
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    text = F.col(f"c{names.index('text')}").cast("string")
    scored = plain.withColumn("score", _scorer(docs, labels, settings)(text))
    return scored.filter(F.col("score") >= threshold).drop("score").toDF(*names)
