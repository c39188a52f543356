"""A factorisation machine over hashed terms, trained on a bounded sample.

score(x) = sigmoid(b + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The pair sum is the identity for all products <v_i, v_j> x_i x_j, so that a
document costs its number of terms times the number of factors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import SLICE, is_held_out, pick, slices


@dataclass(frozen=True)
class Settings:
    """buckets: hashed terms; sample: labelled documents at most, half of each class.

    least_chi2: a term is learned if the chi-squared statistic of its presence and the
    label reaches this, so that long texts do not add up the noise of many rare terms.
    """

    buckets: int = 1 << 18
    factors: int = 8
    sample: int = 8_000
    least_docs: int = 4
    least_chi2: float = 14.0
    epochs: int = 20
    batch: int = 128
    rate: float = 0.05
    decay: float = 2e-4
    seed: int = 7


@dataclass
class Model:
    """place: for each bucket its row in weights, -1 where it was not learned."""

    bias: float
    place: np.ndarray
    weights: np.ndarray
    vectors: np.ndarray
    dense: int

    def scores(self, rows: np.ndarray, buckets: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
        """Scores of n documents from (row, bucket, value) triples sorted by row."""
        at = self.place[buckets]
        known = at >= 0
        rows, at, values = rows[known], at[known], values[known].astype(np.float64)
        total = self.bias + np.bincount(rows, self.weights[at] * values, n)
        for vector in self.vectors.T:
            product = vector[at] * values
            total += 0.5 * (np.bincount(rows, product, n) ** 2 - np.bincount(rows, product**2, n))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` by key, for keys 0 to n - 1."""
    return np.stack([np.bincount(keys, column, n) for column in values.T], axis=1).astype(np.float32)


def _chi2(seen: np.ndarray, hits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Of a term's presence (``seen`` documents, ``hits`` labelled 1) and the label."""
    n, positive = max(1, len(labels)), labels.sum()
    spread = seen * (n - seen) * positive * (n - positive)
    return np.where(spread > 0, n * (n * hits - seen * positive) ** 2 / np.maximum(spread, 1), 0)


def train(
    docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, weights: np.ndarray, settings: Settings, dense: int
) -> Model:
    """Fit by mini-batches with adaptive steps; ``dense`` buckets at the end are always kept."""
    rng = np.random.default_rng(settings.seed)
    size = settings.buckets + dense
    seen, hits = np.zeros(size), np.zeros(size)
    for (buckets, _), label in zip(docs, labels, strict=True):
        seen[buckets] += 1
        hits[buckets] += label
    chosen = (seen >= settings.least_docs) & (_chi2(seen, hits, labels) >= settings.least_chi2)
    chosen[settings.buckets :] = True
    kept = np.flatnonzero(chosen)
    place = np.full(size, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    compact = [(place[b], v.astype(np.float32)) for b, v in docs]
    compact = [(at[at >= 0], values[at >= 0]) for at, values in compact]
    n, k = len(kept), settings.factors
    share = float(np.clip(np.average(labels, weights=weights), 0.01, 0.99)) if len(labels) else 0.5
    bias = np.log(share / (1 - share))
    w, v = np.zeros(n, np.float32), rng.normal(0, 0.02 if len(docs) else 0, (n, k)).astype(np.float32)
    gw, gv, gb = np.full(n, 1e-6, np.float32), np.full((n, k), 1e-6, np.float32), 1e-6
    for _ in range(settings.epochs if len(docs) else 0):
        order = rng.permutation(len(docs))
        for start in range(0, len(order), settings.batch):
            chosen = order[start : start + settings.batch]
            lengths = [len(compact[doc][0]) for doc in chosen]
            at = np.concatenate([compact[doc][0] for doc in chosen])
            x = np.concatenate([compact[doc][1] for doc in chosen])
            rows = np.repeat(np.arange(len(chosen)), lengths)
            used, column = np.unique(at, return_inverse=True)
            vx = v[at] * x[:, None]
            sums = _sums(rows, vx, len(chosen))
            pairs = 0.5 * (sums**2 - _sums(rows, vx**2, len(chosen))).sum(axis=1)
            total = bias + np.bincount(rows, w[at] * x, len(chosen)) + pairs
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            error = ((p - labels[chosen]) * weights[chosen]).astype(np.float32) / len(chosen)
            step = error[rows] * x
            dw = np.bincount(column, step, len(used)) + settings.decay * w[used]
            dv = _sums(column, step[:, None] * (sums[rows] - vx), len(used)) + settings.decay * v[used]
            db = float(error.sum())
            gw[used] += dw**2
            gv[used] += dv**2
            gb += db**2
            w[used] -= settings.rate * dw / np.sqrt(gw[used])
            v[used] -= 0.3 * settings.rate * dv / np.sqrt(gv[used])
            bias -= settings.rate * db / np.sqrt(gb)
    return Model(float(bias), place, w, v, dense)


def sample_ids(labels: DataFrame, label: str, settings: Settings) -> DataFrame:
    """At most ``settings.sample`` labelled ids that are not held out, with label and weight.

    Half of them of each class, or all of a class that has fewer, chosen by a hash.
    The weight of a class makes up for its share of the sample.
    """
    rows = pick(labels, doc_id="long", **{label: "int"}).select("doc_id", F.col(label).alias("label"))
    rows = rows.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id")))
    half = settings.sample // 2
    parts = []
    for value in (0, 1):
        of_class = rows.filter(F.col("label") == value)
        order = of_class.withColumn("key", F.xxhash64("doc_id", F.lit(settings.seed)))
        parts.append(order.orderBy("key", "doc_id").limit(half))
    return parts[0].unionAll(parts[1]), {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}


def fit(docs: DataFrame, labels: DataFrame, label: str, featurise, dense: int, settings: Settings) -> Model:
    """Learn from labelled documents that are not held out.

    ``featurise(texts)`` gives (rows, buckets, values) arrays. Only the chosen ids
    are sent to the documents, and only hashed terms of at most ``settings.sample``
    documents come back. Ids with several rows count once, with the smallest text
    hash. Without labels of both classes the model scores every document alike.
    """
    ids, counts = sample_ids(labels, label, settings)
    # settings.sample rows at most.
    chosen = {r.doc_id: r.label for r in ids.collect()}
    sampled = {v: sum(1 for x in chosen.values() if x == v) for v in (0, 1)}
    spark = docs.sparkSession
    small = spark.createDataFrame([(i,) for i in chosen], "s_doc_id long")
    rows = pick(docs, doc_id="long", text="string")
    rows = rows.join(F.broadcast(small), F.col("doc_id") == F.col("s_doc_id"), "left_semi")

    def extract(batches):
        for batch in slices(batches):
            texts = batch["text"].fillna("").tolist()
            at, buckets, values = featurise(texts)
            cuts = np.searchsorted(at, np.arange(len(texts) + 1))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"],
                    "buckets": [buckets[a:b].astype("<i4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                    "vals": [values[a:b].astype("<f4").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)],
                }
            )

    features = rows.mapInPandas(extract, "doc_id long, buckets binary, vals binary")
    one = features.groupBy("doc_id").agg(F.min(F.struct("buckets", "vals")).alias("x"))
    found = sorted((r.doc_id, bytes(r.x.buckets), bytes(r.x.vals)) for r in one.collect())
    data = [(np.frombuffer(b, "<i4"), np.frombuffer(v, "<f4")) for _, b, v in found]
    y = np.array([chosen[i] for i, _, _ in found], np.float64)
    rate = {v: counts.get(v, 0) / max(1, sampled[v]) for v in (0, 1)}
    weights = np.array([rate[int(v)] for v in y], np.float64)
    if len(set(y)) < 2:
        data, y, weights = [], np.array([]), np.array([])
    else:
        weights /= weights.mean()
    return train(data, y, weights, settings, dense)


def scorer(spark, model: Model, featurise):
    """A vectorised column function text -> score; the model's size is fixed by the settings."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        cleaned, out = texts.fillna("").tolist(), []
        for start in range(0, len(cleaned), SLICE):
            part = cleaned[start : start + SLICE]
            out.append(shared.value.scores(*featurise(part), len(part)))
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return score


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    rows = pick(docs, doc_id="long", text="string")
    return rows.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score")).select(
        "*", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def hashed_counts(words_of_rows: list[list[bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, count) sorted by row then bucket; a bucket is the CRC-32 of its word."""
    from zlib import crc32

    lengths = np.fromiter(map(len, words_of_rows), np.int64, len(words_of_rows))
    total = int(lengths.sum())
    codes = np.fromiter((crc32(w) for words in words_of_rows for w in words), np.int64, total)
    keys = np.repeat(np.arange(len(words_of_rows)), lengths) * buckets + codes % buckets
    keys, counts = np.unique(keys, return_counts=True)
    return keys // buckets, keys % buckets, counts


