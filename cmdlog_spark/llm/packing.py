"""Packing token sequences by deficit round-robin over source queues."""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, stage
from cmdlog_spark.llm.tokens import END_OF_TEXT, tokenizer

WINDOW = 2048
# A queue sends multiples of this, so that small sources do not send single tokens.
GRAIN = 32
# Queues at most; sources beyond share queues by hash.
MAX_QUEUES = 256

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
    "offset long, source string, ids binary"
)


def tokenise(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Staged documents: ids (two or four bytes each, the last ends the text), their number
    and where they begin among the ids of the same source in the same part of the scan."""
    rows = pick(docs, doc_id="long", text="string", source="string")
    rows = rows.withColumn("part", F.spark_partition_id())

    def encode(batches):
        sent: dict = {}
        for batch in batches:
            texts = batch["text"].fillna("").tolist()
            found = [np.append(ids, np.uint32(END_OF_TEXT)) for ids in tokenizer(vocabulary).encode(texts)]
            begins = []
            for source, ids in zip(batch["source"], found, strict=True):
                begins.append(sent.get(source, 0))
                sent[source] = begins[-1] + len(ids)
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "source": batch["source"],
                    "part": batch["part"],
                    "begin": begins,
                    "tokens": [len(ids) for ids in found],
                    "wide": [bool(ids.max() > 65_535) for ids in found],
                    "ids": [(ids if ids.max() > 65_535 else ids.astype("<u2")).tobytes() for ids in found],
                }
            )

    schema = "doc_id long, source string, part int, begin long, tokens long, wide boolean, ids binary"
    return stage(rows.mapInPandas(encode, schema), "tokens")


def queues(tokens: DataFrame, targets: dict[str | None, float] | None) -> tuple[DataFrame, DataFrame]:
    """Where each (part, source) lies in its queue, and each queue's length and weight.

    A source has its own queue if there are few; else small ones share queues by hash.
    """
    runs = stage(
        tokens.groupBy("part", "source").agg(F.sum("tokens").alias("n")), "runs"
    )
    sources = runs.groupBy("source").agg(F.sum("n").alias("n"))
    few = sources.count() <= MAX_QUEUES
    total = sources.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    own = F.lit(few) | (F.col("n") * (MAX_QUEUES // 2) >= F.lit(total))
    label = F.to_json(F.struct("source"), {"ignoreNullFields": "false"})
    shared = F.concat(F.lit("shared "), F.pmod(F.xxhash64(label), F.lit(MAX_QUEUES // 2)))
    named = sources.withColumn("queue", F.when(own, label).otherwise(shared))
    weights = F.col("n").cast("double")
    if targets is not None:
        listed = tokens.sparkSession.createDataFrame(
            [(k, float(v)) for k, v in targets.items()], "t_source string, t double"
        )
        named = named.join(listed, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
        weights = F.coalesce(F.col("t"), F.lit(0.0))
    named = stage(named.withColumn("weight", weights), "sources")
    place = named.select(F.col("source").alias("q_source"), "queue")
    runs = runs.join(place, F.col("source").eqNullSafe(F.col("q_source"))).drop("q_source")
    before = W.partitionBy("queue").orderBy("part", "source").rowsBetween(W.unboundedPreceding, -1)
    bases = runs.select(
        F.col("part").alias("b_part"), F.col("source").alias("b_source"), "queue",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
    )
    lengths = named.groupBy("queue").agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"))
    return stage(bases, "bases"), lengths


class Schedule:
    """What each queue has sent after r rounds, in closed form.

    In a round a queue's deficit grows by its share of a window; it sends the whole
    grains that the deficit covers and carries the rest. So after r rounds it has sent
    floor(r * share / GRAIN) grains, or everything. Once a queue is empty, the others
    fill the windows in their proportions; queues without weight come last.
    """

    def __init__(self, lengths: list[int], weights: list[float], window: int):
        self.length = np.array(lengths, np.int64)
        weight = np.array(weights, np.float64)
        last = weight <= 0
        # Rounds are numbered on for queues without a weight, in proportion to their lengths.
        share = np.where(last, self.length, weight)
        for group in (last, ~last):
            share[group] /= max(1e-300, share[group].sum())
        # Grains per round as a fraction of 2 ** 20: integers, so that nothing drifts.
        self.unit = np.maximum(1, np.round(share * window / GRAIN * (1 << 20))).astype(np.int64)
        rounds = self._rounds(np.maximum(0, self.length - 1), np.arange(len(self.length)), 0) + 1
        first = int(rounds[~last].max()) if (~last).any() else 0
        self.offset = np.where(last, first, 0).astype(np.int64)

    def _rounds(self, position, queue, offset):
        """The round in which a position is sent: the least r with sent(r) > position."""
        grains = position // GRAIN + 1
        return (grains * (1 << 20) + self.unit[queue] - 1) // self.unit[queue] - 1 + offset

    def round_of(self, position: np.ndarray, queue: np.ndarray) -> np.ndarray:
        return self._rounds(position, queue, self.offset[queue])

    def sent(self, rounds: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Tokens a queue has sent before round ``rounds`` begins."""
        own = np.maximum(0, rounds - self.offset[queue])
        # Beyond its last round a queue has sent all; this also keeps the product small.
        enough = (self.length[queue] // GRAIN + 1) * (1 << 20) // self.unit[queue] + 1
        own = np.minimum(own, enough)
        return np.minimum(self.length[queue], own * self.unit[queue] // (1 << 20) * GRAIN)

    def before(self, rounds: np.ndarray, queue: np.ndarray) -> np.ndarray:
        """Place in the output of the first token that a queue sends in a round."""
        place = np.zeros(len(rounds), np.int64)
        for other in range(len(self.length)):
            which = np.full(len(rounds), other)
            # Queues before this one have sent their part of the round.
            place += self.sent(rounds + (other < queue), which)
        return place


def _join(owner, first, last, place):
    """Runs of one document that follow each other in the output too become one."""
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (place[1:] != (place + last - first)[:-1])
    begins = np.flatnonzero(new)
    ends = np.append(begins[1:], len(owner)) - 1
    return owner[begins], first[begins], last[ends] if len(begins) else last[:0], place[begins]


def _cut(owner, first, last, place, window, total):
    """Cut runs of tokens [first, last) that stand at ``place`` where a sequence ends.

    What a last, partly filled window holds makes sequences of powers of two.
    """
    full = total // window * window
    ends, at = [], full
    for bit in reversed(range(window.bit_length())):
        if (total - full) >> bit & 1:
            at += 1 << bit
            ends.append(at)
    tail = np.array(ends, np.int64)

    def number(position):
        inside = position // window
        return np.where(position < full, inside, full // window + np.searchsorted(tail, position, side="right"))

    def begin(sequence):
        tail_begin = np.concatenate([[full], tail])
        beyond = np.clip(sequence - full // window, 0, len(tail_begin) - 1)
        return np.where(sequence <= full // window, sequence * window, tail_begin[beyond])

    low, high = number(place), number(place + (last - first) - 1)
    count = high - low + 1
    again = np.repeat(np.arange(len(first)), count)
    sequence = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    from_ = np.maximum(place[again], begin(sequence))
    to = np.minimum((place + last - first)[again], begin(sequence + 1))
    start = first[again] + from_ - place[again]
    return owner[again], start, to - from_, sequence, from_ - begin(sequence)


def pack(
    docs: DataFrame, vocabulary: str, targets: dict | None = None, window: int = WINDOW, with_ids: bool = True
) -> DataFrame:
    """Pack all documents into sequences of at most ``window`` tokens; one row per piece.

    ``targets`` maps sources (None for null) to their wanted share of the tokens of
    each window; by default it is their share of all tokens, so that every window
    looks like the whole. Each source has a queue of its documents in the order of the
    scan; rounds of deficit round-robin make one stream, which is cut into windows. A
    document is cut where the queue's turn or the window ends. Rows: doc_id, start
    (the document's ids before the piece), length, ids_crc32, doc_tokens, sequence_id,
    offset, source, and the ids if ``with_ids`` (else empty). All windows are full; the
    rest makes sequences of powers of two, so nothing is padded.

    A document is its ids and the id 1; null or empty text is that id alone. Repeated
    ids are separate documents. An empty table gives no rows. A very long document is
    split into pieces like any other. Only queue lengths (``MAX_QUEUES`` at most) reach
    the driver: what a queue has sent after any round has a closed form, so that every
    task places its documents by itself.
    """
    tokens = tokenise(docs, vocabulary)
    bases, lengths = queues(tokens, targets)
    found = sorted((r.queue, r.n, r.weight) for r in lengths.collect())
    names = {name: i for i, (name, _, _) in enumerate(found)}
    schedule = Schedule([n for _, n, _ in found], [w for _, _, w in found], window)
    total = int(schedule.length.sum())
    placed = tokens.join(
        bases, (F.col("part") == F.col("b_part")) & F.col("source").eqNullSafe(F.col("b_source"))
    ).select(
        "doc_id", "source", "queue", (F.col("base") + F.col("begin")).alias("begin"), "tokens", "wide", "ids"
    )

    def cut(batches):
        for batch in batches:
            queue = batch["queue"].map(names).to_numpy(np.int64)
            begin, n = batch["begin"].to_numpy(np.int64), batch["tokens"].to_numpy(np.int64)
            low = schedule.round_of(begin, queue)
            count = schedule.round_of(begin + n - 1, queue) - low + 1
            owner = np.repeat(np.arange(len(batch)), count)
            rounds = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            # A round may send nothing of this queue: such runs are empty and fall out.
            first = np.maximum(begin[owner], schedule.sent(rounds, queue[owner]))
            last = np.minimum((begin + n)[owner], schedule.sent(rounds + 1, queue[owner]))
            some = last > first
            owner, rounds, first, last = owner[some], rounds[some], first[some], last[some]
            place = schedule.before(rounds, queue[owner]) + first - schedule.sent(rounds, queue[owner])
            owner, first, last, place = _join(owner, first - begin[owner], last - begin[owner], place)
            owner, start, length, sequence, offset = _cut(owner, first, last, place, window, total)
            ids = [
                np.frombuffer(x, "<u4" if wide else "<u2").astype("<u4").tobytes()
                for x, wide in zip(batch["ids"], batch["wide"], strict=True)
            ]
            spans = zip(owner.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True)
            pieces = [ids[o][a:b] for o, a, b in spans]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64").take(owner).array,
                    "start": start,
                    "length": length,
                    "ids_crc32": [crc32(p) for p in pieces],
                    "doc_tokens": n[owner],
                    "sequence_id": sequence,
                    "offset": offset,
                    "source": batch["source"].take(owner).array,
                    "ids": pieces if with_ids else b"",
                }
            )

    return placed.mapInPandas(cut, PIECES)
