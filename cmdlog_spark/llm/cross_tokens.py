"""Counts of ids of two tokenizers that cover the same bytes, over a whole corpus."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, slices, stage
from cmdlog_spark.llm.token_align import BITS, aligner

# Pairs that are broadcast with their counts, the most frequent ones: 16 bytes each.
MOST_PAIRS = 1 << 18
# Distinct irregular pairs that a task gathers before it hands them on.
GATHERED = 1 << 20
PAGE = 1 << 12


@dataclass(frozen=True)
class Vocabularies:
    """a: byte-level BPE in JSON; b: a sentencepiece model. Paths on every executor."""

    a: str
    b: str


def _halves(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return code >> BITS, code & ((1 << BITS) - 1)


def read_documents(docs: DataFrame, vocabularies: Vocabularies, with_groups: bool = False) -> DataFrame:
    """Staged rows with the token groups of every document and its distinct linked pairs.

    row, doc_id, n_a, n_b, n_groups, n_links, groups_sha256, groups; same: ids of A that
    are linked with their partner, the id of B with the same bytes; a, b: the ids of other
    pairs; same_times, times: how often.
    """
    names = vocabularies

    def read(batches):
        reader = aligner(names.a, names.b)
        for batch in slices(batches):
            ids = batch["doc_id"].astype("Int64")
            for block in reader.read(batch["text"].tolist(), with_groups):
                texts = len(block.n_a)
                left, right = _halves(block.code)
                regular = reader.same[left] == right
                lists = {}
                for chosen, columns in (
                    (regular, {"same": left, "same_times": block.times}),
                    (~regular, {"a": left, "b": right, "times": block.times}),
                ):
                    cuts = np.searchsorted(block.owner[chosen], np.arange(1, texts))
                    lists |= {k: np.split(v[chosen], cuts) for k, v in columns.items()}
                yield pd.DataFrame(
                    {
                        "doc_id": ids.iloc[block.first : block.first + texts].array,
                        "n_a": block.n_a, "n_b": block.n_b, "n_groups": block.n_groups, "n_links": block.n_links,
                        "groups_sha256": block.digest,
                        "groups": [None if g is None else g.decode() for g in block.groups],
                        **lists,
                    }
                )

    numbers = "n_a long, n_b long, n_groups long, n_links long"
    lists = "same array<int>, same_times array<long>, a array<int>, b array<int>, times array<long>"
    read_ = docs.mapInPandas(read, f"doc_id long, {numbers}, groups_sha256 string, groups string, {lists}")
    return stage(read_.withColumn("row", F.monotonically_increasing_id()), "token-groups")


def _flat(column: pd.Series) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *column])


def tally(documents: DataFrame, size: int) -> DataFrame:
    """Staged partial counts of documents for each pair of linked ids.

    Pairs of an id and its partner, which are most, are counted in a vector as long as the
    vocabulary: rows (page, counts), a vector cut in pages. The others are rows (code, n),
    distinct within a task as long as they fit in memory.
    """

    def count(batches):
        vector = np.zeros(size, np.int64)
        codes, counts, waiting = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def gathered():
            found, n = np.unique(np.concatenate([codes[:0], *waiting]), return_counts=True)
            both, total = np.concatenate([codes, found]), np.concatenate([counts, n])
            key, place = np.unique(both, return_inverse=True)
            return key, np.bincount(place, weights=total, minlength=len(key)).astype(np.int64)

        def rows(**columns):
            blank = {"code": None, "n": None, "page": None, "counts": None}
            frame = pd.DataFrame({**blank, **columns})
            return frame.astype({"code": "Int64", "n": "Int64", "page": "Int64"})

        for batch in slices(batches):
            vector += np.bincount(_flat(batch["same"]).astype(np.int64), minlength=size)
            waiting.append(_flat(batch["a"]).astype(np.int64) << BITS | _flat(batch["b"]).astype(np.int64))
            if sum(map(len, waiting)) > GATHERED:
                codes, counts = gathered()
                waiting = []
                if len(codes) > GATHERED:
                    yield rows(code=codes, n=counts)
                    codes, counts = codes[:0], counts[:0]
        codes, counts = gathered()
        if len(codes):
            yield rows(code=codes, n=counts)
        for start in range(0, len(vector), PAGE):
            part = vector[start : start + PAGE]
            if part.any():
                yield rows(page=[start // PAGE], counts=[part.astype("<i8").tobytes()])

    kinds = "code long, n long, page long, counts binary"
    return stage(documents.select("same", "a", "b").mapInPandas(count, kinds), "pair-tally")


def regular_counts(tallied: DataFrame, size: int) -> np.ndarray:
    """For each id of A the documents in which it is linked with its partner."""

    def add(batches):
        total = np.zeros(size + PAGE, np.int64)
        for batch in batches:
            for page, counts in zip(batch["page"], batch["counts"], strict=True):
                part = np.frombuffer(counts, "<i8")
                total[page * PAGE : page * PAGE + len(part)] += part
        some = np.flatnonzero(total)
        yield pd.DataFrame({"id": some, "n": total[some]})

    # A few vectors first, then one: a vector for each task that read texts would be many.
    pages = tallied.filter("page IS NOT NULL").select("page", "counts")
    summed = pages.repartition(16).mapInPandas(add, "id long, n long")
    rows = summed.groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # a row per id at most
    vector = np.zeros(size, np.int64)
    vector[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return vector


def irregular_counts(tallied: DataFrame) -> DataFrame:
    """Staged rows (code, n) of the pairs that are not an id and its partner."""
    rows = tallied.filter("code IS NOT NULL").groupBy("code").agg(F.sum("n").alias("n"))
    return stage(rows, "pairs")


def _frequent(pairs: DataFrame, most: int) -> int:
    """The least count from which on there are at most ``most`` pairs."""
    step = F.floor(F.log2("n") * 8).cast("long")
    rows = pairs.groupBy(step.alias("step")).agg(F.count("*").alias("rows"), F.min("n").alias("low"))
    total, least = 0, None
    for row in sorted(rows.collect(), key=lambda r: -r.step):  # 8 rows a doubling
        total += row.rows
        if total > most:
            return least if least is not None else row.low + (1 << 62)
        least = row.low
    return least or 0


def pair_counts(docs: DataFrame, vocabularies: Vocabularies) -> DataFrame:
    """Rows a, b, documents for every pair of ids that some document holds linked."""
    same = aligner(vocabularies.a, vocabularies.b).same
    tallied = tally(read_documents(pick(docs, doc_id="long", text="string"), vocabularies), len(same))
    regular = regular_counts(tallied, len(same))
    some = np.flatnonzero(regular)
    frame = pd.DataFrame({"a": some, "b": same[some], "documents": regular[some]}, dtype="int64")
    rest = irregular_counts(tallied)
    low = F.lit((1 << BITS) - 1)
    rest = rest.select(F.shiftright("code", BITS).alias("a"), F.col("code").bitwiseAND(low).alias("b"), F.col("n").alias("documents"))
    return rest.unionAll(docs.sparkSession.createDataFrame(frame, "a long, b long, documents long"))


def align(
    docs: DataFrame, vocabularies: Vocabularies, with_groups: bool = False, most_pairs: int = MOST_PAIRS
) -> DataFrame:
    """Token groups of every document under two tokenizers, and how common their links are.

    A encodes a blank and the text, B the text, before which it puts a blank itself. The
    byte offsets where tokens of both end cut them into groups; every token of A is linked
    with every token of B in its group. The count of a pair of ids is the number of
    documents that hold it linked. One row per document: doc_id, n_a, n_b, n_groups,
    n_links, n_best (links whose count is the highest of their A id, ties too), count_sum
    (of all links), groups_sha256 of 'a1,a2|b1;a3|b2,b3' and, with ``with_groups``, that
    text. Null and empty texts, and texts that a tokenizer does not give back byte for
    byte, have no tokens: zeros and ''. Equal and null ids are rows like others, other
    columns play no part, an empty table gives no rows.

    Groups of one token each, whose ids have the same bytes, are counted in vectors; only
    the other pairs are shuffled. The ``most_pairs`` most frequent of them are broadcast
    with their counts, the rest are joined. A group that never ends on both sides costs
    the product of its distinct ids, which the vocabularies bound.
    """
    documents = read_documents(pick(docs, doc_id="long", text="string"), vocabularies, with_groups)
    size = len(aligner(vocabularies.a, vocabularies.b).same)
    tallied = tally(documents, size)
    regular = regular_counts(tallied, size)
    pairs = irregular_counts(tallied)
    left = F.shiftright("code", BITS)
    highest = pairs.groupBy(left.alias("a")).agg(F.max("n").alias("n")).toPandas()  # a row per id at most
    best = regular.copy()
    at = highest["a"].to_numpy(np.int64)
    best[at] = np.maximum(best[at], highest["n"].to_numpy(np.int64))
    least = _frequent(pairs, most_pairs)
    head = pairs.filter(F.col("n") >= least).toPandas()  # most_pairs rows at most
    order = np.argsort(head["code"].to_numpy(np.int64))
    shared = docs.sparkSession.sparkContext.broadcast(
        (regular, best, head["code"].to_numpy(np.int64)[order], head["n"].to_numpy(np.int64)[order])
    )

    def score(batches):
        regular, best, codes, counts = shared.value
        for batch in slices(batches):
            texts = len(batch)
            n_best, count_sum = np.zeros(texts, np.int64), np.zeros(texts, np.int64)

            def add(a, owner, times, n, n_best=n_best, count_sum=count_sum):
                is_best = (n > 0) & (n == best[a])
                np.add.at(n_best, owner[is_best], times[is_best])
                np.add.at(count_sum, owner, times * n)

            same = _flat(batch["same"]).astype(np.int64)
            owner = np.repeat(np.arange(texts), batch["same"].map(len))
            add(same, owner, _flat(batch["same_times"]), regular[same])
            a, times = _flat(batch["a"]).astype(np.int64), _flat(batch["times"])
            code = a << BITS | _flat(batch["b"]).astype(np.int64)
            owner = np.repeat(np.arange(texts), batch["a"].map(len))
            n = np.zeros(len(code), np.int64)
            if len(codes):
                place = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                n = np.where(codes[place] == code, counts[place], 0)
            add(a, owner, times, n)
            lost = np.flatnonzero(n == 0)
            cuts = np.searchsorted(owner[lost], np.arange(1, texts))
            lists = {"code": code[lost], "times": times[lost], "best": best[a[lost]]}
            yield batch[plain].assign(
                n_best=n_best, count_sum=count_sum, **{k: np.split(v, cuts) for k, v in lists.items()}
            )

    plain = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    numbers = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    kinds = f"row long, doc_id long, {numbers}, code array<long>, times array<long>, best array<long>"
    lists = ["same", "same_times", "a", "b", "times"]
    scored = stage(documents.select(*plain, *lists).mapInPandas(score, kinds), "aligned")
    open_ = scored.filter(F.size("code") > 0).select("row", F.explode(F.arrays_zip("code", "times", "best")).alias("p"))
    rare = pairs.filter(F.col("n") < least).withColumnRenamed("code", "p_code")
    joined = open_.select("row", "p.code", "p.times", "p.best").join(rare, F.col("code") == F.col("p_code"))
    more = joined.groupBy(F.col("row").alias("m_row")).agg(
        F.sum(F.when(F.col("n") == F.col("best"), F.col("times")).otherwise(0)).alias("m_best"),
        F.sum(F.col("times") * F.col("n")).alias("m_sum"),
    )
    whole = scored.join(more, F.col("row") == F.col("m_row"), "left")
    if with_groups:
        texts = documents.select(F.col("row").alias("g_row"), "groups")
        whole = whole.join(texts, F.col("row") == F.col("g_row"))
    return whole.select(
        *["doc_id", "n_a", "n_b", "n_groups", "n_links"],
        (F.col("n_best") + F.coalesce("m_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("m_sum", F.lit(0))).alias("count_sum"),
        *(["groups_sha256", "groups"] if with_groups else ["groups_sha256"]),
    )
