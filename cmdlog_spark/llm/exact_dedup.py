"""Exact deduplication through a sharded cuckoo index of live digests."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, stage, text_or_empty, without
from cmdlog_spark.llm.cuckoo import CuckooIndex

# Digests one task holds at a time; the number of shards follows the table.
SHARD_ROWS = 100_000

BLANKS = r"[\x20\x09-\x0D]+"


def digest_of(text: Column) -> Column:
    """SHA-256 of the text with each run of ASCII white space made one space."""
    return F.unhex(F.sha2(F.regexp_replace(text, BLANKS, " ").cast("binary"), 256))


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, digest and the part of the scan that read it."""
    rows = pick(docs, doc_id="long", text="string")
    return stage(
        rows.select(
            "doc_id", digest_of(text_or_empty()).alias("digest"), F.spark_partition_id().alias("part")
        ),
        "digests",
    )


def _shard(digest: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(shards)).cast("int")


def _count_batches(batches):
    """Copies within a batch become one row, so that a hot text is small before the shuffle."""
    for batch in batches:
        keys = ["shard", "digest", "part"]
        rows = batch.assign(nothing=batch["doc_id"].isna())
        rows["doc_id"] = rows["doc_id"].astype("Int64")
        smallest = rows.groupby(keys, sort=False)["doc_id"].transform("min")
        same = (rows["doc_id"] == smallest).fillna(False) | (rows["nothing"] & smallest.isna())
        rows["smallest"], rows["same"] = smallest, same.astype("int64")
        counted = rows.groupby(keys, sort=False).agg(
            doc_id=("smallest", "first"), copies=("same", "size"), firsts=("same", "sum")
        )
        yield counted.reset_index()


def _resolve(group: pd.DataFrame) -> pd.DataFrame:
    """Run the rows of one shard through its index, then answer for every part."""
    index = CuckooIndex(len(group))
    digests = [bytes(d) for d in group["digest"]]
    columns = (digests, group["doc_id"], group["copies"], group["firsts"])
    for digest, doc_id, copies, firsts in zip(*columns, strict=True):
        index.insert(digest, None if pd.isna(doc_id) else int(doc_id), int(copies), int(firsts))
    found = [index.find(d) for d in digests]
    return pd.DataFrame(
        {
            "part": group["part"],
            "digest": digests,
            "keep_id": pd.array([e[1] for e in found], dtype="Int64"),
            "group_size": [e[2] for e in found],
            "firsts": [e[3] for e in found],
        }
    ).drop_duplicates(["part", "digest"])


def exact_groups(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each part and digest of fingerprints(): keep_id, group_size and the rows with keep_id."""
    shards = max(1, -(-rows.count() // shard_rows))
    partial = rows.select("doc_id", "digest", "part", _shard(F.col("digest"), shards).alias("shard"))
    partial = partial.mapInPandas(
        _count_batches, "shard int, digest binary, part int, doc_id long, copies long, firsts long"
    )
    return partial.groupBy("shard").applyInPandas(
        _resolve, "part int, digest binary, keep_id long, group_size long, firsts long"
    )


def exact_dedup(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when equal after white space is joined; a null text is empty,
    and empty texts are one group. The smallest doc_id stays; a null id is never
    smaller than another, and stays only where no other id is in the group. Of
    rows with the same id and text one is kept. An empty table gives no rows.

    Digests go to shards of bounded size, each with a cuckoo index that verifies
    hits against its stored digests. A hot text is counted per batch first, and the
    answer comes back per part of the scan, so that no task meets all its copies.
    """
    rows = fingerprints(docs)
    groups = exact_groups(rows, shard_rows)
    first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    joined = rows.join(groups, ["part", "digest"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        first.alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        (first & (F.col("firsts") > 1)).alias("again"),
    )
    return _keep_one(stage(joined, "exact"))


def _keep_one(rows: DataFrame) -> DataFrame:
    """Of rows alike in id and text, ``kept`` holds for one: count them, write them out again."""
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    counted = rows.filter("again").groupBy(*names).agg(F.count("*").alias("n"))
    numbered = counted.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    again = numbered.withColumn("kept", F.col("k") == 1)
    return rows.filter(~F.col("again")).select(*names).unionAll(again.select(*names))


def keep_exact_firsts(docs: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The documents with all their columns, one of each group of equal texts."""
    result = exact_dedup(docs, shard_rows)
    copies = result.filter(~F.col("kept")).groupBy("doc_id", F.unhex("text_sha256").alias("key"))
    is_first = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return without(docs, stage(copies.agg(F.max(is_first).alias("one_stays")), "copies"), digest_of)


def apply_changes(live: DataFrame, inserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """Update an index of live digests: rows (digest binary, doc_id long, copies long).

    ``live`` is such a table, or an earlier result. ``inserts`` and ``deletes`` hold
    digest and doc_id, one row per document. Deletes go before inserts; deleting an
    unknown digest does nothing. Returns the digests still live with their number
    of copies, ``was_live`` (before the change) and doc_id, the smallest id that the
    index has seen for the digest since it became live. Empty inputs are allowed.
    """

    def part(df: DataFrame, step: int, copies: Column) -> DataFrame:
        # One row per digest first: a hot text stays small.
        rows = df.select("digest", F.col("doc_id").cast("long").alias("doc_id"), copies.alias("copies"))
        counted = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.sum("copies").alias("copies"))
        return counted.withColumn("step", F.lit(step))

    rows = stage(
        part(live, 0, F.col("copies").cast("long"))
        .unionAll(part(deletes, 1, F.lit(1).cast("long")))
        .unionAll(part(inserts, 2, F.lit(1).cast("long"))),
        "changes",
    )
    shards = max(1, -(-rows.count() // SHARD_ROWS))

    def change(group: pd.DataFrame) -> pd.DataFrame:
        index, before = CuckooIndex(len(group)), set()
        for row in group.sort_values("step", kind="stable").itertuples(index=False):
            digest, doc_id = bytes(row.digest), None if pd.isna(row.doc_id) else int(row.doc_id)
            if row.step == 1:
                index.delete(digest, int(row.copies))
                continue
            index.insert(digest, doc_id, int(row.copies))
            if row.step == 0:
                before.add(digest)
        out = [(e[0], e[1], e[2], e[0] in before) for e in index.entries()]
        frame = pd.DataFrame(out, columns=["digest", "doc_id", "copies", "was_live"])
        return frame.astype({"doc_id": "Int64", "copies": "int64", "was_live": "bool"})

    sharded = rows.withColumn("shard", _shard(F.col("digest"), shards))
    return sharded.groupBy("shard").applyInPandas(
        change, "digest binary, doc_id long, copies long, was_live boolean"
    )
