"""Near-duplicate documents by SimHash fingerprints, compared exactly in tiles."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, slices, stage
from cmdlog_spark.llm.components import components
from cmdlog_spark.llm.words import LOWER

BITS = 64
# Population counts are taken of so many equal parts of a fingerprint.
PARTS = 4
# Fingerprints on a side of a tile, and cells of a tile compared at a time.
BLOCK = 2_048
CELLS = 1 << 22
# Shingles of one text hashed at a time.
CHUNK = 1 << 16


@dataclass(frozen=True)
class Settings:
    """size: words in a shingle; radius: most differing bits of a link; seed: of XXH64."""

    size: int = 3
    radius: int = 2
    seed: int = 42


def fingerprint(text: str, settings: Settings) -> int:
    """A bit is 1 if more than half of the hashes of the text's shingles have it."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    size, seed = min(settings.size, len(words)), settings.seed
    total = len(words) - size + 1
    ones = np.zeros(BITS, np.int64)
    for start in range(0, total, CHUNK):
        some = words[start : start + CHUNK + size - 1]
        line = b" ".join(some)
        ends = np.cumsum([len(w) + 1 for w in some]) - 1
        begins = np.concatenate([[0], ends[:-1] + 1])
        spans = zip(begins[: len(ends) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
        codes = np.array([xxh64_intdigest(line[a:b], seed) for a, b in spans], "<u8")
        bits = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, settings: Settings) -> DataFrame:
    """Staged rows doc_id, code: the fingerprint as a signed number."""

    def sign(batches):
        for batch in slices(batches):
            codes = [fingerprint(t or "", settings) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"].astype("Int64"), "code": np.array(codes, np.uint64).view(np.int64)}
            )

    return stage(docs.mapInPandas(sign, "doc_id long, code long"), "fingerprints")


def _counts(code: Column) -> list[Column]:
    width = BITS // PARTS
    part = F.lit((1 << width) - 1)
    return [F.bit_count(F.shiftrightunsigned(code, width * i).bitwiseAND(part)).cast("int") for i in range(PARTS)]


def _cell(counts: list[Column]) -> Column:
    cell = F.lit(0)
    for count in counts:
        cell = cell * (BITS // PARTS + 1) + count
    return cell.cast("int")


def _pairs_within(left: np.ndarray, right: np.ndarray, radius: int, same: bool):
    """All pairs of two blocks within the radius; in one block each once, none with itself."""
    step = max(1, CELLS // max(1, len(right)))
    for start in range(0, len(left), step):
        some = left[start : start + step]
        # Of negative numbers numpy would count the bits of the absolute value.
        near = np.bitwise_count((some[:, None] ^ right[None, :]).view(np.uint64)) <= radius
        i, j = np.nonzero(near)
        a, b = some[i], right[j]
        keep = a < b if same else a != b
        yield a[keep], b[keep]


def links(codes: DataFrame, radius: int, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints (``code``) that differ in at most ``radius`` bits.

    Fingerprints with the same population counts of their parts are a row of tiles. The
    counts of two fingerprints differ by no more than their bits, so only rows whose
    counts differ by the radius at most, summed over the parts, meet; all others are
    skipped. Tiles hold about ``block`` fingerprints on a side however many share their
    counts, and every tile is compared whole. A fingerprint has at most 2,080 partners
    within two bits, so that links stay in proportion.
    """
    placed = codes.select("code", *(c.alias(f"p{i}") for i, c in enumerate(_counts(F.col("code")))))
    parts = [f"p{i}" for i in range(PARTS)]
    placed = placed.withColumn("cell", _cell([F.col(p) for p in parts]))
    # 17 ** 4 rows at most.
    cells = placed.groupBy("cell", *parts).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    cells = stage(cells, "cells")
    sizes = cells.select(F.col("cell").alias("s_cell"), "blocks")
    placed = placed.join(sizes, F.col("cell") == F.col("s_cell"))
    number = F.pmod(F.xxhash64("code"), F.col("blocks")).cast("int")
    blocks = placed.groupBy("cell", number.alias("block"), "blocks").agg(F.collect_list("code").alias("codes"))
    blocks = stage(blocks.select("cell", "block", "codes"), "blocks")

    steps = [s for s in product(range(-radius, radius + 1), repeat=PARTS) if sum(map(abs, s)) <= radius]
    moves = F.array(*(F.array(*(F.lit(d) for d in s)) for s in steps))
    moved = cells.select("cell", *parts, F.explode(moves).alias("by"))
    there = [F.col(p) + F.col("by")[i] for i, p in enumerate(parts)]
    inside = F.lit(True)
    for count in there:
        inside = inside & count.between(0, BITS // PARTS)
    moved = moved.filter(inside).select(F.col("cell").alias("n_cell"), _cell(there).alias("other"))
    meets = moved.join(sizes, F.col("other") == F.col("s_cell")).filter("n_cell <= other")
    meets = meets.select("n_cell", "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other_block"))

    one = blocks.join(meets, F.col("cell") == F.col("n_cell"))
    one = one.filter("cell < other OR block <= other_block")
    one = one.select("cell", "block", F.col("codes").alias("left"), "other", "other_block")
    two = blocks.select(F.col("cell").alias("t_cell"), F.col("block").alias("t_block"), F.col("codes").alias("right"))
    tiles = one.join(two, (F.col("other") == F.col("t_cell")) & (F.col("other_block") == F.col("t_block")))
    same = (F.col("cell") == F.col("t_cell")) & (F.col("block") == F.col("t_block"))
    tiles = tiles.select("left", "right", same.alias("same"))

    def compare(batches):
        for batch in batches:
            for left, right, one_block in zip(batch["left"], batch["right"], batch["same"], strict=True):
                for a, b in _pairs_within(np.asarray(left), np.asarray(right), radius, one_block):
                    if len(a):
                        yield pd.DataFrame({"a": a, "b": b})

    return tiles.mapInPandas(compare, "a long, b long")


def simhash_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs of other characters than ASCII white space, A-Z in lower case; shingles
    are runs of ``size`` words, repeats included, joined by a blank; a text with fewer
    words is one shingle. Without words, or null, the fingerprint is zero, which links like
    any other. Fingerprints link at ``radius`` differing bits or fewer; component_id is the
    smallest doc_id reachable. A null id is in no comparison of ids: its component is the
    smallest other id, or null. Repeated rows are rows of one class, other columns play no
    part, an empty table gives no rows.
    """
    settings = settings or Settings()
    signed = fingerprints(pick(docs, doc_id="long", text="string"), settings)
    once = stage(signed.groupBy("code").agg(F.min("doc_id").alias("low")), "codes")
    found = components(links(once.select("code"), settings.radius))
    named = once.join(found, F.col("code") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("root", "code"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = stage(named.join(least, "component").select(F.col("code").alias("c_code"), "component_id"), "classes")
    joined = signed.join(classes, F.col("code") == F.col("c_code"))
    digits = F.lpad(F.lower(F.hex("code")), 16, "0")
    return joined.select("doc_id", digits.alias("fingerprint"), "component_id")
