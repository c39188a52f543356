"""Words that differ by one letter, grouped under their most frequent form."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, slices, stage

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
# Distinct words that a task counts before it hands them on.
GATHERED = 300_000
# Rows of a tile side, and about how many rows meet in a tile that no key overfills.
BLOCK = 2_048
TILE = 1_024
# Cells of a comparison held at a time.
CELLS = 1 << 22


@dataclass(frozen=True)
class Settings:
    """least_length: code points of a word; least_count: occurrences; times: how much more
    frequent a form is; typos: one run in so many loses a letter (0: none)."""

    least_length: int = 6
    least_count: int = 5
    times: int = 5
    typos: int = 0


def word_counts(docs: DataFrame, settings: Settings) -> DataFrame:
    """Staged rows word, n over whole texts."""
    typos = settings.typos

    def count(batches):
        total: Counter = Counter()
        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                prefix = zlib.crc32(f"{'' if pd.isna(doc_id) else doc_id}:".encode())
                for word, n in Counter(RUN.findall((text or "").translate(LOWER))).items():
                    if typos:
                        h = zlib.crc32(word.encode(), prefix)
                        if h % typos == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= settings.least_length:
                        total[word] += n
            if len(total) > GATHERED:
                yield pd.DataFrame({"word": list(total), "n": list(total.values())})
                total = Counter()
        if total:
            yield pd.DataFrame({"word": list(total), "n": list(total.values())})

    counted = docs.mapInPandas(count, "word string, n long")
    summed = counted.groupBy("word").agg(F.sum("n").alias("n"))
    return stage(summed.filter(F.col("n") >= settings.least_count), "words")


def _matrix(words: list[str], width: int) -> np.ndarray:
    """Code points, one row per word, padded with zeros to ``width``."""
    data = "".join(w.ljust(width, "\0") for w in words).encode("utf-32-le")
    return np.frombuffer(data, "<u4").reshape(len(words), width)


def single_edits(left: list[str], right: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs, one word of each side, that one edit turns into each other.

    Words of one length, or of two that differ by one, are compared as padded matrices:
    a single edit leaves a common beginning and a common end that together are as long
    as the longer word less one. Equal words are no pair.
    """
    sizes = [np.array([len(w) for w in side], np.int64) for side in (left, right)]
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for width in np.unique(sizes[0]).tolist():
        rows = np.flatnonzero(sizes[0] == width)
        a = _matrix([left[i] for i in rows], width)
        for other in (width - 1, width, width + 1):
            columns = np.flatnonzero(sizes[1] == other)
            if not len(columns):
                continue
            b = _matrix([right[i] for i in columns], other)
            step = max(1, CELLS // len(columns))
            for start in range(0, len(rows), step):
                i, j = _near(a[start : start + step], b)
                out.append((rows[start + i], columns[j]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _near(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shorter, longer = sorted((a.shape[1], b.shape[1]))
    common = np.zeros((len(a), len(b)), np.int32)
    for x, y in ((a, b), (a[:, ::-1], b[:, ::-1])):
        alive = np.ones(common.shape, bool)
        for column in range(shorter):
            alive &= x[:, column, None] == y[None, :, column]
            if not alive.any():
                break
            common += alive
    # Equal words share more than that on both sides.
    found = (common >= longer - 1) & ~((shorter == longer) & (common == 2 * longer))
    return np.nonzero(found)


def near_words(words: DataFrame, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """Rows word, other, other_n for all ordered pairs of words one edit apart.

    One edit leaves the first or the last half of the shorter word as it is. So each word
    goes to the tiles of its halves, as the shorter and as the longer word of a pair, and
    all words of a tile are compared. Tiles hold many halves; a half with very many words
    is cut into blocks, and every pair of its blocks is a tile of its own.
    """
    length = F.char_length("word")
    keys = []
    for size in (length, length - 1):  # of the shorter word of the pair
        half = F.floor(size / 2).cast("int")
        first, last = F.substring("word", 1, half), F.substring("word", -half, half)
        keys += [F.xxhash64(size, F.lit(kind), part) for kind, part in ((0, first), (1, last))]
    spread = words.select("word", "n", F.explode(F.array(*keys)).alias("key"))
    spread = stage(spread, "halves")
    tiles = max(1, spread.count() // tile)
    spread = spread.withColumn("tile", F.pmod("key", F.lit(tiles)))
    sizes = spread.groupBy("tile").agg(F.count("*").alias("rows"))
    large = sizes.filter(F.col("rows") > block).select(
        F.col("tile").alias("l_tile"), F.ceil(F.col("rows") / block).cast("int").alias("blocks")
    )
    placed = spread.join(large, F.col("tile") == F.col("l_tile"), "left").select(
        "word", "n", "tile", F.coalesce("blocks", F.lit(1)).alias("blocks")
    )
    own = F.pmod(F.xxhash64("word", F.lit(7)), F.col("blocks")).cast("int")
    placed = placed.withColumn("own", own)
    meets = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    meets = meets.select("tile", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "word", "n")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, x, y = key
        sides = [rows[rows["own"] == b] for b in (x, y)]
        left, right = ([*side["word"]] for side in sides)
        i, j = single_edits(left, right)
        a, b = sides[0].iloc[i], sides[1].iloc[j]
        there = {"word": a["word"].array, "other": b["word"].array, "other_n": b["n"].array}
        back = {"word": b["word"].array, "other": a["word"].array, "other_n": a["n"].array}
        frames = [pd.DataFrame(there)] if x == y else [pd.DataFrame(there), pd.DataFrame(back)]
        return pd.concat(frames)

    found = meets.groupBy("tile", "x", "y").applyInPandas(compare, "word string, other string, other_n long")
    return found.groupBy("word", "other").agg(F.first("other_n").alias("other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """Rows word, root from rows word, form: forms followed to the last.

    Every round doubles the steps taken; a form is ``times`` as frequent as its word, so
    the chains are short.
    """
    roots = forms.select("word", F.col("form").alias("root"))
    while True:
        on = roots.select(F.col("word").alias("n_word"), F.col("root").alias("n_root"))
        further = roots.join(on, F.col("root") == F.col("n_word"), "left")
        moved = further.select("word", F.coalesce("n_root", "root").alias("root"), F.col("n_root").isNotNull().alias("moved"))
        roots = stage(moved, "roots")
        if not roots.filter("moved").limit(1).count():
            return roots.select("word", "root")


def spelling_variants(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Words with the frequent word that each is likely a misspelling of.

    Words are runs of Latin-1 letters of whole texts, A-Z in lower case, of at least
    ``least_length`` code points and ``least_count`` occurrences. Two are near if one
    inserted, deleted or replaced code point turns one into the other. A word's form is
    its near word with the most occurrences (ties: smallest in code-point order), if it
    has ``times`` as many as the word. Columns word, n, n_near, form, form_n (null without
    a form), root (forms followed to the last, else the word). With ``typos`` a run loses
    the letter h % length if h, the crc32 of '<doc_id>:<run>', is a multiple of it; a null
    id counts as ''. Null and empty texts have no words; repeated rows count again; other
    columns play no part; an empty table gives no rows.
    """
    settings = settings or Settings()
    words = word_counts(pick(docs, doc_id="long", text="string"), settings)
    near = near_words(words)
    best = near.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("top")
    )
    best = best.select(F.col("word").alias("b_word"), "n_near", "top")
    joined = words.join(best, F.col("word") == F.col("b_word"), "left")
    is_form = -F.col("top.less") >= settings.times * F.col("n")
    named = stage(
        joined.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(is_form, F.col("top.other")).alias("form"),
            F.when(is_form, -F.col("top.less")).alias("form_n"),
        ),
        "forms",
    )
    roots = _roots(named.filter("form IS NOT NULL")).withColumnRenamed("word", "r_word")
    whole = named.join(roots, F.col("word") == F.col("r_word"), "left")
    return whole.select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
