"""Passages that repeat across documents, by MinHash banding of paragraphs."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cmdlog_spark.llm import ngram_join
from cmdlog_spark.llm.common import discard, pick, short_lived_shuffles, slices, stage
from cmdlog_spark.llm.components import components
from cmdlog_spark.llm.repeats import repeated_parts
from cmdlog_spark.llm.words import BASE, LOWER, join_pieces, make_words, mix, ragged, segments
from cmdlog_spark.llm.words import BLANK as BLANKS

NEWLINE = 10
# Cells by which sets of shingles are told apart before they are built.
MARKS = 256
# Codes in a bucket that meet all at once where they are not connected yet.
SMALL = 16


@dataclass(frozen=True)
class Settings:
    """A pair at the least similarity shares a band with 1 - (1 - 0.8^3)^9 = 99.8 %.

    least_words: paragraphs with fewer are no passages. Documents also hold blocks of
    ``block`` words, across their lines; of ``spacing`` blocks in a row at least one is
    compared, so that a passage of block + spacing - 1 words is found anywhere. Edited copies inside longer
    texts are found by windows that begin and end with equal runs of ``size`` words: one
    run in ``anchors`` begins a window, the first such run ``reach`` words on ends it.
    """

    size: int = 5
    percent: int = 80
    bands: int = 9
    rows: int = 3
    least_words: int = 5
    block: int = 32
    spacing: int = 16
    anchors: int = 4
    reach: int = 44


def _runs(values: np.ndarray, first: np.ndarray, count: np.ndarray, power: np.ndarray, inverse: np.ndarray) -> np.ndarray:
    """Codes of runs of words, which depend on the words and their order only."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return mix((sums[first + count] - sums[first]) * inverse[first] + count.astype(np.uint64))


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (int(BASE), pow(int(BASE), -1, 1 << 64)):
        steps = np.full(max(1, size), base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


class Group:
    """Words, lines and blocks of some texts, in code points of their texts.

    ``last`` is the group before: if it ends within the first text of this one, its last
    ``carry`` words go before the own words in ``text``, ``hash_``, ``from_`` and ``to``.
    """

    def __init__(self, group: list[tuple[int, bytes]], passed: dict[int, int], last: Group | None = None, carry: int = 0):
        buffer, owners = join_pieces([(n, piece.translate(LOWER)) for n, piece in group])
        array = np.frombuffer(buffer, np.uint8)
        blank = BLANKS[array]
        change = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if not blank[0]:
            change = np.concatenate([[0], change])
        self.words = make_words(buffer, owners, change[::2], change[1::2])
        self.hash = self.words.hashes()
        points = np.concatenate([[0], np.cumsum((array & 0xC0) != 0x80)])
        ends = owners[1]
        begins = np.concatenate([[0], ends[:-1]])
        # A long text comes in pieces: code points go on where the last piece ended.
        base = []
        for (n, _), a, b in zip(group, begins.tolist(), ends.tolist(), strict=True):
            base.append(passed.get(n, 0) - int(points[a]))
            passed[n] = passed.get(n, 0) + int(points[b - 1] - points[a])
        piece = np.searchsorted(ends, self.words.start, side="right")
        shift = np.array(base, np.int64)[piece]
        self.start, self.end = points[self.words.start] + shift, points[self.words.end] + shift
        line = np.concatenate([[0], np.cumsum(array == NEWLINE)])[self.words.start]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (piece[1:] != piece[:-1])
        self.line_first = np.flatnonzero(new)
        self.line_words = np.diff(np.append(self.line_first, len(line)))
        left = np.repeat(self.line_first + self.line_words, self.line_words) - np.arange(len(line))
        none = np.zeros(0, np.int64)
        before = last.tail(group[0][0], carry) if last else (none, none.astype(np.uint64), none, none, none.astype(bool))
        self.text = np.concatenate([before[0], self.words.text])
        self.hash_ = np.concatenate([before[1], self.hash])
        self.from_ = np.concatenate([before[2], self.start])
        self.to = np.concatenate([before[3], self.end])
        self.taken = np.concatenate([before[4], np.zeros(len(line), bool)])
        # Words left in the line and in the text.
        self.in_line = np.concatenate([np.zeros(len(before[0]), np.int64), left])
        self.in_text = np.searchsorted(self.text, self.text, side="right") - np.arange(len(self.text))
        self.power, self.inverse = _powers(len(self.text) + 1)

    def tail(self, n: int, carry: int) -> tuple[np.ndarray, ...]:
        """The last words of this group, as far as they are of text ``n``."""
        first = max(len(self.text) - carry, int(np.searchsorted(self.text, n)))
        return tuple(x[first:] for x in (self.text, self.hash_, self.from_, self.to, self.taken))

    def lines(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and code of the lines with enough words."""
        chosen = self.line_words >= least
        first, count = self.line_first[chosen], self.line_words[chosen]
        return first, count, _runs(self.hash, first, count, self.power, self.inverse)

    def windows(self, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words, code and code of the ends of the windows."""
        text = self.words.text
        at = np.arange(max(0, len(text) - settings.size + 1))
        at = at[text[at] == text[at + settings.size - 1]]
        runs = _runs(self.hash, at, np.full(len(at), settings.size), self.power, self.inverse)
        # Whether a run is an anchor depends on its words only, so that edits elsewhere change nothing.
        chosen = mix(runs) % np.uint64(settings.anchors) == 0
        at, runs = at[chosen], runs[chosen]
        to = np.searchsorted(at, at + settings.reach)
        some = np.flatnonzero(to < len(at))
        to = to[some]
        near = (text[at[to]] == text[at[some]]) & (at[to] - at[some] < 2 * settings.reach)
        some, to = some[near], to[near]
        first, count = at[some], at[to] - at[some] + settings.size
        code = mix(_runs(self.hash, first, count, self.power, self.inverse))  # not that of an equal line
        return first, count, code, mix(runs[some] * BASE + runs[to])

    def shingles(self, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of all runs of ``size`` words of each line, and where each line's begin."""
        n = np.maximum(count - size + 1, 1)
        at = ragged(first, n)
        width = np.repeat(np.minimum(count, size), n)
        return _runs(self.hash, at, width, self.power, self.inverse), np.cumsum(n) - n

    def blocks(self, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
        """First word (of ``text``) and code of the blocks that are least among ``spacing``
        in a row, of their text or of their line, less those that the last group had."""
        at = np.flatnonzero(self.in_text >= settings.block)
        codes = np.zeros(len(self.text), np.uint64)
        codes[at] = _runs(self.hash_, at, np.full(len(at), settings.block), self.power, self.inverse)
        chosen = _least_in_a_row(codes, self.in_text >= settings.block, settings.spacing)
        chosen |= _least_in_a_row(codes, self.in_line >= settings.block, settings.spacing)
        new = np.flatnonzero(chosen & ~self.taken)
        self.taken |= chosen
        return new, codes[new]


def _least_in_a_row(values: np.ndarray, valid: np.ndarray, k: int) -> np.ndarray:
    """Whether a valid value is the least of the valid ones in some ``k`` places in a row."""
    worst = np.uint64(2**64 - 1)
    codes = np.where(valid, values, worst)
    if not valid.any() or len(codes) < k:
        return valid.copy()
    least = codes
    width = 1
    while width < k:  # minima over windows of doubling width
        step = min(width, k - width)
        least = np.minimum(least[: len(least) - step], least[step:])
        width += step
    padded = np.concatenate([np.zeros(k - 1, np.uint64), least, np.zeros(k - 1, np.uint64)])
    most = padded
    width = 1
    while width < k:
        step = min(width, k - width)
        most = np.maximum(most[: len(most) - step], most[step:])
        width += step
    # A short run has no window of its own: all its values count if it is near an end.
    return (codes == most) & valid


def groups(texts: list[str], settings: Settings | None = None):
    settings = settings or Settings()
    passed: dict[int, int] = {}
    last = None
    for group in segments([t.encode("utf-8", "replace") for t in texts]):
        # So many words hold one block less than are compared in a row.
        last = Group(group, passed, last, settings.block + settings.spacing - 2)
        yield last


def minhashes(shingles: np.ndarray, begin: np.ndarray, settings: Settings) -> np.ndarray:
    """One band key per line (rows) and band (columns)."""
    odd = mix(np.arange(1, settings.bands * settings.rows + 1, dtype=np.uint64)) | np.uint64(1)
    keys = np.zeros((len(begin), settings.bands), np.uint64)
    for band in range(settings.bands):
        key = np.full(len(begin), band + 1, np.uint64)
        for row in range(settings.rows):
            # The upper half of a product by an odd number is an order of its own.
            values = shingles * odd[band * settings.rows + row]
            values ^= values >> np.uint64(32)
            key = mix(key * BASE + np.minimum.reduceat(values * BASE, begin)) if len(begin) else key
        keys[:, band] = key
    return keys


def paragraphs(rows: DataFrame, settings: Settings) -> DataFrame:
    """Staged lines of all documents, with their band keys."""

    def find(batches):
        for batch in slices(batches):
            ids = batch["doc_id"].to_numpy()
            for g in groups(batch["text"].fillna("").tolist(), settings):
                if not len(g.hash):
                    continue
                first, count, code = g.lines(settings.least_words)
                if not len(first):
                    continue
                shingles, begin = g.shingles(first, count, settings.size)
                yield pd.DataFrame(
                    {
                        "doc_id": ids[g.words.text[first]],
                        "code": code.view(np.int64),
                        "start": g.start[first],
                        "end": g.end[first + count - 1],
                        "bands": [*minhashes(shingles, begin, settings).view(np.int64)],
                    }
                )

    return stage(rows.mapInPandas(find, "doc_id long, code long, start long, end long, bands array<long>"), "paragraphs")


def _parts(rows: DataFrame, take, several_codes: bool, name: str, settings: Settings) -> DataFrame:
    """``repeated_parts`` of what ``take`` finds in a group: key, code, text, start and end."""

    def find(batches):
        for batch in slices(batches):
            ids = batch["doc_id"].to_numpy()
            for g in groups(batch["text"].fillna("").tolist(), settings):
                if len(g.hash):
                    key, code, text, start, end = take(g)
                    yield key, code, ids[text], start, end - start

    return repeated_parts(rows, find, several_codes, name)


def open_windows(rows: DataFrame, settings: Settings) -> DataFrame:
    """Staged windows whose ends stand in several documents with different words between.

    Equal windows hold equal blocks.
    """

    def take(g: Group):
        first, count, code, ends = g.windows(settings)
        return ends, code, g.words.text[first], g.start[first], g.end[first + count - 1]

    found = _parts(rows, take, True, "windows", settings)
    return found.select("doc_id", "code", "start", "end", F.array("key").alias("bands"))


def repeated_blocks(rows: DataFrame, settings: Settings) -> DataFrame:
    """Staged blocks that several documents have."""

    def take(g: Group):
        first, code = g.blocks(settings)
        return code, code, g.text[first], g.from_[first], g.to[first + settings.block - 1]

    return _parts(rows, take, False, "blocks", settings).select("doc_id", "code", "start", "end")


def _with_codes(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose id is the w_id of wanted codes, with their list ``codes``."""
    listed = stage(wanted.groupBy("w_id").agg(F.collect_list("code").alias("codes")), "wanted")
    few = listed.limit(ngram_join.FEW + 1).count() <= ngram_join.FEW
    return rows.join(F.broadcast(listed) if few else listed, F.col("doc_id") == F.col("w_id")).drop("w_id")


def _shingled(rows: DataFrame, wanted: DataFrame, settings: Settings) -> DataFrame:
    """Staged shingles of the wanted lines and windows (w_id, code), those that overlap stored once.

    Rows doc_id; code, at and n: of each line or window the code, its first shingle and
    their number; shingles: in order of the text. All but doc_id are packed.
    """

    def build(batches):
        for batch in slices(batches):
            wanted_codes = [np.unique(np.array(codes, np.int64)) for codes in batch["codes"]]
            every = np.unique(np.concatenate([np.zeros(0, np.int64), *wanted_codes]))
            for g in groups(batch["text"].fillna("").tolist(), settings):
                if not len(g.hash):
                    continue
                lines, windows = g.lines(settings.least_words), g.windows(settings)
                first, count, code = (np.concatenate([x, y]) for x, y in zip(lines, windows[:3], strict=True))
                near = np.flatnonzero(np.isin(code.view(np.int64), every))
                near = near[np.argsort(g.words.text[first[near]], kind="stable")]
                texts, begin = np.unique(g.words.text[first[near]], return_index=True)
                out = []
                for text, own in zip(texts.tolist(), np.split(near, begin[1:]), strict=False):
                    signed, place = np.unique(code[own].view(np.int64), return_index=True)
                    place = own[place[np.isin(signed, wanted_codes[text])]]
                    if len(place):
                        at, n, shingles = _shared_shingles(g, first[place], count[place], settings.size)
                        packed = (code[place], at.astype(np.int32), n.astype(np.int32), shingles)
                        out.append((batch["doc_id"][text], *(x.tobytes() for x in packed)))
                yield pd.DataFrame(out, columns=["doc_id", "code", "at", "n", "shingles"])

    kinds = "doc_id long, code binary, at binary, n binary, shingles binary"
    return stage(_with_codes(rows, wanted).select("doc_id", "text", "codes").mapInPandas(build, kinds), "shingled")


def _shared_shingles(g: Group, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Of each run of words its first shingle and their number, and all shingles once in order."""
    whole = count >= size
    n = np.maximum(count - size + 1, 1)
    place = np.unique(ragged(first[whole], n[whole]))
    at = np.searchsorted(place, first)
    at[~whole] = len(place) + np.arange((~whole).sum())  # shorter runs are shingles of their own
    width = np.concatenate([np.full(len(place), size), count[~whole]])
    return at, n, _runs(g.hash, np.concatenate([place, first[~whole]]), width, g.power, g.inverse)


def _each_set(batch: pd.DataFrame):
    """Code and ascending set of shingles of the lines and windows in rows of ``_shingled``."""
    for row in batch.itertuples(index=False):
        code, shingles = np.frombuffer(row.code, np.int64), np.frombuffer(row.shingles, np.uint64)
        at, n = (np.frombuffer(x, np.int32).tolist() for x in (row.at, row.n))
        for i, one in enumerate(code.tolist()):
            yield row, one, np.unique(shingles[at[i] : at[i] + n[i]])


def _line_sets(shingled: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sets of shingles of the lines and windows (w_id, code) wanted."""

    def build(batches):
        for batch in slices(batches):
            batch["codes"] = [set(codes) for codes in batch["codes"]]
            found = [(code, own.tobytes()) for row, code, own in _each_set(batch) if code in row.codes]
            yield pd.DataFrame(found, columns=["code", "shingles"])

    built = _with_codes(shingled, wanted).drop("doc_id").mapInPandas(build, "code long, shingles binary")
    return built.groupBy("code").agg(F.first("shingles").alias("shingles"))


def _marks(shingled: DataFrame) -> DataFrame:
    """Staged size and cells of the set of each code: bit shingle % MARKS is set for each shingle."""

    def mark(batches):
        for batch in slices(batches):
            found = []
            for _, code, own in _each_set(batch):
                cells = np.zeros(MARKS, bool)
                cells[(own % np.uint64(MARKS)).astype(np.int64)] = True
                found.append((code, len(own), np.packbits(cells).tobytes()))
            yield pd.DataFrame(found, columns=["code", "n", "cells"])

    marked = shingled.mapInPandas(mark, "code long, n long, cells binary")
    return stage(marked.groupBy("code").agg(F.first("n").alias("n"), F.first("cells").alias("cells")), "marks")


def may_be_similar(pairs: DataFrame, marks: DataFrame, percent: int) -> DataFrame:
    """The pairs that their marks do not rule out: each cell that only one set has holds a
    shingle, at least, that the other lacks."""
    one, two = (marks.select(*(F.col(c).alias(f"{side}_{c}") for c in marks.columns)) for side in "ab")

    @F.pandas_udf("long")
    def only(left: pd.Series, right: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (left, right))
        return pd.Series(np.bitwise_count(x & ~y).sum(axis=1, dtype=np.int64))

    named = pairs.join(one, F.col("a") == F.col("a_code")).join(two, F.col("b") == F.col("b_code"))
    most = F.least(F.col("a_n") - only("a_cells", "b_cells"), F.col("b_n") - only("b_cells", "a_cells"))
    return named.filter((100 + percent) * most >= percent * (F.col("a_n") + F.col("b_n"))).select("a", "b")


def _prefixes(sets: DataFrame, settings: Settings) -> DataFrame:
    """Rows code, n, at, element: the rare shingles of each set, of which similar sets share one."""

    def codes_of(batch: pd.DataFrame) -> np.ndarray:
        return np.frombuffer(b"".join(batch["shingles"]), np.uint64)

    table = ngram_join.frequencies(sets.select("shingles"), codes_of)
    shared = sets.sparkSession.sparkContext.broadcast(table)

    def take(batches):
        for batch in slices(batches):
            own = [np.frombuffer(x, np.uint64) for x in batch["shingles"]]
            rare = [ngram_join.rare_first(x, shared.value, settings.percent) for x in own]
            count = np.array([len(x) for x in rare], np.int64)
            yield pd.DataFrame(
                {
                    "code": np.repeat(batch["code"].to_numpy(), count),
                    "n": np.repeat(np.array([len(x) for x in own], np.int64), count),
                    "at": ragged(np.zeros(len(count), np.int64), count).astype(np.int32),
                    "element": np.concatenate([np.zeros(0, np.uint64), *rare]).view(np.int64),
                }
            )

    return sets.select("code", "shingles").mapInPandas(take, "code long, n long, at int, element long")


def _of_several(placed: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in more than one component."""
    open_ = placed.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return placed.join(open_.filter("low < high").select(key), key, "left_semi")


def similar_lines(rows: DataFrame, lines: DataFrame, settings: Settings) -> DataFrame:
    """Links between codes of different lines that collide in a band and are similar.

    A line first meets one other: among those that lead its buckets, the one with most
    buckets that others share. Only buckets whose lines are not all connected then are
    left. In those of up to SMALL lines, lines of different components all meet. Larger
    ones may hold many lines that are edits of one but not similar, so there the
    lines meet that also share one of their rare shingles, as every similar pair does:
    no similar pair that collides is lost.
    """
    # Numbers are aggregated by hash, arrays would be sorted; windows have one key only.
    keys = [f"band_{i}" for i in range(max(1, settings.bands))]
    firsts = (F.first(F.get("bands", F.lit(i))).alias(k) for i, k in enumerate(keys))
    reps = lines.groupBy("code").agg(F.min("doc_id").alias("w_id"), *firsts)
    reps = reps.select("code", "w_id", F.array_compact(F.array(*keys)).alias("bands"))
    reps = stage(reps, "lines-once")
    buckets = reps.select("code", F.explode("bands").alias("gram"))
    shared = buckets.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    members = stage(buckets.join(shared.select("gram"), "gram"), "buckets")
    owners = reps.select("code", "w_id").join(members.select("code").distinct(), "code", "left_semi")
    owners = stage(owners.select("w_id", "code"), "bucket-lines")
    discard(reps)
    shingled = _shingled(rows, owners, settings)
    marks = _marks(shingled)

    central = members.groupBy("code").agg((-F.count("*")).alias("lonely"))
    by_rank = F.struct("lonely", F.xxhash64("code"), "code")
    ranked = members.join(central, "code")
    centres = ranked.groupBy("gram").agg(F.min(by_rank).alias("c"))
    # Of the centres of its buckets, a line is compared with the first in rank.
    pairs = members.join(centres, "gram").groupBy("code").agg(F.min("c").getField("code").alias("b"))
    pairs = pairs.filter("code <> b")
    near = pairs.select(F.least("code", "b").alias("a"), F.greatest("code", "b").alias("b")).distinct()
    near = stage(near, "line-pairs")
    links = _verified(near, owners, shingled, marks, settings, "line-links")

    found = components(links)
    placed = members.join(found, F.col("code") == F.col("node"), "left")
    placed = placed.select("gram", "code", F.coalesce("root", "code").alias("root"))
    placed = stage(_of_several(placed, "gram"), "line-open")
    discard(members)
    sizes = placed.groupBy("gram").agg(F.count("*").alias("size"))
    small = placed.join(sizes.filter(F.col("size") <= SMALL).select("gram"), "gram", "left_semi")
    large = stage(placed.join(sizes.filter(F.col("size") > SMALL).select("gram"), "gram", "left_semi"), "line-large")
    other = small.select(F.col("gram").alias("o_gram"), F.col("code").alias("o_code"), F.col("root").alias("o_root"))
    met = small.join(other, (F.col("gram") == F.col("o_gram")) & (F.col("root") < F.col("o_root")))
    met = met.select(F.least("code", "o_code").alias("a"), F.greatest("code", "o_code").alias("b"))

    codes = large.select("code", "root").distinct()
    large_sets = _line_sets(shingled, owners.join(codes, "code", "left_semi"))
    elements = _prefixes(large_sets, settings).join(codes, "code")
    elements = stage(_of_several(elements, "element").drop("root"), "line-elements")
    rare = large.join(elements, "code")
    rare = rare.withColumn("gram", F.xxhash64("gram", "element")).select("gram", "code", "n", "at", "root")
    rare = stage(_of_several(rare, "gram"), "line-rare")
    discard(large, elements)
    if not rare.isEmpty():
        # The original of edited copies shares most rare shingles: what is like it is connected first.
        central = rare.groupBy("code").agg((-F.count("*")).alias("lonely"))
        by_rank = F.struct("lonely", F.xxhash64("code"), "code", "n", "at")
        centres = rare.join(central, "code").groupBy("gram").agg(F.min(by_rank).alias("c"))
        centres = centres.select("gram", "c.code", "c.n", "c.at")
        plain, same = rare.select("gram", "code", "n", "at"), F.col("a_gram") == F.col("b_gram")
        hubs = ngram_join._candidates(plain, centres, same, settings.percent)
        hubs = stage(hubs.join(near, ["a", "b"], "left_anti"), "line-hubs")
        links = links.unionAll(_verified(hubs, owners, shingled, marks, settings, "line-hub-links"))
        near = near.unionAll(hubs)
        found = components(links)
        rare = plain.join(found, F.col("code") == F.col("node"), "left")
        rare = rare.select("gram", "code", "n", "at", F.coalesce("root", "code").alias("root"))
        rare = stage(_of_several(rare, "gram"), "line-rare")
    rest = met.unionAll(ngram_join._across(rare, settings.percent)).distinct()
    rest = stage(rest.join(near, ["a", "b"], "left_anti"), "line-rest")
    discard(placed, rare)
    late = _verified(rest, owners, shingled, marks, settings, "line-rest-links")
    discard(rest, owners, shingled, marks)
    return links.unionAll(late)


def _verified(
    pairs: DataFrame, owners: DataFrame, shingled: DataFrame, marks: DataFrame, settings: Settings, name: str
) -> DataFrame:
    """Staged pairs that are similar, judged on whole sets where marks cannot tell."""
    pairs = stage(may_be_similar(pairs, marks, settings.percent), "line-close")
    sets = stage(_line_sets(shingled, _ends(pairs, owners)), "line-sets")
    links = stage(ngram_join._verify(pairs, sets, settings.percent), name)
    discard(pairs, sets)
    return links


def _ends(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    codes = pairs.select(F.col("a").alias("code")).unionAll(pairs.select(F.col("b").alias("code")))
    return reps.join(codes.distinct(), "code", "left_semi").select("w_id", "code")


def repeated_passages(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Rows doc_id, start, end, removed, n_parts: passages that other documents have too.

    Paragraphs are lines with at least ``least_words`` words, ASCII case ignored. Lines
    that collide in a MinHash band and whose sets of runs of five words have a Jaccard
    similarity of ``percent`` or more are linked; the components are clusters. Blocks of
    words are clustered by equality, so that a passage is found within a longer
    paragraph and over several lines too, however they are wrapped. Windows of 49 to 92
    words with equal ends are linked and clustered as lines are, so that edited passages
    are found there too. In each cluster with several documents, the smallest doc_id
    keeps its passage. Overlapping passages of a document are joined: those that other
    documents keep (removed) and those that it keeps itself in rows of their own, which
    may overlap. To delete the removed rows leaves each repeated word in one document at
    least, a near copy in the form of the one that is kept. Documents without such passages
    have no row.

    Offsets are code points, end exclusive. Null and empty texts and documents without
    id have no passages; rows with one id are one document. A passage may repeat within
    its document only: then it has no row. An empty table gives no rows.
    """
    settings = settings or Settings()
    rows = pick(docs, doc_id="long", text="string").filter("doc_id IS NOT NULL")
    with short_lived_shuffles(docs.sparkSession):
        windows = open_windows(rows, settings)
        blocks = repeated_blocks(rows, settings)
        lines = paragraphs(rows, settings).unionAll(windows)
        links = similar_lines(rows, lines, settings)
        roots = components(links)

        # Copies of a code become one row before codes of one cluster meet.
        codes = lines.groupBy("code").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
        codes = codes.join(roots, F.col("code") == F.col("node"), "left")
        codes = stage(codes.withColumn("root", F.coalesce("root", "code")).drop("node"), "codes")
        clusters = codes.groupBy("root").agg(F.min("low").alias("keep_id"), F.max("high").alias("last_id"))
        clusters = codes.select("code", "root").join(clusters.filter("keep_id < last_id"), "root")
        kept = stage(clusters.select(F.col("code").alias("k_code"), "keep_id"), "clusters")
        discard(codes)
    spans = lines.join(kept, F.col("code") == F.col("k_code")).select("doc_id", "start", "end", "keep_id")

    several = blocks.groupBy("code").agg(F.min("doc_id").alias("keep_id"))
    several = several.select(F.col("code").alias("k_code"), "keep_id")
    inside = blocks.join(several, F.col("code") == F.col("k_code")).select("doc_id", "start", "end", "keep_id")
    return _merge(spans.unionAll(inside))


def _merge(spans: DataFrame) -> DataFrame:
    """Join what overlaps in a document, as many rows as it has passages.

    Parts that another document keeps and parts that this one keeps are joined apart.
    Where both lie on one word, the keeper of the other passage has that word: from
    document to document the ids fall, so the last of them keeps it.
    """
    removed = F.col("keep_id") < F.col("doc_id")
    order = W.partitionBy("doc_id", "removed").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = F.coalesce((F.col("start") > before).cast("int"), F.lit(1))
    islands = spans.withColumn("removed", removed).withColumn("new", starts)
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return islands.groupBy("doc_id", "removed", "island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_parts")
    ).select("doc_id", "start", "end", "removed", "n_parts")
