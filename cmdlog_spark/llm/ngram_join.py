"""Jaccard join of documents on word n-grams, by rare-first prefix filtering."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import discard, pick, slices, stage, text_or_empty, without
from cmdlog_spark.llm.components import components
from cmdlog_spark.llm.words import LOWER, mix, shingle_hashes

# Cells of the frequency table, at any size of the corpus.
CELLS = 1 << 20
# Parts of the suffix filter.
PARTS = 64
PAGE = 1 << 16
# Documents whose ids are broadcast to fetch their texts; more are shuffled.
FEW = 200_000


@dataclass(frozen=True)
class Settings:
    """size: words in a shingle; percent: least similarity, 100 * Jaccard."""

    size: int = 4
    percent: int = 85


def text_key(text: Column) -> Column:
    """Tells apart the texts of one id."""
    return F.xxhash64(text)


def shingle_sets(texts: list[str], size: int) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode("utf-8", "replace").translate(LOWER) for t in texts]
    return shingle_hashes(data, size)


def _cells(codes: np.ndarray, cells: int) -> np.ndarray:
    return (codes & np.uint64(cells - 1)).astype(np.int64)


def frequencies(sets: DataFrame, codes_of, cells: int = CELLS) -> np.ndarray:
    """For each cell a step of the logarithm of its shingles, over all rows of ``sets``.

    ``codes_of`` gives the shingles of a batch. The table has one size, whatever the number
    of documents; shingles that share a cell only blur the order in which prefixes are
    taken, not the result. Every task hands on its counts as a few packed pages, which
    are summed as they come by, first in groups of tasks.
    """
    pages = -(-cells // PAGE)

    def packed(total: np.ndarray) -> pd.DataFrame:
        parts = [total[p * PAGE : (p + 1) * PAGE].astype("<i8") for p in range(pages)]
        some = [p for p in range(pages) if parts[p].any()]
        return pd.DataFrame({"page": np.array(some, np.int32), "counts": [parts[p].tobytes() for p in some]})

    def count(batches):
        total = np.zeros(cells, np.int64)
        for batch in slices(batches):
            total += np.bincount(_cells(codes_of(batch), cells), minlength=cells)
        yield packed(total)

    def add(batches):
        total = np.zeros(pages * PAGE, np.int64)
        for batch in batches:
            for page, counts in zip(batch["page"], batch["counts"], strict=True):
                part = np.frombuffer(counts, "<i8")
                total[page * PAGE : page * PAGE + len(part)] += part
        yield packed(total)

    kinds = "page int, counts binary"
    few = sets.mapInPandas(count, kinds).repartition(16).mapInPandas(add, kinds)

    def steps(batches):
        # Steps of 1/8 of a doubling, one byte each.
        for batch in add(batches):
            total = [np.frombuffer(c, "<i8") for c in batch["counts"]]
            step = [np.minimum(np.log2(np.maximum(t, 1)) * 8, 255).astype(np.uint8).tobytes() for t in total]
            yield pd.DataFrame({"page": batch["page"], "steps": step})

    table = np.zeros(cells, np.uint8)
    for row in few.repartition(pages, "page").mapInPandas(steps, "page int, steps binary").collect():  # CELLS bytes
        part = np.frombuffer(row.steps, np.uint8)
        table[row.page * PAGE : row.page * PAGE + len(part)] = part
    return table


def rare_first(codes: np.ndarray, table: np.ndarray, percent: int) -> np.ndarray:
    """The prefix of an ascending set: its rarest shingles, ties in order of codes."""
    order = np.argsort(table[_cells(codes, len(table))], kind="stable")
    return codes[order[: int(prefix_length(np.int64(len(codes)), percent))]]


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Two sets that reach the similarity share one of their first so many elements."""
    return np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)


def signatures(docs: DataFrame, settings: Settings, shared) -> DataFrame:
    """Staged rows doc_id, key, n_shingles, code (of the set), prefix (rare first) and parts.

    Equal sets have equal codes of 64 bits; the codes of their shingles have 64 bits too.
    """

    def sign(batches):
        table = shared.value
        for batch in slices(batches):
            codes, cuts = shingle_sets(batch["text"].fillna("").tolist(), settings.size)
            keys = table[_cells(codes, len(table))]
            n = np.diff(cuts)
            length = prefix_length(n, settings.percent)
            prefixes, parts, code = [], [], []
            for a, b, k in zip(cuts[:-1].tolist(), cuts[1:].tolist(), length.tolist(), strict=True):
                own = codes[a:b]
                order = np.argsort(keys[a:b], kind="stable")[:k]  # codes ascend already
                prefixes.append(own[order].view(np.int64))
                part = np.bincount((own >> np.uint64(40)).astype(np.int64) % PARTS, minlength=PARTS)
                parts.append(np.minimum(part, 65_535).astype("<u2").tobytes())
                code.append(_set_code(own))
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "key": batch["key"],
                    "n_shingles": n,
                    "code": np.array(code, np.uint64).view(np.int64),
                    "prefix": prefixes,
                    "parts": parts,
                }
            )

    schema = "doc_id long, key long, n_shingles long, code long, prefix array<long>, parts binary"
    return stage(docs.mapInPandas(sign, schema), "signatures")


def _set_code(codes: np.ndarray) -> np.uint64:
    total = np.array([len(codes)], np.uint64)
    total += mix(codes ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)
    return mix(total)[0]


def _long_enough(n: Column, other: Column, percent: int) -> Column:
    return 100 * F.least(n, other) >= percent * F.greatest(n, other)


def _may_reach(n: Column, at: Column, other: Column, other_at: Column, percent: int) -> Column:
    """Positional filter: what can still be shared from the first common element on."""
    most = 1 + F.least(n - at - 1, other - other_at - 1)
    return (100 + percent) * most >= percent * (n + other)


def _candidates(left: DataFrame, right: DataFrame, on: Column, percent: int) -> DataFrame:
    """Pairs of codes that share a prefix element and pass the length and positional filters."""
    a = left.select(*(F.col(k).alias(f"a_{k}") for k in left.columns))
    b = right.select(*(F.col(k).alias(f"b_{k}") for k in right.columns))
    passes = (
        (F.col("a_code") != F.col("b_code"))
        & _long_enough(F.col("a_n"), F.col("b_n"), percent)
        & _may_reach(F.col("a_n"), F.col("a_at"), F.col("b_n"), F.col("b_at"), percent)
    )
    pairs = a.join(b, on & passes)
    return pairs.select(F.least("a_code", "b_code").alias("a"), F.greatest("a_code", "b_code").alias("b")).distinct()


def _length_class(n: Column, percent: int) -> Column:
    """Sets that can reach the similarity are in the same class or in neighbouring ones."""
    return F.floor(F.log(n.cast("double")) / float(np.log(100 / percent)) * 0.999999)


def _across(placed: DataFrame, percent: int) -> DataFrame:
    """Candidates of different components: first pairs of components, then of their members.

    Only members whose lengths are of the same or of neighbouring classes meet.
    """
    placed = placed.withColumn("class", _length_class(F.col("n"), percent))
    # What the members of a component have at best bounds all their pairs.
    best = (F.min("at").alias("at"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("rows"))
    roots = placed.groupBy("gram", "root", "class").agg(*best)
    one = roots.select(*(F.col(k).alias(f"o_{k}") for k in roots.columns))
    near = F.explode(F.array(F.col("class") - 1, F.col("class"), F.col("class") + 1))
    two = roots.withColumn("near", near)
    two = two.select(*(F.col(k).alias(f"t_{k}") for k in two.columns))
    most = 1 + F.least(F.col("o_high") - F.col("o_at") - 1, F.col("t_high") - F.col("t_at") - 1)
    meet = (
        (F.col("o_gram") == F.col("t_gram"))
        & (F.col("o_class") == F.col("t_near"))
        & (F.col("o_root") < F.col("t_root"))
        & (100 * F.least("o_high", "t_high") >= percent * F.greatest("o_low", "t_low"))
        & ((100 + percent) * most >= percent * (F.col("o_low") + F.col("t_low")))
    )
    # The smaller of the two is spread first, then meets the members of the larger.
    smaller = F.col("o_rows") <= F.col("t_rows")
    sides = {
        f"{side}_{k}": F.when(smaller if side == "s" else ~smaller, F.col(f"o_{k}")).otherwise(F.col(f"t_{k}"))
        for side in "sl"
        for k in ("root", "class")
    }
    pairs = one.join(two, meet).select(F.col("o_gram").alias("s_gram"), *(c.alias(k) for k, c in sides.items()))
    same = (F.col("gram") == F.col("s_gram")) & (F.col("root") == F.col("s_root"))
    left = placed.join(pairs, same & (F.col("class") == F.col("s_class")))
    left = left.select("gram", "code", "n", "at", F.col("l_root").alias("other"), F.col("l_class").alias("class"))
    right = placed.select("gram", "code", "n", "at", "root", "class")
    on = (
        (F.col("a_gram") == F.col("b_gram"))
        & (F.col("a_other") == F.col("b_root"))
        & (F.col("a_class") == F.col("b_class"))
    )
    return _candidates(left, right, on, percent)


def _suffix_filter(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Drop pairs whose sets, cut into parts by hash, cannot overlap enough."""
    one = reps.select(F.col("code").alias("a"), F.col("n").alias("a_n"), F.col("parts").alias("a_parts"))
    two = reps.select(F.col("code").alias("b"), F.col("n").alias("b_n"), F.col("parts").alias("b_parts"))

    @F.pandas_udf("long")
    def overlap(left: pd.Series, right: pd.Series) -> pd.Series:
        x = np.frombuffer(b"".join(left), "<u2").reshape(-1, PARTS).astype(np.int64)
        y = np.frombuffer(b"".join(right), "<u2").reshape(-1, PARTS).astype(np.int64)
        # A full counter bounds nothing.
        low = np.where((x == 65_535) | (y == 65_535), 1 << 40, np.minimum(x, y))
        return pd.Series(low.sum(axis=1))

    named = pairs.join(one, "a").join(two, "b")
    enough = (100 + percent) * overlap("a_parts", "b_parts") >= percent * (F.col("a_n") + F.col("b_n"))
    return named.filter(enough).select("a", "b")


def _sets(docs: DataFrame, reps: DataFrame, codes: DataFrame, settings: Settings) -> DataFrame:
    """Staged sets of the documents that stand for the given codes."""
    wanted = reps.join(codes, "code", "left_semi").select(
        F.col("rep_id").alias("w_id"), F.col("code").alias("w_code")
    )
    wanted = stage(wanted, "wanted")
    few = wanted.limit(FEW + 1).count() <= FEW
    rows = docs.join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("w_id")))
    rows = rows.select("text", "w_code")

    def build(batches):
        for batch in slices(batches):
            found, cuts = shingle_sets(batch["text"].fillna("").tolist(), settings.size)
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
            code = np.array([_set_code(found[a:b]) for a, b in spans], np.uint64).view(np.int64)
            right = code == batch["w_code"].to_numpy()  # an id may have other texts too
            yield pd.DataFrame(
                {
                    "code": code[right],
                    "shingles": [found[a:b].tobytes() for (a, b), ok in zip(spans, right, strict=True) if ok],
                }
            )

    built = rows.mapInPandas(build, "code long, shingles binary")
    sets = stage(built.groupBy("code").agg(F.first("shingles").alias("shingles")), "sets")
    discard(wanted)
    return sets


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that reach the similarity, each judged once on whole sets."""
    one = sets.select(F.col("code").alias("a"), F.col("shingles").alias("left"))
    two = sets.select(F.col("code").alias("b"), F.col("shingles").alias("right"))

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(left, right, strict=True):
            u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(u) > len(v):
                u, v = v, u
            at = np.minimum(np.searchsorted(v, u), len(v) - 1)
            common = int((v[at] == u).sum())
            out.append((100 + percent) * common >= percent * (len(u) + len(v)))
        return pd.Series(out)

    named = pairs.join(one, "a").join(two, "b")
    return named.filter(similar("left", "right")).select("a", "b")


def jaccard_links(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Signatures of all documents, and links between the codes of different sets.

    The links connect exactly what all pairs at the similarity would connect. First
    every prefix element links its documents to three centres, so that a large group
    of near copies meets its centres, not itself. What lies in one component then need
    not be compared any more: only pairs across components are left, and they are all
    compared. So no pair is lost, and a group of n copies costs about n comparisons.
    Two of the centres are documents that share most with others, one is any.
    """
    rows = pick(docs, doc_id="long", text="string").withColumn("key", text_key(text_or_empty()))
    spark = docs.sparkSession

    def codes_of(batch: pd.DataFrame) -> np.ndarray:
        return shingle_sets(batch["text"].fillna("").tolist(), settings.size)[0]

    table = frequencies(rows.select("text"), codes_of)
    shared = spark.sparkContext.broadcast(table)
    signed = signatures(rows, settings, shared)
    # Equal sets are one from here on.
    reps = signed.filter("n_shingles > 0").groupBy("code").agg(
        F.min("doc_id").alias("rep_id"),
        F.first("n_shingles").alias("n"),
        F.first("prefix").alias("prefix"),
        F.first("parts").alias("parts"),
    )
    reps = stage(reps, "sets-once")
    postings = reps.select("code", "n", F.posexplode("prefix").alias("at", "gram"))
    common = postings.groupBy("gram").agg(F.count("*").alias("df")).filter("df > 1")
    stored = members = stage(postings.join(common, "gram").drop("df"), "members")

    # Central documents are those whose rare elements others have too, as the original of
    # edited copies: the edits are rare, so the copies' prefixes begin with their own.
    central = members.groupBy("code").agg((-F.count("*") / F.first("n")).alias("lonely"))
    members = members.join(central, "code")
    half = F.pmod(F.xxhash64("code", F.lit(1)), F.lit(2))
    orders = [
        F.struct("lonely", F.xxhash64("code")),
        F.struct(half.alias("half"), "lonely", F.xxhash64("code")),
        F.struct(F.xxhash64("code", F.lit(2))),
    ]
    centres = members.groupBy("gram").agg(
        *(F.min(F.struct(o.alias("o"), "code", "n", "at")).alias(f"c{i}") for i, o in enumerate(orders))
    )
    chosen = [F.struct(*(F.col(f"c{i}.{k}").alias(k) for k in ("code", "n", "at"))) for i in range(3)]
    centres = centres.select("gram", F.explode(F.array(*chosen)).alias("c"))
    centres = centres.select("gram", "c.code", "c.n", "c.at").distinct()
    same = F.col("a_gram") == F.col("b_gram")
    near = _candidates(members.select("gram", "code", "n", "at"), centres, same, settings.percent)
    near = stage(_suffix_filter(near, reps, settings.percent), "near")
    codes = near.select(F.col("a").alias("code")).unionAll(near.select(F.col("b").alias("code"))).distinct()
    sets = _sets(rows, reps, codes, settings)
    links = stage(_verify(near, sets, settings.percent), "near-links")

    found = components(links)
    placed = members.join(found, F.col("code") == F.col("node"), "left").select(
        "gram", "code", "n", "at", F.coalesce("root", "code").alias("root")
    )
    # Elements whose documents are connected already have nothing left to tell.
    open_ = placed.groupBy("gram").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    placed = placed.join(open_.filter("low < high").select("gram"), "gram", "left_semi")
    placed = stage(placed, "open")
    rest = _across(placed, settings.percent)
    rest = rest.join(near, ["a", "b"], "left_anti")
    rest = stage(_suffix_filter(rest, reps, settings.percent), "rest")
    codes = rest.select(F.col("a").alias("code")).unionAll(rest.select(F.col("b").alias("code"))).distinct()
    more = _sets(rows, reps, codes.join(sets, "code", "left_anti"), settings)
    late = stage(_verify(rest, sets.unionAll(more), settings.percent), "rest-links")
    discard(reps, stored, near, sets, placed, rest, more)
    return signed, links.unionAll(late)


def jaccard_components(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, the smallest id reachable.

    Words are runs of other characters than ASCII white space, A-Z in lower case; the
    set of a document holds its distinct runs of ``size`` words, or the whole if it
    has fewer words. Documents link when 100 * Jaccard >= ``percent``. Null and empty
    texts have no set and link with nothing: component_id is their own id. A null id
    is in no comparison of ids: its component is the smallest other id, or null.
    Repeated rows are rows of one class. An empty table gives no rows.
    """
    named = _components(docs, settings or Settings())
    return named.select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, key, n_shingles, component_id and component, a code that empty sets lack."""
    signed, links = jaccard_links(docs, settings)
    smallest = signed.filter("n_shingles > 0").groupBy("code").agg(F.min("doc_id").alias("low"))
    found = components(links)
    named = smallest.join(found, F.col("code") == F.col("node"), "left")
    named = named.withColumn("component", F.coalesce("root", "code"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    classes = stage(named.join(least, "component").select("code", "component", "component_id"), "classes")
    kept = signed.select("doc_id", "key", "n_shingles", "code")
    joined = kept.filter("n_shingles > 0").join(classes, "code").drop("code")
    alone = kept.filter("n_shingles = 0").drop("code")
    alone = alone.withColumn("component_id", F.col("doc_id")).withColumn("component", F.lit(None).cast("long"))
    return joined.unionByName(alone)


def keep_component_firsts(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents with all their columns, the one with the smallest id of each component.

    Documents without words all stay.
    """
    named = _components(docs, settings or Settings()).filter(F.col("component").isNotNull())
    rows = stage(named.groupBy("component", "doc_id", "key").agg(F.count("*").alias("n")), "rows")
    # A struct with a null id sorts first: put it last.
    order = F.struct(F.col("doc_id").isNull().alias("nothing"), "doc_id", "key")
    firsts = rows.groupBy("component").agg(F.min(order).alias("f"), F.sum("n").alias("size"))
    firsts = firsts.filter("size > 1").select(F.col("component").alias("f_component"), "f")
    joined = rows.join(firsts, F.col("component") == F.col("f_component"))
    is_first = F.col("doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("key") == F.col("f.key"))
    gone = joined.select("doc_id", "key", "n", is_first.alias("one_stays")).filter("n > 1 OR NOT one_stays")
    return without(docs, stage(gone.select("doc_id", "key", "one_stays"), "near-copies"), text_key)
