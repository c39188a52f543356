"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, stage, text_or_empty

MAX_COPIES = 3
WEIGHTS = (1, 2, 3)
# Steps of the order key (its logarithm) in the first and the second look at a source.
COARSE, FINE = 64, 1 << 18
# A random number in (0, 1) with 52 bits.
BITS = float(1 << 52)
# Sources up to which their fillings are broadcast, one row each.
FEW = 10_000
# Documents that fill up a source after the draw.
FILLS = 3


def word_count(text: Column) -> Column:
    r"""Runs of other characters than ASCII white space.

    Words are counted by what is left of the text when each is made one letter.
    """
    squeezed = F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(squeezed, r"[\x20\x09-\x0D]+", "")).cast("long")


def random_number(doc_id: Column, seed: int) -> Column:
    """Depends on the id and the seed only, so that reruns and other partitions agree."""
    text = F.concat_ws(":", F.lit(str(seed)), F.coalesce(doc_id.cast("string"), F.lit("")))
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / BITS


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """Sources with source_size and target, the words the mix takes of each.

    Sources in code point order, null last, get the weights in turn. Targets share
    all words by weight; a target stops at ``max_copies`` times its source, the
    excess goes to the others by weight until none is above. The sources with the
    smallest size per weight are the ones that stop, so a running sum over that
    order finds where to end. ``sizes`` has one row per source.
    """
    # One row per source: as many as there are labels, not documents.
    listed = F.array(*(F.lit(float(w)) for w in weights))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    named = sizes.withColumn("place", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(listed, F.col("place") % len(weights) + 1)
    )
    per_weight = F.col("source_size") / F.col("weight")
    before = W.orderBy(per_weight, "place").rowsBetween(W.unboundedPreceding, -1)
    left = W.orderBy(per_weight, "place").rowsBetween(W.currentRow, W.unboundedFollowing)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    stepped = named.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("stopped_size"),
        F.sum("weight").over(left).alias("left_weight"),
    )
    # Words per weight, if all sources before this one stop at their limit.
    level = (F.col("total") - max_copies * F.col("stopped_size")) / F.col("left_weight")
    stops = F.col("weight") * level > max_copies * F.col("source_size")
    found = stepped.withColumn("level", level).withColumn("stops", stops)
    final = F.min(F.when(~F.col("stops"), F.struct("stopped_size", "place", "level"))).over(everything)
    target = F.when(F.col("stops"), max_copies * F.col("source_size").cast("double")).otherwise(
        F.col("weight") * final["level"]
    )
    return found.select("source", "source_size", target.alias("target"))


def with_rates(docs: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """Expected copies of each document: its weight times a scale, at most ``max_copies``.

    The weights of a source are few (see ``mix``), so the scale comes from its words
    per weight. A weight stops at the limit as sources do.
    """
    classes = docs.groupBy("source", "weight").agg(F.sum("size").cast("double").alias("words"))
    same = F.col("source").eqNullSafe(F.col("t_source"))
    named = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    classes = classes.join(named, same).drop("t_source")
    heavy_first = W.partitionBy("source").orderBy(F.col("weight").desc())
    before = heavy_first.rowsBetween(W.unboundedPreceding, -1)
    onward = heavy_first.rowsBetween(W.currentRow, W.unboundedFollowing)
    stepped = classes.select(
        "*",
        F.coalesce(F.sum("words").over(before), F.lit(0.0)).alias("stopped"),
        F.sum(F.col("words") * F.col("weight")).over(onward).alias("mass"),
    )
    level = F.when(F.col("mass") > 0, (F.col("target") - max_copies * F.col("stopped")) / F.col("mass"))
    stepped = stepped.withColumn("level", F.coalesce(level, F.lit(0.0)))
    # A full source has no level below the limit: all its documents stop there.
    free = F.col("weight") * F.col("level") < max_copies
    whole = W.partitionBy("source")
    scale = F.max(F.when(free, F.struct("weight", "level"))).over(whole)["level"]
    rate = F.when(free, F.col("weight") * F.coalesce(scale, F.lit(0.0))).otherwise(F.lit(float(max_copies)))
    return stepped.select("source", "weight", "source_size", "target", rate.alias("rate"))


def _ranked(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """Rows with the certain copies and the order key of the uncertain one, null if none."""
    named = rates.select(
        F.col("source").alias("r_source"), F.col("weight").alias("r_weight"), "source_size", "target", "rate"
    )
    same = F.col("source").eqNullSafe(F.col("r_source")) & (F.col("weight") == F.col("r_weight"))
    chance = F.col("rate") - F.floor("rate")
    odds = F.col("u") / (1 - F.col("u")) / (chance / (1 - chance))
    return (
        rows.join(named, same)
        .withColumn("u", random_number(F.col("doc_id"), seed))
        .withColumn("odds", F.when((chance > 0) & (F.col("size") > 0), odds))
        .withColumn("whole", F.floor("rate"))
        .drop("r_source", "r_weight", "rate", "u", "weight")
    )


def _drawn(ranked: DataFrame, ends: DataFrame) -> DataFrame:
    """``extra``, the drawn copy; only the rows of the last step are put in order."""
    joined = ranked.join(ends, F.col("source").eqNullSafe(F.col("e_source")), "left")
    at = F.floor(F.log("odds") * FINE)
    drawn = (
        F.when(F.col("odds").isNull() | F.col("e_step").isNull() | (at > F.col("e_step")), 0)
        .when(at < F.col("e_step"), 1)
        .otherwise(None)
    )
    placed = joined.withColumn("extra", drawn)
    in_order = W.partitionBy("source").orderBy("odds", "doc_id", "size")
    run = F.sum("size").over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow))
    fits = F.col("e_before") + run <= F.col("e_room")
    last = placed.filter(F.col("extra").isNull()).withColumn("extra", fits.cast("int"))
    result = placed.filter(F.col("extra").isNotNull()).unionAll(last)
    return result.drop("e_source", "e_step", "e_before", "e_room")


def _fills(drawn: DataFrame) -> DataFrame:
    """For each source some documents left out that bring it nearer to its target.

    First the largest that still fits, again and again, at last the one that ends
    nearest. Rows alike in id and size go together.
    """
    taken = F.sum(F.when(F.col("size") == 0, 0).otherwise((F.col("whole") + F.col("extra")) * F.col("size")))
    gaps = drawn.groupBy("source").agg((F.first("target") - taken).alias("gap"))
    gaps = stage(gaps.select(F.col("source").alias("g_source"), "gap"), "gaps")
    left = drawn.filter((F.col("extra") == 0) & F.col("odds").isNotNull())
    left = left.groupBy("source", "odds", "doc_id", "size").agg(F.count("*").alias("n"))
    left = stage(left.withColumn("words", F.col("n") * F.col("size")), "left")
    same_source = F.col("source").eqNullSafe(F.col("g_source"))
    fills = None
    for last in (False,) * (FILLS - 1) + (True,):
        open_ = left if fills is None else left.join(fills, _same_row(), "left_anti")
        near = F.abs(F.col("gap") - F.col("words"))
        good = near < F.abs("gap") if last else F.col("words") <= F.col("gap")
        best = F.min(F.struct(near.alias("near"), "odds", "doc_id", "size", "words")).alias("f")
        found = open_.join(gaps, same_source).filter(good).groupBy("source").agg(best)
        found = stage(
            found.select(
                F.col("source").alias("f_source"), F.col("f.doc_id").alias("f_doc_id"),
                F.col("f.size").alias("f_size"), F.col("f.words").alias("f_words"),
            ),
            "fills",
        )
        less = gaps.join(found, F.col("g_source").eqNullSafe(F.col("f_source")), "left")
        gaps = stage(less.select("g_source", (F.col("gap") - F.coalesce("f_words", F.lit(0))).alias("gap")), "gaps")
        found = found.drop("f_words")
        fills = found if fills is None else fills.unionAll(found)
    return fills


def _same_row() -> Column:
    return (
        F.col("source").eqNullSafe(F.col("f_source"))
        & F.col("doc_id").eqNullSafe(F.col("f_doc_id"))
        & (F.col("size") == F.col("f_size"))
    )


def _with_copies(ranked: DataFrame, ends: DataFrame, fills: DataFrame) -> DataFrame:
    """Certain copies, the drawn one and the one that fills up."""
    rows = _drawn(ranked, ends).join(F.broadcast(fills) if fills.limit(FEW + 1).count() <= FEW else fills, _same_row(), "left")
    fills_up = F.col("f_size").isNotNull() & F.col("odds").isNotNull()
    extra = F.when(fills_up, 1).otherwise(F.col("extra"))
    copies = F.when(F.col("size") == 0, 0).otherwise(F.col("whole") + extra).cast("long")
    return rows.withColumn("copies", copies).drop("odds", "whole", "extra", "f_source", "f_doc_id", "f_size")


def _plan(rows: DataFrame, weights, max_copies: int, seed: int) -> tuple[DataFrame, ...]:
    """What the whole table decides: rates by source and weight, an end and a filling per source."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    rates = stage(with_rates(rows, source_targets(sizes, weights, max_copies), max_copies), "rates")
    ranked = stage(_ranked(rows, rates, seed), "ranked")
    ends = _ends(ranked)
    return rates, ends, stage(_fills(stage(_drawn(ranked, ends), "drawn")), "fills")


def mix(
    docs: DataFrame,
    weights=WEIGHTS,
    max_copies: int = MAX_COPIES,
    seed: int = 0,
    doc_weight=None,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    ``size`` counts words (null text: 0). ``doc_weight``, a function of the column
    ``size`` with few distinct positive values, says how much more often a document
    is wanted than others of its source; by default all are alike. A document's
    expected copies are its weight times the scale that meets the target of the
    source, ``max_copies`` at most. The whole part is certain. The rest p is the
    chance of one more copy: documents are ranked by their random odds u / (1 - u)
    divided by p / (1 - p), and the lowest are taken as long as their words fit into
    what the target leaves. Then ``FILLS`` documents left out fill up, the last of them
    the one that ends nearest to the target. Ties go by doc_id.

    Documents without words have 0 copies. Rows with the same id count as separate
    documents. An empty table gives no rows. Numbers come from the id and ``seed``,
    hence reruns agree. No source is sorted whole: two histograms of the order key
    find the few documents around the end, and only those are put in order.
    """
    rows = pick(docs, doc_id="long", text="string", source="string").select(
        "doc_id", "source", word_count(text_or_empty()).alias("size")
    )
    rows = stage(rows.withColumn("weight", _weight(doc_weight)), "sizes")
    rates, ends, fills = _plan(rows, weights, max_copies, seed)
    mixed = _with_copies(_ranked(rows, rates, seed), ends, fills)
    return mixed.withColumn("taken", F.col("copies") * F.col("size"))


def _weight(doc_weight) -> Column:
    return F.lit(1.0) if doc_weight is None else doc_weight(F.col("size")).cast("double")


def mix_documents(
    docs: DataFrame, weights=WEIGHTS, max_copies: int = MAX_COPIES, seed: int = 0, doc_weight=None
) -> DataFrame:
    """The documents with all their columns, each as often as ``mix`` takes it.

    The two small tables that the whole decides meet the documents where they are;
    texts are not shuffled.
    """
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, text, source = (F.col(f"c{names.index(n)}") for n in ("doc_id", "text", "source"))
    rows = plain.select(
        "*",
        doc_id.cast("long").alias("doc_id"),
        source.cast("string").alias("source"),
        word_count(F.coalesce(text.cast("string"), F.lit(""))).alias("size"),
    ).withColumn("weight", _weight(doc_weight))
    narrow = stage(rows.select("doc_id", "source", "size", "weight"), "sizes")
    rates, ends, fills = _plan(narrow, weights, max_copies, seed)
    mixed = _with_copies(_ranked(rows, rates, seed), ends, fills).filter("copies > 0")
    copies = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return copies.select(*(f"c{i}" for i in range(len(names)))).toDF(*names)


def _ends(rows: DataFrame) -> DataFrame:
    """For each source the step of log(odds) that holds the end, and the words before it.

    e_room: the words that certain copies leave of the target.
    """
    room = rows.groupBy("source").agg(
        (F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("room")
    )
    room = room.select(F.col("source").alias("e_source"), F.col("room").alias("e_room"))
    ranked = rows.filter(F.col("odds").isNotNull())
    ranked = ranked.select("source", "size", F.floor(F.log("odds") * FINE).alias("fine"))
    same = F.col("source").eqNullSafe(F.col("e_source"))

    def crossing(words: DataFrame, key: str) -> DataFrame:
        """The first step at which the running words pass the room, else the last."""
        order = W.partitionBy("source").orderBy(key)
        running = words.withColumn(
            "upto", F.col("start") + F.sum("words").over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
        )
        hit = F.when(F.col("upto") >= F.col("e_room"), F.struct(key, "upto", "words"))
        return running.groupBy("source", "e_room").agg(
            F.coalesce(F.min(hit), F.max(F.struct(key, "upto", "words"))).alias("end")
        )

    coarse = F.floor(F.col("fine") / (FINE // COARSE)).alias("coarse")
    by_coarse = ranked.groupBy("source", coarse).agg(F.sum("size").alias("words"))
    by_coarse = by_coarse.join(room, same).drop("e_source").withColumn("start", F.lit(0).cast("long"))
    first = crossing(by_coarse, "coarse").select(
        F.col("source").alias("e_source"), "e_room", F.col("end.coarse").alias("e_coarse"),
        (F.col("end.upto") - F.col("end.words")).alias("start"),
    )
    first = stage(first, "coarse")
    inside = ranked.withColumn("coarse", F.floor(F.col("fine") / (FINE // COARSE)))
    inside = inside.join(first, same & (F.col("coarse") == F.col("e_coarse")))
    by_fine = inside.groupBy("source", "e_room", "start", "fine").agg(F.sum("size").alias("words"))
    end = crossing(by_fine, "fine")
    return stage(
        end.select(
            F.col("source").alias("e_source"), "e_room", F.col("end.fine").alias("e_step"),
            (F.col("end.upto") - F.col("end.words")).alias("e_before"),
        ),
        "ends",
    )


def length_band(size: Column) -> Column:
    """Documents of 50 to 5,000 words are wanted twice as often as shorter or longer ones."""
    return F.when(size.between(50, 5_000), 2.0).otherwise(1.0)
