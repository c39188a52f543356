"""Best partners of every command when a few groups hold much of the data.

Input is a table of cells: ``cell, cmd, b, p, latest, rank_by``. Within a cell each
command A with base count ``b`` co-occurs ``b(A) * p(B)`` times with each command
B with partner count ``p``; the score of (A, B) is the sum over all cells.
Enumerating the pairs of a cell costs the square of its commands, so each cell
only shows a list of leaders, ordered by ``rank_by`` (never below ``p``), then
latest time, then text, and a command reads the lists of its cells down to where
nothing below can still be among its best ``k``:

* What a command has read gives lower bounds of scores.
* The ends of its lists bound the scores of all partners it has not met: by the
  sum over its cells of ``b`` times the most a partner below the end can have
  there, and, where ``rank_by`` is the number of runs of a partner anywhere, by
  ``widest``, the most runs of the command that one run can meet, times that
  number at the end.

A command whose k-th best lower bound is not behind the end of its lists is
done; equal scores are decided by the order of the lists, so that groups of
commands that all ran equally often end as soon as others. Partners met that can
still be among the best are scored exactly. Commands that are not done read
lists eight times as long, until the lists are exhausted.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.staging import stage

#: Pair counts can pass 64 bits: two commands with 10^10 runs in one directory.
WIDE = "decimal(38,0)"
#: How much longer the lists of a further round are.
DEEPER = 8


def _wide(a: Column, b: Column) -> Column:
    return a.cast("decimal(19,0)") * b.cast("decimal(19,0)")


def _key(latest: Column, cmd: Column) -> Column:
    """Sorts as equal scores do: newest first, without a time last, then by text."""
    return F.struct(F.coalesce(-latest, F.lit((1 << 63) - 1)).alias("less"), cmd.alias("cmd"))


def _leaders(partners: DataFrame, depth: int) -> DataFrame:
    """The first ``depth`` partners of each cell; every task passes on as many."""
    order = Window.partitionBy("cell").orderBy(F.desc("rank_by"), F.desc("latest"), "cmd")
    return partners.withColumn("place", F.row_number().over(order)).where(F.col("place") <= depth)


def _ends(leaders: DataFrame, most: DataFrame, depth: int) -> DataFrame:
    """Per cell with more partners: what one below the list can have at most, and the last entry."""
    last = leaders.where(F.col("place") == depth).join(most, "cell")
    return last.where(F.col("partners") > depth).select(
        F.col("cell").alias("e_cell"),
        F.least("rank_by", "most").alias("cap"),
        F.col("rank_by").alias("end_rank"),
        _key(F.col("latest"), F.col("cmd")).alias("end_key"),
    )


def _bounds(bases: DataFrame, ends: DataFrame, widest: DataFrame | None) -> DataFrame:
    """Per base: the most that a partner it has not met can score, and how ties go."""
    met = bases.join(ends, F.col("cell") == F.col("e_cell"), "left")
    bounds = met.groupBy("base").agg(
        F.coalesce(F.sum(_wide(F.col("b"), F.col("cap"))), F.lit(0)).cast(WIDE).alias("by_cells"),
        F.max("end_rank").alias("end_rank"),
        F.min("end_key").alias("end_key"),
    )
    if widest is None:
        return bounds.select("base", "by_cells", F.col("by_cells").alias("unmet"), F.lit(True).alias("ties"), "end_key")
    joined = bounds.join(widest.select(F.col("cmd").alias("w_cmd"), "widest"), F.col("base") == F.col("w_cmd"), "left")
    by_runs = F.coalesce(_wide(F.col("widest"), F.col("end_rank")), F.lit(0)).cast(WIDE)
    return joined.select(
        "base",
        "by_cells",
        F.least("by_cells", by_runs).alias("unmet"),
        (by_runs <= F.col("by_cells")).alias("ties"),
        "end_key",
    )


def leading_pairs(
    cells: DataFrame, known: DataFrame, k: int, totals: DataFrame | None = None, depth: int | None = None
) -> DataFrame:
    """Rows base, cmd, n, latest that hold the best ``k`` partners of every base, scored whole.

    ``known`` has the same columns: pairs whose co-occurrence was counted elsewhere. Both
    it and the cells are read again in each round, so they should come from written
    tables. With ``totals`` (cmd, widest, weight) ``rank_by`` is the weight of a command.
    The first lists have ``depth`` entries.
    """
    partners = cells.where(F.col("p") > 0).select("cell", "cmd", "p", "latest", "rank_by")
    bases = cells.where(F.col("b") > 0).select("cell", F.col("cmd").alias("base"), "b")
    most = partners.groupBy("cell").agg(F.max("p").alias("most"), F.count("*").alias("partners"))
    depth = depth or k + 2
    done: list[DataFrame] = []
    while True:
        leaders = stage(_leaders(partners, depth), "leaders")
        ends = _ends(leaders, most, depth)
        met = pairs_met(bases, leaders, ends, known)
        met = stage(met, "pairs-met")
        bounds = _bounds(bases, ends, totals)
        states = stage(_states(met, bounds, totals, k), "bases")
        closed = states.where("closed")
        done.append(stage(_scored(met, closed, bases, partners, totals), "pairs-best"))
        open_ = states.where("NOT closed").select("base")
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)
        bases = stage(bases.join(open_, "base", "left_semi"), "bases-open")
        known = known.join(open_, "base", "left_semi")
        partners = partners.join(bases.select("cell").distinct(), "cell", "left_semi")
        depth *= DEEPER


def pairs_met(bases: DataFrame, leaders: DataFrame, ends: DataFrame, known: DataFrame) -> DataFrame:
    """What each base has read: base, cmd, seen (a lower bound), counted (the known part of
    it), spent (of ``by_cells``) and latest."""
    lists = leaders.join(ends.select("e_cell", "cap"), F.col("cell") == F.col("e_cell"), "left")
    lists = lists.select("cell", "cmd", "p", "latest", F.coalesce("cap", F.lit(0)).alias("cap"))
    read = bases.join(lists, "cell").where(F.col("base") != F.col("cmd"))
    none = F.lit(0).cast(WIDE)
    n, spent = (_wide(F.col("b"), F.col(c)).cast(WIDE) for c in ("p", "cap"))
    read = read.select("base", "cmd", n.alias("seen"), none.alias("counted"), spent.alias("spent"), "latest")
    before = known.select("base", "cmd", F.col("n").alias("seen"), F.col("n").alias("counted"), none.alias("spent"), "latest")
    sums = [F.sum(c).cast(WIDE).alias(c) for c in ("seen", "counted", "spent")]
    return read.unionByName(before).groupBy("base", "cmd").agg(*sums, F.max("latest").alias("latest"))


def _states(met: DataFrame, bounds: DataFrame, totals: DataFrame | None, k: int) -> DataFrame:
    """Bases with their bounds, the least score that counts, and whether they are done."""
    order = Window.partitionBy("base").orderBy(F.desc("seen"), F.desc("latest"), "cmd")
    kth = (
        met.withColumn("place", F.row_number().over(order))
        .where(F.col("place") == k)
        .select("base", F.col("seen").alias("kth"), _key(F.col("latest"), F.col("cmd")).alias("kth_key"))
    )
    # Bases of known pairs alone have no cell to read further.
    everyone = met.select("base").unionByName(bounds.select("base")).distinct()
    named = everyone.join(bounds, "base", "left").join(kth, "base", "left")
    unmet = F.coalesce("unmet", F.lit(0).cast(WIDE))
    tied = (F.col("kth") == unmet) & F.col("ties") & (F.col("kth_key") <= F.col("end_key"))
    closed = (unmet == 0) | (F.col("kth") > unmet) | tied
    return named.select(
        "base",
        F.coalesce("by_cells", F.lit(0).cast(WIDE)).alias("by_cells"),
        F.coalesce("kth", F.lit(0).cast(WIDE)).alias("kth"),
        F.coalesce(closed, F.lit(False)).alias("closed"),
    )


def _scored(
    met: DataFrame, closed: DataFrame, bases: DataFrame, partners: DataFrame, totals: DataFrame | None
) -> DataFrame:
    """Whole scores of the partners that can be among the best of bases that are done."""
    most = F.col("seen") + F.col("by_cells") - F.col("spent")
    rivals = met.join(closed.select("base", "by_cells", "kth"), "base")
    if totals is not None:
        runs = totals.select(F.col("cmd").alias("w_cmd"), "weight")
        reach = totals.select(F.col("cmd").alias("r_cmd"), "widest")
        rivals = rivals.join(runs, F.col("cmd") == F.col("w_cmd")).join(reach, F.col("base") == F.col("r_cmd"))
        most = F.least(most, _wide(F.col("widest"), F.col("weight")))
    rivals = rivals.withColumn("most", most.cast(WIDE)).where(F.col("most") >= F.col("kth"))
    whole = rivals.where(F.col("most") <= F.col("seen")).select("base", "cmd", F.col("seen").alias("n"), "latest")
    # The rest of a score lies in cells whose list ends above the partner.
    part = rivals.where(F.col("most") > F.col("seen")).select("base", "cmd", "counted", "latest")
    looked = (
        part.select("base", "cmd")
        .join(bases, "base")
        .join(partners.select("cell", "cmd", "p", F.col("latest").alias("at")), ["cell", "cmd"])
        .groupBy("base", "cmd")
        .agg(F.sum(_wide(F.col("b"), F.col("p"))).cast(WIDE).alias("found"), F.max("at").alias("at"))
    )
    n = (F.col("counted") + F.coalesce("found", F.lit(0))).cast(WIDE)
    scored = part.join(looked, ["base", "cmd"], "left").select(
        "base", "cmd", n.alias("n"), F.greatest("latest", "at").alias("latest")
    )
    return whole.unionByName(scored)


def best_partners(pairs: DataFrame, k: int) -> DataFrame:
    """Rank partial pair counts: by count, then latest time, then text."""
    order = Window.partitionBy("base").orderBy(F.desc("n"), F.desc("latest"), "cmd")
    return (
        pairs.groupBy("base", "cmd")
        .agg(F.sum("n").cast(WIDE).alias("n"), F.max("latest").alias("latest"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("base", "rank", "cmd", F.col("n").alias("co_occurrences"), "latest")
    )
