"""Ordering, pages and top-k."""

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.times import floor_div
from cmdlog_spark.operators.filters import command_is
from cmdlog_spark.schema import CHUNK, DAY_SECONDS

#: Up to here Spark keeps the first rows in a heap; deeper pages are sought.
HEAP_ROWS = 100_000
#: Order of pages.
KEY = ["epoch", "id", "tie"]


def top(df: DataFrame, order: list, limit: int | None) -> DataFrame:
    """Ordered rows; ``limit=None`` returns them all."""
    ordered = df.orderBy(*order)
    return ordered if limit is None else ordered.limit(limit)


def newest_first(df: DataFrame, limit: int | None = 100) -> DataFrame:
    return top(df, [F.desc("epoch"), F.desc("id")], limit)


def _tie(df: DataFrame) -> Column:
    """Orders rows of equal time and id; only rows that are equal throughout share it."""
    rest = sorted(c for c in df.columns if c not in ("epoch", "id"))
    return F.xxhash64(*rest) if rest else F.lit(0).cast("bigint")


def oldest_first(df: DataFrame, limit: int | None = 100, offset: int = 0) -> DataFrame:
    """A page in (epoch, id) order, nulls first; the other fields decide between equal keys.

    A shallow page is one heap per task. A deep one, or one without an end,
    would push the skipped rows through a single task, so its first row is
    sought by counting instead. Both give the same pages.
    """
    columns = df.columns
    named = df.withColumn("tie", _tie(df))
    deep = offset > 0 and (limit is None or offset + limit > HEAP_ROWS)
    if not deep:
        page = named.orderBy(*KEY)
        page = page.offset(offset) if offset else page
        return (page if limit is None else page.limit(limit)).select(columns)
    found = place_at(named, offset)
    if found is None:
        return df.limit(0)
    start, passed = found
    page = named.where(_after(start))
    if limit is None or limit > 0:
        page = page.unionByName(_rest_of(named.where(_same(start, KEY)), passed, limit))
    return top(page, KEY, limit).select(columns)


def _same(start: Row, names: list[str]) -> Column:
    """Rows whose fields equal those of a key."""
    same = F.lit(True)
    for name in names:
        value = start[name]
        same = same & (F.col(name).isNull() if value is None else F.col(name) == value)
    return same


def _after(start: Row) -> Column:
    """Rows behind a key; nulls come first, as in the order."""
    after = F.lit(False)
    for i, name in enumerate(KEY):
        value = start[name]
        later = F.col(name).isNotNull() if value is None else F.col(name) > value
        after = after | (_same(start, KEY[:i]) & later)
    return after


def _rest_of(equal: DataFrame, passed: int, limit: int | None) -> DataFrame:
    """Rows of one key without the first ``passed``.

    They are equal in all fields, so one row with a count stands for them; were two
    different rows to share a key, the order of their fields would decide.
    """
    columns = equal.columns
    counts = equal.groupBy(*columns).agg(F.count("*").alias("copies"))
    upto = F.sum("copies").over(
        Window.orderBy(*columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    left = F.least("copies", F.col("upto") - F.lit(passed))
    left = left if limit is None else F.least(left, F.lit(limit))
    kept = counts.withColumn("upto", upto).withColumn("left", left).where(F.col("left") > 0)
    return kept.select(*columns, F.explode(F.sequence(F.lit(1), F.col("left"))).alias("n")).drop("n")


def _run(name: str, length: int, number: int | None) -> Column:
    """The rows of one run of ``length`` values, as a range that a scan can skip by."""
    if number is None:
        return F.col(name).isNull()
    return F.col(name).between(number * length, number * length + length - 1)


def key_at(df: DataFrame, position: int) -> Row | None:
    """Key of the row with ``position`` rows before it."""
    found = place_at(df.withColumn("tie", _tie(df)), position)
    return found and found[0]


def place_at(named: DataFrame, position: int) -> tuple[Row, int] | None:
    """Key of the row with ``position`` rows before it, and how many of those share the key.

    Each step counts the rows of finer pieces inside the piece found so far:
    days, seconds, runs of ids, ids, runs of ties, ties. One row reaches the driver
    per step.
    """
    keys = named.select(*KEY)
    left = position
    steps = [("epoch", DAY_SECONDS), ("epoch", 1), ("id", CHUNK), ("id", 1)]
    for name, length in [*steps, ("tie", 1 << 44), ("tie", 1 << 24), ("tie", 1)]:
        piece = floor_div(F.col(name), length)
        counts = keys.groupBy(piece.alias("piece")).agg(F.count("*").alias("n"))
        running = F.sum("n").over(
            Window.orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        found = (
            counts.withColumn("upto", running)
            .where(F.col("upto") > left)
            .orderBy("piece")
            .limit(1)
            .first()
        )
        if found is None:
            return None
        left -= found["upto"] - found["n"]
        keys = keys.where(_run(name, length, found["piece"]))
    return keys.first(), left


def recent_runs(df: DataFrame, cmd: str, n: int = 5) -> DataFrame:
    """Last runs of one command."""
    return newest_first(df.where(command_is(cmd)), n).select("id", "epoch", "pwd", "cmd")


def recent_runs_all(df: DataFrame, n: int = 5) -> DataFrame:
    """Last runs of every command; each task passes on ``n`` rows per command."""
    newest = Window.partitionBy("cmd").orderBy(F.desc("epoch"), F.desc("id"))
    return (
        df.select("id", "epoch", "pwd", "cmd")
        .withColumn("rank", F.row_number().over(newest))
        .where(F.col("rank") <= n)
    )
