"""Consecutive numbers over a whole table without a whole-table window.

Rows are cut into chunks of bounded size, or written in order. A small table holds how
many rows come before each chunk or written part.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.staging import stage

#: Of the numbers that Spark gives rows: the place in a part; the part is above it.
PLACE_BITS = 33


def rows_before(
    df: DataFrame, group: list[str], chunk: list[str], counted: Column | None = None
) -> DataFrame:
    """Per chunk: counted rows in earlier chunks of its group, and in the group.

    The windows run over one row per chunk, a millionth of the data.
    """
    n = F.count("*") if counted is None else F.count_if(counted)
    sizes = df.groupBy(*group, *chunk).agg(n.alias("n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(*chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(
        *group,
        *chunk,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"),
        F.sum("n").over(whole).alias("total"),
    )


def number_in_place(df: DataFrame, start: int) -> DataFrame:
    """Give rows ids that go on from ``start`` in the order in which they lie.

    ``df`` is a written table whose ``id`` is the number that Spark gave its rows as they
    were written: the part, and the place in it. Counts per part tell what comes before
    each. No window sees the rows, so that equal rows are in nobody's way.
    """
    part = F.shiftright("id", PLACE_BITS)
    counts = df.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each task that wrote the table.
    before = counts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("id").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    joined = df.withColumn("part", part).join(F.broadcast(before), "part")
    return joined.withColumn("id", F.lit(start + 1) + F.col("before") + place).drop("part", "before")


def write_in_place(df: DataFrame) -> DataFrame:
    """Write rows with the number that Spark gives them as ``id``."""
    return df.withColumn("id", F.monotonically_increasing_id())


def ordered_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows written in ranges of ``order``, with Spark's number of each as ``id``.

    Rows that are equal in it are dealt out by their number in the input.
    """
    keys = [F.col(c).alias(f"at_{i}") for i, c in enumerate(order)]
    named = df.select("*", *keys, F.monotonically_increasing_id().alias("at_row"))
    by = [*[f"at_{i}" for i in range(len(order))], "at_row"]
    ordered = named.repartitionByRange(*by).sortWithinPartitions(*by)
    return stage(write_in_place(ordered).drop(*by), "in-order")


def assign_ids(df: DataFrame, start: int, *, order: list[str] | None = None) -> DataFrame:
    """Replace ``id`` by ids that go on from ``start`` in ``order``, (source, id) by default.

    Ranges of that order are sorted and written, then numbered as they lie. One repeated
    id on many rows is no task of its own. Null sources and rows without an old id come
    first. ``df`` should come from a written table: Spark reads it once more to find the
    ranges.
    """
    return number_in_place(ordered_parts(df, order or ["src_ord", "id"]), start)
