"""bash and zsh history files.

A line frame has the columns ``file, part, pos, line``: ``(part, pos)`` orders
the lines of a file, and a part is a piece of bounded size (one input split),
so a single huge file is still read and parsed by many tasks.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.text import parse_long, rtrim_ws, trim_ws
from cmdlog_spark.functions.times import floor_div
from cmdlog_spark.operators.numbering import rows_before
from cmdlog_spark.schema import CHUNK, SYNTHETIC_EPOCH


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Line frame of text files, split by Spark as usual.

    Lines of one split stay together and in order inside a task, so the start
    of the split and the running id order them without a shuffle.
    """
    text = spark.read.option("lineSep", "\n").text(paths)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("part"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").alias("line"),
    )


def with_parts(lines: DataFrame) -> DataFrame:
    """Add ``part`` to a frame whose ``pos`` is the line number in the file."""
    return lines.withColumn("part", floor_div(F.col("pos"), CHUNK))


def _text_lines(lines: DataFrame) -> DataFrame:
    text = rtrim_ws(F.col("line"))
    return lines.select("file", "part", "pos", text.alias("text")).where(F.col("text") != "")


def _stamp(text: Column) -> Column:
    """Seconds in a ``#<integer>`` line, null for every other line."""
    return F.when(text.startswith("#"), parse_long(trim_ws(F.substr(text, F.lit(2)))))


def parse_bash_lines(lines: DataFrame) -> DataFrame:
    """Commands with the time that stands on the line before, if one does.

    The previous line comes from a window over one part; for the first line of
    a part it is the last line of an earlier part, taken from a table with one
    row per part.
    """
    marked = _text_lines(lines).withColumn("stamp", _stamp(F.col("text")))
    inside = Window.partitionBy("file", "part").orderBy("pos")
    ends = marked.groupBy("file", "part").agg(F.max_by("stamp", "pos").alias("stamp"))
    carried = F.lag("stamp").over(Window.partitionBy("file").orderBy("part"))
    carry = ends.select("file", "part", carried.alias("carried"))
    return (
        marked.withColumns(
            {"before": F.lag("stamp").over(inside), "first": F.row_number().over(inside) == 1}
        )
        .where(F.col("stamp").isNull())
        .join(carry, ["file", "part"])
        .select(
            "file",
            "part",
            "pos",
            F.when(F.col("first"), F.col("carried")).otherwise(F.col("before")).alias("epoch"),
            F.col("text").alias("cmd"),
        )
    )


def parse_zsh_lines(lines: DataFrame) -> DataFrame:
    """Commands of the extended format; any other line is a command as it is."""
    extended = r"(?s)^: ([^:;]*)(?::[^;]*)?;(.*)$"
    text = F.col("text")
    return (
        _text_lines(lines)
        .withColumn("epoch", parse_long(F.regexp_extract(text, extended, 1)))
        .select(
            "file",
            "part",
            "pos",
            "epoch",
            F.when(F.col("epoch").isNull(), text)
            .otherwise(F.regexp_extract(text, extended, 2))
            .alias("cmd"),
        )
    )


def read_bash_history(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_bash_lines(read_lines(spark, paths))


def read_zsh_history(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_zsh_lines(read_lines(spark, paths))


def assign_synthetic_epoch(entries: DataFrame) -> DataFrame:
    """Give untimed entries of a file rising seconds that end at the fixed base.

    The k-th of M gets ``base - M + k``. A file that grew gets other seconds,
    so its untimed lines import again.
    """
    untimed = F.col("epoch").isNull()
    counts = rows_before(entries, ["file"], ["part"], untimed)
    inside = Window.partitionBy("file", "part").orderBy("pos")
    upto = F.count_if(untimed).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    synthetic = F.lit(SYNTHETIC_EPOCH) - F.col("total") + F.col("before") + F.col("upto")
    return (
        entries.withColumn("upto", upto)
        .join(counts, ["file", "part"])
        .withColumn("epoch", F.coalesce("epoch", synthetic))
        .drop("upto", "before", "total")
    )
