"""The answers users ask for, composed from the operators."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.functions.commands import command_context, command_type
from cmdlog_spark.functions.text import suggestion_text, variation_mark
from cmdlog_spark.functions.times import local_datetime, relative_time
from cmdlog_spark.operators.aggregate import directory_preview, profile
from cmdlog_spark.operators.filters import command_is, keep
from cmdlog_spark.operators.related import suggestions
from cmdlog_spark.operators.topk import newest_first, oldest_first, recent_runs


def _rows(df: DataFrame, tz: str) -> DataFrame:
    return df.select("id", local_datetime(F.col("epoch"), tz).alias("dt"), "pwd", "cmd", "epoch")


def list_events(
    df: DataFrame, limit: int | None = 100, offset: int = 0, tz: str = "UTC", **conditions
) -> DataFrame:
    """Events in order of time, a page at a time."""
    return _rows(oldest_first(keep(df, **conditions), limit, offset), tz)


def search_events(
    df: DataFrame, query: str, limit: int | None = 100, tz: str = "UTC", **conditions
) -> DataFrame:
    """Newest events whose command contains ``query``."""
    return _rows(newest_first(keep(df, query=query, **conditions), limit), tz)


def preview(df: DataFrame, cmd: str, now: int, shown: int = 5) -> dict[str, DataFrame]:
    """Everything known about one command; all parts are empty for an unknown one.

    Nothing is written: each part is a scan of the rows of the command. One aggregate by
    directory leads to the profile and the directories, a bounded heap to the recent runs.
    """
    own = df.where(command_is(cmd))
    usage = profile(own, cmd).select(
        "*",
        relative_time(F.col("first_used"), now).alias("first_seen"),
        relative_time(F.col("last_used"), now).alias("last_seen"),
        command_type(F.col("cmd")).alias("type"),
        command_context(F.col("cmd")).alias("context"),
    )
    recent = recent_runs(own, cmd).select(
        "*",
        relative_time(F.col("epoch"), now).alias("when"),
        variation_mark(F.col("cmd"), cmd).alias("mark"),
    )
    known = usage.select(F.col("cmd").alias("base"))
    related = suggestions(df, cmd).join(known, "base", "left_semi")
    return {
        "profile": usage,
        "directories": directory_preview(own, shown),
        "recent": recent,
        "related": related.withColumn("shown", suggestion_text(F.col("cmd"))),
    }
