"""Summaries and usage profiles. Every one aggregates before it shuffles."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.times import local_datetime, local_timestamp
from cmdlog_spark.operators.filters import Session, command_is, keep
from cmdlog_spark.operators.topk import top


def summary(
    df: DataFrame,
    *,
    by_pwd: bool = False,
    limit: int | None = 100,
    tz: str = "UTC",
    **conditions,
) -> DataFrame:
    """Newest id, last local time and number of runs per command.

    ``by_pwd`` adds the directory to the key. ``conditions`` are those of
    :func:`cmdlog_spark.operators.filters.keep`.
    """
    keys = ["cmd", "pwd"] if by_pwd else ["cmd"]
    grouped = (
        keep(df, **conditions)
        .groupBy(*keys)
        .agg(F.max("id").alias("mid"), F.max("epoch").alias("last"), F.count("*").alias("cnt"))
    )
    order = [F.desc("mid"), *keys]
    return top(grouped, order, limit).select(
        "mid", local_datetime(F.col("last"), tz).alias("dt"), "cnt", *keys
    )


def top_commands(
    df: DataFrame,
    now: int,
    *,
    days: int = 30,
    limit: int | None = 50,
    session: Session | None = None,
    by_pwd: bool = False,
) -> DataFrame:
    """Most frequent commands, or (directory, command) pairs, of the last days."""
    keys = ["pwd", "cmd"] if by_pwd else ["cmd"]
    grouped = (
        keep(df, session=session, days=days, now=now)
        .groupBy(*keys)
        .agg(F.count("*").alias("cnt"), F.max("epoch").alias("last"))
    )
    order = [F.desc("cnt"), F.desc("last"), *keys]
    return top(grouped, order, limit).select("cnt", *keys)


def daily_counts(
    df: DataFrame,
    now: int,
    *,
    days: int = 30,
    session: Session | None = None,
    tz: str = "UTC",
) -> DataFrame:
    """Events per local day, oldest first; days without events are absent."""
    return (
        keep(df, session=session, days=days, now=now)
        .groupBy(local_timestamp(F.col("epoch"), tz).cast("date").alias("date"))
        .agg(F.count("*").alias("cnt"))
        .orderBy("date")
        .select(F.col("date").cast("string").alias("day"), "cnt")
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("rows"))


def command_directories(df: DataFrame) -> DataFrame:
    """One row per command and directory, however many directories there are."""
    return df.groupBy("cmd", "pwd").agg(
        F.count("*").alias("uses"),
        F.min("epoch").alias("first_used"),
        F.max("epoch").alias("last_used"),
    )


def profile_all(df: DataFrame) -> DataFrame:
    """Uses, first and last use, and number of directories of every command.

    Grouping by directory first makes the distinct count a plain count, and a
    command that fills the table reaches the second shuffle as one row per task.
    """
    return (
        command_directories(df)
        .groupBy("cmd")
        .agg(
            F.sum("uses").alias("total_uses"),
            F.min("first_used").alias("first_used"),
            F.max("last_used").alias("last_used"),
            F.count("pwd").alias("unique_dirs"),
        )
    )


def profile_all_approx(df: DataFrame, rsd: float = 0.02) -> DataFrame:
    """:func:`profile_all` in one shuffle, with an estimated directory count."""
    return df.groupBy("cmd").agg(
        F.count("*").alias("total_uses"),
        F.min("epoch").alias("first_used"),
        F.max("epoch").alias("last_used"),
        F.approx_count_distinct("pwd", rsd).alias("unique_dirs"),
    )


def profile(df: DataFrame, cmd: str) -> DataFrame:
    """Profile of one command; no row when it was never run."""
    return profile_all(df.where(command_is(cmd)))


def profile_directories(df: DataFrame, cmd: str) -> DataFrame:
    """The distinct directories of one command, in order, one per row."""
    return df.where(command_is(cmd)).select("pwd").distinct().orderBy("pwd")


def directory_preview(df: DataFrame, shown: int = 5) -> DataFrame:
    """First ``shown`` directories of each command and how many are left out."""
    pairs = df.select("cmd", "pwd").where(F.col("pwd").isNotNull()).distinct()
    first = (
        pairs.withColumn("rank", F.row_number().over(Window.partitionBy("cmd").orderBy("pwd")))
        .where(F.col("rank") <= shown)
        .groupBy("cmd")
        .agg(F.array_sort(F.collect_list("pwd")).alias("dirs"))
    )
    return (
        pairs.groupBy("cmd")
        .agg(F.count("*").alias("n"))
        .join(first, "cmd")
        .select("cmd", "dirs", (F.col("n") - F.size("dirs")).alias("more"))
    )
