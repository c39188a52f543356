"""Row conditions on the history table. All of them combine with AND."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.functions.text import ascii_lower, ascii_lower_str
from cmdlog_spark.functions.times import day_of
from cmdlog_spark.schema import DAY_SECONDS, WINDOW_SECONDS

Session = tuple[int, int]


def in_session(session: Session) -> Column:
    """``session`` is the pair (salt, ppid)."""
    salt, ppid = session
    return (F.col("salt") == salt) & (F.col("ppid") == ppid)


def in_directory(directory: str) -> Column:
    return F.col("pwd") == directory


def under_directory(directory: str) -> Column:
    """Literal prefix, ASCII case ignored, no notion of path separators."""
    return ascii_lower(F.col("pwd")).startswith(ascii_lower_str(directory))


def contains_text(query: str) -> Column:
    """Literal substring of the command, ASCII case ignored."""
    return ascii_lower(F.col("cmd")).contains(ascii_lower_str(query))


def starts_with_text(query: str) -> Column:
    return ascii_lower(F.col("cmd")).startswith(ascii_lower_str(query))


def since(epoch: int) -> Column:
    return F.col("epoch") >= epoch


def days_cutoff(now: int, days: int) -> int:
    return now - DAY_SECONDS * days


def last_days(now: int, days: int) -> Column:
    return since(days_cutoff(now, days))


def command_is(cmd: str) -> Column:
    return F.col("cmd") == cmd


def command_differs(cmd: str) -> Column:
    return F.col("cmd") != cmd


def close_in_time(left: Column, right: Column, seconds: int = WINDOW_SECONDS) -> Column:
    return F.abs(left - right) < seconds


def keep_since(df: DataFrame, epoch: int) -> DataFrame:
    """``since`` plus the partition condition that follows from it."""
    if "day" in df.columns:
        df = df.where(F.col("day") >= day_of(F.lit(epoch)))
    return df.where(since(epoch))


def keep(
    df: DataFrame,
    *,
    session: Session | None = None,
    here: str | None = None,
    under: str | None = None,
    query: str | None = None,
    starts: bool = False,
    since_epoch: int | None = None,
    days: int | None = None,
    now: int | None = None,
) -> DataFrame:
    """Apply every condition that is given."""
    if here is not None and under is not None:
        raise ValueError("here and under exclude each other")
    if since_epoch is not None and days is not None:
        raise ValueError("since_epoch and days exclude each other")
    if days is not None:
        if now is None:
            raise ValueError("days needs now")
        since_epoch = days_cutoff(now, days)
    if since_epoch is not None:
        df = keep_since(df, since_epoch)
    if session is not None:
        df = df.where(in_session(session))
    if here is not None:
        df = df.where(in_directory(here))
    if under is not None:
        df = df.where(under_directory(under))
    if query is not None:
        df = df.where(starts_with_text(query) if starts else contains_text(query))
    return df
