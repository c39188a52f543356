"""Rows as JSON lines and fixed-width text."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.functions.times import local_datetime
from cmdlog_spark.operators.filters import Session, keep

# Key order of the two JSON forms and the text layouts.
EXPORT_KEYS = ["id", "hist_id", "epoch", "ppid", "pwd", "salt", "cmd"]
ROW_KEYS = ["id", "epoch", "pwd", "cmd"]
TEXT_LAYOUTS = {
    "list": ("%6d | %s | %s | %s", ["id", "dt", "pwd", "cmd"]),
    "summary": ("%6d | %s | %6d | %s", ["mid", "dt", "cnt", "cmd"]),
    "summary_pwd": ("%6d | %s | %6d | %s > %s", ["mid", "dt", "cnt", "pwd", "cmd"]),
    "top": ("%6d | %s", ["cnt", "cmd"]),
    "by_pwd": ("%6d | %s | %s", ["cnt", "pwd", "cmd"]),
    "daily": ("%s | %6d", ["day", "cnt"]),
}


def _json(keys: list[str]):
    return F.to_json(F.struct(*keys), {"ignoreNullFields": "false"})


def export_rows(df: DataFrame, session: Session | None = None) -> DataFrame:
    """The rows of an export, oldest first."""
    return keep(df, session=session).select(*EXPORT_KEYS).orderBy("epoch", "id")


def export_jsonl(df: DataFrame, path: str, session: Session | None = None) -> None:
    """Write one JSON object per event; file names follow the order of rows."""
    export_rows(df, session).select(_json(EXPORT_KEYS).alias("value")).write.text(path)


def to_export_json(df: DataFrame) -> DataFrame:
    return df.select("id", _json(EXPORT_KEYS).alias("value"))


def to_json_rows(df: DataFrame) -> DataFrame:
    """``{id, epoch, pwd, cmd}`` objects, one per row."""
    return df.select("id", _json(ROW_KEYS).alias("value"))


def to_text_rows(df: DataFrame, kind: str, tz: str = "UTC") -> DataFrame:
    """One line of text per row in the layout of ``kind``."""
    layout, columns = TEXT_LAYOUTS[kind]
    if "dt" in columns and "dt" not in df.columns:
        df = df.withColumn("dt", local_datetime(F.col("epoch"), tz))
    return df.select(F.format_string(layout, *columns).alias("value"))
