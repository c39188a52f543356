"""Events that lack what every event must have, kept beside the table with the reason."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cmdlog_spark.schema import EVENT

#: Fields every event must have, in the order in which the first fault is named.
REQUIRED = ["cmd", "pwd", "epoch", "ppid", "salt"]
#: Column with the text of a line that is no JSON event.
CORRUPT = "_corrupt"
QUARANTINE = T.StructType(
    [T.StructField("reason", T.StringType()), *EVENT.fields, T.StructField(CORRUPT, T.StringType())]
)


def fault(df: DataFrame) -> Column:
    """What is wrong with an event; null for a good one."""
    found = F.lit(None).cast("string")
    for name in reversed(REQUIRED):
        found = F.when(F.col(name).isNull(), f"no {name}").otherwise(found)
    if CORRUPT in df.columns:
        found = F.when(F.col(CORRUPT).isNotNull(), "malformed").otherwise(found)
    return found


def good_events(df: DataFrame) -> DataFrame:
    return df.where(fault(df).isNull()).drop(CORRUPT)


def bad_events(df: DataFrame) -> DataFrame:
    """The other events in the layout of the quarantine."""
    fields = {f.name: f.dataType for f in QUARANTINE.fields}
    named = df.withColumn("reason", fault(df)).where(F.col("reason").isNotNull())
    return named.select(
        *[
            (F.col(n) if n in named.columns else F.lit(None)).cast(kind).alias(n)
            for n, kind in fields.items()
        ]
    )


def _folder(path: str) -> str:
    return f"{path.rstrip('/')}-quarantine"


def put_aside(df: DataFrame, path: str, batch: str | None = None) -> None:
    """Write the bad events of a batch, if any; a batch that comes again replaces its own."""
    name, bad = batch or uuid.uuid4().hex, bad_events(df)
    if not bad.isEmpty():
        bad.write.mode("overwrite").parquet(f"{_folder(path)}/batch={name}")


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    """Rows reason, fields of the event, the corrupt line and the batch."""
    layout = T.StructType([*QUARANTINE.fields, T.StructField("batch", T.StringType())])
    try:
        return spark.read.schema(layout).parquet(_folder(path))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], layout)


def quarantine_counts(spark: SparkSession, path: str) -> DataFrame:
    """Rows reason, rows."""
    return read_quarantine(spark, path).groupBy("reason").agg(F.count("*").alias("rows"))
