"""Event table and template catalog."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cmdlog_spark.schema import HISTORY, TEMPLATE


def scan_history(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The event table at ``path``, with ``day`` and ``row_hash`` where stored.

    The seven plain columns are always there, null where the files lack them; a
    query scans only the columns it names.
    """
    if fmt != "parquet":
        return spark.read.schema(HISTORY).format(fmt).load(path)
    stored = spark.read.parquet(path).columns
    fields = list(HISTORY.fields)
    if "row_hash" in stored:
        fields.append(T.StructField("row_hash", T.StringType()))
    if "day" in stored:
        fields.append(T.StructField("day", T.DateType()))
    return spark.read.schema(T.StructType(fields)).parquet(path)


def table_so_far(
    spark: SparkSession, path: str, schema: T.StructType | None = None
) -> DataFrame | None:
    """The table at ``path``, or None before anything has written it."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_templates(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """The template catalog, with the defaults of absent fields filled in.

    A variable is required unless it says otherwise; missing lists and maps
    are empty.
    """
    catalog = spark.read.schema(TEMPLATE).format(fmt).load(path)
    return fill_template_defaults(catalog)


def fill_template_defaults(catalog: DataFrame) -> DataFrame:
    variables = F.transform(
        "variables",
        lambda v: v.withField("required", F.coalesce(v["required"], F.lit(True))),
    )
    return catalog.withColumns(
        {
            "variables": F.coalesce(variables, F.array().cast(TEMPLATE["variables"].dataType)),
            "defaults": F.coalesce("defaults", F.create_map().cast("map<string,string>")),
        }
    )
