"""Legacy history tables, dumped as one JSON object per row.

A dump holds ``id, cmd, pwd`` and cells that the old table kept in any storage class:
numbers, texts or nulls, told apart by their JSON form. Spark splits large files; cells
come back as text with their class, and nothing is coerced here.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlog_spark.schema import RAW

# The columns whose cells may be of any storage class.
LOOSE_COLUMNS = ["hist_id", "epoch", "ppid", "salt"]


def _kind(cell: Column) -> Column:
    """Storage class of a JSON value."""
    name = F.schema_of_variant(cell)
    return (
        F.when(cell.isNull() | (name == "VOID"), "null")
        .when(name == "BIGINT", "integer")
        .when(name == "STRING", "text")
        .when(name.startswith("DOUBLE") | name.startswith("DECIMAL"), "real")
        .otherwise("blob")
    )


def _cells(name: str) -> list[Column]:
    cell = F.variant_get(F.col("row"), f"$.{name}", "variant")
    kind = _kind(cell)
    text = F.when(kind.isin("integer", "text", "real"), F.try_variant_get(F.col("row"), f"$.{name}", "string"))
    return [text.alias(f"{name}_txt"), kind.alias(f"{name}_type")]


def _plain(path: Column) -> Column:
    """A path in one form, however many slashes its scheme has."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "/+$", "")


def read_legacy_history(spark: SparkSession, paths: list[str]) -> DataFrame:
    """``RAW`` rows of every dump, a file or a folder; ``src_ord`` is the place in ``paths``.

    A line that is no JSON object is a row of nulls, which an import counts as bad.
    """
    if not paths:
        raise ValueError("at least one source is required")
    file = _plain(F.col("_metadata.file_path"))
    lines = spark.read.text(paths).select("value", file.alias("file"))
    lines = lines.withColumn("folder", F.regexp_replace("file", "/[^/]*$", ""))
    uris = [p.replace("%", "%25").replace(" ", "%20").replace("#", "%23") for p in paths]
    named = spark.createDataFrame(list(enumerate(zip(paths, uris, strict=True))), "src_ord int, p struct<src:string,uri:string>")
    named = named.select("src_ord", "p.src", _plain(F.col("p.uri")).alias("uri"))
    # Each line names its file and its folder; as many rows to meet as the caller has named paths.
    places = lines.select("value", F.explode(F.array("file", "folder")).alias("uri"))
    placed = places.join(F.broadcast(named), "uri")
    rows = placed.withColumn("row", F.try_parse_json("value"))

    def plain(name: str, kind: str) -> Column:
        return F.try_variant_get(F.col("row"), f"$.{name}", kind).alias(name)

    cells = [c for name in LOOSE_COLUMNS for c in _cells(name)]
    return rows.select(
        "src", "src_ord", plain("id", "bigint"), plain("cmd", "string"), plain("pwd", "string"), *cells
    ).select(*RAW.names)
