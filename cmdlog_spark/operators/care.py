"""Look after the event table: profile, describe, audit and rewrite it."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cmdlog_spark.functions.cells import row_hash
from cmdlog_spark.functions.staging import stage
from cmdlog_spark.functions.times import day_of
from cmdlog_spark.operators.ledger import Ledger
from cmdlog_spark.schema import MAX_EPOCH, MIN_EPOCH
from cmdlog_spark.sinks.quarantine import REQUIRED

# Limits of the size and fragmentation notices.
MEGABYTE = 1_000_000
LARGE_MB = 100.0
FRAGMENTED_INFO, FRAGMENTED_WARN = 0.1, 0.2
RECLAIMABLE_MB = 10.0
#: A file far below the target costs a task of its own.
TARGET_FILE_BYTES = 128 * 1024 * 1024
SMALL_FILE_BYTES = TARGET_FILE_BYTES // 4


def table_profile(table: DataFrame, small_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """Rows, files, megabytes and the share of bytes in small files, one row."""
    files = table.groupBy("_metadata.file_path").agg(
        F.count("*").alias("rows"), F.max("_metadata.file_size").alias("bytes")
    )
    small = F.col("bytes") < small_bytes
    size = F.coalesce(F.sum("bytes"), F.lit(0))
    loose = F.coalesce(F.sum(F.when(small, F.col("bytes"))), F.lit(0))
    return files.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"),
        F.count("*").alias("files"),
        (size / MEGABYTE).alias("size_mb"),
        (loose / MEGABYTE).alias("small_mb"),
        F.when(size > 0, loose / size).otherwise(0.0).alias("fragmentation"),
    )


def table_health(table: DataFrame, small_bytes: int = SMALL_FILE_BYTES) -> DataFrame:
    """Notices that follow from the profile, as (check, status, detail)."""
    size, share, loose = F.col("size_mb"), F.col("fragmentation"), F.col("small_mb")

    def check(name: str, status: str, text: str, *values) -> F.Column:
        return F.struct(
            F.lit(name).alias("check"),
            F.lit(status).alias("status"),
            F.format_string(text, *values).alias("detail"),
        )

    percent = share * 100
    checks = F.array(
        check("table.rows", "ok", "%d rows in %d files", F.col("rows"), F.col("files")),
        F.when(size > LARGE_MB, check("table.size", "info", "large table (%.1f MB)", size)),
        F.when(
            share > FRAGMENTED_WARN,
            check("table.files", "warn", "%.1f%% of bytes in small files", percent),
        ).when(
            share > FRAGMENTED_INFO,
            check("table.files", "info", "%.1f%% of bytes in small files", percent),
        ),
        F.when(
            loose > RECLAIMABLE_MB,
            check("table.rewrite", "info", "%.1f MB worth a rewrite", loose),
        ),
    )
    return table_profile(table, small_bytes).select(F.inline(F.array_compact(checks)))


def describe_table(
    df: DataFrame, name: str, partitions: tuple[str, ...] = (), keys: tuple[str, ...] = ("id",)
) -> DataFrame:
    """Columns of a table in order, with type, flags, place in the key (0: none) and observed nulls."""
    columns = [
        F.struct(
            F.lit(name).alias("table"),
            F.lit(i).cast("bigint").alias("position"),
            F.lit(f.name).alias("column"),
            F.lit(f.dataType.simpleString()).alias("type"),
            F.lit(f.nullable).alias("nullable"),
            F.lit(f.name in partitions).alias("partition"),
            F.lit(keys.index(f.name) + 1 if f.name in keys else 0).cast("bigint").alias("key"),
            F.count_if(F.col(f.name).isNull()).alias("nulls"),
        )
        for i, f in enumerate(df.schema.fields, 1)
    ]
    return df.agg(F.array(*columns).alias("c")).select(F.inline("c"))


def audit(df: DataFrame) -> DataFrame:
    """Data checks with the number of offending rows.

    Required columns without nulls, readable times and, where hashes are
    stored, hashes that fit are read off in one pass. Repeated ids and hashes
    are counted per key before they are counted at all.
    """
    hashed = row_hash()
    no_null = [F.count_if(F.col(c).isNull()).alias(f"null.{c}") for c in ["id", *REQUIRED]]
    odd_time = ~F.col("epoch").between(MIN_EPOCH, MAX_EPOCH)
    counters = [*no_null, F.count_if(odd_time).alias("time.range")]
    if "row_hash" in df.columns:
        wrong = ~F.col("row_hash").eqNullSafe(hashed)
        counters.append(F.count_if(wrong).alias("hash.stored"))
    one_pass = df.agg(*counters)
    rows = one_pass.select(
        F.explode(F.create_map(*[x for c in one_pass.columns for x in (F.lit(c), F.col(f"`{c}`"))]))
    ).toDF("check", "rows")

    def repeats(key, name: str) -> DataFrame:
        per_key = df.groupBy(key.alias("key")).agg(F.count("*").alias("n"))
        extra = F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows")
        return per_key.agg(extra).select(F.lit(name).alias("check"), "rows")

    stored = F.col("row_hash") if "row_hash" in df.columns else hashed
    found = rows.unionByName(repeats(F.col("id"), "id.repeated")).unionByName(
        repeats(stored, "hash.repeated")
    )
    # Logging keeps duplicates, so repeated hashes are only worth a note.
    bad = F.when(F.col("check").isin("hash.repeated", "time.range"), "info").otherwise("fail")
    return found.select(
        "check",
        F.when(F.col("rows") == 0, "ok").otherwise(bad).alias("status"),
        "rows",
        F.format_string("%d rows", "rows").alias("detail"),
    )


def _fingerprint(df: DataFrame):
    """Row count and an order-free sum over hashes of whole rows, stored columns too."""
    row = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.sum(row).alias("hashes")).first()


def plan_files(table: DataFrame, target_bytes: int) -> DataFrame:
    """Days packed into files by the bytes they take: day, first, bins.

    A day's share of a file follows its rows. Days that follow each other fill a file
    together; one that takes more than a file has several. The running sum sees one row
    per day.
    """
    pieces = table.groupBy("day", F.col("_metadata.file_path").alias("file")).agg(
        F.count("*").alias("n"), F.max("_metadata.file_size").alias("size")
    )
    files = pieces.groupBy("file").agg(F.sum("n").alias("all"))
    share = F.col("size") * F.col("n") / F.col("all")
    days = pieces.join(files, "file").groupBy("day").agg(F.sum(share).alias("bytes"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("bytes").over(earlier), F.lit(0.0))
    return days.select(
        "day",
        F.floor(before / target_bytes).cast("int").alias("first"),
        F.greatest(F.lit(1), F.ceil(F.col("bytes") / target_bytes)).cast("int").alias("bins"),
    )


def optimise(
    spark: SparkSession, source: str, target: str, files: int | None = None
) -> DataFrame:
    """Rewrite the table to a new path, sorted, in fewer and fuller files.

    All stored columns go along as they are: a hash that does not fit stays for the audit
    to find, and the ledger goes too, so that a batch that is replayed after the rewrite
    writes nothing. Days are packed by the bytes they take, and a day that holds much of
    the table spans several files. The source is left alone; a rewrite that does not hold
    the same rows is an error.
    """
    table = spark.read.option("mergeSchema", "true").parquet(source)
    if "row_hash" not in table.columns:
        table = table.withColumn("row_hash", row_hash())
    if "day" not in table.columns:
        table = table.withColumn("day", day_of(F.col("epoch")))
    if files is None:
        target_bytes = TARGET_FILE_BYTES
    else:
        size = table_profile(spark.read.parquet(source)).first()["size_mb"] * MEGABYTE
        target_bytes = max(1, round(size / files))
    # One row per day: fewer than four million.
    plan = stage(plan_files(table, target_bytes), "files")
    last = plan.agg(F.max(F.col("first") + F.col("bins"))).first()[0] or 1
    piece = F.pmod(F.xxhash64("epoch", "id"), F.col("f_bins")).cast("int")
    named = plan.select(F.col("day").alias("f_day"), F.col("first").alias("f_first"), F.col("bins").alias("f_bins"))
    placed = table.join(F.broadcast(named), F.col("day").eqNullSafe(F.col("f_day")))
    (
        placed.withColumn("bin", F.col("f_first") + piece)
        .repartitionByRange(last, "bin")
        .sortWithinPartitions("day", "epoch", "id")
        .select(table.columns)
        .write.partitionBy("day")
        .parquet(target)
    )
    rewritten = spark.read.schema(table.schema).parquet(target)
    if _fingerprint(rewritten) != _fingerprint(table):
        raise RuntimeError(f"{target} does not hold the rows of {source}")
    Ledger(spark, source).copy_to(target)
    return rewritten
