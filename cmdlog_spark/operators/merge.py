"""Append events, import other tables without duplicates, count what happened."""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from cmdlog_spark.functions.cells import coerce_int, row_hash
from cmdlog_spark.functions.staging import stage
from cmdlog_spark.functions.times import day_of
from cmdlog_spark.operators.ledger import Ledger
from cmdlog_spark.operators.noise import NoiseRules, drop_noise
from cmdlog_spark.operators.numbering import assign_ids, number_in_place, write_in_place
from cmdlog_spark.schema import HISTORY, MAX_EPOCH, STORED
from cmdlog_spark.sinks.quarantine import REQUIRED, good_events, put_aside
from cmdlog_spark.sources.shell_files import assign_synthetic_epoch
from cmdlog_spark.sources.tables import table_so_far

FIELDS = [c for c in HISTORY.names if c != "id"]
#: What a hash tells apart. Directory and command are one text in it.
IDENTITY = ["hist_id", "epoch", "ppid", "salt"]
#: Decimal digits of an order key: source, number in the source, length of the directory.
SOURCE_DIGITS, NUMBER_DIGITS, LENGTH_DIGITS = 10, 20, 8


def with_derived(df: DataFrame) -> DataFrame:
    """Add the two stored columns that follow from a row."""
    return df.withColumns({"row_hash": row_hash(), "day": day_of(F.col("epoch"))})


def write_events(df: DataFrame, path: str) -> None:
    """Append rows to the table at ``path``, partitioned by day.

    The rebalance hint gives each day few files and splits a day that holds
    much of the data over several tasks.
    """
    df.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def last_id(table: DataFrame | None) -> int:
    """Largest id of a table, 0 for an empty or missing one."""
    if table is None:
        return 0
    return table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("id")).first()["id"]


def first_free_id(spark: SparkSession, path: str) -> int:
    return last_id(table_so_far(spark, path, STORED)) + 1


def append_events(
    df: DataFrame, path: str, rules: NoiseRules | None = None, no_filter: bool = False
) -> None:
    """Log events: put bad ones aside, drop noise, keep duplicates.

    Events without an ``id`` get ids that go on from the table's last. They are written
    first, so that their number is known and a task that runs again finds the same order.
    """
    spark = df.sparkSession
    put_aside(df, path)
    good = good_events(df)
    kept = good if no_filter else drop_noise(good, rules)
    ledger = Ledger(spark, path)
    if "id" in df.columns:
        write_events(with_derived(kept), path)
        ledger.ids_given_elsewhere()
        return
    kept = stage(write_in_place(kept), "events")
    entry = ledger.take(kept.count(), lambda: first_free_id(spark, path))
    write_events(with_derived(number_in_place(kept, entry["first"] - 1)), path)


def coerce_raw(raw: DataFrame) -> DataFrame:
    """Typed rows from loose cells, with ``bad`` marking those to skip."""
    loose = ("hist_id", "epoch", "ppid", "salt")
    typed = raw.select(
        "src",
        "src_ord",
        "id",
        "cmd",
        "pwd",
        *[coerce_int(F.col(f"{c}_txt"), F.col(f"{c}_type")).alias(c) for c in loose],
    )
    bad = F.lit(False)
    for name in REQUIRED:
        bad = bad | F.col(name).isNull()
    return typed.withColumn("bad", bad)


def _digits(value: Column, digits: int) -> Column:
    return F.lpad(value.cast(f"decimal({digits},0)").cast("string"), digits, "0")


def first_per_hash(
    rows: DataFrame, order: list[str], listed_in: DataFrame | None = None
) -> DataFrame:
    """First row of each hash in ``order``, with the columns of ``order`` and ``src``.

    ``order`` is nothing, or a whole number that goes up within columns that cut the rows
    into sources or chunks. Place and length of the directory make one number of fixed
    width, so that copies collapse in a hash table of the task that reads them; the hash
    itself is taken once per row that is left. ``listed_in`` is a table with at least the
    same sources or chunks that costs less to read, as one that has not been filtered.
    """
    chunk, chunks = order[:-1], None
    if chunk:
        # One row per source or chunk.
        listed = [*chunk, *(["src"] if "src" in rows.columns and "src" not in chunk else [])]
        chunks = (rows if listed_in is None else listed_in).select(*listed).distinct()
        chunks = chunks.withColumn("chunk_no", F.row_number().over(Window.orderBy(*chunk)))
        if chunk == ["src_ord"] and isinstance(rows.schema["src_ord"].dataType, IntegerType):
            number = F.col("src_ord").cast("decimal(10,0)") + (1 << 31)
            chunks = chunks.withColumn("chunk_no", number)
        else:
            same = F.lit(True)
            named = chunks.select("chunk_no", *[F.col(c).alias(f"at_{c}") for c in chunk])
            for name in chunk:
                same = same & F.col(name).eqNullSafe(F.col(f"at_{name}"))
            rows = rows.join(named, same)
            number = F.col("chunk_no")
    else:
        number = F.lit(0)
    # A missing number comes first.
    place = F.col(order[-1]).cast("decimal(20,0)") + F.lit(Decimal((1 << 63) + 1)) if order else F.lit(0)
    text = F.concat("pwd", F.lit("\n"), "cmd")
    key = F.concat(
        _digits(number, SOURCE_DIGITS),
        _digits(F.coalesce(place, F.lit(0)), NUMBER_DIGITS),
        _digits(F.char_length("pwd"), LENGTH_DIGITS),
    ).cast("decimal(38,0)")
    least = rows.groupBy(*IDENTITY, text.alias("text")).agg(F.min(key).alias("key"))
    width = SOURCE_DIGITS + NUMBER_DIGITS + LENGTH_DIGITS
    digits = F.lpad(F.col("key").cast("string"), width, "0")
    length = F.substring(digits, SOURCE_DIGITS + NUMBER_DIGITS + 1, LENGTH_DIGITS).cast("int")
    found = least.select(
        *IDENTITY,
        F.substring("text", F.lit(1), length).alias("pwd"),
        F.substr("text", length + 2).alias("cmd"),
        F.substring(digits, 1, SOURCE_DIGITS).cast("decimal(10,0)").alias("no"),
        F.nullif(F.substring(digits, SOURCE_DIGITS + 1, NUMBER_DIGITS).cast("decimal(20,0)"), F.lit(0)).alias("place"),
    ).withColumn("row_hash", row_hash())
    columns = ["row_hash", *IDENTITY, "pwd", "cmd"]
    if not order:
        return found.select(*columns)
    last = (F.col("place") - F.lit(Decimal((1 << 63) + 1))).cast("bigint").alias(order[-1])
    if chunks is None:
        return found.select(*columns, last)
    named = found.join(chunks, F.col("no") == F.col("chunk_no"))
    return named.select(*columns, *[c for c in chunks.columns if c != "chunk_no"], last)


def _on_days_of(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of a table partitioned by day that lie on the days of ``rows``.

    The list of days, of which there are fewer than four million, is written and prunes
    the partitions when the job runs: Spark reuses the broadcast of a plain scan for that.
    """
    days = stage(rows.select(day_of(F.col("epoch")).alias("day")).distinct(), "days")
    # True of every day; Spark prunes at run time only for a side that has a filter.
    days = days.where(F.col("day") <= day_of(F.lit(MAX_EPOCH).cast("bigint")))
    return target.join(F.broadcast(days), "day", "left_semi")


def hashes_of(target: DataFrame, days_from: DataFrame | None = None) -> DataFrame:
    """Distinct hashes of a table, stored or derived.

    Of a table partitioned by day only what meets ``days_from`` is read and kept: equal
    hashes have equal epochs, so other days are pruned, and of the rest only hashes that
    occur there are shuffled. For that last step Spark broadcasts them, or tests a Bloom
    filter of them in the scan where they are many.
    """
    pruned = days_from is not None and "day" in target.columns
    if pruned:
        target = _on_days_of(target, days_from)
    if "row_hash" not in target.columns:
        target = target.withColumn("row_hash", row_hash())
    hashes = target.select("row_hash")
    if pruned and "row_hash" in days_from.columns:
        hashes = hashes.join(days_from.select("row_hash"), "row_hash", "left_semi")
    return hashes.distinct()


def unseen(
    rows: DataFrame, target: DataFrame, days_from: DataFrame | None = None
) -> DataFrame:
    """Rows whose hash the target does not hold."""
    return rows.join(hashes_of(target, days_from), "row_hash", "left_anti")


def already_present(
    rows: DataFrame, target: DataFrame, days_from: DataFrame | None = None
) -> DataFrame:
    """Rows whose hash the target holds."""
    return rows.join(hashes_of(target, days_from), "row_hash", "left_semi")


def import_stats(
    rows: DataFrame, new_rows: DataFrame, sources: list[str] | None = None
) -> DataFrame:
    """Considered, skipped and inserted rows per source, and a total row.

    ``sources`` are the names of all sources given, in order: one without rows has a line
    of zeros.
    """
    if sources is not None and not sources:
        raise ValueError("at least one source is required")
    considered = rows.groupBy("src_ord", "src").agg(
        F.count("*").alias("considered"), F.count_if("bad").alias("skipped_bad")
    )
    inserted = new_rows.groupBy("src_ord").agg(F.count("*").alias("inserted"))
    per_source = considered.join(inserted, "src_ord", "left").select(
        "src_ord",
        "src",
        "considered",
        F.coalesce("inserted", F.lit(0)).alias("inserted"),
        "skipped_bad",
    )
    if sources is not None:
        kind = per_source.schema["src_ord"].dataType
        names = rows.sparkSession.createDataFrame(list(enumerate(sources)), "src_ord long, src string")
        absent = names.select(
            F.col("src_ord").cast(kind).alias("src_ord"),
            "src",
            *[F.lit(0).cast("bigint").alias(c) for c in ("considered", "inserted", "skipped_bad")],
        ).join(per_source.select("src"), "src", "left_anti")
        per_source = per_source.unionByName(absent)
    total = per_source.agg(
        F.lit(None).cast(per_source.schema["src_ord"].dataType).alias("src_ord"),
        F.lit("total").alias("src"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c)
            for c in ("considered", "inserted", "skipped_bad")
        ],
    )
    return per_source.unionByName(total)


def merge_typed(
    target: DataFrame, rows: DataFrame, order: list[str], sources: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """New rows and counters for rows that carry ``src``, ``src_ord``, ``bad``."""
    once = first_per_hash(rows.where(~F.col("bad")), order, listed_in=rows)
    new_rows = unseen(once, target, days_from=once)
    return new_rows, import_stats(rows, new_rows, sources)


def merge_import(
    target: DataFrame, raw: DataFrame, sources: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``raw`` to insert into ``target``, and the counters.

    Sources count in the order of ``src_ord``, rows by ``id``; the first copy
    of a row wins. ``sources`` names them all, also those without rows.
    """
    return merge_typed(target, coerce_raw(raw), ["src_ord", "id"], sources)


def typed_entries(
    entries: DataFrame, pwd: str, ppid: int = 0, salt: int = 0
) -> DataFrame:
    """Parsed shell files as rows to merge, of one directory and session."""
    return assign_synthetic_epoch(entries).select(
        F.col("file").cast("string").alias("src"),
        F.col("file").alias("src_ord"),
        "part",
        F.col("pos").alias("id"),
        F.lit(None).cast("bigint").alias("hist_id"),
        "cmd",
        "epoch",
        F.lit(ppid).cast("bigint").alias("ppid"),
        F.lit(pwd).alias("pwd"),
        F.lit(salt).cast("bigint").alias("salt"),
        F.lit(False).alias("bad"),
    )


def merge_history_files(
    target: DataFrame, entries: DataFrame, pwd: str, ppid: int = 0, salt: int = 0
) -> tuple[DataFrame, DataFrame]:
    """New rows and counters for parsed shell files. No noise filter applies.

    The parsed entries are read several times, so they are written first.
    """
    rows = typed_entries(stage(entries, "entries"), pwd, ppid, salt)
    return merge_typed(target, rows, ["src_ord", "part", "id"])


def number_new_rows(new_rows: DataFrame, start: int) -> DataFrame:
    """History rows with ids that go on from ``start`` in insert order."""
    order = [c for c in ("src_ord", "part", "id") if c in new_rows.columns]
    numbered = assign_ids(new_rows, start, order=order)
    return numbered.select(*HISTORY.names, "row_hash")


def insert_new_rows(spark: SparkSession, path: str, new_rows: DataFrame) -> None:
    """Number the new rows, a written table, after the ids taken so far and append them."""
    entry = Ledger(spark, path).take(new_rows.count(), lambda: first_free_id(spark, path))
    numbered = number_new_rows(new_rows, entry["first"] - 1)
    write_events(numbered.withColumn("day", day_of(F.col("epoch"))), path)


def _import(
    spark: SparkSession, path: str, rows: DataFrame, order: list[str], sources: list[str] | None = None
) -> DataFrame:
    """Merge into the table at ``path`` and return the counters.

    Sources, their distinct rows and the new rows are written once each: all are read
    several times, and the counters must not see the table after the append.
    """
    rows = stage(rows, "import-rows")
    target = table_so_far(spark, path)
    if target is None:
        target = spark.createDataFrame([], HISTORY)
    once = stage(first_per_hash(rows.where(~F.col("bad")), order, listed_in=rows), "import-once")
    new_rows = stage(unseen(once, target, days_from=once), "import-new")
    insert_new_rows(spark, path, new_rows)
    return import_stats(rows, new_rows, sources)


def import_tables(
    spark: SparkSession, path: str, raw: DataFrame, sources: list[str] | None = None
) -> DataFrame:
    """Import ``raw`` rows of other tables into the table at ``path``."""
    return _import(spark, path, coerce_raw(raw), ["src_ord", "id"], sources)


def import_history_files(
    spark: SparkSession, path: str, entries: DataFrame, pwd: str, ppid: int = 0, salt: int = 0
) -> DataFrame:
    """Import parsed shell files into the table at ``path``."""
    rows = typed_entries(stage(entries, "entries"), pwd, ppid, salt)
    return _import(spark, path, rows, ["src_ord", "part", "id"])
