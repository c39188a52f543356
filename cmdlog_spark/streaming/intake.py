"""Events as a stream: plain intake, and intake that merges."""

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from cmdlog_spark.operators.ledger import Ledger
from cmdlog_spark.operators.merge import (
    first_free_id,
    first_per_hash,
    unseen,
    with_derived,
    write_events,
)
from cmdlog_spark.operators.noise import NoiseRules, drop_noise
from cmdlog_spark.operators.numbering import number_in_place, write_in_place
from cmdlog_spark.schema import EVENT, STORED
from cmdlog_spark.sinks.quarantine import CORRUPT, good_events, put_aside
from cmdlog_spark.sources.tables import table_so_far


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON events, one per line, from files as they arrive in a folder.

    A line that is no event comes as its text in a column of its own.
    """
    layout = T.StructType([*EVENT.fields, T.StructField(CORRUPT, T.StringType())])
    return spark.readStream.schema(layout).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def prepare(events: DataFrame, rules: NoiseRules | None, no_filter: bool) -> DataFrame:
    """The good events, without noise."""
    good = good_events(events)
    return with_derived(good if no_filter else drop_noise(good, rules))


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name kept with the checkpoint: a new checkpoint is a new stream."""
    path = f"{checkpoint.rstrip('/')}/intake-id"
    try:
        return spark.read.text(path).first().value
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    name = uuid.uuid4().hex
    spark.createDataFrame([(name,)], "value string").write.text(path)
    return name


def _write_once(batch: DataFrame, rows: DataFrame, path: str, name: str) -> None:
    """Give the rows of a batch ids and append them, however often the batch comes.

    The ledger says whether the table holds the batch. If a failure came between, its
    rows and ids are those of the first time, and what the table holds of these ids is
    left out. Neither costs a read of the table, but for a batch that failed half-way.
    """
    spark = batch.sparkSession
    ledger = Ledger(spark, path)
    if ledger.is_done(name):
        return
    entry = ledger.find(name)
    begun = entry is not None
    if not begun:
        put_aside(batch, path, name)
        kept = ledger.keep(write_in_place(rows), name)
        count = spark.read.parquet(kept).count()
        entry = ledger.take(count, lambda: first_free_id(spark, path), name, kept)
    numbered = number_in_place(spark.read.parquet(entry["kept"]), entry["first"] - 1)
    table = table_so_far(spark, path, STORED) if begun else None
    if table is not None:
        last = entry["first"] + entry["rows"] - 1
        held = table.where(F.col("id").between(entry["first"], last)).select("id")
        numbered = numbered.join(held, "id", "left_anti")
    write_events(numbered, path)
    ledger.done(name, entry)


def start_intake(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    rules: NoiseRules | None = None,
    no_filter: bool = False,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append arriving events to the table at ``path``; duplicates stay, bad ones are put aside.

    Batches are written as ``append_events`` writes, so that the table holds what
    streams and batches have added, with ids that go on. A batch that is replayed after a
    failure is not written again.
    """
    stream = _stream_id(events.sparkSession, checkpoint)

    def append_batch(batch: DataFrame, number: int) -> None:
        # Read for the good and for the bad events.
        batch = batch.persist()
        try:
            _write_once(batch, prepare(batch, rules, no_filter), path, f"{stream}-{number}")
        finally:
            batch.unpersist()

    return (
        events.writeStream.foreachBatch(append_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def start_merge(
    events: DataFrame,
    path: str,
    checkpoint: str,
    *,
    rules: NoiseRules | None = None,
    no_filter: bool = False,
    window: str | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Append only events whose hash the table at ``path`` does not hold, with new ids.

    Copies within a batch collapse in the tasks that read them; the rest meet
    the touched days of the table. No event is ever too late; bad ones are put aside.

    ``window`` adds state that drops copies arriving that close together, for
    senders that repeat themselves often. It runs on arrival time: with event
    time, a late event would fall behind the watermark and be lost. All copies
    of an event share a state partition, so leave it out when one event may
    repeat without bound.
    """
    stream = _stream_id(events.sparkSession, checkpoint)
    arriving = events
    if window is not None:
        # Bad events have no hash to go by: they stay apart from one another.
        whole = [c for c in events.columns if c != CORRUPT]
        corrupt = F.coalesce(CORRUPT, F.lit("")) if CORRUPT in events.columns else F.lit("")
        arriving = (
            events.withColumn("arrived", F.current_timestamp())
            .withColumn("alike", F.sha2(F.concat(F.to_json(F.struct(*whole)), corrupt), 256))
            .withWatermark("arrived", window)
            .dropDuplicatesWithinWatermark(["alike"])
            .drop("arrived", "alike")
        )

    def merge_batch(batch: DataFrame, number: int) -> None:
        # Read several times below; kept, or the source and any state would run again.
        batch = batch.persist()
        try:
            once = first_per_hash(prepare(batch, rules, no_filter), [])
            target = table_so_far(batch.sparkSession, path, STORED)
            new_rows = once if target is None else unseen(once, target, days_from=once)
            rows = with_derived(new_rows.select(*EVENT.names))
            _write_once(batch, rows, path, f"{stream}-{number}")
        finally:
            batch.unpersist()

    return (
        arriving.writeStream.foreachBatch(merge_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
