"""Cut a long lineage by writing an intermediate table once.

The table goes to the shared folder the cluster names in
``spark.checkpoint.dir``, so a lost executor costs a re-read, not a re-run.
"""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


def staging_root(spark: SparkSession) -> str:
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(
        CHECKPOINT_DIR
    )
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    # One machine only: a fresh folder stands in for the shared one.
    root = tempfile.mkdtemp(prefix="cmdlog-")
    spark.conf.set(CHECKPOINT_DIR, root)
    return root


def staging_path(spark: SparkSession, name: str) -> str:
    return f"{staging_root(spark).rstrip('/')}/cmdlog/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, and continue from the written files."""
    spark = df.sparkSession
    path = staging_path(spark, name)
    if _OWNERS:
        _OWNERS[-1].append((spark, path))
    df.write.options(**options).parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.staged_path = path
    return written


#: Lists of tables written while ``owned`` is active, the innermost last.
_OWNERS: list[list[tuple[SparkSession, str]]] = []


@contextmanager
def owned() -> Iterator[list[tuple[SparkSession, str]]]:
    """Collects the tables that are staged inside, to be deleted by ``delete`` once what
    is read from them has been written."""
    made: list[tuple[SparkSession, str]] = []
    _OWNERS.append(made)
    try:
        yield made
    finally:
        _OWNERS.remove(made)


def delete(tables: list[tuple[SparkSession, str]]) -> None:
    """Delete staged tables; one that is gone already is no error."""
    for spark, path in tables:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    tables.clear()


def discard(*tables: DataFrame) -> None:
    """Delete tables returned by ``stage`` that nothing reads any more."""
    delete([(t.sparkSession, t.staged_path) for t in tables])
