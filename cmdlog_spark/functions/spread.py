"""Use all cores on an input that Spark reads in few tasks."""

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deal out the rows of a small, unsplit input before work that is heavy per row.

    An input of as many splits as there are cores, as any large one is, stays where it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
