"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import discard, stage


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b): root is the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are
    linked to its smallest neighbour, then its smaller ones too. The number of rounds
    grows with the logarithm of the longest path. Links of a node are only grouped
    for their minimum, so that a node with very many links is no task of its own.
    Every round is written to the shared folder. Null ends and self-links are left
    out; no links give no rows.
    """
    plain = links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high"))
    edges = stage(plain.filter("low < high").distinct(), "links")
    marked = _mark(edges)
    while True:
        before, edges = edges, stage(_small_star(_large_star(edges)), "links")
        discard(before)
        mark = _mark(edges)
        if mark == marked:
            break
        marked = mark
    roots = edges.select(F.col("low").alias("root")).distinct()
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionAll(
        roots.select(F.col("root").alias("node"), "root")
    )


def _mark(edges: DataFrame) -> tuple:
    """Number and sum of hashes of the links: equal marks, equal links."""
    code = F.xxhash64("low", "high").cast("decimal(38,0)")
    row = edges.agg(F.count("*").alias("n"), F.sum(code).alias("code")).first()
    return row.n, row.code


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are linked to the smallest of the node and its neighbours."""
    both = edges.unionAll(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
    both = both.toDF("node", "other")
    least = both.groupBy("node").agg(F.min("other").alias("least"))
    least = least.select(F.col("node").alias("l_node"), F.least("node", "least").alias("least"))
    larger = both.filter("other > node").join(least, F.col("node") == F.col("l_node"))
    return larger.select(F.col("least").alias("low"), F.col("other").alias("high")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("high").agg(F.min("low").alias("least"))
    named = least.select(F.col("high").alias("l_node"), "least")
    smaller = edges.join(named, F.col("high") == F.col("l_node"))
    to_least = smaller.filter("low > least").select(F.col("least").alias("low"), F.col("low").alias("high"))
    own = least.select(F.col("least").alias("low"), "high")
    return to_least.unionAll(own).distinct()
