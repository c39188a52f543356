"""Nearest neighbours by a robust-pruned directed graph in every shard."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import discard, pick, short_lived_shuffles, small_batches, stage

# Numbers that one step of pruning or scoring unfolds at a time, in memory a few times over.
CELLS = 4 << 20
# Bytes of vectors in one graph and in one pack of queries, as doubles.
GRAPH_BYTES, PACK_BYTES = 32 << 20, 16 << 20
# Rows that are whole graphs: few to a row group, which readers unfold at once.
LONG_ROWS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.enable.dictionary": "false"}


@dataclass(frozen=True)
class Settings:
    """shard_rows: distinct vectors of one graph; degree: edges of a node; beam: nodes kept
    by a search; relax: how much nearer a neighbour must be to rule out an edge; wave:
    queries that one task answers; parts: tasks at most among which a wave finds the graphs."""

    shard_rows: int = 12_000
    degree: int = 28
    beam: int = 144
    build_beam: int = 40
    relax: float = 1.2
    batch: int = 256
    wave: int = 20_000
    parts: int = 16
    nearest: int = 20
    every: int = 20


def greedy(points, edges, entry: int, queries, beam: int, batch: int = 256):
    """Beam search of all queries at once: the nearest nodes found and their squared distances.

    In each step every query opens its nearest node that is not yet open and takes in
    that node's neighbours; it ends when all nodes of the beam are open.
    """
    nodes = np.full((len(queries), beam), -1, np.int32)
    dists = np.full((len(queries), beam), np.inf, np.float32)
    norms = np.einsum("ij,ij->i", points, points)
    for start in range(0, len(queries), batch):
        q = queries[start : start + batch]
        rows = np.arange(len(q))
        found = np.full((len(q), beam), -1, np.int32)
        far = np.full((len(q), beam), np.inf, np.float32)
        opened = np.zeros((len(q), beam), bool)
        seen = np.zeros((len(q), len(points)), bool)
        found[:, 0] = entry
        far[:, 0] = norms[entry] - 2 * (q @ points[entry])
        seen[:, entry] = True
        active = rows
        while len(active):
            candidates = np.where(opened[active] | (found[active] < 0), np.inf, far[active])
            best = candidates.argmin(axis=1)
            alive = candidates[np.arange(len(active)), best] < np.inf
            active, best = active[alive], best[alive]
            if not len(active):
                break
            opened[active, best] = True
            near = edges[found[active, best]]
            new = (near >= 0) & ~seen[active[:, None], near]
            seen[active[:, None], np.where(new, near, entry)] = True
            safe = np.where(new, near, 0)
            d = norms[safe] - 2 * np.einsum("qrd,qd->qr", points[safe], q[active])
            d = np.where(new, d, np.inf).astype(np.float32)
            all_d = np.concatenate([far[active], d], axis=1)
            all_n = np.concatenate([found[active], np.where(new, near, -1)], axis=1)
            all_o = np.concatenate([opened[active], np.zeros_like(new)], axis=1)
            keep = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
            far[active] = np.take_along_axis(all_d, keep, axis=1)
            found[active] = np.take_along_axis(all_n, keep, axis=1)
            opened[active] = np.take_along_axis(all_o, keep, axis=1)
        nodes[start : start + batch], dists[start : start + batch] = found, far
    return nodes, dists


def robust_prune(points, own: np.ndarray, candidates: np.ndarray, degree: int, relax: float) -> np.ndarray:
    """For each point its diverse neighbours: the nearest candidate is taken, candidates much
    nearer to it than to the point are ruled out, and so on."""
    step = max(1, CELLS // (candidates.shape[1] * points.shape[1]))
    if len(own) > step:  # many candidates or long vectors: each point is pruned by itself
        parts = [slice(start, start + step) for start in range(0, len(own), step)]
        return np.concatenate([robust_prune(points, own[p], candidates[p], degree, relax) for p in parts])
    c = points[np.maximum(candidates, 0)]
    p = points[own]
    to_point = ((c - p[:, None, :]) ** 2).sum(axis=2)
    # A candidate that repeats counts once.
    order = np.argsort(candidates, axis=1, kind="stable")
    sorted_ = np.take_along_axis(candidates, order, axis=1)
    again = np.zeros_like(sorted_, bool)
    again[:, 1:] = sorted_[:, 1:] == sorted_[:, :-1]
    repeats = np.zeros_like(again)
    np.put_along_axis(repeats, order, again, axis=1)
    to_point = np.where((candidates < 0) | (candidates == own[:, None]) | repeats, np.inf, to_point)
    out = np.full((len(own), degree), -1, np.int32)
    rows = np.arange(len(own))
    for k in range(degree):
        best = to_point.argmin(axis=1)
        live = to_point[rows, best] < np.inf
        if not live.any():
            break
        out[live, k] = candidates[rows, best][live]
        between = ((c - c[rows, best][:, None, :]) ** 2).sum(axis=2)
        to_point = np.where(relax * relax * between <= to_point, np.inf, to_point)
        to_point[rows, best] = np.inf
    return out


def build(points: np.ndarray, settings: Settings, seed: int = 0) -> tuple[np.ndarray, int]:
    """Edges of every node and the node where searches begin."""
    n, rng = len(points), np.random.default_rng(seed)
    degree = settings.degree
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    if n <= degree + 1:
        all_ = np.tile(np.arange(n, dtype=np.int32), (n, 1))
        edges = np.full((n, degree), -1, np.int32)
        edges[:, :n] = np.where(all_ == np.arange(n)[:, None], -1, all_)[:, :degree]
        return edges, entry
    edges = rng.integers(0, n, (n, degree), dtype=np.int32)
    for relax in (1.0, settings.relax):
        order = rng.permutation(n)
        for start in range(0, n, settings.batch):
            own = order[start : start + settings.batch]
            found, _ = greedy(points, edges, entry, points[own], settings.build_beam, settings.batch)
            mine = np.concatenate([found, edges[own]], axis=1)
            edges[own] = robust_prune(points, own, mine, degree, relax)
            _add_backward(points, edges, own, relax)
    return edges, entry


def _add_backward(points, edges: np.ndarray, own: np.ndarray, relax: float) -> None:
    """Every new edge in the other direction too; full nodes are pruned again."""
    degree = edges.shape[1]
    sources = np.repeat(own, degree)
    targets = edges[own].ravel()
    sources, targets = sources[targets >= 0], targets[targets >= 0]
    order = np.argsort(targets, kind="stable")
    sources, targets = sources[order], targets[order]
    nodes, begin, count = np.unique(targets, return_index=True, return_counts=True)
    wide = np.full((len(nodes), int(count.max()) if len(count) else 0), -1, np.int32)
    column = np.arange(len(targets)) - np.repeat(begin, count)
    wide[np.repeat(np.arange(len(nodes)), count), column] = sources
    for start in range(0, len(nodes), 512):
        part = slice(start, start + 512)
        some = wide[part][:, : max(1, int(count[part].max()))]
        mine = np.concatenate([edges[nodes[part]], some], axis=1)
        edges[nodes[part]] = robust_prune(points, nodes[part], mine, degree, relax)


def _matrix(vectors) -> np.ndarray:
    return np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), -1)


def _lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """One more coordinate makes all lengths equal; then near means large inner product."""
    rest = np.sqrt(np.maximum(0, longest - np.einsum("ij,ij->i", vectors, vectors)))
    return np.concatenate([vectors, rest[:, None]], axis=1).astype(np.float32)


def distinct_vectors(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """Staged classes of equal vectors: key, vector (bytes of ``_narrow``), size of the vector and
    the smallest ids of the class, one more than are asked for."""
    rows = pick(embeddings, vec_id="long", embedding="array<double>").filter("vec_id IS NOT NULL")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(F.col("embedding").isNotNull() & finite & some)
    # Equal numbers, equal bytes: -0.0 becomes 0.0.
    rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x + 0.0))

    def pack(batches):
        for batch in batches:
            arrays = [np.asarray(v, "<f8") for v in batch["embedding"]]
            yield pd.DataFrame(
                {"vec_id": batch["vec_id"], "vector": [a.tobytes() for a in arrays], "size": [len(a) for a in arrays]}
            )

    packed = rows.mapInPandas(pack, "vec_id long, vector binary, size int")
    # The rank filter works in every task before the shuffle: a hot vector stays small.
    ranked = packed.withColumn("rank", F.row_number().over(W.partitionBy("vector").orderBy("vec_id")))
    ranked = ranked.filter(F.col("rank") <= settings.nearest + 1)
    classes = ranked.groupBy("vector", "size").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = classes.withColumn("key", F.xxhash64("vector"))

    def narrow(batches):
        for batch in batches:
            yield batch.assign(vector=[_narrow(np.frombuffer(v, "<f8")) for v in batch["vector"]])

    return stage(classes.mapInPandas(narrow, classes.schema), "classes")


def nearest_neighbours(embeddings: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Rows query_id, rank, vec_id, score: the nearest found for every ``every``-th id.

    Candidates are all rows but the query's own; near is a large inner product, in double
    precision; ties go to the smaller vec_id. Vectors that are null, empty, zero or hold
    null or non-finite numbers take no part, neither do rows without an id; vectors of
    another length than the query's are no candidates. Rows with one id: each is a row.
    An empty table gives no rows.

    Equal vectors are one node, so that a hot vector does not fill a graph. Shards of
    bounded size get a graph each; all queries search all shards, in waves of bounded
    size, and the exact scores of what they find are ranked. A graph is one row and so is
    a wave: their pairs are formed where they are searched, and no copies are shuffled. A
    task keeps the nearest so far of each query, and works on few queries at a time.
    """
    spark = embeddings.sparkSession
    # One pair of a graph and a wave at a time goes to Python.
    with small_batches(spark), short_lived_shuffles(spark):
        return _nearest_neighbours(embeddings, settings or Settings())


def _nearest_neighbours(embeddings: DataFrame, settings: Settings) -> DataFrame:
    graphs = _graphs(embeddings, settings)
    packs = _packs(embeddings, settings)
    # Not an equation of two columns, by which all vectors of one length would meet in one task.
    alike = (F.col("size") - F.col("length")) == 0
    pairs = graphs.coalesce(settings.parts).join(packs, alike).drop("shard", "length")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nearest = {}
        for batch in batches:
            for pair in batch.itertuples(index=False):
                query_ids, found = np.frombuffer(pair.query_ids, "<i8"), _searched(pair, settings)
                if pair.pack in nearest:
                    found = _nearest([nearest[pair.pack][1], found], settings.nearest)
                nearest[pair.pack] = query_ids, found
        for query_ids, (row, ids, score) in nearest.values():
            yield pd.DataFrame({"query_id": query_ids[row], "vec_id": ids, "score": score})

    hits = pairs.mapInPandas(search, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.nearest)
    ranked = stage(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    discard(graphs, packs)
    return ranked


def _graphs(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """Staged graphs, one a row: shard, size of its vectors, the vectors, edges, numbers of ids
    and ids of all its nodes one behind the other, and what a search needs to begin."""
    classes = distinct_vectors(embeddings, settings)
    total, numbers = classes.agg(F.count("*"), F.coalesce(F.sum(F.col("size").cast("long")), F.lit(0))).first()
    shards = max(1, -(-total // settings.shard_rows), -(-8 * numbers // GRAPH_BYTES))
    sharded = classes.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shards)).cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        size = int(group["size"].iloc[0])
        vectors = np.concatenate([_wide(v, 1, size) for v in group["vector"]])
        order = sorted(range(len(vectors)), key=lambda i: vectors[i].tobytes())
        vectors, each = vectors[order], group["ids"].to_numpy()[order]
        longest = float(np.einsum("ij,ij->i", vectors, vectors).max())
        edges, entry = build(_lifted(vectors, longest), settings)
        counts = np.array([len(x) for x in each], "<i4")
        ids = np.concatenate(each).astype("<i8")
        return pd.DataFrame(
            {
                "shard": [group["shard"].iloc[0]], "size": [size], "vectors": [_narrow(vectors)],
                "edges": [edges.astype("<i4").tobytes()], "counts": [counts.tobytes()], "ids": [ids.tobytes()],
                "longest": [longest], "entry": [entry],
            }
        )

    graphs = sharded.groupBy("shard", "size").applyInPandas(
        make,
        "shard int, size int, vectors binary, edges binary, counts binary, ids binary, longest double, entry int",
    )
    graphs = stage(graphs, "graphs", **LONG_ROWS)
    discard(classes)
    return graphs


def _packs(embeddings: DataFrame, settings: Settings) -> DataFrame:
    """Staged queries, up to a wave of one length a row: pack (its number), length, query_ids and
    the vectors, one behind the other."""
    asked = pick(embeddings, vec_id="long", embedding="array<double>")
    asked = asked.filter(F.col("vec_id") % settings.every == 0).select("vec_id", "embedding")
    queries = stage(_queries(asked), "queries")
    waves = max(1, -(-queries.count() // settings.wave))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40

        def packed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal number
            for length, group in rows.groupby("size"):
                yield pd.DataFrame(
                    {
                        "pack": [number], "length": [length], "asked": [_narrow(_matrix(group["vector"]))],
                        "query_ids": [group["query_id"].to_numpy("<i8").tobytes()],
                    }
                )
                number += 1

        waiting, rows, size = [], 0, 0
        for batch in batches:
            # At most as many rows of this batch as the wave still takes.
            while len(batch):
                taken, batch = batch.iloc[: settings.wave - rows], batch.iloc[settings.wave - rows :]
                waiting.append(taken)
                rows, size = rows + len(taken), size + 8 * int(taken["size"].sum())
                if rows >= settings.wave or size >= PACK_BYTES:
                    yield from packed(pd.concat(waiting))
                    waiting, rows, size = [], 0, 0
        if waiting:
            yield from packed(pd.concat(waiting))

    packs = queries.coalesce(waves).mapInPandas(pack, "pack long, length int, asked binary, query_ids binary")
    packs = stage(packs, "packs", **LONG_ROWS)
    discard(queries)
    return packs


def _searched(pair, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest in one graph to each query of one pack: row of the query, id, score."""
    counts, ids, query_ids = (np.frombuffer(b, t) for b, t in ((pair.counts, "<i4"), (pair.ids, "<i8"), (pair.query_ids, "<i8")))
    first = np.cumsum(counts, dtype=np.int64) - counts
    vectors, asked = _wide(pair.vectors, len(counts), pair.size), _wide(pair.asked, len(query_ids), pair.size)
    points = _lifted(vectors, pair.longest)
    edges = np.frombuffer(pair.edges, "<i4").reshape(len(counts), -1)
    beam, hits = min(settings.beam, len(counts)), []
    for start in range(0, len(asked), settings.batch):
        q = asked[start : start + settings.batch]
        lifted = np.concatenate([q, np.zeros((len(q), 1))], axis=1).astype(np.float32)
        found, _ = greedy(points, edges, pair.entry, lifted, beam, settings.batch)
        row, column = np.nonzero(found >= 0)
        node = found[row, column]
        score = _scores(q, vectors, row, node)
        # One class more than asked for: the query's own may be among them.
        order = np.lexsort((-score, row))
        row, node, score = row[order], node[order], score[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) <= settings.nearest
        row, node, score = start + row[best], node[best], score[best]
        count = counts[node]
        place = np.arange(count.sum()) + np.repeat(first[node] - (np.cumsum(count) - count), count)
        row, score = np.repeat(row, count), np.repeat(score, count)
        other = query_ids[row] != ids[place]
        hits.append(_nearest([(row[other], ids[place][other], score[other])], settings.nearest))
    return tuple(np.concatenate(x) for x in zip(*hits, strict=True))


def _narrow(vectors: np.ndarray) -> bytes:
    """Four bytes a number where that loses nothing, else eight."""
    with np.errstate(over="ignore"):
        short = vectors.astype("<f4")
    return short.tobytes() if (short == vectors).all() else vectors.astype("<f8").tobytes()


def _wide(numbers: bytes, rows: int, size: int) -> np.ndarray:
    """The vectors, in double precision, that ``_narrow`` was given."""
    kind = "<f4" if len(numbers) == 4 * rows * size else "<f8"
    return np.frombuffer(numbers, kind).reshape(rows, size).astype(np.float64)


def _scores(queries: np.ndarray, vectors: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
    """Inner products of pairs, some at a time: unfolded, all would take the size of a vector each."""
    step = max(1, CELLS // (2 * vectors.shape[1]))
    parts = [slice(start, start + step) for start in range(0, len(row), step)]
    return np.concatenate([(queries[row[p]] * vectors[node[p]]).sum(axis=1) for p in parts])


def _nearest(hits: list[tuple], nearest: int) -> tuple:
    """Of hits, each (row of the query, id, score), the best of every row in the order of the result."""
    row, ids, score = (np.concatenate(x) for x in zip(*hits, strict=True))
    # Spark's order: what is no number comes before all numbers.
    order = np.lexsort((ids, -score, ~np.isnan(score), row))
    row, ids, score = row[order], ids[order], score[order]
    best = np.arange(len(row)) - np.searchsorted(row, row) < nearest
    return row[best], ids[best], score[best]


def _queries(asked: DataFrame) -> DataFrame:
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    asked = asked.filter(F.col("embedding").isNotNull() & finite & some)

    def pack(batches):
        for batch in batches:
            arrays = [np.asarray(v, "<f8") + 0.0 for v in batch["embedding"]]
            yield pd.DataFrame(
                {"query_id": batch["vec_id"], "vector": [a.tobytes() for a in arrays], "size": [len(a) for a in arrays]}
            )

    return asked.mapInPandas(pack, "query_id long, vector binary, size int")
