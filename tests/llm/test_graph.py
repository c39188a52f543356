import threading

import numpy as np
import psutil
import pytest

from cmdlog_spark.llm import vector_graph
from cmdlog_spark.llm.vector_graph import Settings

KINDS = "vec_id long, embedding array<double>"


def exact(rows, asked, nearest=20):
    """(query_id, rank, vec_id) of every query of ``asked``, by comparing it with all rows."""
    out = []
    for query_id, q in asked:
        found = [(-float(np.dot(q, v)), i) for i, v in rows if len(v) == len(q) and i != query_id]
        out += [(query_id, k, i) for k, (_, i) in enumerate(sorted(found)[:nearest], 1)]
    return sorted(out)


def test_full_waves_need_little_memory(spark):
    """A worker unfolds the candidates of few queries at a time; those of all would take 1.4 GB."""
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(800, 16)) @ rng.normal(size=(16, 512))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], KINDS)

    def workers():
        for p in psutil.Process().children(recursive=True):
            try:
                if "pyspark.daemon" in " ".join(p.cmdline()):
                    yield p.pid, p.memory_info().rss >> 20
            except psutil.Error:
                pass

    before, grown, done = dict(workers()), [0], threading.Event()

    def watch():
        while not done.wait(0.02):
            grown.extend(mb - before.get(pid, 0) for pid, mb in workers())

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        got = vector_graph.nearest_neighbours(df, Settings(every=1)).toPandas()
    finally:
        done.set()
        watcher.join()
    assert 0 < max(grown) < 600
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    best = np.argsort(-scores, axis=1)[:, :20]
    hits = sum(len(set(own["vec_id"]) & set(best[q])) for q, own in got.groupby("query_id"))
    assert len(got) == 800 * 20 and hits >= 0.9 * len(got)


@pytest.mark.parametrize("settings", [Settings(), Settings(shard_rows=9, wave=4, batch=3)])
def test_lengths_ids_and_numbers_of_any_kind(spark, settings):
    """Graphs of a few nodes are complete, so the result is exact: several lengths, ids and vectors that
    repeat, scores that are equal, numbers that four bytes hold and that they don't."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=2 + i % 3)) for i in range(60)]
    rows += [(i, rng.integers(-2, 3, 5).astype(float)) for i in range(60, 81) if i % 7]
    rows += [(100 + i, rows[3][1]) for i in range(25)] + [(40, rows[0][1]), (20, rows[20][1])]
    rows += [(200, np.array([0.1, 1e-300])), (220, np.array([3.0, 1e9, 1e-3]))]
    rows = [(i, v) for i, v in rows if (v != 0).any()]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows], KINDS)
    got = vector_graph.nearest_neighbours(df, settings).toPandas()
    ids = [i for i, _ in rows if i % 20 == 0]
    once = [(i, v) for i, v in rows if i % 20 == 0 and ids.count(i) == 1]
    want = exact(rows, once)
    mine = got[got["query_id"].isin([i for i, _ in once])]
    assert sorted(mine[["query_id", "rank", "vec_id"]].itertuples(index=False, name=None)) == want
    # Rows with one id are ranked together, and none finds itself.
    for twice in {i for i in ids if ids.count(i) > 1}:
        own = got[got["query_id"] == twice]
        assert own["rank"].tolist() and sorted(own["rank"]) == list(range(1, 21)) and twice not in set(own["vec_id"])


def test_pruning_in_parts_is_the_same(monkeypatch):
    rng = np.random.default_rng(7)
    points = rng.normal(size=(300, 12)).astype(np.float32)
    own = np.arange(0, 300, 3)
    candidates = rng.integers(-1, 300, (len(own), 40)).astype(np.int32)
    whole = vector_graph.robust_prune(points, own, candidates, 9, 1.2)
    monkeypatch.setattr(vector_graph, "CELLS", 40 * 12 * 7)
    assert (vector_graph.robust_prune(points, own, candidates, 9, 1.2) == whole).all()
