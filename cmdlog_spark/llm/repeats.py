"""Parts of texts whose key stands in several documents; most never repeat and are dropped unwritten.

Parts travel in pages of one range of keys, as arrays of the narrowest numbers that hold
them: a row of its own for each part would take about twice the shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cmdlog_spark.llm.common import small_batches, stage

# Parts that a task gathers before it cuts them into pages.
GATHERED = 1 << 20
COLUMNS = ("key", "code", "doc_id", "start", "length")
PAGES = "range int, late boolean, n int, " + ", ".join(f"{c} binary" for c in COLUMNS)

Parts = tuple[np.ndarray, ...]


def repeated_parts(rows: DataFrame, find: Callable, several_codes: bool, name: str) -> DataFrame:
    """Staged rows doc_id, code, start, end, key: parts with keys of several documents.

    ``find`` turns batches of ``rows`` into parts: arrays key and code (unsigned), doc_id,
    start and length. With ``several_codes`` a key must have different codes too. The
    documents that decide a key go ahead, a few for each key and gathering of a task; all
    other parts are judged as they come by, so a key may have any number of them.
    """
    ranges = max(64, 4 * rows.rdd.getNumPartitions())

    def send(batches):
        held, size = [], 0
        for parts in find(batches):
            held.append(parts)
            size += len(parts[0])
            if size >= GATHERED:
                yield from _pages(held, ranges)
                held, size = [], 0
        if size:
            yield from _pages(held, ranges)

    def judge(batches):
        now, ahead, open_ = None, [], None
        for batch in batches:
            for page in batch.itertuples(index=False):
                if page.range != now:
                    if open_ is None:
                        yield from _open(ahead, several_codes)[1]
                    now, ahead, open_ = page.range, [], None
                parts = _unpack(page)
                if not page.late:
                    ahead.append(parts)
                    continue
                if open_ is None:
                    open_, found = _open(ahead, several_codes)
                    ahead = []
                    yield from found
                yield _frame(parts, _within(parts[0], open_))
        if open_ is None:
            yield from _open(ahead, several_codes)[1]

    with small_batches(rows.sparkSession):
        pages = rows.mapInPandas(send, PAGES).repartition("range").sortWithinPartitions("range", "late")
        return stage(pages.mapInPandas(judge, "doc_id long, code long, start long, end long, key long"), name)


def _groups(parts: Parts) -> tuple[Parts, np.ndarray]:
    """The parts in order of key and doc_id, and where each key begins."""
    order = np.lexsort((parts[2], parts[0]))
    parts = tuple(x[order] for x in parts)
    key = parts[0]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    return parts, np.flatnonzero(new)


def _pages(held: list[Parts], ranges: int) -> Iterator[pd.DataFrame]:
    parts, begin = _groups(tuple(np.concatenate(x) for x in zip(*held, strict=True)))
    key, code = parts[:2]
    group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(key))))
    ahead = np.zeros(len(key), bool)
    ahead[begin] = True
    ahead[np.append(begin[1:], len(key)) - 1] = True  # least and largest doc_id of each key
    for least in (np.minimum, np.maximum):
        at = np.flatnonzero(code == least.reduceat(code, begin)[group])
        ahead[at[np.unique(group[at], return_index=True)[1]]] = True
    place = (key % np.uint64(ranges)).astype(np.int64) * 2 + ~ahead
    order = np.argsort(place, kind="stable")
    place, parts = place[order], tuple(x[order] for x in parts)
    cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    ends = np.append(cuts[1:], len(place))
    for some in np.array_split(np.arange(len(cuts)), -(-len(cuts) // 64)):
        slices_ = [slice(a, b) for a, b in zip(cuts[some].tolist(), ends[some].tolist(), strict=True)]
        page = {"range": (place[cuts[some]] // 2).astype(np.int32), "late": place[cuts[some]] % 2 == 1}
        page["n"] = (ends - cuts)[some].astype(np.int32)
        packed = {c: [_pack(x[s]) for s in slices_] for c, x in zip(COLUMNS, parts, strict=True)}
        if (parts[0] == parts[1]).all():  # codes that are the keys are sent once
            packed["code"] = [b""] * len(some)
        yield pd.DataFrame(page | packed)


def _pack(values: np.ndarray) -> bytes:
    if values.min() < 0:
        return values.astype("<i8").tobytes()
    return values.astype(np.min_scalar_type(values.max())).tobytes()


def _unpack(page) -> Parts:
    out = []
    for name in COLUMNS:
        raw = getattr(page, name)
        kind = np.uint64 if name in ("key", "code") else np.int64
        width = len(raw) // page.n
        out.append(np.frombuffer(raw, kind if width == 8 else f"<u{width}").astype(kind) if width else out[0])
    return tuple(out)


def _open(ahead: list[Parts], several_codes: bool) -> tuple[np.ndarray, list[pd.DataFrame]]:
    """The keys of several documents, ascending, and the parts sent ahead that have them."""
    if not ahead:
        return np.zeros(0, np.uint64), []
    parts, begin = _groups(tuple(np.concatenate(x) for x in zip(*ahead, strict=True)))
    key, code, doc_id = parts[:3]
    last = np.append(begin[1:], len(key)) - 1
    chosen = doc_id[begin] < doc_id[last]
    if several_codes:
        chosen &= np.minimum.reduceat(code, begin) < np.maximum.reduceat(code, begin)
    found = _frame(parts, np.repeat(chosen, last - begin + 1))
    return key[begin[chosen]], [found] if len(found) else []


def _within(values: np.ndarray, ascending: np.ndarray) -> np.ndarray:
    if not len(ascending):
        return np.zeros(len(values), bool)
    return ascending[np.minimum(np.searchsorted(ascending, values), len(ascending) - 1)] == values


def _frame(parts: Parts, chosen: np.ndarray) -> pd.DataFrame:
    key, code, doc_id, start, length = (x[chosen] for x in parts)
    signed = {"doc_id": doc_id, "code": code.view(np.int64), "start": start, "end": start + length}
    return pd.DataFrame(signed | {"key": key.view(np.int64)})
