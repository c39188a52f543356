import random
import re

import pytest
from pyspark.sql import functions as F

from cmdlog_spark.demo import raw
from cmdlog_spark.functions.cells import row_hash
from cmdlog_spark.operators import merge, numbering
from cmdlog_spark.operators.noise import NoiseRules
from cmdlog_spark.schema import STORED
from cmdlog_spark.sources import tables

EVENTS = [
    {"cmd": "a", "epoch": 1},
    {"cmd": "a", "epoch": 1},
    {"cmd": "b", "epoch": 2, "hist_id": 5},
]


def counters(stats):
    return {r.src: (r.considered, r.inserted, r.skipped_bad) for r in stats.collect()}


def test_import_drops_copies_and_appending_keeps_them(spark, make_history, tmp_path):
    path, df = str(tmp_path / "t"), make_history(*EVENTS)
    merge.append_events(df, path)
    assert spark.read.parquet(path).count() == 3
    new_rows, stats = merge.merge_import(df.limit(0), raw(df, "s", 0))
    assert sorted(r.id for r in new_rows.collect()) == [1, 3]
    assert counters(stats) == {"s": (3, 2, 0), "total": (3, 2, 0)}


def test_importing_twice_inserts_once(spark, make_history, tmp_path):
    path = str(tmp_path / "t")
    merge.append_events(make_history({"cmd": "old", "epoch": 10**6}), path)
    for inserted in (2, 0):
        stats = merge.import_tables(spark, path, raw(make_history(*EVENTS), "s", 0))
        assert counters(stats)["total"] == (3, inserted, 0)
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [(r.id, r.cmd, r.hist_id) for r in rows] == [(1, "old", None), (2, "a", None), (3, "b", 5)]


def test_a_target_without_hashes_is_compared(make_history):
    df = make_history(*EVENTS)
    new_rows, _ = merge.merge_import(df.where("cmd = 'a'"), raw(df, "s", 0))
    assert [r.cmd for r in new_rows.collect()] == ["b"]


def test_first_source_wins_and_bad_rows_are_counted(make_history):
    df = make_history(*EVENTS)
    later = raw(df, "later", 1)
    first = raw(df.where("id > 1"), "first", 0)
    bad = raw(df, "bad", 2).withColumns({"salt_txt": F.lit(None).cast("string"), "salt_type": F.lit("null")})
    null_cmd = raw(df, "null", 3).withColumn("cmd", F.lit(None).cast("string"))
    loose_id = raw(df.where("id = 3"), "loose", 4).withColumns(
        {"hist_id_txt": F.lit("x y"), "hist_id_type": F.lit("text")}
    )
    every = later.unionByName(first).unionByName(bad).unionByName(null_cmd).unionByName(loose_id)
    new_rows, stats = merge.merge_import(df.limit(0), every)
    assert {(r.src, r.id, r.hist_id) for r in new_rows.collect()} == {
        ("first", 2, None), ("first", 3, 5), ("loose", 3, None),
    }
    assert counters(stats) == {
        "first": (2, 2, 0), "later": (3, 0, 0), "bad": (3, 0, 3), "null": (3, 0, 3),
        "loose": (1, 1, 0), "total": (12, 3, 6),
    }


def test_equal_hashes_of_different_rows(make_history):
    """A line break can move between directory and command: one row stays whole."""
    df = make_history({"cmd": "b\nc", "epoch": 1, "pwd": "a"}, {"cmd": "c", "epoch": 1, "pwd": "a\nb"})
    new_rows, _ = merge.merge_import(df.limit(0), raw(df, "s", 0))
    assert [(r.id, r.pwd, r.cmd) for r in new_rows.collect()] == [(1, "a", "b\nc")]


def test_only_touched_days_of_the_target_are_read(spark, make_history, tmp_path):
    path = str(tmp_path / "t")
    merge.append_events(make_history(*[{"cmd": "x", "epoch": d * 86_400} for d in range(5)]), path)
    df = make_history({"cmd": "x", "epoch": 86_400}, {"cmd": "y", "epoch": 3 * 86_400})
    new_rows, _ = merge.merge_import(spark.read.parquet(path), raw(df, "s", 0))
    plan = new_rows._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.splitlines() if "FileScan" in x and "PartitionFilters: []" not in x]
    assert len(scans) == 1 and re.search(r"PartitionFilters: \[.*dynamicpruning", scans[0])
    assert [r.cmd for r in new_rows.collect()] == ["y"]
    # Files of other days may be gone: nothing reads them.
    for day in ("1970-01-01", "1970-01-03", "1970-01-05"):
        for file in (tmp_path / "t" / f"day={day}").glob("*.parquet"):
            file.write_bytes(b"no parquet")
    table = spark.read.schema(STORED).parquet(path)
    again, _ = merge.merge_import(table, raw(df, "s", 0))
    assert [r.cmd for r in again.collect()] == ["y"]


def test_copies_collapse_in_hash_tables(spark, make_history, tmp_path):
    """One scan of each side, no sort for the first of each hash, and texts of any shape."""
    path = str(tmp_path / "t")
    rows = [{"cmd": c, "epoch": e, "pwd": p} for c in ("", "x", "\n", "é\nx") for p in ("", "/", "\n/") for e in (1, 2)]
    df = make_history(*rows, *rows)
    merge.append_events(df.where("id > 40"), path, no_filter=True)
    new_rows, _ = merge.merge_import(tables.scan_history(spark, path), raw(df, "s", 0))
    plan = new_rows._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
    first, held = {}, {r.row_hash for r in tables.scan_history(spark, path).collect()}
    for r in df.withColumn("row_hash", row_hash()).orderBy("id").collect():
        first.setdefault(r.row_hash, (r.id, r.pwd, r.cmd, r.epoch))
    want = sorted(v for k, v in first.items() if k not in held)
    assert sorted((r.id, r.pwd, r.cmd, r.epoch) for r in new_rows.collect()) == want


def test_present_and_unseen_split_the_rows(make_history):
    rows = make_history(*[{"cmd": str(i), "epoch": i} for i in range(6)]).withColumn(
        "row_hash", row_hash()
    )
    target = rows.where("id <= 4").unionByName(rows.where("id <= 2"))
    assert {r.id for r in merge.already_present(rows, target).collect()} == {1, 2, 3, 4}
    assert {r.id for r in merge.unseen(rows, target).collect()} == {5, 6}


def test_append_drops_noise_unless_told_not_to(spark, make_history, tmp_path):
    df = make_history({"cmd": "ls", "epoch": 1}, {"cmd": "make", "epoch": 2}, {"cmd": " ", "epoch": 3})
    merge.append_events(df, str(tmp_path / "a"), NoiseRules(ignore_prefix=["x"]))
    assert [r.cmd for r in spark.read.parquet(str(tmp_path / "a")).collect()] == ["make"]
    merge.append_events(df, str(tmp_path / "b"), no_filter=True)
    assert spark.read.parquet(str(tmp_path / "b")).count() == 3


def test_merge_of_shell_files(spark, make_history):
    entries = spark.createDataFrame(
        [("f", 0, 0, None, "a"), ("f", 0, 1, 77, "b"), ("f", 1, 2, None, "a"), ("g", 0, 0, None, "a")],
        "file string, part long, pos long, epoch long, cmd string",
    )
    new_rows, stats = merge.merge_history_files(make_history(*EVENTS), entries, "/w", 3, 4)
    got = merge.number_new_rows(new_rows, 100).orderBy("id").collect()
    # The second file's only untimed line gets the second of the first's last.
    assert [(r.id, r.cmd, r.epoch, r.pwd, r.ppid, r.salt, r.hist_id) for r in got] == [
        (101, "a", 999_999_999, "/w", 3, 4, None),
        (102, "b", 77, "/w", 3, 4, None),
        (103, "a", 1_000_000_000, "/w", 3, 4, None),
    ]
    assert counters(stats)["total"] == (4, 3, 0)


def test_ids_follow_source_and_id_over_many_chunks(spark):
    rng = random.Random(3)
    rows = [(src, i) for src in range(3) for i in rng.sample(range(-20, 60), 30)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "src_ord int, id long").withColumn("old", F.col("id"))
    got = numbering.assign_ids(df, 1000).orderBy("id").collect()
    assert [(r.src_ord, r.old) for r in got] == sorted(rows)
    assert [r.id for r in got] == list(range(1001, 1091))


def test_importing_shell_files_twice(spark, make_history, tmp_path):
    path = str(tmp_path / "t")
    merge.append_events(make_history({"cmd": "old", "epoch": 1}), path)
    entries = spark.createDataFrame(
        [("f", 0, i, None if i % 2 else i, f"c{i}") for i in range(6)],
        "file string, part long, pos long, epoch long, cmd string",
    )
    for inserted in (6, 0):
        stats = merge.import_history_files(spark, path, entries, "/w")
        assert counters(stats) == {"f": (6, inserted, 0), "total": (6, inserted, 0)}
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [r.cmd for r in rows] == ["old"] + [f"c{i}" for i in range(6)]
    assert [r.id for r in rows] == list(range(1, 8))


def test_events_without_ids_are_numbered_on(spark, make_history, tmp_path):
    path = str(tmp_path / "t")
    events = make_history(*[{"cmd": f"c{i}", "epoch": i} for i in range(20)]).drop("id")
    merge.append_events(events.coalesce(1), path)
    merge.append_events(events.where("epoch < 3").coalesce(1), path)
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [(r.id, r.epoch) for r in rows] == [
        (i, e) for i, e in enumerate([*range(20), *range(3)], 1)
    ]


def test_import_into_a_new_table(spark, make_history, tmp_path):
    path = str(tmp_path / "new")
    stats = merge.import_tables(spark, path, raw(make_history(*EVENTS), "s", 0))
    assert counters(stats)["total"] == (3, 2, 0)
    assert [r.id for r in spark.read.parquet(path).orderBy("id").collect()] == [1, 2]


def test_a_source_without_rows_is_counted(make_history):
    df = make_history(*EVENTS)
    _, stats = merge.merge_import(df.limit(0), raw(df, "s", 0), sources=["s", "nothing"])
    assert counters(stats) == {"s": (3, 2, 0), "nothing": (0, 0, 0), "total": (3, 2, 0)}
    with pytest.raises(ValueError):
        merge.merge_import(df.limit(0), raw(df, "s", 0), sources=[])


def test_rows_that_miss_different_numbers_differ(make_history):
    rows = make_history(
        {"cmd": "a", "epoch": 1, "salt": 7, "ppid": None}, {"cmd": "a", "epoch": 1, "salt": None, "ppid": 7},
        {"cmd": None, "epoch": 1}, {"cmd": "", "epoch": 1},
    )
    assert rows.select(row_hash().alias("h")).distinct().count() == 4


def test_one_repeated_id_is_spread(spark, make_history):
    """Equal old ids are no task of their own, and all ids are given once."""
    df = spark.range(0, 40_000, 1, 8).select(
        F.lit(0).alias("src_ord"), F.when(F.col("id") % 4 == 0, F.col("id")).otherwise(5).alias("id"), F.col("id").alias("was")
    )
    got = numbering.assign_ids(df, 100).persist()
    assert sorted(r.id for r in got.select("id").collect()) == list(range(101, 40_101))
    ordered = [r.old for r in got.join(df.select("was", F.col("id").alias("old")), "was").orderBy("id").collect()]
    assert ordered == sorted(ordered)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        written = numbering.ordered_parts(df, ["src_ord", "id"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = written.groupBy(F.shiftright("id", numbering.PLACE_BITS)).count().collect()
    assert max(r["count"] for r in parts) < 15_000
