import json
import shutil

import pytest
from pyspark.sql import functions as F

from cmdlog_spark.functions.cells import row_hash
from cmdlog_spark.operators import care, merge
from cmdlog_spark.operators.noise import NoiseRules
from cmdlog_spark.schema import EVENT, STORED
from cmdlog_spark.sinks import quarantine
from cmdlog_spark.sources.tables import scan_history
from cmdlog_spark.streaming import intake


def drop(folder, name, *events):
    folder.mkdir(exist_ok=True)
    filled = [{"hist_id": None, "ppid": 1, "pwd": "/", "salt": 2, **e} for e in events]
    (folder / name).write_text("\n".join(map(json.dumps, filled)))


def run(spark, tmp_path, start, **options):
    events = intake.read_event_stream(spark, str(tmp_path / "in"))
    query = start(events, str(tmp_path / "out"), str(tmp_path / "state"), **options)
    assert query.awaitTermination(120)
    return sorted((r.epoch, r.cmd) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_intake_keeps_copies_and_drops_noise(spark, tmp_path):
    drop(tmp_path / "in", "1", {"cmd": "make", "epoch": 5}, {"cmd": "make", "epoch": 5}, {"cmd": "ls", "epoch": 6})
    assert run(spark, tmp_path, intake.start_intake) == [(5, "make"), (5, "make")]
    drop(tmp_path / "in", "2", {"cmd": "late", "epoch": -5}, {"cmd": "skip me", "epoch": 9})
    rules = NoiseRules(ignore_prefix=["skip"])
    assert run(spark, tmp_path, intake.start_intake, rules=rules) == [
        (-5, "late"), (5, "make"), (5, "make"),
    ]
    table = spark.read.parquet(str(tmp_path / "out"))
    assert table.where(table.row_hash != row_hash()).count() == 0


def test_stream_and_batches_share_a_table(spark, tmp_path, make_history):
    path = str(tmp_path / "out")
    merge.append_events(make_history(*[{"cmd": f"b{i}", "epoch": i} for i in range(4)]).drop("id"), path)
    drop(tmp_path / "in", "1", {"cmd": "s1", "epoch": 5}, {"cmd": "s2", "epoch": 5})
    assert len(run(spark, tmp_path, intake.start_intake)) == 6
    merge.append_events(make_history({"cmd": "after", "epoch": 9}).drop("id"), path)
    assert sorted(r.id for r in scan_history(spark, path).collect()) == list(range(1, 8))


def test_replayed_batch_is_skipped(spark, tmp_path):
    drop(tmp_path / "in", "1", {"cmd": "a", "epoch": 5}, {"cmd": "b", "epoch": 5})
    run(spark, tmp_path, intake.start_intake)
    # As after a failure between the write and its commit.
    for file in (tmp_path / "state" / "commits").glob("*0*"):
        file.rename(tmp_path / f"lost{file.name}")
    drop(tmp_path / "in", "2", {"cmd": "c", "epoch": 6})
    assert run(spark, tmp_path, intake.start_intake) == [(5, "a"), (5, "b"), (6, "c")]


@pytest.mark.parametrize("window", [None, "1 hour"])
def test_merge_drops_copies_within_and_across_batches(spark, tmp_path, window):
    drop(tmp_path / "in", "1", {"cmd": "a", "epoch": 10**9}, {"cmd": "a", "epoch": 10**9}, {"cmd": "ls", "epoch": 6})
    assert run(spark, tmp_path, intake.start_merge, window=window) == [(10**9, "a")]
    # Far older than what came before, and still merged.
    drop(tmp_path / "in", "2", {"cmd": "a", "epoch": 10**9}, {"cmd": "old", "epoch": 3})
    assert run(spark, tmp_path, intake.start_merge, window=window) == [(3, "old"), (10**9, "a")]


def test_merge_without_state_still_meets_the_table(spark, tmp_path):
    drop(tmp_path / "in", "1", {"cmd": "a", "epoch": 7})
    run(spark, tmp_path, intake.start_merge)
    drop(tmp_path / "in", "2", {"cmd": "a", "epoch": 7}, {"cmd": "b", "epoch": 7})
    (tmp_path / "state").rename(tmp_path / "lost-state")
    assert run(spark, tmp_path, intake.start_merge) == [(7, "a"), (7, "b")]


def test_bad_events_are_put_aside_once(spark, tmp_path):
    drop(tmp_path / "in", "1", {"cmd": "a", "epoch": 5}, {"cmd": None, "epoch": 5}, {"cmd": "b"}, {"cmd": "c", "epoch": "x"})
    (tmp_path / "in" / "2").write_text('{"cmd": "cut\n')
    assert run(spark, tmp_path, intake.start_intake) == [(5, "a")]
    want = {"no cmd": 1, "no epoch": 1, "malformed": 2}
    path = str(tmp_path / "out")
    assert {r.reason: r.rows for r in quarantine.quarantine_counts(spark, path).collect()} == want
    lost_commits(tmp_path)
    assert run(spark, tmp_path, intake.start_intake) == [(5, "a")]
    assert {r.reason: r.rows for r in quarantine.quarantine_counts(spark, path).collect()} == want
    assert {r.cmd for r in quarantine.read_quarantine(spark, path).where("reason = 'no epoch'").collect()} == {"b"}


def lost_commits(tmp_path):
    """As after a failure between a write and its commit."""
    for file in (tmp_path / "state" / "commits").glob("*0*"):
        file.rename(tmp_path / f"lost{file.name}")


@pytest.mark.parametrize("start", [intake.start_intake, intake.start_merge])
def test_batch_that_failed_half_way_is_completed(spark, tmp_path, start):
    drop(tmp_path / "in", "1", *[{"cmd": f"c{i}", "epoch": i * 86_400} for i in range(6)])
    run(spark, tmp_path, start)
    path = tmp_path / "out"
    before = sorted((r.id, r.cmd) for r in scan_history(spark, str(path)).collect())
    # The claim stands, some files are there, the rest and the mark are not.
    [done] = (tmp_path / "out-ledger").glob("done-*")
    entry = json.loads(done.read_text())
    scan_history(spark, str(path)).write.parquet(str(tmp_path / "copy"))
    kept = spark.read.parquet(str(tmp_path / "copy")).withColumn("id", F.col("id") - entry["first"])
    kept.write.parquet(entry["kept"])
    for crc in (tmp_path / "out-ledger").glob(".done-*"):
        crc.unlink()
    done.unlink()
    for day in ("1970-01-02", "1970-01-05"):
        shutil.rmtree(path / f"day={day}")
    lost_commits(tmp_path)
    run(spark, tmp_path, start)
    assert sorted((r.id, r.cmd) for r in scan_history(spark, str(path)).collect()) == before


def test_two_writers_share_no_id(spark, tmp_path):
    streams = []
    for name in ("one", "two"):
        drop(tmp_path / name, "1", *[{"cmd": f"{name}{i}", "epoch": i} for i in range(30)])
        drop(tmp_path / name, "2", *[{"cmd": f"{name}{i}", "epoch": i} for i in range(30, 50)])
        events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / name))
        streams.append(intake.start_intake(events, str(tmp_path / "out"), str(tmp_path / f"state-{name}")))
    assert all(s.awaitTermination(120) for s in streams)
    rows = scan_history(spark, str(tmp_path / "out")).collect()
    assert sorted(r.id for r in rows) == list(range(1, 101))


def test_batch_does_not_read_the_table(spark, tmp_path):
    drop(tmp_path / "in", "1", {"cmd": "a", "epoch": 5})
    run(spark, tmp_path, intake.start_intake)
    for file in (tmp_path / "out" / "day=1970-01-01").glob("*.parquet"):
        file.write_bytes(b"no parquet")
    drop(tmp_path / "in", "2", {"cmd": "b", "epoch": 90_000}, {"cmd": "c", "epoch": 90_000})
    events = intake.read_event_stream(spark, str(tmp_path / "in"))
    for start, state in ((intake.start_intake, "state"), (intake.start_merge, "other")):
        if state == "other":
            # A merge reads the days that it touches, and no other.
            drop(tmp_path / "in2", "1", {"cmd": "b", "epoch": 90_000}, {"cmd": "d", "epoch": 90_000})
            events = intake.read_event_stream(spark, str(tmp_path / "in2"))
        assert start(events, str(tmp_path / "out"), str(tmp_path / state)).awaitTermination(120)
    got = spark.read.schema(STORED).parquet(str(tmp_path / "out")).where("day = '1970-01-02'")
    assert sorted((r.id, r.cmd) for r in got.collect()) == [(2, "b"), (3, "c"), (4, "d")]


def test_replay_after_a_rewrite_writes_nothing(spark, tmp_path):
    drop(tmp_path / "in", "1", {"cmd": "a", "epoch": 5}, {"cmd": "b", "epoch": 5})
    run(spark, tmp_path, intake.start_intake)
    care.optimise(spark, str(tmp_path / "out"), str(tmp_path / "new"))
    lost_commits(tmp_path)
    events = intake.read_event_stream(spark, str(tmp_path / "in"))
    query = intake.start_intake(events, str(tmp_path / "new"), str(tmp_path / "state"))
    assert query.awaitTermination(120)
    assert scan_history(spark, str(tmp_path / "new")).count() == 2


def test_ids_given_elsewhere_are_not_given_again(spark, tmp_path, make_history):
    path = str(tmp_path / "out")
    merge.append_events(make_history({"cmd": "a", "epoch": 1}).drop("id"), path)
    merge.append_events(make_history({"cmd": "b", "epoch": 1, "id": 70}), path)
    merge.append_events(make_history({"cmd": "c", "epoch": 1}).drop("id"), path)
    assert sorted((r.id, r.cmd) for r in scan_history(spark, path).collect()) == [(1, "a"), (70, "b"), (71, "c")]
