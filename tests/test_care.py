import pytest
from pyspark.sql import functions as F

from cmdlog_spark.functions import staging
from cmdlog_spark.functions.cells import row_hash
from cmdlog_spark.operators import care
from cmdlog_spark.operators.merge import with_derived, write_events
from cmdlog_spark.sources.tables import scan_history


@pytest.fixture
def table(spark, make_history, tmp_path):
    path = str(tmp_path / "table")
    df = make_history(*[{"cmd": f"c{i % 5}", "epoch": i * 20_000} for i in range(40)])
    for part in range(4):
        write_events(with_derived(df.where(F.col("id") % 4 == part)), path)
    return path


def test_profile_and_health(spark, table):
    profile = care.table_profile(spark.read.parquet(table)).first()
    assert profile.rows == 40 and profile.files >= 10 and profile.fragmentation == 1.0
    assert profile.size_mb == profile.small_mb > 0
    checks = {r.check: r.status for r in care.table_health(spark.read.parquet(table)).collect()}
    assert checks == {"table.rows": "ok", "table.files": "warn"}
    assert care.table_profile(spark.read.parquet(table), small_bytes=1).first().fragmentation == 0


def test_optimise_keeps_rows_in_fewer_sorted_files(spark, table, tmp_path):
    target = str(tmp_path / "new")
    before = care.table_profile(spark.read.parquet(table)).first()
    rewritten = care.optimise(spark, table, target)
    after = care.table_profile(spark.read.parquet(target)).first()
    assert after.rows == before.rows and after.files < before.files
    names = ["id", "hist_id", "cmd", "epoch", "ppid", "pwd", "salt", "row_hash", "day"]
    assert sorted(rewritten.select(names).collect()) == sorted(
        scan_history(spark, table).select(names).collect()
    )


def test_optimise_carries_stored_columns(spark, table, tmp_path):
    """Wrong hashes stay for the audit to find, and columns of other writers survive."""
    odd = spark.read.parquet(table).withColumns(
        {"row_hash": F.when(F.col("id") <= 5, "0").otherwise(F.col("row_hash")), "batch": F.concat(F.lit("b"), "id")}
    )
    odd.write.partitionBy("day").parquet(str(tmp_path / "odd"))
    rewritten = care.optimise(spark, str(tmp_path / "odd"), str(tmp_path / "new"), files=3)
    found = {r.check: r.rows for r in care.audit(rewritten).collect()}
    assert found["hash.stored"] == 5
    assert rewritten.where(F.col("batch") == F.concat(F.lit("b"), "id")).count() == 40


def test_files_are_planned_by_bytes(spark, table):
    days = {str(r.day): (r.first, r.bins) for r in care.plan_files(spark.read.parquet(table), 1 << 40).collect()}
    assert set(days.values()) == {(0, 1)}
    small = care.plan_files(spark.read.parquet(table), 500).orderBy("day").collect()
    assert all(r.bins > 1 for r in small) and [r.first for r in small] == sorted({r.first for r in small})


def test_a_rewrite_that_lost_rows_is_refused(spark, table, tmp_path, monkeypatch):
    marks = iter([(1, 2), (1, 3)])
    monkeypatch.setattr(care, "_fingerprint", lambda df: next(marks))
    with pytest.raises(RuntimeError):
        care.optimise(spark, table, str(tmp_path / "new"))


def test_describe(spark, table):
    rows = care.describe_table(scan_history(spark, table), "history", ("day",)).collect()
    assert [(r.column, r.type) for r in rows][:3] == [("id", "bigint"), ("hist_id", "bigint"), ("cmd", "string")]
    assert {r.column: r.nulls for r in rows}["hist_id"] == 40
    assert [r.column for r in rows if r.partition] == ["day"]
    assert [(r.column, r.key) for r in rows if r.key] == [("id", 1)]


def test_audit_finds_each_kind_of_damage(make_history):
    sound = make_history(*[{"cmd": str(i), "epoch": i} for i in range(5)])
    assert {r.status for r in care.audit(sound).collect()} == {"ok"}
    damaged = make_history(
        {"cmd": "a", "epoch": 1, "id": 1},
        {"cmd": "b", "epoch": 1, "id": 1},
        {"cmd": None, "epoch": 1},
        {"cmd": "c", "epoch": 10**12},
        {"cmd": "d", "epoch": 4},
        {"cmd": "d", "epoch": 4},
    ).withColumn("row_hash", F.when(F.col("cmd") == "b", "0").otherwise(row_hash()))
    found = {r.check: (r.status, r.rows) for r in care.audit(damaged).collect() if r.rows}
    assert found == {
        "id.repeated": ("fail", 1),
        "null.cmd": ("fail", 1),
        "time.range": ("info", 1),
        "hash.stored": ("fail", 1),
        "hash.repeated": ("info", 1),
    }


def test_staging_uses_the_folder_of_the_session(spark):
    root = spark.sparkContext.getConf().get(staging.CHECKPOINT_DIR)
    assert staging.staging_path(spark, "x").startswith(f"{root}/cmdlog/x-")


def test_staged_tables_go_with_their_owner(spark):
    with staging.owned() as made:
        one = staging.stage(spark.range(3), "one")
        with staging.owned() as inner:
            two = staging.stage(spark.range(4), "two")
        three = staging.stage(spark.range(5), "three")
    outside = staging.stage(spark.range(6), "outside")
    assert [p for _, p in made] == [one.staged_path, three.staged_path]
    assert [p for _, p in inner] == [two.staged_path]
    staging.discard(three)
    staging.delete(made)
    assert made == [] and two.count() == 4 and outside.count() == 6
    for table in (one, three):
        with pytest.raises(Exception, match="PATH_NOT_FOUND|FILE_NOT_EXIST"):
            spark.read.parquet(table.staged_path).count()
