import pytest
from pyspark.sql import functions as F

from cmdlog_spark.functions.times import day_of
from cmdlog_spark.operators import noise
from cmdlog_spark.operators.filters import close_in_time, keep, under_directory
from cmdlog_spark.operators.merge import with_derived, write_events

SPECIAL = [
    'echo "quoted"', "echo 'single'", "echo 100%", "echo a_b", "echo back\\slash",
    "echo $HOME", "ls *.txt", "echo hi # note",
]


def commands_of(df):
    return {r.cmd for r in df.collect()}


@pytest.mark.parametrize(
    "query, found",
    [
        ("%", {"echo 100%"}),
        ("_", {"echo a_b"}),
        ("\\", {"echo back\\slash"}),
        ('"', {'echo "quoted"'}),
        ("$home", {"echo $HOME"}),
        ("*.TXT", {"ls *.txt"}),
        ("# n", {"echo hi # note"}),
    ],
)
def test_query_is_literal_and_ignores_ascii_case(make_history, query, found):
    df = make_history(*[{"cmd": c, "epoch": i} for i, c in enumerate(SPECIAL)])
    assert commands_of(keep(df, query=query)) == found


def test_query_does_not_fold_other_letters(make_history):
    df = make_history({"cmd": "Ä", "epoch": 1}, {"cmd": "ä", "epoch": 2})
    assert commands_of(keep(df, query="ä")) == {"ä"}


def test_under_is_a_literal_prefix(make_history):
    dirs = ["/tmp/proj_%", "/tmp/proj_x", "/TMP/PROJ_%/a", "/tmp/projx", "/tmp/proj"]
    df = make_history(*[{"cmd": d, "epoch": 1, "pwd": d} for d in dirs])
    assert commands_of(df.where(under_directory("/tmp/proj_%"))) == {"/tmp/proj_%", "/TMP/PROJ_%/a"}
    assert commands_of(df.where(under_directory("/tmp/proj"))) == set(dirs)


def test_conditions_combine(make_history):
    df = make_history(
        {"cmd": "git a", "epoch": 100},
        {"cmd": "git b", "epoch": 100, "ppid": 11},
        {"cmd": "git c", "epoch": 99},
        {"cmd": "hg git", "epoch": 100},
    )
    got = keep(df, session=(42, 10), query="git", starts=True, since_epoch=100, here="/tmp")
    assert commands_of(got) == {"git a"}


def test_days_include_the_cutoff(make_history):
    now = 10 * 86_400
    df = make_history(
        {"cmd": "in", "epoch": 8 * 86_400}, {"cmd": "out", "epoch": 8 * 86_400 - 1}
    )
    assert commands_of(keep(df, days=2, now=now)) == {"in"}


@pytest.mark.parametrize(
    "clash", [{"here": "/a", "under": "/a"}, {"since_epoch": 1, "days": 1, "now": 2}, {"days": 1}]
)
def test_clashing_conditions_are_refused(make_history, clash):
    with pytest.raises(ValueError):
        keep(make_history({"cmd": "a", "epoch": 1}), **clash)


def test_since_prunes_partitions_and_keeps_far_epochs(spark, make_history, tmp_path):
    path = str(tmp_path / "t")
    epochs = [0, 86_400, 2 * 86_400, 253_402_300_900, -(10**15)]
    df = make_history(*[{"cmd": str(e), "epoch": e} for e in epochs])
    write_events(with_derived(df), path)
    found = keep(spark.read.parquet(path), since_epoch=86_400)
    assert commands_of(found) == {"86400", "172800", "253402300900"}
    plan = found._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    far = keep(spark.read.parquet(path), since_epoch=253_402_300_850)
    assert commands_of(far) == {"253402300900"}


def test_close_in_time_is_strict(spark):
    df = spark.createDataFrame([(0, 3599), (0, 3600), (-1, 3598), (-1, 3599)], "a long, b long")
    assert [r[0] for r in df.select(close_in_time(F.col("a"), F.col("b"))).collect()] == [
        True, False, True, False,
    ]


def kept(make_history, rules, *cmds):
    df = make_history(*[{"cmd": c, "epoch": i} for i, c in enumerate(cmds)])
    return [r.cmd for r in noise.drop_noise(df, rules).orderBy("id").collect()]


def test_builtin_noise(make_history):
    cmds = [
        "ls", " ls ", "ls -la", "ls\t-la", "lsof", "cd", "cd /x", "cdx", "pwd", "pwd -P",
        "history", "clear", "exit", "exit 1", "", " \t\n", "logger log x", "cd\nls", "　",
    ]
    assert kept(make_history, noise.NoiseRules(self_names=["logger"]), *cmds) == [
        "lsof", "cdx", "pwd -P", "exit 1", "cd\nls",
    ]


def test_switching_the_builtin_rules_off_still_drops_blank(make_history):
    rules = noise.NoiseRules(use_builtin=False)
    assert kept(make_history, rules, "ls", " ", "cd /x") == ["ls", "cd /x"]


def test_own_rules(make_history):
    rules = noise.NoiseRules(
        ignore_exact=[" echo hello ", "a.c"], ignore_prefix=["git s", " x", "e "], use_builtin=False
    )
    cmds = ["echo hello", "  echo hello", "echo hello 2", "git status", "git log", " xy", "abc",
            "a.c", "e ", "e f"]
    assert kept(make_history, rules, *cmds) == ["echo hello 2", "git log", " xy", "abc", "e "]
    assert kept(make_history, noise.NoiseRules(ignore_prefix=[""]), "a", "b") == []


def test_day_column_matches_epoch(make_history):
    df = make_history({"cmd": "a", "epoch": -1})
    assert str(df.select(day_of(F.col("epoch"))).first()[0]) == "1969-12-31"
