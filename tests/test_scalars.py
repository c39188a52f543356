import hashlib

import pytest
from pyspark.sql import functions as F

from cmdlog_spark.functions import commands, text, times
from cmdlog_spark.functions.cells import coerce_int, row_hash


def values(spark, column, *inputs, kind="string"):
    """``column(F.col('x'))`` for each input."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, x {kind}")
    return [r.y for r in df.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_trim_knows_all_white_space(spark):
    got = values(spark, text.trim_ws, "\t a b \n", "　x ", "   ", "y")
    assert got == ["a b", "x", "", "y"]


def test_ascii_lower_leaves_other_letters(spark):
    assert values(spark, text.ascii_lower, "ÄB", "Git") == ["Äb", "git"]


def test_first_word(spark):
    assert values(spark, text.first_word, "  git  log", "\tls", "", "one") == ["git", "ls", "", "one"]


@pytest.mark.parametrize(
    "width, expected",
    [(10, ["abcdefg...", "äöüäöüä...", "short"]), (3, ["..."] * 3), (2, ["..."] * 3)],
)
def test_truncate_counts_characters(spark, width, expected):
    got = values(spark, lambda c: text.truncate(c, width), "abcdefghijkl", "äöüäöüäöüäöü", "short")
    assert got == expected


def test_long_command_is_cut_for_suggestions(spark):
    [got] = values(spark, text.suggestion_text, "echo " * 1000 + "end")
    assert got == ("echo " * 1000)[:57] + "..."


def test_json_text(spark):
    got = values(spark, text.json_text, 'a"b', "a\\b", "a\nb\tc\rd", "\x01", None)
    assert got == ['"a\\"b"', '"a\\\\b"', '"a\\nb\\tc\\rd"', '"\\u0001"', "null"]


def test_escape_like_makes_text_literal(spark):
    pattern = text.escape_like("100%_\\")
    assert pattern == "100\\%\\_\\\\"
    got = values(spark, lambda c: F.like(c, F.lit(pattern)), "100%_\\", "100x_\\")
    assert got == [True, False]


def test_parse_long(spark):
    got = values(spark, text.parse_long, "5", "+5", "-5", "5 ", "5L", "", "9" * 30, "5\n")
    assert got == [5, 5, -5, None, None, None, None, None]


def test_variation_mark(spark):
    got = values(spark, lambda c: text.variation_mark(c, "git"), "git", "git log", "gitk")
    assert got == ["", "→", "≠"]


def test_local_datetime_at_the_edges(spark):
    epochs = [0, 1, 2147483647, 4000000000, -1, 253402300799, 253402300800, 2**63 - 1, -(2**63)]
    got = values(spark, times.local_datetime, *epochs, kind="bigint")
    assert got == [
        "1970-01-01 00:00:00",
        "1970-01-01 00:00:01",
        "2038-01-19 03:14:07",
        "2096-10-02 07:06:40",
        "1969-12-31 23:59:59",
        "9999-12-31 23:59:59",
        None,
        None,
        None,
    ]


def test_local_time_follows_daylight_saving(spark):
    winter, summer = 1_704_067_200, 1_719_792_000
    got = values(
        spark, lambda c: times.local_datetime(c, "Europe/Berlin"), winter, summer, kind="bigint"
    )
    assert got == ["2024-01-01 01:00:00", "2024-07-01 02:00:00"]
    got = values(
        spark, lambda c: times.local_date(c, "America/New_York"), winter, summer, kind="bigint"
    )
    assert got == ["2023-12-31", "2024-06-30"]


def test_relative_time(spark):
    now = 1_700_000_000
    ages = [-1, 0, 59, 60, 3_599, 3_600, 86_399, 86_400, 604_799, 604_800]
    got = values(
        spark, lambda c: times.relative_time(c, now), *[now - a for a in ages], kind="bigint"
    )
    assert got == [
        "in the future", "0s ago", "59s ago", "1m ago", "59m ago", "1h ago", "23h ago",
        "1d ago", "6d ago", "2023-11-07",
    ]
    got = values(spark, lambda c: times.relative_time(c, now), -(2**63), 2**63 - 1, kind="bigint")
    assert got == [str(-(2**63)), "in the future"]


def test_floor_div(spark):
    inputs = [-(2**63), -3_601, -3_600, -1, 0, 3_599, 3_600, 2**63 - 1]
    got = values(spark, lambda c: times.floor_div(c, 3_600), *inputs, kind="bigint")
    assert got == [i // 3_600 for i in inputs]


def test_day_never_decreases(spark):
    epochs = [-(2**63), -62_167_219_201, -1, 0, 86_399, 86_400, 253_402_300_800, 2**63 - 1]
    got = values(spark, lambda c: times.day_of(c).cast("string"), *epochs, kind="bigint")
    assert got == [
        "0000-01-01", "0000-01-01", "1969-12-31", "1970-01-01", "1970-01-01", "1970-01-02",
        "9999-12-31", "9999-12-31",
    ]


def test_coerce_int_by_storage_class(spark):
    cells = [
        (None, "null", None),
        ("7", "integer", 7),
        ("-7", "integer", -7),
        ("3.0", "real", 3),
        ("1.5", "real", None),
        ("inf", "real", None),
        ("nan", "real", None),
        ("1e+300", "real", 2**63 - 1),
        (None, "blob", None),
        ("  970* 1571608128 ssh", "text", 970),
        ("", "text", None),
        ("abc 42", "text", 42),
        ("x y 7", "text", None),
        (" 12 ", "text", 12),
        ("12**", "text", 12),
        ("*", "text", None),
        ("1.0", "text", None),
        ("+5", "text", 5),
        ("9" * 25 + " 8", "text", 8),
        (" 5* 6", "text", 5),
    ]
    df = spark.createDataFrame(
        [(i, *c) for i, c in enumerate(cells)], "i int, txt string, kind string, want bigint"
    )
    got = df.select("i", "want", coerce_int(F.col("txt"), F.col("kind")).alias("got"))
    assert [r.got for r in got.orderBy("i").collect()] == [c[2] for c in cells]


def test_row_hash_keeps_the_line_of_a_missing_hist_id(make_history):
    long = "echo " * 1000 + "end"
    df = make_history(
        {"cmd": "ls", "epoch": 5, "hist_id": 7},
        {"cmd": "ls", "epoch": 5},
        {"cmd": long, "epoch": -1},
    )
    got = [r.h for r in df.select("id", row_hash().alias("h")).orderBy("id").collect()]
    texts = ["5\n10\n42\n7\n/tmp\nls", "5\n10\n42\n\n/tmp\nls", f"-1\n10\n42\n\n/tmp\n{long}"]
    assert got == [hashlib.sha256(t.encode()).hexdigest() for t in texts]


def test_command_type(spark):
    got = values(
        spark, commands.command_type, "GIT log", "kubens x", " pip3 install", "goimports",
        "mv a b", "uname", "", "gitk",
    )
    assert got == [
        "git", "kubectl", "python", "go", "navigation", "system", "generic", "generic",
    ]


def test_context_takes_the_first_rule(spark):
    got = values(
        spark, commands.command_context, "git commit -m status", "docker run ps", "make",
        "npm test", "kubectl get pods", "cargo fmt", "git COMMIT",
    )
    assert got == [
        "Shows working directory status and changes",
        "Creates and starts new container",
        "Builds project targets",
        "Runs test suite",
        None,
        "Rust package management",
        "Git version control operation",
    ]


def test_semantic_suggestions(spark):
    got = values(
        spark, commands.semantic_suggestions, "git fetch", "git commit && git push", "make x",
        "docker ps", "git log", "yarn add",
    )
    assert got == [
        ["git status", "git log --oneline -5", "git merge"],
        ["git status", "git log --oneline", "git push"],
        ["make clean", "make install", "make test"],
        ["docker logs", "docker exec"],
        [],
        [],
    ]
