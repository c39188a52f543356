import json
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from cmdlog_spark.operators.merge import coerce_raw
from cmdlog_spark.sources import legacy, shell_files, tables

BASE = 1_000_000_000


def integer(text):
    digits = text[1:] if text[:1] in "+-" else text
    ok = digits.isascii() and digits.isdigit() and -(2**63) <= int(text) < 2**63
    return int(text) if ok else None


def plain_bash(lines):
    found, pending = [], None
    for line in map(str.rstrip, lines):
        if not line:
            continue
        stamp = integer(line[1:].strip()) if line.startswith("#") else None
        if stamp is not None:
            pending = stamp
        else:
            found.append((pending, line))
            pending = None
    return found


def plain_zsh(lines):
    found = []
    for line in map(str.rstrip, lines):
        if not line:
            continue
        head, semicolon, cmd = line[2:].partition(";")
        epoch = integer(head.split(":")[0]) if line.startswith(": ") and semicolon else None
        found.append((None, line) if epoch is None else (epoch, cmd))
    return found


def with_synthetic(entries):
    missing = sum(e is None for e, _ in entries)
    numbers = iter(range(BASE - missing + 1, BASE + 1))
    return [(next(numbers) if e is None else e, c) for e, c in entries]


LINE = st.one_of(
    st.sampled_from(
        ["", "  ", "#12", "#-3", "# 44 ", "#x", "#", "##5", "ls", "ls  ", "# note", "#99999999999999999999",
         ": 5:0;ls", ": 5;a;b", ": :0;x", ": x:0;y", ":5:0;z", ": 7:0;", ": 7:0", ": 8:1:2;c d"]
    ),
    st.text(alphabet="#: ;15ab\t", max_size=8),
)


def line_frame(spark, files, part_size):
    rows = [
        (f, p // part_size, p, line) for f, ls in files.items() for p, line in enumerate(ls)
    ]
    return spark.createDataFrame(rows, "file string, part long, pos long, line string")


def by_file(entries):
    result = {}
    for r in entries.orderBy("file", "part", "pos").collect():
        result.setdefault(r.file, []).append((r.epoch, r.cmd))
    return result


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(files=st.lists(st.lists(LINE, max_size=14), min_size=1, max_size=3), size=st.integers(1, 4))
def test_parsers_equal_a_plain_loop(spark, files, size):
    files = {f"f{i}": lines for i, lines in enumerate(files)}
    frame = line_frame(spark, files, size)
    for parse, plain in [
        (shell_files.parse_bash_lines, plain_bash),
        (shell_files.parse_zsh_lines, plain_zsh),
    ]:
        want = {f: plain(ls) for f, ls in files.items() if plain(ls)}
        entries = parse(frame)
        assert by_file(entries) == want
        timed = shell_files.assign_synthetic_epoch(entries)
        assert by_file(timed) == {f: with_synthetic(es) for f, es in want.items()}


def test_files_are_split_and_still_read_in_order(spark, tmp_path):
    rng = random.Random(1)
    pool = ["#17", "#18", "make all", "git status", "", "echo ü", "# note", "ls\r"]
    texts = {}
    for name in ("a", "b"):
        lines = [rng.choice(pool) + ("" if i % 3 else " x") for i in range(400)]
        (tmp_path / name).write_text("\n".join(lines), encoding="utf-8", newline="")
        texts[name] = lines
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        entries = shell_files.read_bash_history(spark, str(tmp_path))
        assert entries.select("file", "part").distinct().count() > 8
        got = by_file(entries.withColumn("file", F.element_at(F.split("file", "/"), -1)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {name: plain_bash(lines) for name, lines in texts.items()}


def test_history_with_and_without_stored_columns(spark, make_history, tmp_path):
    path = str(tmp_path / "plain")
    make_history({"cmd": "a", "epoch": 1}).write.parquet(path)
    assert tables.scan_history(spark, path).columns[-1] == "salt"


def test_template_defaults(spark, tmp_path):
    (tmp_path / "t.json").write_text(
        '{"id":"a","name":"A","command":"run {x}","variables":[{"name":"x"}]}\n'
        '{"id":"b","name":"B","command":"b","variables":[{"name":"y","required":false}],'
        '"defaults":{"y":"1"}}\n'
        '{"id":"c","name":"C","command":"c"}\n'
    )
    rows = {r.id: r for r in tables.read_templates(spark, str(tmp_path)).collect()}
    assert rows["a"].variables[0].required is True and rows["a"].defaults == {}
    assert rows["b"].variables[0].required is False and rows["b"].defaults == {"y": "1"}
    assert rows["c"].variables == []


def legacy_dump(path, rows):
    names = ["id", "hist_id", "cmd", "epoch", "ppid", "pwd", "salt"]
    path.write_text("".join(json.dumps(dict(zip(names, row, strict=True))) + "\n" for row in rows))
    return str(path)


def test_legacy_cells_of_every_class(spark, tmp_path):
    one = legacy_dump(
        tmp_path / "one.jsonl",
        [
            (1, 7, "ls", 100, 1, "/a", 9),
            (2, "  970* 1571608128 ssh", "b", 1.5, 1, "/a", 9),
            (3, None, "c", "", 1, "/a", 9),
            (4, None, None, 100, 1, "/a", 9),
            (9, [0], "d", "5 x", 2**60, "/ü", 9),
            (10, 1e300, "e", {"x": 1}, 1, "/a", 9),
            (11, 2.0, "f", 100.0, 1, "/a", 9),
        ],
    )
    two = legacy_dump(tmp_path / "two #1 50%.jsonl", [(1, 1, "z", 1, 1, "/", 1)])
    raw = legacy.read_legacy_history(spark, [one, two])
    got = coerce_raw(raw).orderBy("src_ord", "id").collect()
    assert [(r.src_ord, r.id, r.hist_id, r.epoch, r.ppid, r.bad) for r in got] == [
        (0, 1, 7, 100, 1, False),
        (0, 2, 970, None, 1, True),
        (0, 3, None, None, 1, True),
        (0, 4, None, 100, 1, True),
        (0, 9, None, 5, 2**60, False),
        (0, 10, 2**63 - 1, None, 1, True),
        (0, 11, 2, 100, 1, False),
        (1, 1, 1, 1, 1, False),
    ]
    assert {r.src for r in got} == {one, two}


def test_legacy_dumps_of_folders_are_split(spark, tmp_path):
    rows = [(i, 1, "x", 1, 1, "/", 1) for i in range(200)]
    folders = []
    for name in "abc":
        (tmp_path / name).mkdir()
        legacy_dump(tmp_path / name / "part-0.jsonl", rows)
        folders.append(str(tmp_path / name))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        raw = legacy.read_legacy_history(spark, folders)
        assert raw.rdd.getNumPartitions() > 8
        assert sorted((r.src_ord, r.id) for r in raw.collect()) == [(n, i) for n in range(3) for i in range(200)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_odd_legacy_dumps(spark, tmp_path):
    with pytest.raises(ValueError):
        legacy.read_legacy_history(spark, [])
    empty = legacy_dump(tmp_path / "e.jsonl", [])
    assert legacy.read_legacy_history(spark, [empty]).collect() == []
    (tmp_path / "bad.jsonl").write_text('no json\n{"id": 1}\n')
    got = coerce_raw(legacy.read_legacy_history(spark, [str(tmp_path / "bad.jsonl")])).collect()
    assert sorted((r.id or 0, r.bad) for r in got) == [(0, True), (1, True)]
    with pytest.raises(AnalysisException):
        legacy.read_legacy_history(spark, [str(tmp_path / "nothing")])
