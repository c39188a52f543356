"""Pair counts against plain loops, with thresholds that reach every path."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cmdlog_spark.operators import related
from cmdlog_spark.operators import pairs

TOOLS = ["git a", "git b", "Git c", "git", "make", "make x", "ls", "ls ", " ls", "docker ps"]


def brute(rows, near):
    """(base, cmd) -> (pairs, latest) over all pairs of rows."""
    found = defaultdict(lambda: [0, -(2**62)])
    for a in rows:
        for b in rows:
            if a["cmd"] != b["cmd"] and near(a, b):
                entry = found[a["cmd"], b["cmd"]]
                entry[0] += 1
                entry[1] = max(entry[1], b["epoch"])
    return {k: tuple(v) for k, v in found.items()}


def best(pairs, k=2):
    per_base = defaultdict(list)
    for (base, cmd), (n, latest) in pairs.items():
        per_base[base].append((-n, -latest, cmd))
    return {
        (base, rank): (cmd, -n, -latest)
        for base, found in per_base.items()
        for rank, (n, latest, cmd) in enumerate(sorted(found)[:k], 1)
    }


def in_session(a, b):
    same = a["salt"] == b["salt"] and a["ppid"] == b["ppid"]
    return same and abs(a["epoch"] - b["epoch"]) < 3600


def in_directory(a, b):
    return a["pwd"] == b["pwd"]


def rows_of(seed, count, commands, sessions, span):
    """Random rows of which one session and one directory hold a third."""
    rng = random.Random(seed)
    rows = []
    for _ in range(count):
        hot = rng.random() < 1 / 3
        rows.append(
            {
                "cmd": f"c{int(rng.paretovariate(0.7)) % commands}",
                "epoch": rng.randrange(-span, span),
                "ppid": 0 if hot else rng.randrange(sessions),
                "salt": 0 if hot else rng.randrange(2),
                "pwd": "/hot" if hot else f"/d{rng.randrange(sessions)}",
            }
        )
    return rows


def listed(found):
    return {
        (r.base, r.rank): (r.cmd, int(r.co_occurrences), r.latest) for r in found.collect()
    }


CASES = [(2, 300, 12, 3, 9_000), (3, 250, 200, 2, 2_000)]


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("hot_rows", [1, 20])
def test_session_pairs_equal_a_loop(make_history, case, hot_rows):
    rows = rows_of(*case)
    found = related.session_pairs(make_history(*rows), hot_rows=hot_rows)
    assert listed(found) == best(brute(rows, in_session))


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("hot_commands", [1, 8])
def test_directory_pairs_equal_a_loop(make_history, case, hot_commands):
    rows = rows_of(*case)
    found = related.directory_pairs(make_history(*rows), hot_commands=hot_commands)
    assert listed(found) == best(brute(rows, in_directory))


@pytest.mark.parametrize("k", [1, 4])
def test_other_numbers_of_partners(make_history, k):
    rows = rows_of(5, 200, 25, 3, 5_000)
    df = make_history(*rows)
    assert listed(related.session_pairs(df, k=k, hot_rows=1)) == best(brute(rows, in_session), k)
    found = related.directory_pairs(df, k=k, hot_commands=1)
    assert listed(found) == best(brute(rows, in_directory), k)


def test_long_lists_of_hot_groups_are_joined_by_key(make_history, monkeypatch):
    monkeypatch.setattr(related, "MAX_BROADCAST_GROUPS", 1)
    rows = rows_of(6, 200, 25, 4, 5_000)
    df = make_history(*rows)
    assert listed(related.session_pairs(df, hot_rows=1)) == best(brute(rows, in_session))
    found = related.directory_pairs(df, hot_commands=1)
    assert listed(found) == best(brute(rows, in_directory))


def spied(monkeypatch):
    """Numbers of pairs that each round forms."""
    formed, whole = [], pairs.pairs_met

    def count(*arguments):
        found = whole(*arguments)
        formed.append(found.count())
        return found

    monkeypatch.setattr(pairs, "pairs_met", count)
    return formed


def test_hot_cells_form_few_pairs(make_history, monkeypatch):
    """A directory of many rare commands must not be squared."""
    formed = spied(monkeypatch)
    rows = [{"cmd": f"x{i}", "epoch": i, "pwd": "/hot"} for i in range(400)]
    rows += [{"cmd": c, "epoch": 0, "pwd": "/hot"} for c in ("a", "b", "c") for _ in range(9)]
    assert listed(related.directory_pairs(make_history(*rows))) == best(brute(rows, in_directory))
    assert sum(formed) <= 403 * 4


def test_one_off_commands_of_a_directory(make_history, monkeypatch):
    """4,000 commands that all ran once: equal scores end on time and text."""
    formed = spied(monkeypatch)
    rows = [{"cmd": f"x{i}", "epoch": i % 37, "pwd": "/flat"} for i in range(4_000)]
    found = listed(related.directory_pairs(make_history(*rows)))
    assert sum(formed) < 20 * 4_000
    newest = sorted(rows, key=lambda r: (-r["epoch"], r["cmd"]))[:3]
    want = {}
    for row in rows:
        others = [r for r in newest if r["cmd"] != row["cmd"]][:2]
        want |= {(row["cmd"], n): (r["cmd"], 1, r["epoch"]) for n, r in enumerate(others, 1)}
    assert found == want


@pytest.mark.parametrize("seed", [11, 12])
def test_flat_and_mixed_groups_equal_a_loop(make_history, seed):
    """Commands that ran once or twice, in many crowded directories and sessions at once."""
    rng = random.Random(seed)
    rows = [
        {
            "cmd": f"x{rng.randrange(120)}" if rng.random() < 0.5 else f"y{i}",
            "epoch": rng.randrange(12_000),
            "pwd": f"/d{rng.randrange(4)}",
            "ppid": rng.randrange(2),
        }
        for i in range(260)
    ]
    df = make_history(*rows)
    directory = related.directory_pairs(df, hot_commands=5 if seed == 11 else 70)
    assert listed(directory) == best(brute(rows, lambda a, b: a["pwd"] == b["pwd"]))
    near = lambda a, b: a["ppid"] == b["ppid"] and abs(a["epoch"] - b["epoch"]) < 3600
    assert listed(related.session_pairs(df, hot_rows=5)) == best(brute(rows, near))


def test_large_directories_are_cut_into_blocks(make_history, monkeypatch):
    monkeypatch.setattr(related, "BLOCK_COMMANDS", 3)
    rows = rows_of(9, 250, 40, 3, 9_000)
    pairs_ = brute(rows, in_directory)
    want = sorted((-n, -at, cmd) for (base, cmd), (n, at) in pairs_.items() if base == "c1")[:4]
    found = related.directory_partners(make_history(*rows), "c1", k=4).collect()
    assert [(-int(r.co_occurrences), -r.latest, r.cmd) for r in found] == want


@pytest.mark.parametrize("case", CASES)
def test_one_base_equals_a_loop(make_history, case):
    rows = rows_of(*case)
    df = make_history(*rows)
    for near, partners in [
        (in_session, related.session_partners),
        (in_directory, related.directory_partners),
    ]:
        want = [v for (base, _), v in sorted(best(brute(rows, near)).items()) if base == "c1"]
        found = partners(df, "c1").collect()
        assert [(r.cmd, int(r.co_occurrences), r.latest) for r in found] == want


def test_an_hour_apart_is_too_far(make_history):
    df = make_history(
        {"cmd": "a", "epoch": -1},
        {"cmd": "b", "epoch": 3_598},
        {"cmd": "c", "epoch": 3_599},
        {"cmd": "d", "epoch": 10, "ppid": 11},
        {"cmd": "e", "epoch": -3_600},
    )
    assert {r.cmd for r in related.session_partners(df, "a", k=9).collect()} == {"b", "e"}
    pairs = {(r.base, r.cmd) for r in related.session_pairs(df, k=9).collect()}
    assert ("a", "b") in pairs and ("a", "c") not in pairs and ("d", "a") not in pairs


def same_tool(base, rows, k=3):
    words = base.split()
    key = (words[0] if words else "").lower() + " "
    latest = defaultdict(lambda: -(2**62))
    for r in rows:
        if r["cmd"] != base and r["cmd"].lower().startswith(key):
            latest[r["cmd"]] = max(latest[r["cmd"]], r["epoch"])
    return [c for c, _ in sorted(latest.items(), key=lambda e: (-e[1], e[0]))[:k]]


def test_same_tool(make_history):
    rng = random.Random(7)
    cmds = TOOLS + [f"git {c}" for c in "defg"]
    rows = [{"cmd": rng.choice(cmds), "epoch": rng.randrange(50)} for _ in range(120)]
    df = make_history(*rows)
    every = defaultdict(list)
    for r in related.tool_pairs(df).orderBy("base", "rank").collect():
        every[r.base].append(r.cmd)
    for base in {r["cmd"] for r in rows}:
        want = same_tool(base, rows)
        assert every[base] == want
    assert [r.cmd for r in related.tool_partners(df, "Git c").collect()] == same_tool("Git c", rows)


def test_suggestions_keep_the_order_of_lists(make_history):
    rows = [
        {"cmd": "git commit -m x", "epoch": 100},
        {"cmd": "git status", "epoch": 200, "ppid": 2, "pwd": "/b"},
        {"cmd": "git diff", "epoch": 300, "ppid": 3, "pwd": "/c"},
        {"cmd": "make", "epoch": 150, "pwd": "/d"},
        {"cmd": "ls", "epoch": 9_000, "ppid": 4},
    ]
    df = make_history(*rows)
    found = related.suggestions(df, "git commit -m x").orderBy("position").collect()
    assert [r.cmd for r in found] == [
        "git status", "git log --oneline", "git push", "git diff", "make",
    ]
    every = related.suggestions_all(df).collect()
    for base in ("git commit -m x", "make"):
        one = {(r.position, r.cmd) for r in related.suggestions(df, base).collect()}
        assert {(r.position, r.cmd) for r in every if r.base == base} == one
