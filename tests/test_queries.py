import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cmdlog_spark.operators import aggregate, topk
from cmdlog_spark.plans import reports
from cmdlog_spark.sinks import export

NOW = 1_700_000_000


def test_summary_counts_and_newest_first(make_history):
    df = make_history(
        {"cmd": "a", "epoch": 10}, {"cmd": "b", "epoch": 30}, {"cmd": "a", "epoch": 20, "pwd": "/x"}
    )
    assert [tuple(r) for r in aggregate.summary(df).collect()] == [
        (3, "1970-01-01 00:00:20", 2, "a"), (2, "1970-01-01 00:00:30", 1, "b"),
    ]
    by_pwd = aggregate.summary(df, by_pwd=True, limit=2).collect()
    assert [(r.mid, r.cmd, r.pwd) for r in by_pwd] == [(3, "a", "/x"), (2, "b", "/tmp")]


def test_top_breaks_ties_by_time_then_text(make_history):
    df = make_history(
        {"cmd": "b", "epoch": NOW}, {"cmd": "a", "epoch": NOW}, {"cmd": "c", "epoch": NOW + 1},
        {"cmd": "d", "epoch": NOW - 86_400 * 30 - 1}, {"cmd": "e", "epoch": NOW - 86_400 * 30},
    )
    assert [r.cmd for r in aggregate.top_commands(df, NOW).collect()] == ["c", "a", "b", "e"]
    assert aggregate.top_commands(df, NOW, limit=2).count() == 2


def test_counts_add_up(make_history):
    df = make_history(*[{"cmd": f"c{i % 7}", "epoch": i * 5_000} for i in range(60)])
    days = aggregate.daily_counts(df, 300_000, days=10, tz="Asia/Tokyo").collect()
    assert [r.day for r in days] == sorted(r.day for r in days)
    total = aggregate.row_count(df).first().rows
    assert sum(r.cnt for r in days) == total == 60
    top = aggregate.top_commands(df, 300_000, days=10, limit=None).collect()
    assert sum(r.cnt for r in top) == total


def test_directories_with_commas_stay_whole(make_history):
    dirs = ["/a", "/b", "/c", "/d", "/e", "/f", "/g,h"]
    df = make_history(*[{"cmd": "x", "epoch": i, "pwd": d} for i, d in enumerate(dirs + dirs)])
    assert [r.pwd for r in aggregate.profile_directories(df, "x").collect()] == dirs
    profile = aggregate.profile(df, "x").first()
    assert (profile.total_uses, profile.first_used, profile.last_used, profile.unique_dirs) == (
        14, 0, 13, 7,
    )
    assert aggregate.profile_all_approx(df).first().unique_dirs == 7
    shown = aggregate.directory_preview(df).first()
    assert (shown.dirs, shown.more) == (dirs[:5], 2)
    assert aggregate.directory_preview(df, 8).first().more == 0


def pages(make_history):
    rows = [{"cmd": str(i), "epoch": (i * 37) % 11 * 50_000, "id": i} for i in range(1, 60)]
    order = sorted((r["epoch"], r["id"]) for r in rows)
    return make_history(*rows), [i for _, i in order]


@pytest.mark.parametrize("limit, offset", [(10, 0), (10, 5), (None, 0), (None, 17), (7, 55), (5, 90)])
@pytest.mark.parametrize("heap", [0, 10**6])
def test_pages(make_history, monkeypatch, limit, offset, heap):
    monkeypatch.setattr(topk, "HEAP_ROWS", heap)
    df, ids = pages(make_history)
    got = [r.id for r in topk.oldest_first(df, limit, offset).collect()]
    assert got == (ids[offset:] if limit is None else ids[offset : offset + limit])


@pytest.mark.parametrize("heap", [0, 10**6])
def test_pages_with_null_keys(make_history, monkeypatch, heap):
    monkeypatch.setattr(topk, "HEAP_ROWS", heap)
    keys = [(e, i) for i, e in enumerate([5, None, 7, None, -3, 5, None, 90_000, None, 7], 1)]
    df = make_history(*[{"cmd": "c", "epoch": e, "id": i} for e, i in [*keys, (5, None)]])
    order = [i for _, i in sorted(((e is not None, e or 0, i or 0), i) for e, i in [*keys, (5, None)])]
    for offset in range(12):
        for limit in (None, 3):
            got = [r.id for r in topk.oldest_first(df, limit, offset).collect()]
            assert got == (order[offset:] if limit is None else order[offset : offset + limit])


def test_key_at_with_small_chunks(make_history, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 4)
    df, ids = pages(make_history)
    assert [topk.key_at(df, p).id for p in (0, 13, 58)] == [ids[0], ids[13], ids[58]]
    assert topk.key_at(df, 59) is None


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    keys=st.lists(st.tuples(st.sampled_from([None, 1, 2]), st.sampled_from([None, 7]), st.sampled_from("ab")), max_size=12),
    offset=st.integers(0, 12),
    limit=st.one_of(st.none(), st.integers(0, 4)),
)
def test_deep_pages_equal_shallow_ones(make_history, keys, offset, limit):
    """Repeated and null keys, equal rows too: pages neither repeat nor lose rows."""
    df = make_history(*[{"cmd": c, "epoch": e, "id": i} for e, i, c in keys])
    everything = [tuple(r) for r in topk.oldest_first(df, None).collect()]
    heap = topk.HEAP_ROWS
    try:
        topk.HEAP_ROWS = 0
        deep = [tuple(r) for r in topk.oldest_first(df, limit, offset).collect()]
        topk.HEAP_ROWS = 10**6
        shallow = [tuple(r) for r in topk.oldest_first(df, limit, offset).collect()]
    finally:
        topk.HEAP_ROWS = heap
    want = everything[offset:] if limit is None else everything[offset : offset + limit]
    assert deep == want
    if limit is not None:
        assert shallow == want


def test_newest_first(make_history):
    df, ids = pages(make_history)
    assert [r.id for r in topk.newest_first(df, 4).collect()] == ids[::-1][:4]
    assert [r.id for r in topk.newest_first(df, None).collect()] == ids[::-1]


def test_recent_runs(make_history):
    df = make_history(*[{"cmd": "a", "epoch": i // 2} for i in range(8)], {"cmd": "b", "epoch": 0})
    assert [r.id for r in topk.recent_runs(df, "a").collect()] == [8, 7, 6, 5, 4]
    every = topk.recent_runs_all(df).collect()
    assert {(r.cmd, r.id, r.rank) for r in every} == {
        ("a", 8, 1), ("a", 7, 2), ("a", 6, 3), ("a", 5, 4), ("a", 4, 5), ("b", 9, 1),
    }


def test_list_and_search(make_history):
    df = make_history({"cmd": "git a", "epoch": 5}, {"cmd": "GIT b", "epoch": 3}, {"cmd": "c", "epoch": 4})
    assert [r.id for r in reports.list_events(df).collect()] == [2, 3, 1]
    assert [r.id for r in reports.search_events(df, "git").collect()] == [1, 2]
    assert [r.id for r in reports.search_events(df, "git", limit=1).collect()] == [1]
    assert [r.id for r in reports.search_events(df, "git", since_epoch=4).collect()] == [1]


def test_export_is_valid_json_in_order(spark, make_history, tmp_path):
    texts = ['say "x"', "back\\slash", "a\nb\tc\rd", "\x01", "ü %_$*#"]
    df = make_history(*[{"cmd": t, "epoch": 9 - i} for i, t in enumerate(texts)], {"cmd": "z", "epoch": 0, "ppid": 1})
    path = tmp_path / "out"
    export.export_jsonl(df, str(path), session=(42, 10))
    lines = [x for f in sorted(path.glob("part-*")) for x in f.read_text().splitlines()]
    objects = [json.loads(x) for x in lines]
    assert [o["cmd"] for o in objects] == texts[::-1]
    assert list(objects[0]) == ["id", "hist_id", "epoch", "ppid", "pwd", "salt", "cmd"]
    assert objects[0]["hist_id"] is None
    rows = [json.loads(r.value) for r in export.to_json_rows(df).collect()]
    assert list(rows[0]) == ["id", "epoch", "pwd", "cmd"]


def test_text_rows_do_not_cut_long_numbers(make_history):
    df = make_history({"cmd": "a", "epoch": 0, "id": 12_345_678}, {"cmd": "b", "epoch": 1, "id": 7})
    assert [r.value for r in export.to_text_rows(df.orderBy("cmd"), "list").collect()] == [
        "12345678 | 1970-01-01 00:00:00 | /tmp | a",
        "     7 | 1970-01-01 00:00:01 | /tmp | b",
    ]


def test_preview(make_history):
    rows = [{"cmd": "git status", "epoch": NOW - 90 * i, "pwd": f"/d{i}"} for i in range(7)]
    df = make_history(*rows, {"cmd": "git diff", "epoch": NOW})
    shown = reports.preview(df, "git status", NOW)
    profile = shown["profile"].first()
    assert (profile.total_uses, profile.unique_dirs, profile.type) == (7, 7, "git")
    assert (profile.first_seen, profile.last_seen) == ("9m ago", "0s ago")
    assert profile.context == "Shows working directory status and changes"
    assert [(r.id, r.when, r.mark) for r in shown["recent"].collect()][:2] == [
        (1, "0s ago", ""), (2, "1m ago", ""),
    ]
    assert shown["directories"].first().more == 2
    assert [r.cmd for r in shown["related"].collect()] == ["git diff"]


def test_preview_of_an_unknown_command_is_empty(make_history):
    df = make_history({"cmd": "make x", "epoch": NOW})
    assert all(part.count() == 0 for part in reports.preview(df, "make", NOW).values())
