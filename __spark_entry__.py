"""Registered queries, one or more per operator, with their oracle SQL.

Queries run over whole tables: ``events`` read as shell history,
``conversations`` as history files, ``part`` and ``orders`` as command
templates and calls of them (see ``cmdlog_spark/demo.py``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlog_spark import demo
from cmdlog_spark.demo import BASE, DAYS, DIRECTORY, NOW, QUERY, SESSION
from cmdlog_spark.functions import commands, text, times
from cmdlog_spark.functions.cells import coerce_int, row_hash
from cmdlog_spark.functions.staging import staging_path
from cmdlog_spark.operators import (
    aggregate,
    care,
    filters,
    merge,
    noise,
    related,
    templates,
    topk,
)
from cmdlog_spark.plans import reports
from cmdlog_spark.schema import EVENT
from cmdlog_spark.sinks import export, quarantine
from cmdlog_spark.sources import legacy, shell_files, tables
from cmdlog_spark.streaming import intake

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}

# Names the oracle SQL may use, in the order in which they build on each other.
_VIEWS = {
    "history": demo.HISTORY_SQL,
    "hashed": """SELECT *, sha256(concat_ws(chr(10), epoch, ppid, salt,
        coalesce(CAST(hist_id AS VARCHAR), ''), pwd, cmd)) AS row_hash FROM history""",
    "quiet": """SELECT * FROM hashed
        WHERE cmd NOT IN ('ls', 'pwd', 'history', 'clear', 'exit')
          AND NOT regexp_matches(cmd, '^(cd|ls|echo)([ \t]|$)')
          AND cmd <> 'make' AND NOT starts_with(cmd, 'cargo t')""",
}


def _query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir) with its oracle."""

    def add(function: Query) -> Query:
        _QUERIES[name] = function
        if sql is not None:
            views = ", ".join(f"{view} AS ({body})" for view, body in _VIEWS.items())
            # A WITH of the query itself goes on from the shared views.
            start, rest = ("", sql.strip())
            if rest.startswith("WITH "):
                start, rest = ", ", rest.removeprefix("WITH ")
            else:
                views += " "
            _ORACLES[name] = f"WITH {views}{start}{rest}"
        return function

    return add


def _history_query(name: str, sql: str | None = None):
    """Register a function of the history table."""

    def add(function: Callable[[DataFrame], DataFrame]):
        _query(name, sql)(lambda spark, sf_dir: function(demo.history(spark, sf_dir)))
        return function

    return add


def _filter_query(name: str, condition, where: str) -> None:
    _history_query(name, f"SELECT id, cmd, pwd, epoch FROM history WHERE {where}")(
        lambda h: h.where(condition()).select("id", "cmd", "pwd", "epoch")
    )


def _projection_query(name: str, column, sql: str) -> None:
    _history_query(name, f"SELECT id, {sql} AS v FROM history")(
        lambda h: h.select("id", column().alias("v"))
    )


_RULES = noise.NoiseRules(
    ignore_exact=[" make "], ignore_prefix=["cargo t"], self_names=["echo"]
)
_LOWER_CMD = f"translate(cmd, '{text.UPPER}', '{text.LOWER}')"
_LOWER_PWD = f"translate(pwd, '{text.UPPER}', '{text.LOWER}')"
_SALT, _PPID = SESSION
_CUTOFF = NOW - 86_400 * DAYS
_DT = "strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d %H:%M:%S')"
_DAY = "strftime(make_timestamp(epoch * 1000000), '%Y-%m-%d')"


def _staged_history(spark: SparkSession, sf_dir: str) -> str:
    """The history written as an event table; its path."""
    path = staging_path(spark, "history")
    merge.write_events(merge.with_derived(demo.history(spark, sf_dir)), path)
    return path


def _listed(values) -> F.Column:
    """A map as text, its keys in order."""
    pairs = F.array_sort(F.map_entries(values))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


# Sources -------------------------------------------------------------------


@_query("a1_history_scan", "SELECT id, hist_id, cmd, epoch, ppid, pwd, salt FROM history")
def _(spark, sf_dir):
    return tables.scan_history(spark, _staged_history(spark, sf_dir)).drop("day", "row_hash")


def _bash_oracle(line_table: str) -> str:
    return f"""lines AS ({line_table}),
    kept AS (SELECT file, pos, rtrim(line) AS t FROM lines WHERE rtrim(line) <> ''),
    marked AS (SELECT file, pos, t,
        CASE WHEN regexp_matches(t, '^#[+-]?[0-9]+$') THEN CAST(substr(t, 2) AS BIGINT) END AS stamp
        FROM kept),
    paired AS (SELECT *, lag(stamp) OVER (PARTITION BY file ORDER BY pos) AS epoch FROM marked),
    entries AS (SELECT file, pos, epoch, t AS cmd FROM paired WHERE stamp IS NULL)"""


def _zsh_oracle(line_table: str) -> str:
    pattern = "'^: ([+-]?[0-9]+)(:[^;]*)?;(.*)$'"
    return f"""lines AS ({line_table}),
    entries AS (SELECT file, pos,
        CASE WHEN regexp_matches(t, {pattern}, 's')
             THEN CAST(regexp_extract(t, {pattern}, 1, 's') AS BIGINT) END AS epoch,
        CASE WHEN regexp_matches(t, {pattern}, 's')
             THEN regexp_extract(t, {pattern}, 3, 's') ELSE t END AS cmd
        FROM (SELECT file, pos, rtrim(line) AS t FROM lines WHERE rtrim(line) <> ''))"""


_BASH = _bash_oracle(demo.lines_sql(demo.BASH_LINES))
_ZSH = _zsh_oracle(demo.lines_sql(demo.ZSH_LINES))
_ENTRIES = "SELECT file, epoch, cmd FROM entries"


def _bash_entries(spark, sf_dir) -> DataFrame:
    lines = shell_files.with_parts(demo.lines(spark, sf_dir, demo.BASH_LINES))
    return shell_files.parse_bash_lines(lines)


def _zsh_entries(spark, sf_dir) -> DataFrame:
    lines = shell_files.with_parts(demo.lines(spark, sf_dir, demo.ZSH_LINES))
    return shell_files.parse_zsh_lines(lines)


@_query("a2_bash_lines", f"WITH {_BASH} {_ENTRIES}")
def _(spark, sf_dir):
    return _bash_entries(spark, sf_dir).select("file", "epoch", "cmd")


@_query("a3_zsh_lines", f"WITH {_ZSH} {_ENTRIES}")
def _(spark, sf_dir):
    return _zsh_entries(spark, sf_dir).select("file", "epoch", "cmd")


def _written_files(spark, sf_dir, parts: tuple[str, ...]) -> str:
    """The lines as real text files, one folder per group of conversations."""
    path = staging_path(spark, "shell-files")
    lines = demo.lines(spark, sf_dir, parts)
    grouped = lines.withColumn("book", times.floor_div(F.col("file"), 64))
    (
        grouped.repartition("book")
        .sortWithinPartitions("book", "file", "pos")
        .select("book", "line")
        .write.partitionBy("book")
        .text(path)
    )
    return path


def _books(parts: tuple[str, ...]) -> str:
    """The same files for the oracle: lines of a group follow each other."""
    return f"""SELECT file // 64 AS file, file * 1000 + pos AS pos, line
        FROM ({demo.lines_sql(parts)})"""


def _book_entries(entries: DataFrame) -> DataFrame:
    book = F.regexp_extract("file", r"book=(\d+)", 1).cast("bigint")
    return entries.select(book.alias("file"), "epoch", "cmd")


@_query("a2_bash_files", f"WITH {_bash_oracle(_books(demo.BASH_LINES))} {_ENTRIES}")
def _(spark, sf_dir):
    path = _written_files(spark, sf_dir, demo.BASH_LINES)
    return _book_entries(shell_files.read_bash_history(spark, path))


@_query("a3_zsh_files", f"WITH {_zsh_oracle(_books(demo.ZSH_LINES))} {_ENTRIES}")
def _(spark, sf_dir):
    path = _written_files(spark, sf_dir, demo.ZSH_LINES)
    return _book_entries(shell_files.read_zsh_history(spark, path))


@_query("a4_legacy_history", "SELECT id, hist_id, cmd, epoch, ppid, pwd, salt FROM history")
def _(spark, sf_dir):
    path = demo.write_legacy_dump(demo.history(spark, sf_dir), staging_path(spark, "legacy"))
    typed = merge.coerce_raw(legacy.read_legacy_history(spark, [path]))
    return typed.select("id", "hist_id", "cmd", "epoch", "ppid", "pwd", "salt")


_CATALOG_COMMAND = "CASE p_partkey % 10 " + " ".join(
    f"WHEN {i} THEN '{c}'" for i, c in enumerate(demo.TEMPLATE_COMMANDS)
) + " END"
_CATALOG_SIZE = "CASE p_partkey % 10 " + " ".join(
    f"WHEN {i} THEN {len(v)}" for i, v in enumerate(demo.TEMPLATE_VARIABLES)
) + " END"


def _sql_text(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return value


_CATALOG_VARIABLES = "CASE p_partkey % 10 " + " ".join(
    "WHEN {} THEN '{}'".format(
        i, "|".join(":".join([n, "null", _sql_text(r), _sql_text(d)]) for n, r, d in variables)
    )
    for i, variables in enumerate(demo.TEMPLATE_VARIABLES)
) + " END"


@_query(
    "a5_template_scan",
    f"""SELECT 't' || p_partkey AS id, CASE WHEN p_size = 1 THEN '' ELSE p_name END AS name,
        CASE WHEN p_size % 2 = 0 THEN p_brand END AS description, {_CATALOG_COMMAND} AS command,
        p_type AS category, {_CATALOG_VARIABLES} AS variables,
        CASE p_partkey % 10 WHEN 4 THEN 'user=root' WHEN 9 THEN 'x={{y}}' ELSE '' END AS defaults
    FROM part""",
)
def _(spark, sf_dir):
    path = staging_path(spark, "templates")
    demo.templates(spark, sf_dir).write.json(path)
    null = F.lit("null")
    fields = ("name", "description", "required", "default")
    variable = lambda v: F.concat_ws(":", *[F.coalesce(v[f].cast("string"), null) for f in fields])
    return tables.read_templates(spark, path).withColumns(
        {"variables": F.array_join(F.transform("variables", variable), "|"), "defaults": _listed(F.col("defaults"))}
    )


# Sinks ---------------------------------------------------------------------

_DAMAGE = """CASE WHEN id % 7 = 0 THEN 'no pwd' WHEN id % 11 = 0 THEN 'no epoch' END"""


def _damaged(h: DataFrame) -> DataFrame:
    """Events of which some lack a field."""
    return h.withColumns(
        {
            "pwd": F.when(F.col("id") % 7 != 0, F.col("pwd")),
            "epoch": F.when(F.col("id") % 11 != 0, F.col("epoch")),
        }
    )


def _kept_and_put_aside(spark: SparkSession, path: str) -> DataFrame:
    stored = tables.scan_history(spark, path).agg(F.lit("stored").alias("reason"), F.count("*").alias("rows"))
    return quarantine.quarantine_counts(spark, path).unionByName(stored)


@_query(
    "b1_bad_events",
    f"""SELECT reason, count(*) AS rows FROM (SELECT {_DAMAGE} AS reason FROM history)
    WHERE reason IS NOT NULL GROUP BY reason
    UNION ALL SELECT 'stored', count(*) FROM quiet WHERE ({_DAMAGE}) IS NULL""",
)
def _(spark, sf_dir):
    path = staging_path(spark, "events")
    merge.append_events(_damaged(demo.history(spark, sf_dir)).drop("id"), path, _RULES)
    return _kept_and_put_aside(spark, path)


@_query(
    "b1_append_events",
    "SELECT id, hist_id, cmd, epoch, ppid, pwd, salt, row_hash FROM quiet",
)
def _(spark, sf_dir):
    path = staging_path(spark, "events")
    merge.append_events(demo.history(spark, sf_dir), path, _RULES)
    return spark.read.parquet(path).drop("day")


@_query(
    "b1_append_new_ids",
    """SELECT count(*) AS rows, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id,
        count(*) AS ids FROM history""",
)
def _(spark, sf_dir):
    path = staging_path(spark, "events")
    merge.append_events(demo.history(spark, sf_dir).drop("id"), path, no_filter=True)
    return spark.read.parquet(path).agg(
        F.count("*").alias("rows"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
        F.countDistinct("id").alias("ids"),
    )


@_query("b2_export_jsonl", "SELECT id, hist_id, epoch, ppid, pwd, salt, cmd FROM history")
def _(spark, sf_dir):
    path = staging_path(spark, "export")
    export.export_jsonl(demo.history(spark, sf_dir), path)
    return tables.scan_history(spark, path, "json").select(*export.EXPORT_KEYS)


_JSON_KEYS = "'id', id, {} 'epoch', epoch, {} 'pwd', pwd, {} 'cmd', cmd"


@_history_query(
    "b2_export_text",
    """SELECT id, CAST(json_object('id', id, 'hist_id', hist_id, 'epoch', epoch, 'ppid', ppid,
        'pwd', pwd, 'salt', salt, 'cmd', cmd) AS VARCHAR) AS value
    FROM history WHERE ppid = {p} AND salt = {s}""".format(p=_PPID, s=_SALT),
)
def _(h):
    return export.to_export_json(export.export_rows(h, SESSION))


@_history_query(
    "b3_json_rows",
    """SELECT id, CAST(json_object('id', id, 'epoch', epoch, 'pwd', pwd, 'cmd', cmd) AS VARCHAR)
        AS value FROM history""",
)
def _(h):
    return export.to_json_rows(h)


@_history_query(
    "b4_text_list",
    f"SELECT printf('%6d | %s | %s | %s', id, {_DT}, pwd, cmd) AS value FROM history",
)
def _(h):
    return export.to_text_rows(h, "list")


_SUMMARY = """SELECT max(id) AS mid, {dt} AS dt, count(*) AS cnt, {keys}
    FROM history {where} GROUP BY {keys}"""
_LAST_DT = _DT.replace("epoch", "max(epoch)")


def _summary(keys: str, where: str = "") -> str:
    return _SUMMARY.format(dt=_LAST_DT, keys=keys, where=where)


@_history_query(
    "b4_text_summary",
    f"""SELECT printf('%6d | %s | %6d | %s', mid, dt, cnt, cmd) AS value
    FROM ({_summary("cmd")})""",
)
def _(h):
    return export.to_text_rows(aggregate.summary(h, limit=None), "summary")


@_history_query(
    "b4_text_summary_pwd",
    f"""SELECT printf('%6d | %s | %6d | %s > %s', mid, dt, cnt, pwd, cmd) AS value
    FROM ({_summary("cmd, pwd")})""",
)
def _(h):
    return export.to_text_rows(aggregate.summary(h, by_pwd=True, limit=None), "summary_pwd")


@_history_query(
    "b4_text_stats",
    f"""SELECT printf('%6d | %s', count(*), cmd) AS value FROM history
        WHERE epoch >= {_CUTOFF} GROUP BY cmd
    UNION ALL SELECT printf('%6d | %s | %s', count(*), pwd, cmd) FROM history
        WHERE epoch >= {_CUTOFF} GROUP BY pwd, cmd
    UNION ALL SELECT printf('%s | %6d', {_DAY}, count(*)) FROM history
        WHERE epoch >= {_CUTOFF} GROUP BY {_DAY}""",
)
def _(h):
    every = aggregate.top_commands(h, NOW, days=DAYS, limit=None)
    per_pwd = aggregate.top_commands(h, NOW, days=DAYS, limit=None, by_pwd=True)
    daily = aggregate.daily_counts(h, NOW, days=DAYS)
    return (
        export.to_text_rows(every, "top")
        .unionByName(export.to_text_rows(per_pwd, "by_pwd"))
        .unionByName(export.to_text_rows(daily, "daily"))
    )


# Cleaning and merging ------------------------------------------------------


@_history_query("c1_row_hash", "SELECT id, row_hash FROM hashed")
def _(h):
    return h.select("id", row_hash().alias("row_hash"))


@_history_query("c2_coerce_int", f"SELECT id, {demo.CELL_VALUE} AS v FROM history")
def _(h):
    return h.select("id", coerce_int(F.expr(demo.CELL_TEXT), F.lit("text")).alias("v"))


def _merge_parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Target: two rows in three. Sources: all rows, then the same again with
    every tenth row damaged."""
    h = demo.history(spark, sf_dir)
    damaged = F.when(F.col("id") % 10 == 0, "x y z").otherwise(F.col("epoch_txt"))
    second = demo.raw(h, "second", 1).withColumns(
        {"epoch_txt": damaged, "epoch_type": F.lit("text")}
    )
    return h.where(F.col("id") % 3 != 0), demo.raw(h, "first", 0).unionByName(second)


_MERGED = """WITH target AS (SELECT row_hash FROM hashed WHERE id % 3 <> 0),
    fresh AS (SELECT * FROM hashed WHERE row_hash NOT IN (SELECT row_hash FROM target)
        QUALIFY row_number() OVER (PARTITION BY row_hash ORDER BY id) = 1)"""


@_query(
    "c3_merge_import",
    f"{_MERGED} SELECT id, hist_id, cmd, epoch, ppid, pwd, salt, row_hash FROM fresh",
)
def _(spark, sf_dir):
    new_rows, _ = merge.merge_import(*_merge_parts(spark, sf_dir))
    return new_rows.drop("src", "src_ord")


@_query(
    "c4_import_stats",
    f"""{_MERGED},
    per AS (SELECT 'first' AS src, (SELECT count(*) FROM hashed) AS considered,
            (SELECT count(*) FROM fresh) AS inserted, 0 AS skipped_bad
        UNION ALL SELECT 'second', (SELECT count(*) FROM hashed), 0,
            (SELECT count(*) FROM hashed WHERE id % 10 = 0)
        UNION ALL SELECT 'third', 0, 0, 0)
    SELECT src, considered, inserted, CAST(skipped_bad AS BIGINT) AS skipped_bad FROM per
    UNION ALL SELECT 'total', CAST(sum(considered) AS BIGINT), CAST(sum(inserted) AS BIGINT),
        CAST(sum(skipped_bad) AS BIGINT) FROM per""",
)
def _(spark, sf_dir):
    # The third source has no rows.
    _, stats = merge.merge_import(*_merge_parts(spark, sf_dir), sources=["first", "second", "third"])
    return stats.drop("src_ord")


_TIMED = f"""{_BASH}, timed AS (SELECT file, pos, cmd, coalesce(epoch, 1000000000
        - sum(CASE WHEN epoch IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY file)
        + sum(CASE WHEN epoch IS NULL THEN 1 ELSE 0 END)
            OVER (PARTITION BY file ORDER BY pos)) AS epoch FROM entries)"""


@_query(
    "c5_synthetic_epoch",
    f"WITH {_TIMED} SELECT file, cmd, CAST(epoch AS BIGINT) AS epoch FROM timed",
)
def _(spark, sf_dir):
    entries = _bash_entries(spark, sf_dir)
    return shell_files.assign_synthetic_epoch(entries).select("file", "cmd", "epoch")


@_query(
    "c6_merge_files",
    f"""WITH {_TIMED} SELECT DISTINCT cmd, CAST(epoch AS BIGINT) AS epoch,
        CAST(0 AS BIGINT) AS ppid, '/home/u8' AS pwd, CAST(0 AS BIGINT) AS salt,
        sha256(concat_ws(chr(10), CAST(epoch AS BIGINT), 0, 0, '', '/home/u8', cmd)) AS row_hash
    FROM timed""",
)
def _(spark, sf_dir):
    target = demo.history(spark, sf_dir)
    new_rows, _ = merge.merge_history_files(target, _bash_entries(spark, sf_dir), "/home/u8")
    return new_rows.select("cmd", "epoch", "ppid", "pwd", "salt", "row_hash")


@_query(
    "c7_assign_ids",
    f"""{_MERGED} SELECT 1000000 + row_number() OVER (ORDER BY id) AS id, row_hash FROM fresh""",
)
def _(spark, sf_dir):
    new_rows, _ = merge.merge_import(*_merge_parts(spark, sf_dir))
    return merge.number_new_rows(new_rows, 1_000_000).select("id", "row_hash")


# Filters -------------------------------------------------------------------

_filter_query(
    "d1_session", lambda: filters.in_session(SESSION), f"salt = {_SALT} AND ppid = {_PPID}"
)
_filter_query("d2_here", lambda: filters.in_directory(DIRECTORY), f"pwd = '{DIRECTORY}'")
_filter_query(
    "d3_under",
    lambda: filters.under_directory(DIRECTORY.upper()),
    f"starts_with({_LOWER_PWD}, '{DIRECTORY}')",
)
_filter_query(
    "d4_search", lambda: filters.contains_text(QUERY), f"contains({_LOWER_CMD}, '{QUERY}')"
)
_filter_query(
    "d4_search_literal", lambda: filters.contains_text("100%"), "contains(cmd, '100%')"
)


@_history_query(
    "d5_list_matching",
    f"""SELECT id, {_DT} AS dt, pwd, cmd, epoch FROM history
    WHERE contains({_LOWER_CMD}, 'git') AND pwd = '{DIRECTORY}' ORDER BY epoch, id LIMIT 100""",
)
def _(h):
    return reports.list_events(h, query="GIT", here=DIRECTORY)


_filter_query(
    "d6_starts", lambda: filters.starts_with_text("GIT"), f"starts_with({_LOWER_CMD}, 'git')"
)
_filter_query("d7_since", lambda: filters.since(_CUTOFF), f"epoch >= {_CUTOFF}")
_filter_query("d8_last_days", lambda: filters.last_days(NOW, DAYS), f"epoch >= {_CUTOFF}")
_filter_query(
    "d9_like_escape",
    lambda: F.like(F.col("pwd"), F.lit("%" + text.escape_like("proj_%", "!")), F.lit("!")),
    "pwd LIKE '%proj!_!%' ESCAPE '!'",
)
_filter_query(
    "d10_builtin_noise",
    lambda: noise.is_builtin_noise(F.col("cmd"), ["echo"]),
    """cmd IN ('ls', 'pwd', 'history', 'clear', 'exit')
        OR regexp_matches(cmd, '^(cd|ls|echo)([ \t]|$)')""",
)
_filter_query(
    "d11_ignore_exact",
    lambda: noise.is_ignored_exact(F.col("cmd"), [" make ", "git status"]),
    "cmd IN ('make', 'git status')",
)
_filter_query(
    "d12_ignore_prefix",
    lambda: noise.is_ignored_prefix(F.col("cmd"), ["cargo t", "git c"]),
    "starts_with(cmd, 'cargo t') OR starts_with(cmd, 'git c')",
)


@_query(
    "d13_blank",
    """SELECT doc_id, u.line AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10)))
        AS line FROM documents) u WHERE trim(u.line, {ws}) <> ''""".format(
        ws=" || ".join(f"chr({ord(c)})" for c in text.WHITESPACE)
    ),
)
def _(spark, sf_dir):
    documents = demo.read_table(spark, sf_dir, "documents")
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.where(~noise.is_blank(F.col("line")))


@_history_query(
    "d13_noise_filter", "SELECT id, cmd FROM quiet"
)
def _(h):
    return noise.drop_noise(h, _RULES).select("id", "cmd")


_filter_query("d14_command_is", lambda: filters.command_is(BASE), f"cmd = '{BASE}'")
_filter_query("d15_command_differs", lambda: filters.command_differs(BASE), f"cmd <> '{BASE}'")
_filter_query(
    "d16_close_in_time",
    lambda: filters.close_in_time(F.col("epoch"), F.lit(_CUTOFF)),
    f"abs(epoch - {_CUTOFF}) < 3600",
)


@_history_query(
    "d_all_conditions",
    f"""SELECT id, {_DT} AS dt, pwd, cmd, epoch FROM history
    WHERE contains({_LOWER_CMD}, 'git') AND starts_with({_LOWER_PWD}, '/home/u8/proj')
      AND epoch >= {_CUTOFF} ORDER BY epoch DESC, id DESC LIMIT 100""",
)
def _(h):
    return reports.search_events(h, "git", under="/home/u8/proj", days=DAYS, now=NOW)


# Scalar functions ----------------------------------------------------------

_projection_query("e1_local_datetime", lambda: times.local_datetime(F.col("epoch")), _DT)
_projection_query(
    "e1_local_datetime_zone",
    lambda: times.local_datetime(F.col("epoch"), "Asia/Kolkata"),
    _DT.replace("epoch * 1000000", "(epoch + 19800) * 1000000"),
)
_projection_query("e2_local_date", lambda: times.local_date(F.col("epoch")), _DAY)
_RELATIVE_NOW = NOW - 3 * 86_400
_projection_query(
    "e3_relative_time",
    lambda: times.relative_time(F.col("epoch"), _RELATIVE_NOW),
    f"""CASE WHEN {_RELATIVE_NOW} - epoch < 0 THEN 'in the future'
        WHEN {_RELATIVE_NOW} - epoch < 60 THEN ({_RELATIVE_NOW} - epoch) || 's ago'
        WHEN {_RELATIVE_NOW} - epoch < 3600 THEN ({_RELATIVE_NOW} - epoch) // 60 || 'm ago'
        WHEN {_RELATIVE_NOW} - epoch < 86400 THEN ({_RELATIVE_NOW} - epoch) // 3600 || 'h ago'
        WHEN {_RELATIVE_NOW} - epoch < 604800 THEN ({_RELATIVE_NOW} - epoch) // 86400 || 'd ago'
        ELSE {_DAY} END""",
)

_TYPE = "CASE lower(split_part(cmd, ' ', 1)) " + " ".join(
    f"WHEN '{w}' THEN '{kind}'" for kind, ws in commands.TYPE_WORDS.items() for w in ws
) + " ELSE 'generic' END"
_projection_query("e4_command_type", lambda: commands.command_type(F.col("cmd")), _TYPE)
_CONTEXT = f"CASE {_TYPE} " + " ".join(
    f"WHEN '{kind}' THEN CASE "
    + " ".join(f"WHEN contains(cmd, '{k}') THEN '{t}'" for k, t in rules)
    + " END"
    for kind, rules in commands.CONTEXT_RULES.items()
) + " END"
_projection_query("e5_context", lambda: commands.command_context(F.col("cmd")), _CONTEXT)
_projection_query(
    "e6_first_word", lambda: text.first_word(F.col("cmd")), "split_part(cmd, ' ', 1)"
)
_projection_query(
    "e7_truncate",
    lambda: text.truncate(F.col("cmd"), 12),
    "CASE WHEN length(cmd) > 12 THEN substr(cmd, 1, 9) || '...' ELSE cmd END",
)
_projection_query(
    "e8_json_text", lambda: text.json_text(F.col("cmd")), "CAST(to_json(cmd) AS VARCHAR)"
)
_projection_query(
    "e9_variation_mark",
    lambda: text.variation_mark(F.col("cmd"), "ls"),
    "CASE WHEN cmd = 'ls' THEN '' WHEN starts_with(cmd, 'ls ') THEN '→' ELSE '≠' END",
)
_projection_query(
    "e10_text_basics",
    lambda: F.concat_ws(
        "|",
        F.lower("cmd"),
        text.trim_ws(F.concat(F.lit(" \t"), "pwd", F.lit(" "))),
        F.col("cmd").startswith("git").cast("string"),
        F.col("cmd").contains("s").cast("string"),
        F.replace("cmd", F.lit("git"), F.lit("hg")),
    ),
    """concat_ws('|', lower(cmd), pwd, starts_with(cmd, 'git'), contains(cmd, 's'),
        replace(cmd, 'git', 'hg'))""",
)
_projection_query(
    "e11_concat_abs",
    lambda: F.concat("pwd", F.lit("> "), "cmd", F.abs(F.col("epoch") - NOW).cast("string")),
    f"pwd || '> ' || cmd || abs(epoch - {NOW})",
)


@_query(
    "e12_ascii_lower",
    f"""SELECT doc_id, md5(translate(text, '{text.UPPER}', '{text.LOWER}')) AS v
    FROM documents""",
)
def _(spark, sf_dir):
    documents = demo.read_table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.md5(text.ascii_lower(F.col("text"))).alias("v"))


# Aggregations --------------------------------------------------------------


@_history_query("f1_summary", f"{_summary('cmd')} ORDER BY mid DESC LIMIT 100")
def _(h):
    return aggregate.summary(h)


@_history_query(
    "f1_summary_filtered",
    _summary("cmd", f"WHERE contains({_LOWER_CMD}, 'git') AND pwd = '{DIRECTORY}'")
    + " ORDER BY mid DESC LIMIT 3",
)
def _(h):
    return aggregate.summary(h, limit=3, query="git", here=DIRECTORY)


@_history_query(
    "f2_summary_pwd", f"{_summary('cmd, pwd')} ORDER BY mid DESC LIMIT 100"
)
def _(h):
    return aggregate.summary(h, by_pwd=True)


_TOP = f"""SELECT count(*) AS cnt, cmd FROM history WHERE epoch >= {_CUTOFF}
    GROUP BY cmd ORDER BY cnt DESC, max(epoch) DESC, cmd LIMIT 50"""


@_history_query("f3_stats_top", _TOP)
def _(h):
    return aggregate.top_commands(h, NOW, days=DAYS)


@_history_query(
    "f4_stats_by_pwd",
    f"""SELECT count(*) AS cnt, pwd, cmd FROM history WHERE epoch >= {_CUTOFF}
    GROUP BY pwd, cmd ORDER BY cnt DESC, max(epoch) DESC, pwd, cmd LIMIT 50""",
)
def _(h):
    return aggregate.top_commands(h, NOW, days=DAYS, by_pwd=True)


@_history_query(
    "f5_stats_daily",
    f"""SELECT {_DAY} AS day, count(*) AS cnt FROM history WHERE epoch >= {_CUTOFF}
    GROUP BY day ORDER BY day""",
)
def _(h):
    return aggregate.daily_counts(h, NOW, days=DAYS)


_PROFILE = """SELECT cmd, count(*) AS total_uses, min(epoch) AS first_used,
    max(epoch) AS last_used, count(DISTINCT pwd) AS unique_dirs FROM history"""


@_history_query("f6_profile", f"{_PROFILE} WHERE cmd = '{BASE}' GROUP BY cmd")
def _(h):
    return aggregate.profile(h, BASE)


@_history_query(
    "f6_profile_directories", f"SELECT DISTINCT pwd FROM history WHERE cmd = '{BASE}'"
)
def _(h):
    return aggregate.profile_directories(h, BASE)


@_history_query("f7_profile_all", f"{_PROFILE} GROUP BY cmd")
def _(h):
    return aggregate.profile_all(h)


@_history_query(
    "f7_command_directories",
    """SELECT cmd, pwd, count(*) AS uses, min(epoch) AS first_used, max(epoch) AS last_used
    FROM history GROUP BY cmd, pwd""",
)
def _(h):
    return aggregate.command_directories(h)


@_history_query("f8_row_count", "SELECT count(*) AS rows FROM history")
def _(h):
    return aggregate.row_count(h)


@_history_query(
    "f9_directory_cap",
    """SELECT cmd, array_to_string(list_sort(list(DISTINCT pwd))[1:5], '|') AS dirs,
        greatest(count(DISTINCT pwd) - 5, 0) AS more FROM history GROUP BY cmd""",
)
def _(h):
    return aggregate.directory_preview(h).withColumn("dirs", F.array_join("dirs", "|"))


# Order and limits ----------------------------------------------------------

_ROWS = f"SELECT id, {_DT} AS dt, pwd, cmd, epoch FROM history"


@_history_query("g1_oldest_page", f"{_ROWS} ORDER BY epoch, id LIMIT 100 OFFSET 250")
def _(h):
    return reports.list_events(h, limit=100, offset=250)


@_history_query("g1_deep_page", f"{_ROWS} ORDER BY epoch, id OFFSET 321")
def _(h):
    return reports.list_events(h, limit=None, offset=321)


@_history_query(
    "g2_newest_page",
    f"""{_ROWS} WHERE contains({_LOWER_CMD}, '{QUERY}')
    ORDER BY epoch DESC, id DESC LIMIT 100""",
)
def _(h):
    return reports.search_events(h, QUERY)


@_history_query("g3_top_after_aggregation", _TOP.replace("LIMIT 50", "LIMIT 5"))
def _(h):
    return aggregate.top_commands(h, NOW, days=DAYS, limit=5)


_RECENT = "SELECT id, epoch, pwd, cmd FROM history"


@_history_query(
    "g4_recent_runs", f"{_RECENT} WHERE cmd = '{BASE}' ORDER BY epoch DESC, id DESC LIMIT 5"
)
def _(h):
    return topk.recent_runs(h, BASE)


@_history_query(
    "g5_recent_runs_all",
    """SELECT id, epoch, pwd, cmd, rank FROM (SELECT *, row_number() OVER
        (PARTITION BY cmd ORDER BY epoch DESC, id DESC) AS rank FROM history) WHERE rank <= 5""",
)
def _(h):
    return topk.recent_runs_all(h).withColumn("rank", F.col("rank").cast("bigint"))


@_history_query("g6_unlimited", _summary("cmd, pwd"))
def _(h):
    return aggregate.summary(h, by_pwd=True, limit=None)


@_history_query(
    "g7_export_order", "SELECT id, hist_id, epoch, ppid, pwd, salt, cmd FROM history"
)
def _(h):
    return export.export_rows(h)


# Joins ---------------------------------------------------------------------

# Pair counts are DECIMAL(38,0); as text both engines print them alike.


def _printed(partners: DataFrame, *more: str) -> DataFrame:
    return partners.select(
        *more, "cmd", F.col("co_occurrences").cast("string").alias("co_occurrences"), "latest"
    )


def _pairs(on: str, base: str = "") -> str:
    return f"""SELECT h1.cmd AS base, h2.cmd AS cmd, count(*) AS n, max(h2.epoch) AS latest
        FROM history h1 JOIN history h2 ON {on}
        WHERE h1.cmd <> h2.cmd {base} GROUP BY 1, 2"""


_IN_SESSION = "h1.salt = h2.salt AND h1.ppid = h2.ppid AND abs(h1.epoch - h2.epoch) < 3600"
_IN_DIRECTORY = "h1.pwd = h2.pwd"
_OF_BASE = f"AND h1.cmd = '{BASE}'"


def _one_base(on: str) -> str:
    return f"""SELECT cmd, CAST(n AS VARCHAR) AS co_occurrences, latest
        FROM ({_pairs(on, _OF_BASE)}) ORDER BY n DESC, latest DESC, cmd LIMIT 2"""


def _ranked_pairs(on: str) -> str:
    return f"""SELECT *, row_number() OVER (PARTITION BY base ORDER BY n DESC, latest DESC, cmd)
        AS rank FROM ({_pairs(on)})"""


def _all_bases(on: str) -> str:
    return f"""SELECT base, CAST(rank AS BIGINT) AS rank, cmd,
        CAST(n AS VARCHAR) AS co_occurrences, latest FROM ({_ranked_pairs(on)}) WHERE rank <= 2"""


@_history_query("h1_session_base", _one_base(_IN_SESSION))
def _(h):
    return _printed(related.session_partners(h, BASE))


@_history_query("h2_session_pairs", _all_bases(_IN_SESSION))
def _(h):
    return _printed(related.session_pairs(h), "base", F.col("rank").cast("bigint").alias("rank"))


@_history_query("h3_directory_base", _one_base(_IN_DIRECTORY))
def _(h):
    return _printed(related.directory_partners(h, BASE))


@_history_query("h4_directory_pairs", _all_bases(_IN_DIRECTORY))
def _(h):
    pairs = related.directory_pairs(h)
    return _printed(pairs, "base", F.col("rank").cast("bigint").alias("rank"))


def _incoming(h: DataFrame) -> tuple[DataFrame, DataFrame]:
    return h.withColumn("row_hash", row_hash()), h.where(F.col("id") % 3 != 0)


_INCOMING = "SELECT id, row_hash FROM hashed WHERE row_hash"


@_history_query(
    "h5_unseen_hashes", f"{_INCOMING} NOT IN (SELECT row_hash FROM hashed WHERE id % 3 <> 0)"
)
def _(h):
    return merge.unseen(*_incoming(h)).select("id", "row_hash")


@_history_query(
    "h6_present_hashes", f"{_INCOMING} IN (SELECT row_hash FROM hashed WHERE id % 3 <> 0)"
)
def _(h):
    return merge.already_present(*_incoming(h)).select("id", "row_hash")


# Recommendation ------------------------------------------------------------

_COMMANDS = "SELECT cmd, max(epoch) AS latest FROM history GROUP BY cmd"
_TOOL_PAIRS = f"""SELECT b.cmd AS base, c.cmd AS cmd, c.latest, row_number() OVER
        (PARTITION BY b.cmd ORDER BY c.latest DESC, c.cmd) AS rank
    FROM ({_COMMANDS}) b JOIN ({_COMMANDS}) c ON b.cmd <> c.cmd
     AND starts_with(lower(c.cmd), lower(split_part(b.cmd, ' ', 1)) || ' ')"""


def _rule_rows() -> str:
    """(kind, priority, keyword, rank, cmd), one row per keyword and suggestion."""
    return ", ".join(
        f"('{kind}', {priority}, '{keyword}', {rank}, '{cmd}')"
        for kind, rules in commands.SUGGESTION_RULES.items()
        for priority, (keywords, advice) in enumerate(rules, 1)
        for keyword in keywords
        for rank, cmd in enumerate(advice, 1)
    )


_SEMANTIC = f"""SELECT DISTINCT b.cmd AS base, r.rank, r.cmd
    FROM (SELECT DISTINCT cmd, {_TYPE} AS kind FROM history) b
    JOIN (VALUES {_rule_rows()}) r(kind, priority, keyword, rank, cmd)
      ON r.kind = b.kind AND contains(b.cmd, r.keyword)
    QUALIFY r.priority = min(r.priority) OVER (PARTITION BY b.cmd)"""


@_history_query(
    "i1_same_tool",
    f"SELECT cmd, latest FROM ({_TOOL_PAIRS}) WHERE base = '{BASE}' AND rank <= 3",
)
def _(h):
    return related.tool_partners(h, BASE)


@_history_query(
    "i1_same_tool_all",
    f"SELECT base, CAST(rank AS BIGINT) AS rank, cmd, latest FROM ({_TOOL_PAIRS}) WHERE rank <= 3",
)
def _(h):
    return related.tool_pairs(h).withColumn("rank", F.col("rank").cast("bigint"))


@_history_query(
    "i2_semantic", f"SELECT base, CAST(rank AS BIGINT) AS rank, cmd FROM ({_SEMANTIC})"
)
def _(h):
    bases = h.select(F.col("cmd").alias("base")).distinct()
    return related.semantic_list(bases).select("base", F.col("rank").cast("bigint"), "cmd")


_COMBINED = f"""SELECT base, cmd, list_no, rank, row_number() OVER
        (PARTITION BY base ORDER BY list_no, rank) AS position
    FROM (SELECT *, row_number() OVER (PARTITION BY base, cmd ORDER BY list_no, rank) AS copy
        FROM (SELECT base, 1 AS list_no, rank, cmd FROM ({_SEMANTIC})
            UNION ALL SELECT base, 2, rank, cmd FROM ({_TOOL_PAIRS}) WHERE rank <= 3
            UNION ALL SELECT base, 3, rank, cmd FROM ({_ranked_pairs(_IN_SESSION)}) WHERE rank <= 2
            UNION ALL SELECT base, 4, rank, cmd FROM ({_ranked_pairs(_IN_DIRECTORY)})
                WHERE rank <= 2)
        WHERE cmd <> base) WHERE copy = 1"""
_SUGGESTED = f"""SELECT base, CAST(position AS BIGINT) AS position, cmd,
    CAST(list_no AS BIGINT) AS list_no FROM ({_COMBINED}) WHERE position <= 5"""


def _suggested(found: DataFrame) -> DataFrame:
    longs = [F.col(c).cast("bigint").alias(c) for c in ("position", "list_no")]
    return found.select("base", "cmd", *longs)


@_history_query("i3_suggestions", f"{_SUGGESTED} AND base = '{BASE}'")
def _(h):
    return _suggested(related.suggestions(h, BASE))


@_history_query("i4_suggestions_all", _SUGGESTED)
def _(h):
    return _suggested(related.suggestions_all(h))


def _since(column: str) -> str:
    """Text of an age, as the relative times of previews."""
    age = f"({NOW} - {column})"
    return f"""CASE WHEN {age} < 0 THEN 'in the future' WHEN {age} < 60 THEN {age} || 's ago'
        WHEN {age} < 3600 THEN {age} // 60 || 'm ago' WHEN {age} < 86400 THEN {age} // 3600 || 'h ago'
        WHEN {age} < 604800 THEN {age} // 86400 || 'd ago'
        ELSE strftime(make_timestamp({column} * 1000000), '%Y-%m-%d') END"""


@_history_query(
    "i5_preview_profile",
    f"""SELECT *, {_since("first_used")} AS first_seen, {_since("last_used")} AS last_seen,
        'git' AS type, 'Shows working directory status and changes' AS context
    FROM ({_PROFILE} WHERE cmd = '{BASE}' GROUP BY cmd)""",
)
def _(h):
    return reports.preview(h, BASE, NOW)["profile"]


@_history_query(
    "i5_preview_directories",
    f"""WITH d AS (SELECT DISTINCT pwd FROM history WHERE cmd = '{BASE}')
    SELECT '{BASE}' AS cmd, (SELECT string_agg(pwd, '|' ORDER BY pwd) FROM
            (SELECT pwd FROM d ORDER BY pwd LIMIT 5)) AS dirs,
        (SELECT greatest(count(*) - 5, 0) FROM d) AS more""",
)
def _(h):
    shown = reports.preview(h, BASE, NOW)["directories"]
    return shown.withColumn("dirs", F.array_join("dirs", "|"))


@_history_query(
    "i5_preview_recent",
    f"""SELECT id, epoch, pwd, cmd, '' AS mark, {_since("epoch")} AS "when" FROM history
    WHERE cmd = '{BASE}' ORDER BY epoch DESC, id DESC LIMIT 5""",
)
def _(h):
    return reports.preview(h, BASE, NOW)["recent"]


@_history_query(
    "i5_preview_related",
    f"""SELECT base, CAST(position AS BIGINT) AS position, cmd, CAST(list_no AS BIGINT) AS list_no,
        cmd AS shown, CAST(rank AS BIGINT) AS rank
    FROM ({_COMBINED}) WHERE position <= 5 AND base = '{BASE}'""",
)
def _(h):
    related_ = reports.preview(h, BASE, NOW)["related"]
    longs = [F.col(c).cast("bigint").alias(c) for c in ("position", "list_no", "rank")]
    return related_.select("base", "cmd", "shown", *longs)


@_history_query(
    "i5_preview_unknown",
    f"""SELECT *, '' AS first_seen, '' AS last_seen, '' AS type, '' AS context
    FROM ({_PROFILE} WHERE cmd = 'no such command' GROUP BY cmd)""",
)
def _(h):
    return reports.preview(h, "no such command", NOW)["profile"]


# Templates -----------------------------------------------------------------

_CATALOG = f"""WITH catalog AS (SELECT 't' || p_partkey AS id, p_partkey % 10 AS kind,
    CASE WHEN p_size = 1 THEN '' ELSE p_name END AS name, {_CATALOG_COMMAND} AS command FROM part)"""


@_query(
    "k1_placeholders",
    f"""{_CATALOG} SELECT id, CASE kind WHEN 8 THEN 'a' ELSE array_to_string(
        regexp_extract_all(command, '\\{{([^}}]+)\\}}', 1), ',') END AS names FROM catalog""",
)
def _(spark, sf_dir):
    names = F.array_join(templates.placeholders(F.col("command")), ",")
    return demo.templates(spark, sf_dir).select("id", names.alias("names"))


@_query(
    "k2_validate",
    f"""{_CATALOG} SELECT id AS template_id, 'empty name' AS problem, '' AS subject
        FROM catalog WHERE name = ''
    UNION ALL SELECT id, 'empty command', '' FROM catalog WHERE kind = 3
    UNION ALL SELECT id, 'bad variable name', '1bad' FROM catalog WHERE kind = 2
    UNION ALL SELECT id, 'undeclared variable', 'dst' FROM catalog WHERE kind = 1""",
)
def _(spark, sf_dir):
    return templates.validate_templates(demo.templates(spark, sf_dir))


def _requests(spark, sf_dir) -> DataFrame:
    return templates.request_maps(demo.requests(spark, sf_dir))


def _rendered(spark, sf_dir, **options) -> DataFrame:
    catalog = demo.templates(spark, sf_dir)
    found = templates.render_templates(catalog, _requests(spark, sf_dir), **options)
    return found.withColumn("variables_used", _listed(F.col("variables_used")))


def _render_oracle(invalid: str, jobs: str) -> str:
    """Outcome of every kind of template, worked out by hand."""
    return f"""WITH calls AS (SELECT o_orderkey AS req_id, 't' || o_custkey AS template_id, o.*,
        p_partkey % 10 AS kind, p_size = 1 AS nameless, p_partkey IS NULL AS unknown
        FROM orders o LEFT JOIN part ON p_partkey = o_custkey),
    judged AS (SELECT *, CASE WHEN unknown THEN 'unknown' {invalid}
        WHEN o_orderkey % 3 = 0 THEN 'malformed'
        WHEN kind = 2 OR (kind = 8 AND o_orderkey % 2 = 1) THEN 'missing'
        WHEN kind IN (1, 6 {jobs}) THEN 'unresolved' ELSE 'ok' END AS status FROM calls)
    SELECT req_id, template_id, status,
        CASE status WHEN 'unknown' THEN template_id WHEN 'malformed' THEN 'host'
          WHEN 'invalid' THEN CASE WHEN nameless THEN 'empty name' WHEN kind = 3
            THEN 'empty command' WHEN kind = 2 THEN 'bad variable name 1bad'
            ELSE 'undeclared variable dst' END
          WHEN 'missing' THEN CASE kind WHEN 2 THEN '1bad' ELSE 'a' END
          WHEN 'unresolved' THEN CASE kind WHEN 1 THEN 'dst' WHEN 6 THEN 'flags' ELSE 'jobs' END
        END AS detail,
        CASE WHEN status = 'ok' THEN CASE kind
          WHEN 0 THEN 'run n' || o_orderkey || ' --size 10' WHEN 3 THEN ''
          WHEN 4 THEN 'ssh root@h' || o_custkey || '=x' WHEN 5 THEN 'make -j 4'
          WHEN 7 THEN 'echo groß' WHEN 8 THEN 'mv old old.bak'
          ELSE 'echo ' || o_orderpriority || ' ' || o_orderpriority END END AS command,
        CASE WHEN status = 'ok' THEN concat_ws('|',
          CASE WHEN o_orderkey % 2 = 0 THEN 'a=old' END,
          CASE WHEN o_orderkey % 2 = 1 THEN 'b=unused' END,
          CASE WHEN kind = 7 THEN 'größe=groß' END,
          CASE WHEN o_orderkey % 3 <> 0 THEN 'host=h' || o_custkey || '=x' END,
          CASE WHEN kind = 5 THEN 'jobs=4' END,
          'name=n' || o_orderkey,
          CASE WHEN kind = 0 THEN 'size=10' END,
          'src=s',
          CASE WHEN kind = 4 THEN 'user=root' END,
          CASE WHEN kind = 9 THEN 'x={{y}}' END,
          'y=' || o_orderpriority) END AS variables_used
    FROM judged"""


_INVALID = "WHEN nameless OR kind IN (1, 2, 3) THEN 'invalid'"


@_query("k3_render", _render_oracle(_INVALID, ""))
def _(spark, sf_dir):
    return _rendered(spark, sf_dir)


@_query("k3_render_unchecked", _render_oracle("", ""))
def _(spark, sf_dir):
    return _rendered(spark, sf_dir, check=False)


@_query(
    "k4_assignments",
    """WITH parts AS (SELECT o_orderkey AS req_id, unnest([{}]) AS assignment FROM orders)
    SELECT req_id, assignment, contains(assignment, '=') AS ok,
        CASE WHEN contains(assignment, '=') THEN split_part(assignment, '=', 1) END AS key,
        CASE WHEN contains(assignment, '=')
             THEN substr(assignment, strpos(assignment, '=') + 1) END AS value
    FROM parts""".format(", ".join(demo.ASSIGNMENTS)),
)
def _(spark, sf_dir):
    calls = demo.assignments(spark, sf_dir).select("req_id", "assignment")
    return templates.parse_assignments(calls)


@_query(
    "k5_list_templates",
    f"""SELECT 't' || p_partkey AS id, CASE WHEN p_size = 1 THEN '' ELSE p_name END AS name,
        CASE WHEN p_size % 2 = 0 THEN p_brand ELSE 'No description' END AS description,
        p_type AS category, CAST({_CATALOG_SIZE} AS BIGINT) AS variables
    FROM part WHERE p_size <> 1 AND p_partkey % 10 NOT IN (1, 2, 3)""",
)
def _(spark, sf_dir):
    return templates.list_templates(demo.templates(spark, sf_dir))


@_query("k6_strict_render", _render_oracle("", ", 5"))
def _(spark, sf_dir):
    return _rendered(spark, sf_dir, mode="strict", check=False)


# Table care ----------------------------------------------------------------


@_query(
    "l1_table_profile",
    """SELECT count(*) AS rows, true AS has_files, true AS has_bytes, 1.0 AS all_small, 0.0 AS none_small
    FROM history""",
)
def _(spark, sf_dir):
    # Limits that every file and none is below.
    table = spark.read.parquet(_staged_history(spark, sf_dir))
    one = care.table_profile(table, small_bytes=1 << 60)
    two = care.table_profile(table, small_bytes=1).select(F.col("fragmentation").alias("none_small"), "rows")
    return one.join(two, "rows").select(
        "rows",
        (F.col("files") > 0).alias("has_files"),
        ((F.col("size_mb") > 0) & (F.col("size_mb") == F.col("small_mb"))).alias("has_bytes"),
        F.col("fragmentation").alias("all_small"),
        "none_small",
    )


@_query(
    "l1_table_health",
    """SELECT 'all' AS of, 'table.rows' AS "check", 'ok' AS status, count(*) || ' rows' AS told FROM history
    UNION ALL SELECT 'all', 'table.files', 'warn', '100.0%'
    UNION ALL SELECT 'none', 'table.rows', 'ok', count(*) || ' rows' FROM history""",
)
def _(spark, sf_dir):
    # Notices with every file and with none below the limit; no more than the counts are compared.
    table = spark.read.parquet(_staged_history(spark, sf_dir))
    told = F.regexp_extract("detail", "^([0-9]+ rows|[0-9.]+%)", 1).alias("told")
    found = [
        care.table_health(table, small).select(F.lit(of).alias("of"), "check", "status", told)
        for of, small in (("all", 1 << 60), ("none", 1))
    ]
    return found[0].unionByName(found[1]).where(F.col("check").isin("table.rows", "table.files"))


@_query(
    "l2_optimise", "SELECT id, hist_id, cmd, epoch, ppid, pwd, salt, row_hash FROM hashed"
)
def _(spark, sf_dir):
    target = staging_path(spark, "optimised")
    return care.optimise(spark, _staged_history(spark, sf_dir), target).drop("day")


@_query(
    "l3_describe",
    """WITH nulls AS (SELECT count(*) FILTER (WHERE hist_id IS NULL) AS n FROM history)
    SELECT 'history' AS "table", CAST(p AS BIGINT) AS position, c AS "column", t AS type,
        CASE WHEN c = 'hist_id' THEN n ELSE 0 END AS nulls, c = 'day' AS partition,
        true AS nullable, CAST(CASE WHEN c = 'id' THEN 1 ELSE 0 END AS BIGINT) AS key
    FROM nulls, (VALUES (1, 'id', 'bigint'), (2, 'hist_id', 'bigint'), (3, 'cmd', 'string'),
        (4, 'epoch', 'bigint'), (5, 'ppid', 'bigint'), (6, 'pwd', 'string'),
        (7, 'salt', 'bigint'), (8, 'row_hash', 'string'), (9, 'day', 'date')) v(p, c, t)""",
)
def _(spark, sf_dir):
    table = tables.scan_history(spark, _staged_history(spark, sf_dir))
    return care.describe_table(table, "history", ("day",))


@_history_query(
    "l4_audit",
    """WITH found AS (SELECT unnest(['null.id', 'null.cmd', 'null.pwd', 'null.epoch', 'null.ppid',
            'null.salt', 'time.range', 'hash.stored', 'id.repeated']) AS "check", 0 AS rows
        UNION ALL SELECT 'hash.repeated', count(*) - count(DISTINCT row_hash) FROM hashed)
    SELECT "check", CASE WHEN rows = 0 THEN 'ok' ELSE 'info' END AS status,
        CAST(rows AS BIGINT) AS rows, rows || ' rows' AS detail FROM found""",
)
def _(h):
    return care.audit(h.withColumn("row_hash", row_hash()))


# Streaming -----------------------------------------------------------------


def _arrivals(spark, sf_dir, copies: int) -> tuple[DataFrame, str]:
    """A stream over the history written as files of JSON events."""
    folder = staging_path(spark, "arrivals")
    for _ in range(copies):
        demo.history(spark, sf_dir).select(*EVENT.names).write.mode("append").json(folder)
    return intake.read_event_stream(spark, folder), staging_path(spark, "stream")


@_query(
    "m1_bad_events",
    f"""SELECT CASE WHEN id % 13 = 0 THEN 'malformed' ELSE {_DAMAGE} END AS reason, count(*) AS rows
    FROM history GROUP BY 1 HAVING reason IS NOT NULL
    UNION ALL SELECT 'stored', count(*) FROM quiet WHERE ({_DAMAGE}) IS NULL AND id % 13 <> 0""",
)
def _(spark, sf_dir):
    folder, path = staging_path(spark, "arrivals"), staging_path(spark, "stream")
    line = F.to_json(F.struct(*EVENT.names))
    cut = F.when(F.col("id") % 13 == 0, F.substring(line, 1, 20)).otherwise(line)
    _damaged(demo.history(spark, sf_dir)).select(cut.alias("value")).write.text(folder)
    stream = intake.read_event_stream(spark, folder)
    intake.start_intake(stream, path, f"{path}-state", rules=_RULES).awaitTermination()
    return _kept_and_put_aside(spark, path)


@_query("m1_stream_intake", "SELECT hist_id, cmd, epoch, ppid, pwd, salt, row_hash FROM quiet")
def _(spark, sf_dir):
    events, path = _arrivals(spark, sf_dir, 1)
    intake.start_intake(events, path, f"{path}-state", rules=_RULES).awaitTermination()
    return tables.scan_history(spark, path).drop("id", "day")


@_query(
    "m1_stream_into_table",
    """SELECT count(*) AS rows, count(*) AS ids, CAST(1 AS BIGINT) AS first_id,
       count(*) AS last_id FROM quiet""",
)
def _(spark, sf_dir):
    # Batches before and after the stream write to the same table.
    events = demo.history(spark, sf_dir)
    parts = [events.where(F.col("id") % 3 == k).select(*EVENT.names) for k in range(3)]
    folder, path = staging_path(spark, "arrivals"), staging_path(spark, "stream")
    parts[1].write.json(folder)
    merge.append_events(parts[0], path, _RULES)
    stream = intake.read_event_stream(spark, folder)
    intake.start_intake(stream, path, f"{path}-state", rules=_RULES).awaitTermination()
    merge.append_events(parts[2], path, _RULES)
    return tables.scan_history(spark, path).agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


@_query(
    "m2_stream_merge",
    "SELECT DISTINCT hist_id, cmd, epoch, ppid, pwd, salt, row_hash FROM quiet",
)
def _(spark, sf_dir):
    events, path = _arrivals(spark, sf_dir, 2)
    intake.start_merge(events, path, f"{path}-state", rules=_RULES).awaitTermination()
    return tables.scan_history(spark, path).drop("id", "day")


@_query(
    "m2_stream_merge_ids",
    """SELECT count(*) AS rows, count(*) AS ids, CAST(1 AS BIGINT) AS first_id, count(*) AS last_id
       FROM (SELECT DISTINCT row_hash FROM quiet)""",
)
def _(spark, sf_dir):
    events, path = _arrivals(spark, sf_dir, 2)
    intake.start_merge(events, path, f"{path}-state", rules=_RULES).awaitTermination()
    return tables.scan_history(spark, path).agg(
        F.count("*").alias("rows"),
        F.countDistinct("id").alias("ids"),
        F.min("id").alias("first_id"),
        F.max("id").alias("last_id"),
    )


# The training-data operators and their pipeline are there or not as a whole.
try:
    import corpus_pipeline
    from cmdlog_spark.llm import queries as llm_queries
except ModuleNotFoundError as error:
    if not (error.name or "").startswith(("cmdlog_spark.llm", "corpus_pipeline")):
        raise
else:
    _QUERIES.update(llm_queries.QUERIES)
    _ORACLES.update(llm_queries.ORACLES)
    _QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL is not None:
        _ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL



def entry(spark: SparkSession) -> DataFrame:
    """Most used commands of the last days."""
    return _QUERIES["f3_stats_top"](spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
