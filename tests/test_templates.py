import random

import pytest
from pyspark.sql import functions as F

from cmdlog_spark.operators import templates
from cmdlog_spark.schema import TEMPLATE


def variable(name, required=True, default=None):
    return (name, None, required, default)


def catalog(spark, *rows):
    """Templates from (id, command, variables, defaults)."""
    filled = [(i, i.upper(), None, c, None, v, d) for i, c, v, d in rows]
    return spark.createDataFrame(filled, TEMPLATE)


TEMPLATES = [
    ("ssh", "ssh {user}@{host} -p {port}", [variable("user"), variable("host"), variable("port", True, "22")], {"user": "root"}),
    ("opt", "ls {flags} {dir}", [variable("flags", False), variable("dir", False, ".")], {}),
    ("twice", "mv {a} {a}.bak", [variable("a")], {}),
    ("nested", "echo {x} {y}", [variable("x"), variable("y")], {"x": "{y}"}),
    ("back", "echo {x} {y}", [variable("x"), variable("y")], {"y": "{x}"}),
    ("same", "{v}", [variable("v", True, "one"), variable("v", True, "two")], {}),
    ("größe", "echo {größe}", [variable("größe", True, "groß")], {}),
    ("plain", "echo }{", [], {}),
    ("empty", "echo {}", [], {}),
]


def rendered(spark, requests, **options):
    frame = spark.createDataFrame(
        [(i, t, v, None) for i, (t, v) in enumerate(requests)],
        "req_id int, template_id string, vars map<string,string>, bad string",
    )
    found = templates.render_templates(catalog(spark, *TEMPLATES), frame, **options)
    return [(r.status, r.command or r.detail) for r in found.orderBy("req_id").collect()]


def test_precedence_and_outcomes(spark):
    requests = [
        ("ssh", {"host": "h"}),
        ("ssh", {"host": "h", "user": "me", "port": "1"}),
        ("ssh", {}),
        ("opt", {"flags": "-l"}),
        ("opt", {}),
        ("twice", {"a": "f"}),
        ("nested", {"y": "1"}),
        ("back", {"x": "1"}),
        ("same", None),
        ("größe", {}),
        ("plain", {}),
        ("empty", {}),
        ("nowhere", {}),
        ("twice", {"a": "$1 \\ ${b"}),
    ]
    assert rendered(spark, requests) == [
        ("ok", "ssh root@h -p 22"),
        ("ok", "ssh me@h -p 1"),
        ("missing", "host"),
        ("ok", "ls -l ."),
        ("unresolved", "flags"),
        ("ok", "mv f f.bak"),
        ("ok", "echo 1 1"),
        # Keys go in order: x is done when y brings in another one.
        ("unresolved", "x"),
        ("ok", "one"),
        ("ok", "echo groß"),
        ("ok", "echo }{"),
        ("unresolved", ""),
        ("unknown", "nowhere"),
        ("ok", "mv $1 \\ ${b $1 \\ ${b.bak"),
    ]


def test_strict_mode_ignores_defaults_of_optional_variables(spark):
    requests = [("opt", {"flags": "-l"}), ("ssh", {"host": "h"})]
    assert rendered(spark, requests, mode="strict") == [
        ("unresolved", "dir"), ("ok", "ssh root@h -p 22"),
    ]
    with pytest.raises(ValueError):
        rendered(spark, requests, mode="other")


def test_all_missing_names_are_listed(spark):
    assert rendered(spark, [("nested", {"x": "1"}), ("back", {})])[0] == ("missing", "y")
    frame = [("two", "{a}{b}", [variable("a"), variable("b")], {})]
    request = spark.createDataFrame(
        [(1, "two", {}, None)], "req_id int, template_id string, vars map<string,string>, bad string"
    )
    found = templates.render_templates(catalog(spark, *frame), request).first()
    assert (found.status, found.detail, found.variables_used) == ("missing", "a, b", None)


def test_placeholders(spark):
    df = spark.createDataFrame([("{b} {a} {b} {} {{c} x}",)], "command string")
    assert df.select(templates.placeholders(F.col("command"))).first()[0] == ["b", "a", "{c"]


def test_validation_lists_every_problem(spark):
    bad = [
        ("", "run", [], {}),
        ("cmd", "", [], {}),
        ("names", "x", [variable(n) for n in ("ok_1", "1a", "a-b", "", "_x", "größe", "a b")], {}),
        ("open", "{a} {b} {c}", [variable("b")], {}),
        ("fine", "{a}", [variable("a")], {}),
    ]
    found = templates.validate_templates(catalog(spark, *bad))
    assert {(r.template_id, r.problem, r.subject) for r in found.collect()} == {
        ("", "empty id", ""),
        ("", "empty name", ""),
        ("cmd", "empty command", ""),
        *[("names", "bad variable name", n) for n in ("1a", "a-b", "", "_x", "a b")],
        ("open", "undeclared variable", "a"),
        ("open", "undeclared variable", "c"),
    }


def test_invalid_templates_do_not_render(spark):
    bad = catalog(spark, ("open", "{a} {b}", [variable("a")], {}))
    request = spark.createDataFrame(
        [(1, "open", {"a": "1", "b": "2"}, None)],
        "req_id int, template_id string, vars map<string,string>, bad string",
    )
    first = templates.render_templates(bad, request).first()
    assert (first.status, first.detail) == ("invalid", "undeclared variable b")
    assert templates.render_templates(bad, request, check=False).first().command == "1 2"


def test_assignments_split_at_the_first_sign_and_the_last_counts(spark):
    rows = [(1, 0, "a=b=c"), (1, 1, "k="), (1, 2, "=v"), (2, 0, "x=1"), (2, 1, "x=2"), (3, 0, "bare")]
    df = spark.createDataFrame(rows, "req_id int, pos int, assignment string")
    parsed = templates.parse_assignments(df).orderBy("req_id", "pos").collect()
    assert [(r.key, r.value, r.ok) for r in parsed] == [
        ("a", "b=c", True), ("k", "", True), ("", "v", True), ("x", "1", True), ("x", "2", True),
        (None, None, False),
    ]
    maps = {r.req_id: (r.vars, r.bad) for r in templates.assignment_maps(df).collect()}
    assert maps == {
        1: ({"a": "b=c", "k": "", "": "v"}, None), 2: ({"x": "2"}, None), 3: ({}, "bare"),
    }


def test_listing(spark):
    row = templates.list_templates(catalog(spark, *TEMPLATES[:1])).first()
    assert (row.name, row.description, row.variables) == ("SSH", "No description", 3)


def test_compiled_parts_equal_replacing_key_by_key(spark):
    """Random commands and values, braces in odd places too."""
    rng = random.Random(4)
    bits = ["{a}", "{b}", "{a b}", "{", "}", "x", "$1", "\\", "{{a}}", "{a}{b}", "", "\n", "é"]
    rows = [
        ("".join(rng.choices(bits, k=rng.randrange(6))), {k: rng.choice(["1", "", "{b}", "}", "z{", "$0"]) for k in rng.sample(["a", "b", "a b", "c"], 3)})
        for _ in range(300)
    ]
    df = spark.createDataFrame(rows, "command string, vars map<string,string>")
    parts = df.withColumns({"parts": templates.compiled(F.col("command")), "plain": templates._is_plain(F.col("vars"))})
    joined = templates._joined(F.col("parts"), F.col("vars"))
    braces = F.exists("parts", lambda p: p["literal"].contains("{"))
    found = parts.where(F.col("plain") & ~braces).select(
        "command", joined.alias("one"), templates.substitute(F.col("command"), F.col("vars")).alias("two")
    ).collect()
    assert len(found) > 40 and all(r.one == r.two for r in found)


def test_assignments_stay_in_their_row(spark):
    rows = [(1, ["a=1", "b=2", "a=3", "=x"]), (2, ["no sign", "a==", "also none"]), (3, []), (4, None)]
    df = spark.createDataFrame(rows, "req_id int, assignments array<string>")
    found = templates.request_maps(df)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.req_id: (r.vars, r.bad) for r in found.collect()}
    assert got == {1: ({"a": "3", "b": "2", "": "x"}, None), 2: ({"a": "="}, "also none"), 3: ({}, None), 4: (None, None)}
