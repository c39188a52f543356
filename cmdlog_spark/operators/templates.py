"""Command templates as a table: check, list and render in bulk."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlog_spark.functions.spread import spread

EMPTY_MAP = "map<string,string>"
# A placeholder, and the form of a variable name.
PLACEHOLDER = r"\{([^}]+)\}"
VARIABLE_NAME = r"^\p{IsAlphabetic}[\p{IsAlphabetic}\p{N}_]*$"
#: First opening brace with a closing one after it.
LEFT_OVER = r"^[^{]*\{([^}]*)\}"
#: Text and a placeholder without braces inside behind it, or the rest of a command.
PARTS = r"(?s)(.*?)(?:\{([^{}]+)\}|\z)"


def placeholders(command: Column) -> Column:
    """Distinct names in braces, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(command, F.lit(PLACEHOLDER), F.lit(1)))


def _names(variables: Column) -> Column:
    return F.transform(variables, lambda v: v["name"])


def template_problems() -> Column:
    """What is wrong with a template, as an array of (problem, subject)."""

    def whole(condition: Column, problem: str) -> Column:
        row = F.struct(F.lit(problem).alias("problem"), F.lit("").alias("subject"))
        return F.when(condition, F.array(row))

    def each(names: Column, problem: str) -> Column:
        return F.transform(
            names,
            lambda n: F.struct(F.lit(problem).alias("problem"), n.alias("subject")),
        )

    names = _names(F.col("variables"))
    nothing = F.array().cast("array<struct<problem:string,subject:string>>")
    found = [
        whole(F.col("id") == "", "empty id"),
        whole(F.col("name") == "", "empty name"),
        whole(F.col("command") == "", "empty command"),
        each(F.filter(names, lambda n: ~n.rlike(VARIABLE_NAME)), "bad variable name"),
        each(F.array_except(placeholders(F.col("command")), names), "undeclared variable"),
    ]
    return F.concat(*[F.coalesce(f, nothing) for f in found])


def validate_templates(catalog: DataFrame) -> DataFrame:
    """One row per problem: the template, what is wrong and with what."""
    return catalog.select(F.col("id").alias("template_id"), F.inline(template_problems()))


def list_templates(catalog: DataFrame) -> DataFrame:
    """The templates that have no problem."""
    return catalog.where(F.size(template_problems()) == 0).select(
        "id",
        "name",
        F.coalesce("description", F.lit("No description")).alias("description"),
        "category",
        F.size("variables").cast("bigint").alias("variables"),
    )


def parse_assignments(assignments: DataFrame) -> DataFrame:
    """Split ``assignment`` at its first equals sign; ``ok`` is false without one."""
    at = F.instr("assignment", "=")
    return assignments.withColumns(
        {
            "key": F.when(at > 0, F.substr("assignment", F.lit(1), at - 1)),
            "value": F.when(at > 0, F.substr("assignment", at + 1)),
            "ok": at > 0,
        }
    )


def _last_values(entries: str) -> Column:
    """Map of the last value of each key from a column of (key, pos, value) in order.

    The column must be written, aggregated or used twice in the select: Spark then works
    it out once, and a value is compared with the next one only.
    """
    following = lambda i: F.get(F.col(entries), i + 1)["key"]
    last = F.filter(entries, lambda e, i: ~F.coalesce(following(i) == e["key"], F.lit(False)))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def request_maps(requests: DataFrame) -> DataFrame:
    """``vars`` and ``bad`` for requests with an array of ``assignments``; the last value wins.

    The arguments of a request stay in their row: nothing is exploded or gathered.
    """

    def entry(text: Column, pos: Column) -> Column:
        at = F.instr(text, "=")
        key, value = F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1)
        return F.struct(key.alias("key"), pos.alias("pos"), value.alias("value"))

    has_sign = lambda a: F.instr(a, "=") > 0
    signed = F.transform(F.filter("assignments", has_sign), entry)
    bad = F.array_min(F.filter("assignments", lambda a: ~has_sign(a)))
    kept = [c for c in requests.columns if c != "assignments"]
    dealt = spread(requests)
    sorted_ = dealt.select(*kept, F.sort_array(signed).alias("entries"), bad.alias("bad"))
    return sorted_.select(*kept, _last_values("entries").alias("vars"), "bad")


def assignment_maps(assignments: DataFrame) -> DataFrame:
    """One map per request from ``req_id, pos, assignment``; the last value wins.

    A request gathers the arguments of one command line, whose length the
    system limits. A malformed assignment of a request is kept in ``bad``.
    """
    found = F.when(F.col("ok"), F.struct("key", "pos", "value"))
    return (
        parse_assignments(assignments)
        .groupBy("req_id")
        .agg(
            F.sort_array(F.collect_list(found)).alias("entries"),
            F.min(F.when(~F.col("ok"), F.col("assignment"))).alias("bad"),
        )
        .select("req_id", _last_values("entries").alias("vars"), "bad")
    )


def _own_defaults(variables: Column, strict: bool) -> Column:
    """Defaults given with the variables; the first of a repeated name counts."""

    def usable(v):
        has = v["default"].isNotNull()
        return has & v["required"] if strict else has

    chosen = F.filter(variables, usable)
    names = _names(chosen)
    first = F.filter(chosen, lambda v, i: F.array_position(names, v["name"]) == i + 1)
    return F.map_from_entries(F.transform(first, lambda v: F.struct(v["name"], v["default"])))


def _over(low: Column, high: Column) -> Column:
    """Union of two maps in which ``high`` wins."""
    return F.map_zip_with(low, high, lambda _, a, b: F.coalesce(b, a))


def substitute(command: Column, values: Column) -> Column:
    """Replace ``{key}`` by its value, key by key in order of the keys.

    A value that brings in a placeholder of a later key is expanded again.
    """
    return F.aggregate(
        F.array_sort(F.map_entries(values)),
        command,
        lambda text, e: F.replace(
            text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]
        ),
    )


def compiled(command: Column) -> Column:
    """A command as an array of (literal, name): text, and the placeholder behind it."""
    literals = F.regexp_extract_all(command, F.lit(PARTS), F.lit(1))
    names = F.regexp_extract_all(command, F.lit(PARTS), F.lit(2))
    pairs = F.arrays_zip(literals.alias("literal"), names.alias("name"))
    return F.transform(pairs, lambda p: F.struct(p["literal"].alias("literal"), F.nullif(p["name"], F.lit("")).alias("name")))


def _joined(parts: Column, values: Column) -> Column:
    """The parts with the values in their places; a name without a value stays in braces."""

    def shown(part: Column) -> Column:
        name = part["name"]
        kept = F.concat(F.lit("{"), name, F.lit("}"))
        value = F.coalesce(F.try_element_at(values, name), kept)
        return F.when(name.isNull(), part["literal"]).otherwise(F.concat(part["literal"], value))

    return F.array_join(F.transform(parts, shown), "")


def _is_plain(values: Column) -> Column:
    """No value can bring in a placeholder, and no key is more than a name."""
    entries = F.map_entries(values)
    odd = lambda e: e["value"].contains("{") | e["key"].contains("{") | e["key"].contains("}")
    return ~F.exists(entries, odd)


def render_templates(
    catalog: DataFrame, requests: DataFrame, mode: str = "lenient", check: bool = True
) -> DataFrame:
    """Render ``requests(req_id, template_id, vars, bad)`` against the catalog.

    A value comes from the request, else the template's ``defaults``, else the
    variable's own default; in ``strict`` mode the last holds for required
    variables only. ``status`` is ok; unknown for a template that is not there;
    invalid for one that fails validation, unless ``check`` is off; malformed
    for a bad assignment; missing (``detail`` lists the names); or unresolved
    (``detail`` is the placeholder left). Only ok rows have text.

    Templates are validated and cut into literals and placeholders once each. A request
    joins the parts with its values; only where a value or a literal holds a brace, so
    that replacing can make a new placeholder, keys are replaced one after the other.
    """
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode}")
    empty = F.create_map().cast(EMPTY_MAP)
    own = _own_defaults(F.col("variables"), strict=mode == "strict")
    required = F.transform(F.filter("variables", lambda v: v["required"]), lambda v: v["name"])
    judged = catalog.select(
        F.col("id").alias("template_id"),
        "command",
        required.alias("required"),
        _over(own, F.coalesce("defaults", empty)).alias("base"),
        template_problems().alias("problems"),
        compiled(F.col("command")).alias("parts"),
    )
    fault = F.get("problems", F.lit(0))
    known = judged.select(
        "template_id",
        "command",
        "required",
        "base",
        "parts",
        F.exists("parts", lambda p: p["literal"].contains("{")).alias("braces"),
        F.concat_ws(" ", fault["problem"], F.nullif(fault["subject"], F.lit(""))).alias("fault"),
        (F.size("problems") > 0).alias("invalid"),
    )
    joined = requests.join(known, "template_id", "left")
    failed = [
        (F.col("command").isNull(), "unknown", F.col("template_id")),
        (F.col("bad").isNotNull(), "malformed", F.col("bad")),
    ]
    if check:
        failed.insert(1, (F.col("invalid"), "invalid", F.col("fault")))
    early = F.lit(None).cast("string")
    for condition, name, _ in reversed(failed):
        early = F.when(condition, name).otherwise(early)
    # What is known to fail is not rendered.
    resolved = joined.withColumn("early", early).withColumn(
        "values", F.when(F.col("early").isNull(), _over(F.col("base"), F.coalesce("vars", empty)))
    )
    missing = F.filter("required", lambda n: ~F.map_contains_key(F.col("values"), n))
    plain = ~F.col("braces") & _is_plain(F.col("values"))
    text = F.when(plain, _joined(F.col("parts"), F.col("values"))).otherwise(
        substitute(F.col("command"), F.col("values"))
    )
    filled = resolved.withColumn("missing", missing)
    rendered = filled.withColumn("text", F.when(F.size("missing") == 0, text))
    late = [
        (F.size("missing") > 0, "missing", F.array_join("missing", ", ")),
        (F.col("text").rlike(LEFT_OVER), "unresolved", F.regexp_extract("text", LEFT_OVER, 1)),
    ]
    status, detail = F.lit("ok"), F.lit(None).cast("string")
    for condition, name, told in reversed([*failed, *late]):
        status = F.when(condition, name).otherwise(status)
        detail = F.when(condition, told).otherwise(detail)
    outcome = rendered.withColumns({"status": status, "detail": detail})
    is_ok = F.col("status") == "ok"
    return outcome.select(
        "req_id",
        "template_id",
        "status",
        "detail",
        F.when(is_ok, F.col("text")).alias("command"),
        F.when(is_ok, F.col("values")).alias("variables_used"),
    )
