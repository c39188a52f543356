"""Temporal URL filter: every capture against the list entries in force when it was fetched.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick

# Days in one bucket of the as-of join: an interval is met by the captures of its buckets only.
BUCKET_DAYS = 32
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case without a closing point; empty if the text has none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1)), r"\.$", "")


def intervals(entries: DataFrame) -> DataFrame:
    """Validity intervals (rule, since, until) from dated entries (rule, action, day).

    A rule holds from a day with ``add`` to the next day with ``remove``, which is not in
    it; until is null while it holds. On one day the removal goes first. Repeated
    additions and removals change nothing; entries with a null in any column are left out.
    """
    rows = pick(entries, rule="string", action="string", day="long").dropna()
    rows = rows.filter(F.col("action").isin("add", "remove")).distinct()
    # On a day with both, the rule is in force at its end, as after an addition alone.
    last = rows.groupBy("rule", "day").agg(F.min("action").alias("action"))
    order = W.partitionBy("rule").orderBy("day")
    before = F.lag("action").over(order)
    changes = last.withColumn("before", before).filter(F.coalesce("before", F.lit("remove")) != F.col("action"))
    until = F.lead("day").over(order)
    named = changes.withColumn("until", until).filter("action = 'add'")
    return named.select("rule", F.col("day").alias("since"), "until")


def depths(rules: DataFrame) -> tuple[int, int]:
    """The greatest numbers of labels of a '.domain' and of steps of a path among the rules."""
    rule = F.col("rule")
    labels = F.when(rule.startswith("."), F.size(F.split(rule, r"\.")) - 1)
    steps = F.when(~rule.startswith("."), F.size(F.split(rule, "/")) - 1)
    row = rules.agg(F.max(labels).alias("labels"), F.max(steps).alias("steps")).first()
    return row.labels or 0, row.steps or 0


def rule_keys(url: Column, most_labels: int, most_steps: int) -> Column:
    """All rules that could name a URL: its host, the domains above it as '.domain', path
    prefixes as 'host/step/step', up to so many labels and steps."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    # The last labels, at every length.
    above = F.transform(
        F.slice(F.sequence(F.lit(1), F.size(labels)), 1, most_labels),
        lambda n: F.concat(F.lit("."), F.array_join(F.slice(labels, -n, n), ".")),
    )
    steps = F.filter(F.split(F.regexp_extract(F.coalesce(url, F.lit("")), PATH, 1), "/"), lambda s: s != "")
    paths = F.transform(
        F.sequence(F.lit(0), F.least(F.size(steps), F.lit(most_steps))),
        lambda n: F.when(n == 0, host).otherwise(F.concat(host, F.lit("/"), F.array_join(F.slice(steps, 1, F.greatest(n, F.lit(1))), "/"))),
    )
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(paths, above))


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """One row per capture: page_id, host, day, blocked, n_rules, rule.

    ``captures`` has page_id, url and day (of the fetch), ``entries`` rule, action and
    day. A rule names a host, a domain with all below it ('.domain') or a path prefix
    ('host/step'). n_rules counts the rules in force on the day, rule is the first of
    them by length (longest), then text. Captures without a host or a day match nothing;
    repeated rows are judged row by row. Empty tables give no rows or no matches.

    The as-of join is an equality of rule and bucket of days. Captures are counted per
    (url host and path steps, day) first, so a hot host is joined once per day and path,
    not once per page.
    """
    rows = pick(captures, page_id="long", url="string", day="long")
    valid = intervals(entries)
    keys = rule_keys(F.col("url"), *depths(valid))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), "day", keys.alias("keys"))
    bucket = F.floor(F.col("day") / BUCKET_DAYS)
    asked = rows.filter(F.col("day").isNotNull()).select("day", F.explode("keys").alias("key"))
    asked = asked.distinct().withColumn("bucket", bucket)

    newest = asked.agg(F.max("day").alias("newest")).first().newest
    # An interval without an end lasts to the newest capture.
    newest = F.lit(newest).cast("long")
    last = F.least(F.coalesce(F.col("until") - 1, newest), newest)
    bounded = valid.withColumn("last", last)
    spread = bounded.filter("last >= since").select(
        "rule", "since", "last",
        F.explode(F.sequence(F.floor(F.col("since") / BUCKET_DAYS), F.floor(F.col("last") / BUCKET_DAYS))).alias("b"),
    )
    hits = asked.join(spread, (F.col("key") == F.col("rule")) & (F.col("bucket") == F.col("b")))
    hits = hits.filter(F.col("day").between(F.col("since"), F.col("last"))).select(
        F.col("rule").alias("h_rule"), F.col("day").alias("h_day")
    )
    return _answer(rows, hits.distinct())


def _answer(rows: DataFrame, hits: DataFrame) -> DataFrame:
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    asked = rows.select("page_id", "host", "day", "row", F.explode_outer("keys").alias("key"))
    joined = asked.join(hits, (F.col("key") == F.col("h_rule")) & (F.col("day") == F.col("h_day")), "left")
    best = F.min(F.when(F.col("h_rule").isNotNull(), F.struct((-F.length("h_rule")).alias("l"), "h_rule")))
    found = joined.groupBy("row", "page_id", "host", "day").agg(
        F.count("h_rule").alias("n_rules"), best.alias("best")
    )
    return found.select(
        "page_id", "host", "day", (F.col("n_rules") > 0).alias("blocked"), "n_rules", F.col("best.h_rule").alias("rule")
    )
