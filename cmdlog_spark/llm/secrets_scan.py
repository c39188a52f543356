"""Secret scan: known forms, and strings too random for text.

DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cmdlog_spark.llm.common import pick, stage, text_or_empty

ASSIGN = (
    r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]"
    r"|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
# Runs end where no further character fits, so a least length may be part of the pattern.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
BASE_KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX}
LEAST = 20
RANDOM = f"[A-Za-z0-9+/_=-]{{{LEAST},}}"
# Lengths in one family of tests: a false-discovery rate holds within each.
BANDS = (20, 24, 32, 48, 64, 128)
# Steps of -log10 p in which p values are counted, and the greatest of them.
STEPS, MOST = 256, 60


@dataclass(frozen=True)
class Settings:
    """rate: false discoveries at most, in share; text_coincidence and text_changes describe
    text (two letters equal; a letter of another class than the one before)."""

    rate: float = 0.001
    text_coincidence: float = 0.065
    text_changes: float = 0.08
    text_correlation: float = 0.25


def spans_of(text: Column, pattern: str) -> Column:
    """Leftmost matches that do not overlap: structs start, end (code points) and value."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.zip_with(
        F.slice(gaps, 1, F.size(values)),
        values,
        lambda gap, value: F.struct(gap.alias("gap"), value.alias("value")),
    )
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def add(done: Column, pair: Column) -> Column:
        start = done["at"] + F.length(pair["gap"])
        end = start + F.length(pair["value"])
        found = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        return F.struct(end.alias("at"), F.array_append(done["all"], found).alias("all"))

    return F.aggregate(
        pairs, F.struct(F.lit(0).alias("at"), empty.alias("all")), add, lambda done: done["all"]
    )


def _tail(z: Column) -> Column:
    """P(normal > z), by a rational approximation of the error function (error below 2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    powers = (
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    )
    poly = F.lit(powers[-1])
    for c in reversed(powers[:-1]):
        poly = poly * t + c
    upper = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, upper).otherwise(1 - upper)


def battery(rows: DataFrame, settings: Settings) -> DataFrame:
    """Tests of the strings ``value``: encoding, alphabet, three statistics and p.

    The null is text in the encoding: letters as uneven as in words, long stretches of
    one class, neighbours alike. p is the chance that text looks as random as the
    string, from the sum of three normal scores:

    - chi-squared against a uniform alphabet, through the coincidences it is made of;
    - runs of letters of one class (lower, upper, digit, other);
    - serial correlation of neighbouring characters.

    ``uniform`` is the score of chi-squared under true randomness: a string that is too
    uneven for its alphabet is no random one, however it scores against text.
    """
    value = F.col("value")
    encoding = (
        F.when(value.rlike("^[0-9]+$"), "digits")
        .when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex")
        .when(value.rlike("^[A-Z2-7]+=*$"), "base32")
        .when(value.rlike("^([a-z0-9]+|[A-Z0-9]+)$"), "base36")
        .when(value.rlike("^[A-Za-z0-9]+$"), "base62")
        .otherwise("base64")
    )
    letters = F.lit(64.0)
    for name, size in (("base62", 62.0), ("base36", 36.0), ("base32", 32.0), ("hex", 16.0), ("digits", 10.0)):
        letters = F.when(F.col("encoding") == name, size).otherwise(letters)
    body = F.regexp_replace(value, "=+$", "")
    codes = F.transform(F.split(body, ""), F.ascii)
    rows = rows.withColumns({"encoding": encoding, "codes": F.filter(codes, lambda c: c > 0)})
    rows = rows.withColumn("len", F.size("codes").cast("double"))
    n = F.col("len")
    counts = F.transform(
        F.array_distinct("codes"),
        lambda c: F.size(F.filter(F.col("codes"), lambda d: d == c)).cast("double"),
    )
    squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)

    def kind(c: Column) -> Column:
        return (
            F.when(c.between(97, 122), 0).when(c.between(65, 90), 1).when(c.between(48, 57), 2).otherwise(3)
        )

    pairs = F.zip_with(
        F.slice("codes", 1, F.size("codes") - 1),
        F.slice("codes", 2, F.size("codes")),
        lambda x, y: F.struct(x.alias("x"), y.alias("y")),
    )
    changes = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + (kind(p["x"]) != kind(p["y"])).cast("double"))
    total = F.aggregate("codes", F.lit(0.0), lambda a, c: a + c)
    power = F.aggregate("codes", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    products = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"].cast("double") * p["y"])
    rows = rows.withColumns(
        {"squares": squares, "changes": changes, "total": total, "power": power, "products": products}
    ).drop("codes")

    k = letters
    chi2 = k / n * F.col("squares") - n
    # Under randomness chi-squared has mean k - 1 and variance near 2 (k - 1).
    uniform = (chi2 - (k - 1)) / F.sqrt(2 * (k - 1))
    # Hexadecimal and digits have no uneven text to differ from: their text is words in letters.
    uneven = F.greatest(F.lit(settings.text_coincidence), 1.6 / k)
    coincidence = (F.col("squares") - n) / (n * (n - 1))
    spread = F.sqrt(2 * uneven * (1 - uneven) / (n * (n - 1)) + 4 * (uneven * uneven * 0.25) / n)
    z1 = (uneven - coincidence) / spread
    rate = settings.text_changes
    z2 = (F.col("changes") - rate * (n - 1)) / F.sqrt(rate * (1 - rate) * (n - 1))
    mean = F.col("total") / n
    variance = F.greatest(F.col("power") / n - mean * mean, F.lit(1e-9))
    correlation = (F.col("products") / (n - 1) - mean * mean) / variance
    z3 = (F.lit(settings.text_correlation) - correlation) * F.sqrt(n)
    z = (z1 + F.least(z2, F.lit(30.0)) + z3) / math.sqrt(3.0)
    return rows.withColumns({"uniform": uniform, "p": _tail(z)}).drop(
        "squares", "changes", "total", "power", "products"
    )


def _band(length: Column) -> Column:
    band = F.lit(BANDS[0])
    for low in BANDS[1:]:
        band = F.when(length >= low, low).otherwise(band)
    return band


def random_strings(rows: DataFrame, settings: Settings) -> DataFrame:
    """The strings that are random: Benjamini-Hochberg on p among those of like length.

    p values are rounded up to steps, so that a table of bands and steps holds all that
    the procedure needs: the largest step whose p is at most rate * rank / number.
    """
    tested = battery(rows, settings)
    step = F.least(F.floor(-F.log10(F.greatest(F.col("p"), F.lit(10.0**-MOST))) * STEPS), F.lit(MOST * STEPS))
    tested = tested.withColumns({"step": step.cast("int"), "band": _band(F.col("len"))})
    tested = stage(tested, "strings")
    counted = tested.groupBy("band", "step").agg(F.count("*").alias("n"))
    # A few thousand rows: bands times steps.
    best_first = W.partitionBy("band").orderBy(F.col("step").desc())
    rank = F.sum("n").over(best_first.rowsBetween(W.unboundedPreceding, W.currentRow))
    number = F.sum("n").over(W.partitionBy("band"))
    p = F.pow(F.lit(10.0), -F.col("step") / STEPS)
    passing = counted.select("band", "step", rank.alias("rank"), number.alias("number"))
    passing = passing.filter(p <= settings.rate * F.col("rank") / F.col("number"))
    least = passing.groupBy("band").agg(F.min("step").alias("least"))
    named = least.select(F.col("band").alias("l_band"), "least")
    found = tested.join(named, (F.col("band") == F.col("l_band")) & (F.col("step") >= F.col("least")))
    return found.filter(F.col("uniform") < 4)


def scan(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random.

    Assignments, access keys and hexadecimal runs are the matches of their patterns that
    are long enough; ``random`` spans are other strings of 20 characters or more that
    pass ``random_strings``; equal signs at their end do not count. Spans are kind:start:end by start, then kind, in code points.
    Null texts count as empty: no spans. Repeated rows are scanned row by row, also those
    with one id. Strings of any length are tested whole. An empty table gives no rows.
    """
    settings = settings or Settings()
    rows = pick(docs, doc_id="long", text="string").withColumn("text", text_or_empty())
    matched = {}
    for kind, pattern in BASE_KINDS.items():
        hit = F.col("text").rlike(pattern)
        matched[kind] = F.when(hit, spans_of(F.col("text"), pattern))
    matched["random"] = F.when(F.col("text").rlike(RANDOM), spans_of(F.col("text"), RANDOM))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")
    rows = rows.select("doc_id", *(F.coalesce(c, empty).alias(k) for k, c in matched.items()))
    long_enough = F.filter("assign", lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 8)
    rows = rows.withColumn("assign", long_enough).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows, "spans")

    strings = rows.filter(F.size("random") > 0).select("row", F.explode("random").alias("s"))
    # Each distinct string is tested once, with its copies counted once: copies are not news.
    values = strings.select(F.col("s.value").alias("value")).distinct()
    # Signs at the end only fill up: headings underlined with them are no strings.
    values = values.filter(F.length(F.regexp_replace("value", "=+$", "")) >= LEAST)
    random = random_strings(values, settings).select(F.col("value").alias("r_value"))
    hits = strings.join(random, F.col("s.value") == F.col("r_value"))
    hits = hits.groupBy("row").agg(F.collect_list(F.struct("s.start", "s.end")).alias("more"))
    joined = rows.drop("random").join(hits, "row", "left")

    places = {"assign": 0, "access": 1, "hex": 2, "random": 3}
    span = "struct<start:int,place:int,end:int,kind:string>"

    def named(column: str, kind: str) -> Column:
        return F.transform(
            F.col(column),
            lambda s: F.struct(
                s["start"].alias("start"), F.lit(places[kind]).alias("place"), s["end"].alias("end"), F.lit(kind).alias("kind")
            ),
        ).cast(f"array<{span}>")

    base = F.array_sort(F.concat(*(named(k, k) for k in BASE_KINDS)))
    more = F.coalesce(named("more", "random"), F.array().cast(f"array<{span}>"))

    def text_of(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    return joined.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in BASE_KINDS),
        F.sha2(text_of(base).cast("binary"), 256).alias("base_sha256"),
        text_of(F.array_sort(F.concat(base, more))).alias("spans"),
        F.when(F.col("more").isNull(), 0).otherwise(F.size("more")).cast("long").alias("n_random"),
    )
