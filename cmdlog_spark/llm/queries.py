"""The registered queries of this package, each over its whole table, with oracles where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlog_spark.llm import (
    cross_tokens,
    exact_dedup,
    mixing,
    ngram_join,
    packing,
    paragraph_dedup,
    quality,
    secrets_scan,
    simhash,
    spelling,
    toxicity,
    url_filter,
    vector_graph,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def vocabularies() -> cross_tokens.Vocabularies:
    import public_tokenizers

    return cross_tokens.Vocabularies(
        str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model"))
    )


@_query("op1_pack")
def _(spark, sf_dir):
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)
    return pieces.drop("ids")


def captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a day of their fetch, from 0 to 364."""
    return table(spark, sf_dir, "pages").select("page_id", "url", (F.col("page_id") * 37 % 365).alias("day"))


def list_entries(pages: DataFrame) -> DataFrame:
    """A dated list about the hosts of pages: some added, removed and added again, some
    domains, some path prefixes. What a host gets depends on its hash."""
    hosts = pages.select(url_filter.host_of(F.col("url")).alias("host")).filter("host <> ''").distinct()
    number = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 4), 16, 10).cast("long")
    hosts = hosts.withColumn("h", number)

    def entry(rule, action: str, day):
        return F.struct(rule.alias("rule"), F.lit(action).alias("action"), day.cast("long").alias("day"))

    host, h = F.col("host"), F.col("h")
    domain = F.concat(F.lit("."), F.substring_index(host, ".", -2))
    path = F.concat(host, F.lit("/en"))
    entries = (
        F.when(h % 5 == 0, F.array(entry(host, "add", h % 200), entry(host, "remove", h % 200 + 60), entry(host, "add", h % 200 + 120)))
        .when(h % 97 == 1, F.array(entry(domain, "add", h % 300), entry(domain, "remove", h % 300 + 20)))
        .when(h % 5 == 2, F.array(entry(path, "add", h % 250), entry(path, "remove", h % 250 + 90)))
    )
    return hosts.select(F.explode(entries).alias("e")).select("e.*")


@_query(
    "op2_url_filter",
    r"""WITH captures AS (
      SELECT page_id, (page_id * 37) % 365 AS day,
        regexp_replace(lower(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', '') AS host,
        trim(regexp_replace(regexp_extract(coalesce(url, ''), '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') AS path
      FROM pages
    ), hosts AS (
      SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 4) AS BIGINT) AS h FROM captures WHERE host <> ''
    ), entries AS (
      SELECT host AS rule, 'add' AS action, h % 200 AS day FROM hosts WHERE h % 5 = 0
      UNION SELECT host, 'remove', h % 200 + 60 FROM hosts WHERE h % 5 = 0
      UNION SELECT host, 'add', h % 200 + 120 FROM hosts WHERE h % 5 = 0
      UNION SELECT '.' || array_to_string(string_split(host, '.')[-2:], '.'), 'add', h % 300 FROM hosts WHERE h % 97 = 1 AND h % 5 <> 0
      UNION SELECT '.' || array_to_string(string_split(host, '.')[-2:], '.'), 'remove', h % 300 + 20 FROM hosts WHERE h % 97 = 1 AND h % 5 <> 0
      UNION SELECT host || '/en', 'add', h % 250 FROM hosts WHERE h % 5 = 2 AND h % 97 <> 1
      UNION SELECT host || '/en', 'remove', h % 250 + 90 FROM hosts WHERE h % 5 = 2 AND h % 97 <> 1
    ), daily AS (
      SELECT rule, day, min(action) AS action FROM entries GROUP BY rule, day
    ), hits AS (
      SELECT c.page_id, c.host, c.day, d.rule FROM captures c JOIN daily d ON d.day <= c.day AND c.host <> '' AND (
        d.rule = c.host OR (starts_with(d.rule, '.') AND ends_with('.' || c.host, d.rule))
        OR (contains(d.rule, '/') AND starts_with(c.host || '/' || c.path || '/', d.rule || '/')))
      GROUP BY c.page_id, c.host, c.day, d.rule HAVING max_by(d.action, d.day) = 'add'
    ), ranked AS (
      SELECT page_id, count(*) AS n_rules, first(rule ORDER BY length(rule) DESC, rule) AS rule FROM hits GROUP BY page_id
    )
    SELECT c.page_id, c.host, c.day, n_rules IS NOT NULL AS blocked, coalesce(n_rules, 0) AS n_rules, rule
    FROM captures c LEFT JOIN ranked USING (page_id)""",
)
def _(spark, sf_dir):
    pages = captures(spark, sf_dir)
    return url_filter.filter_urls(pages, list_entries(pages))


@_query("op3_toxicity")
def _(spark, sf_dir):
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query(
    "op5_exact_dedup",
    r"""WITH hashed AS (
      SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
      FROM documents
    ), grouped AS (
      SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM hashed GROUP BY 1
    )
    SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
    FROM hashed JOIN grouped USING (text_sha256)""",
)
def _(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


@_query("op6_jaccard_join")
def _(spark, sf_dir):
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


@_query("op7_secret_scan")
def _(spark, sf_dir):
    return secrets_scan.scan(table(spark, sf_dir, "documents"))


@_query("op9_mix")
def _(spark, sf_dir):
    mixed = mixing.mix(table(spark, sf_dir, "documents"), doc_weight=mixing.length_band)
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@_query("op10_quality")
def _(spark, sf_dir):
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query("op8_paragraph_dedup")
def _(spark, sf_dir):
    return paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))


@_query("op4_graph_search")
def _(spark, sf_dir):
    return vector_graph.nearest_neighbours(table(spark, sf_dir, "embeddings"))


@_query("op11_cross_tokens")
def _(spark, sf_dir):
    return cross_tokens.align(table(spark, sf_dir, "documents"), vocabularies())


@_query("op12_spelling")
def _(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"), spelling.Settings(typos=199))


@_query("op13_simhash")
def _(spark, sf_dir):
    return simhash.simhash_components(table(spark, sf_dir, "documents"))
