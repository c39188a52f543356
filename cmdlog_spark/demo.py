"""The library's inputs in shape, derived from the driver's tables.

Each view exists once as Spark code and once as SQL for the oracle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cmdlog_spark.schema import HISTORY, TEMPLATE
from cmdlog_spark.sources.tables import fill_template_defaults

# Parameters of the registered queries.
NOW = 1_706_659_200
DAYS = 7
BASE = "git status"
DIRECTORY = "/home/u8/proj_x"
SESSION = (19_723, 8)
QUERY = "kubectl"

COMMAND_SQL = """CASE event_type
    WHEN 'click'    THEN CASE event_id % 4 WHEN 0 THEN 'git status' WHEN 1 THEN 'git push origin main'
                         WHEN 2 THEN 'Git log --oneline' ELSE 'git commit -m "100% done"' END
    WHEN 'view'     THEN CASE event_id % 4 WHEN 0 THEN 'ls' WHEN 1 THEN 'ls -la'
                         WHEN 2 THEN 'cd /tmp' ELSE 'lsof -i' END
    WHEN 'purchase' THEN CASE event_id % 4 WHEN 0 THEN 'docker build .' WHEN 1 THEN 'docker ps'
                         WHEN 2 THEN 'kubectl get pods' ELSE 'npm install' END
    WHEN 'signup'   THEN CASE event_id % 4 WHEN 0 THEN 'cargo build' WHEN 1 THEN 'cargo test'
                         WHEN 2 THEN 'make test' ELSE 'make' END
    ELSE CASE event_id % 4 WHEN 0 THEN 'python3 a_b.py' WHEN 1 THEN 'KUBECTL describe pod'
                         WHEN 2 THEN 'go test ./...' ELSE 'echo done' END END"""

HISTORY_COLUMNS = [
    "event_id + 1 AS id",
    "CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id END AS hist_id",
    f"{COMMAND_SQL} AS cmd",
    "ep AS epoch",
    "user_id AS ppid",
    """'/home/u' || CAST(user_id % 20 AS VARCHAR(8)) ||
       CASE event_id % 3 WHEN 0 THEN '/proj_%' WHEN 1 THEN '/proj_x' ELSE '/proj_x/src' END AS pwd""",
    "CAST(floor(ep / 86400) AS BIGINT) AS salt",
]

HISTORY_SQL = f"""SELECT {", ".join(HISTORY_COLUMNS)}
FROM (SELECT *, CAST(floor(epoch(ts)) AS BIGINT) AS ep FROM events)"""


# Given layouts of the tables used; stating them saves a look into the files.
SCHEMAS = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
    "documents": "doc_id BIGINT, text STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderpriority STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


# Epoch seconds of ``ts`` read as UTC, whatever the session zone.
SECONDS_OF_TS = """CAST(extract(DAY FROM ts - TIMESTAMP_NTZ '1970-01-01') AS BIGINT) * 86400
    + extract(HOUR FROM ts) * 3600 + extract(MINUTE FROM ts) * 60
    + CAST(floor(extract(SECOND FROM ts)) AS BIGINT)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as shell history."""
    events = read_table(spark, sf_dir, "events").withColumn("ep", F.expr(SECONDS_OF_TS))
    return events.selectExpr(*HISTORY_COLUMNS)


_SECONDS = "CAST(1700000000 + conv_id*100 + turn AS VARCHAR(20))"
_TEXT = "replace(text, chr(10), ' ')"
#: The lines of one turn: in bash files a user's text follows its time stamp.
BASH_LINES = (f"CASE WHEN role = 'user' THEN '#' || {_SECONDS} END", _TEXT)
ZSH_LINES = (f"CASE WHEN role = 'user' THEN ': ' || {_SECONDS} || ':0;' || {_TEXT} ELSE {_TEXT} END",)


def lines_sql(parts: tuple[str, ...]) -> str:
    return " UNION ALL ".join(
        f"SELECT conv_id AS file, turn * 2 + {n} AS pos, {part} AS line FROM conversations WHERE {part} IS NOT NULL"
        for n, part in enumerate(parts)
    )


def lines(spark: SparkSession, sf_dir: str, parts: tuple[str, ...]) -> DataFrame:
    """``conversations`` as the lines of one history file per conversation."""
    table = read_table(spark, sf_dir, "conversations")
    each = table.selectExpr("conv_id AS file", "turn", f"posexplode(array({', '.join(parts)})) AS (n, line)")
    return each.where("line IS NOT NULL").selectExpr("file", "turn * 2 + n AS pos", "line")


# Loose cells: ids of every shape in hist_id, and every shape of text in epoch
# for one row in seven; the other integers are sound.
CELL_TEXT = """CASE id % 6 WHEN 0 THEN '  970* 1571608128 ssh x' WHEN 1 THEN CAST(epoch AS VARCHAR(20))
    WHEN 2 THEN '' WHEN 3 THEN 'abc 42' WHEN 4 THEN 'x y 7' ELSE ' 12 ' END"""
CELL_VALUE = """CASE id % 6 WHEN 0 THEN 970 WHEN 1 THEN epoch WHEN 3 THEN 42 WHEN 5 THEN 12
    ELSE NULL END"""


def raw(df: DataFrame, src: str, src_ord: int) -> DataFrame:
    """History rows as cells of a legacy table."""

    def cell(name: str) -> list[Column]:
        text = F.col(name).cast("string")
        kind = F.when(text.isNull(), "null").otherwise("integer")
        return [text.alias(f"{name}_txt"), kind.alias(f"{name}_type")]

    cells = [c for name in ("hist_id", "epoch", "ppid", "salt") for c in cell(name)]
    return df.select(
        F.lit(src).alias("src"), F.lit(src_ord).alias("src_ord"), "id", "cmd", "pwd", *cells
    )


# Ten kinds of templates over the parts, in the order of FIXTURES.
KINDS = 10
TEMPLATE_COMMANDS = [
    "run {name} --size {size}",
    "cp {src} {dst}",
    "tar {1bad}",
    "",
    "ssh {user}@{host}",
    "make -j {jobs}",
    "grep {flags} {host}",
    "echo {größe}",
    "mv {a} {a}.bak",
    "echo {x} {y}",
]
# (name, required, default) of each variable.
TEMPLATE_VARIABLES = [
    [("name", True, None), ("size", True, "10")],
    [("src", True, None)],
    [("1bad", True, None)],
    [],
    [("user", True, None), ("host", True, None)],
    [("jobs", False, "4")],
    [("flags", False, None), ("host", True, None)],
    [("größe", True, "groß")],
    [("a", True, None)],
    [("x", True, None), ("y", True, None)],
]
TEMPLATE_DEFAULTS: list[dict[str, str]] = [
    {}, {}, {}, {}, {"user": "root"}, {}, {}, {}, {}, {"x": "{y}"},
]


def _by_kind(kind: Column, values: list[Column], dtype) -> Column:
    result = F.lit(None).cast(dtype)
    for i, value in enumerate(values):
        result = F.when(kind == i, value.cast(dtype)).otherwise(result)
    return result


def templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as a template catalog."""
    kind = F.pmod(F.col("p_partkey"), F.lit(KINDS))

    def variable(name, required, default):
        return F.struct(
            F.lit(name).alias("name"),
            F.lit(None).cast("string").alias("description"),
            F.lit(required).alias("required"),
            F.lit(default).cast("string").alias("default"),
        )

    types = {f.name: f.dataType for f in TEMPLATE}
    variables = [F.array(*[variable(*v) for v in vs]) for vs in TEMPLATE_VARIABLES]
    defaults = [
        F.create_map(*[F.lit(x) for kv in d.items() for x in kv]) for d in TEMPLATE_DEFAULTS
    ]
    catalog = read_table(spark, sf_dir, "part").select(
        F.concat(F.lit("t"), F.col("p_partkey").cast("string")).alias("id"),
        F.when(F.col("p_size") == 1, "").otherwise(F.col("p_name")).alias("name"),
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).alias("description"),
        _by_kind(kind, [F.lit(c) for c in TEMPLATE_COMMANDS], "string").alias("command"),
        F.col("p_type").alias("category"),
        _by_kind(kind, variables, types["variables"]).alias("variables"),
        _by_kind(kind, defaults, types["defaults"]).alias("defaults"),
    )
    return fill_template_defaults(catalog)


# The assignments of a request, one list entry each, from an order. A later
# value of a name counts, and one in three requests has a malformed entry.
ASSIGNMENTS = [
    "'name=n' || CAST(o_orderkey AS VARCHAR(20))",
    """CASE WHEN o_orderkey % 3 = 0 THEN 'host'
        ELSE 'host=h' || CAST(o_custkey AS VARCHAR(20)) || '=x' END""",
    "CASE WHEN o_orderkey % 2 = 0 THEN 'a=old' ELSE 'b=unused' END",
    "'src=s'",
    "'y=' || o_orderstatus",
    "'y=' || o_orderpriority",
]


def assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as the arguments of template calls."""
    table = read_table(spark, sf_dir, "orders")
    return table.selectExpr(
        "o_orderkey AS req_id",
        "'t' || CAST(o_custkey AS VARCHAR(20)) AS template_id",
        f"posexplode(array({', '.join(ASSIGNMENTS)})) AS (pos, assignment)",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as template calls with their arguments."""
    table = read_table(spark, sf_dir, "orders")
    return table.selectExpr(
        "o_orderkey AS req_id",
        "'t' || CAST(o_custkey AS VARCHAR(20)) AS template_id",
        f"array({', '.join(ASSIGNMENTS)}) AS assignments",
    )


def write_legacy_dump(df: DataFrame, folder: str) -> str:
    """History rows as a dump of a legacy table; its folder."""
    df.select(*HISTORY.names).write.option("ignoreNullFields", "false").json(folder)
    return folder
