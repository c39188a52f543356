"""Compare every registered query with its oracle: python -m tests.check [names]."""

import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as registry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    """Rows in an order of their own, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=repr)


def difference(spark_df, connection, sql: str) -> str | None:
    got_rows = [tuple(r) for r in spark_df.collect()]
    want = connection.execute(sql)
    want_columns = [d[0] for d in want.description]
    want_rows = want.fetchall()
    if sorted(spark_df.columns) != sorted(want_columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(want_columns)}"
    got, want = rows_of(spark_df.columns, got_rows), rows_of(want_columns, want_rows)
    if got == want:
        return None
    extra = [r for r in got if r not in set(want)][:3] if len(got) < 100_000 else []
    lost = [r for r in want if r not in set(got)][:3] if len(want) < 100_000 else []
    return f"{len(got)} rows != {len(want)} rows; only ours {extra}; only oracle {lost}"


def main() -> int:
    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, sqls, failed = oracle(sf_dir), registry.oracle_sql(), 0
    for name, query in registry.queries().items():
        if len(sys.argv) > 1 and not any(name.startswith(a) for a in sys.argv[1:]):
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in sqls:
                problem = difference(df, connection, sqls[name])
            else:
                problem = None if df.collect() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        kind = "sql" if name in sqls else "rows"
        print(f"{name:26} {kind:4} {time.time() - start:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
