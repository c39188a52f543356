import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "America/New_York")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_history(spark):
    """History rows from (cmd, epoch) and any other fields; ids count from 1."""
    from cmdlog_spark.schema import HISTORY

    def make(*rows):
        filled = [
            {"id": i, "hist_id": None, "ppid": 10, "pwd": "/tmp", "salt": 42, **row}
            for i, row in enumerate(rows, 1)
        ]
        data = [tuple(row[name] for name in HISTORY.names) for row in filled]
        return spark.createDataFrame(data, HISTORY)

    return make
