"""Every registered query against its oracle SQL."""

import pytest

import __spark_entry__ as registry
from tests.check import difference, oracle

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    with oracle(SF_DIR) as connection:
        yield connection


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF_DIR)
    assert difference(df, duck, registry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_gives_rows(spark, name):
    assert registry.queries()[name](spark, SF_DIR).take(1)


def test_entry_has_rows(spark):
    assert registry.entry(spark).take(1)
