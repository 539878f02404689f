"""Every registered query against its SQL oracle on the smallest tables, and the ambiguity of the shipped formats."""

import pytest
from pyspark.sql import functions as F

import checks
from checks.compare import compare, connect
from checks.lines import mixed
from logloom.operators.normalize import detect_format
from logloom.plans.formats_in import FORMATS


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(checks.QUERIES))
def test_query_equals_oracle(spark, con, sf, name):
    ok, message, _ = compare(spark, con, name, checks.QUERIES[name], checks.ORACLE.get(name), sf)
    assert ok, message


def test_every_oracle_has_a_query():
    assert set(checks.ORACLE) <= set(checks.QUERIES)


def test_no_line_is_recognised_twice(spark, sf):
    assert detect_format(mixed(spark, sf), FORMATS).filter(F.size("candidates") > 1).count() == 0


def test_entry(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    assert df.columns == ["minute_s", "status", "severity", "lines", "bytes", "clients"]
    assert df.count() > 0
