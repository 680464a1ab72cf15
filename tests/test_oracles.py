"""Every registered query of the engine itself gives the rows of its SQL; those without have a plain version in test_plain."""

from pathlib import Path

import oracle
import pytest

from larder.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, small, con, name):
    assert oracle.differences(QUERIES[name](spark, small), con, ORACLES[name]) is None


def test_queries_without_sql_have_plain_versions():
    source = Path(__file__).with_name("test_plain.py").read_text()
    assert [n for n in QUERIES if n not in ORACLES and n not in source] == []


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
