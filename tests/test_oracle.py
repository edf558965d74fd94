"""Every registered query agrees with its SQL on the small tables; the others return rows."""

import os

import pytest
from oracle import compare, duck

from rushlight.queries import load

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, SQL = load()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name in SQL:
        problem = compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
        assert problem == ""
    else:
        assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
