"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks.against_sql import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, db, name):
    frame = queries()[name](spark, FOLDER).toPandas()
    if name in oracle_sql():
        assert compare(frame, db.execute(oracle_sql()[name]).df()) == "ok"
    else:
        assert len(frame) > 0


def test_entry(spark):
    assert entry(spark).count() > 0
