import os
import sys

sys.path.insert(0, os.path.dirname(__file__))

import pytest  # noqa: E402
from oracle import connect, spark_rows, sql_rows

from signalens.plans import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_matches_sql(spark, con, name):
    assert spark_rows(Q.queries()[name](spark, SF)) == sql_rows(con, Q.oracle_sql()[name])
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
