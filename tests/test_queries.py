import pytest

import __spark_entry__ as E
from tests.check_oracles import compare, connect

SF_DIR = "/root/testdata/sf0.001"


def test_the_flagship_runs(spark):
    assert E.entry(spark).count() > 0


def test_every_oracle_has_its_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query_agrees_with_its_sql(spark, name):
    assert compare(spark, connect(SF_DIR), name, SF_DIR) is None
