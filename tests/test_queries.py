import pytest
from oracle import same

import __spark_entry__
from millrace.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(spark, QUERIES[name], ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.where("l_quantity IS NULL").count() == 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
