import pytest

from docrec.plans.registry import ORACLES, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_oracle(spark, small, name):
    check(QUERIES[name](spark, small), ORACLES[name], small)


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
