"""Every registered query against its SQL, at the smallest scale."""

import pytest

from compare import connect, differences, spark_rows, sql_rows
from tallyframe.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query(spark, name):
    got = spark_rows(REGISTRY.queries[name](spark, SF))
    if name in REGISTRY.oracles:
        assert not differences(got, sql_rows(connect(SF), REGISTRY.oracles[name]))
    else:
        assert got[1]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
