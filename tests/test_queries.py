from __future__ import annotations

import pytest
from oracle import expected, rows

from siltstone.plans.catalog import BUILT, ORACLES, QUERIES



@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf_dir, name):
    assert rows(QUERIES[name](spark, sf_dir)) == expected(sf_dir, ORACLES[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and BUILT


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
