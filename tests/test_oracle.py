"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from loamgraph import registry
from tests.conftest import SF, normal


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name in registry.oracle_sql():
        want = duck.sql(registry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got) == normal(want)
    else:
        assert len(got.columns) > 0
