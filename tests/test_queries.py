"""Every query of the core against its SQL."""

import pytest
from against_sql import compare

from ledgerloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL[name])


def test_registry():
    assert set(registry.SQL) <= set(registry.QUERIES)
