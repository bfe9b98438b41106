"""Every query of the subpackage against its SQL."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from against_sql import compare  # noqa: E402

from ledgerloom.llm import registry  # noqa: E402


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, name):
    compare(spark, registry.QUERIES[name], registry.SQL[name])
