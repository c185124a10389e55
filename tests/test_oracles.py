"""Every registered query runs, and agrees with DuckDB where it has SQL, on the smallest tables."""

import os

import pytest

from tallyseek.plans import registry
from tests.oracle_check import connect, differences

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")

registry.load()

# Hundreds of boosting rounds, minutes even on the smallest tables; TALLYSEEK_LONG=1 runs them too.
LONG = {"gbt_forecast_a", "gbt_forecast_b"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees(spark, name):
    if name in LONG and not os.environ.get("TALLYSEEK_LONG"):
        pytest.skip("long")
    found = registry.QUERIES[name](spark, FOLDER)
    if name in registry.ORACLES:
        assert differences(found, connect(FOLDER), registry.ORACLES[name]) == []
    else:
        assert found.count() > 0
