"""Units grow with the input: their join must not pass through the driver."""

import os

import pytest

from gridweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_units_are_not_broadcast(spark):
    plan = catalogue.queries()["dispatch_by_fuel"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
