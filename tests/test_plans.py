"""Range queries join by equality only."""

import pytest

from bandwalk import catalog


@pytest.mark.parametrize("name", ["j1_range_join", "f3_in_range_edges", "f10_survival_gate", "j10_as_of_header", "d8_rng_in_range", "a20_graph_stats"])
def test_no_join_by_comparison(spark, name):
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
