"""Plans: pruned scans, no products, Python only where a page-local or ordered step needs it."""

import re

import pytest

from quirefold.plans import queries as plans

#: Union-find over a page's edges, throttling in order, the model.
WITH_PYTHON = {"cluster_components", "cluster_boxes", "drawing_item_counts", "drawing_cascade", "progress_throttle", "describe_images"}


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_plan(spark, sf_dir, name):
    plan = plans.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)
    assert bool(re.search("Python|Pandas|Arrow", plan)) == (name in WITH_PYTHON)
    assert not re.search(r"Exchange SinglePartition, ENSURE[^\n]*\n[^\n]*(Sort|Window)", plan)


def test_scans_read_only_what_they_need(spark, sf_dir):
    plan = plans.QUERIES["iou_pairs"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "l_shipdate" not in plan and "l_tax" not in plan
