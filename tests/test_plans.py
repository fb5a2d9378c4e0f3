"""Plans that matter at scale: pruned scans, pushed filters, no cross joins and no Python where none is needed."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return entry.queries()[name](spark, SF)._jdf.queryExecution().toString()


def test_scan_is_pruned_and_filtered(spark):
    p = plan(spark, "scan_pruned").split("== Physical Plan ==")[1]
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_shipdate" in p
    assert "PushedFilters: [IsNotNull(l_shipdate), GreaterThanOrEqual(l_shipdate" in p


@pytest.mark.parametrize("name", ["agg_cluster_purity", "agg_completeness", "win_glossary", "topk_catalogue", "metric_ari", "join_range", "join_reciprocal", "graph_degree", "refine_label_split", "vote_ensemble", "dist_dice"])
def test_native_plans_have_no_python(spark, name):
    p = plan(spark, name)
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p


@pytest.mark.parametrize("name", ["join_range", "join_nearest", "join_reciprocal", "join_verify_candidates", "refine_ocr_rematch", "win_glossary"])
def test_no_unbounded_cross_join(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_partial_aggregation_before_shuffle(spark):
    p = plan(spark, "agg_contingency").split("== Physical Plan ==")[1]
    assert p.count("HashAggregate") >= 2 and p.index("Exchange") < p.rindex("HashAggregate")
