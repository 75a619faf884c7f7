"""Plans keep the properties that large data needs."""

import pytest
from compare import SMALL

import __spark_entry__ as contract
from tiermill.plans import registry

# Run flows or writes while the plan is built; their work is not in the final plan.
WRITING = {"stream_silver", "stream_fact", "event_counts", "batch_run_log", "ingest_csv", "ingest_lenient", "scd2_apply"}
NAMES = sorted(set(registry.PLANS) - WRITING)


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NAMES)
def test_no_cross_join_and_no_row_python(spark, name):
    text = physical(contract.queries()[name](spark, SMALL))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text
    assert "MapInPandas" not in text


def test_the_only_python_step_counts_families_in_batches(spark, bronze):
    """Affinity stores its counts first, so the step shows in that plan only."""
    from tiermill.operators.features import family_affinity, family_revenue
    from tiermill.plans.features import AS_OF, lines_before

    text = physical(family_affinity(family_revenue(lines_before(bronze), AS_OF)))
    assert "MapInPandas" in text
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in text


def test_filters_and_columns_reach_the_scan(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = physical(contract.queries()["scan"](spark, SMALL))
    assert "GreaterThanOrEqual(o_orderdate" in text and "LessThanOrEqual(o_orderdate" in text
    assert "o_custkey" not in text.split("ReadSchema")[1]
    text = physical(contract.queries()["pit_features"](spark, SMALL))
    assert "LessThan(o_orderdate" in text and "o_orderpriority" not in text


def test_top_rows_do_not_sort_everything(spark):
    for name in ("rejected_recent", "vector_topk", "quarantine_sample"):
        assert "TakeOrderedAndProject" in physical(contract.queries()[name](spark, SMALL))


def test_quality_checks_share_one_aggregation(spark):
    text = physical(contract.queries()["dq_validity"](spark, SMALL))
    assert text.count("Exchange hashpartitioning") == 1
