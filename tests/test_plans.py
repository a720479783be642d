"""The physical plans that matter at scale: what must not shuffle, what must be pushed down."""

import os

import pytest

import __spark_entry__ as contract
from stackquarry.plans import catalogue, shapes

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    ["scrub_documents", "scrub_map", "unscrub_roundtrip", "select_model", "host_memory", "host_summary", "request_cost",
     "price_or_default", "context_prompt", "request_bodies", "extract_response", "clean_response", "answer_batch",
     "route_to_backend", "parse_query_replies", "quota_status", "stack_output_values", "make_pairs", "truncate_text"],
)
def test_row_by_row_work_does_not_shuffle(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "Exchange hashpartitioning" not in text and "CartesianProduct" not in text
    assert "SinglePartition" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", sorted(name for name in catalogue.QUERIES if not name.startswith("stream_")))
def test_no_products_and_no_single_partition(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text  # row-at-a-time Python


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(contract.queries()["retention"](spark, SF))
    assert "GreaterThanOrEqual(o_orderdate" in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    daily = plan(contract.queries()["daily_usage"](spark, SF))
    assert "event_type" not in daily


def test_prices_are_broadcast_by_their_known_size(spark):
    text = plan(contract.queries()["request_cost"](spark, SF))
    assert "BroadcastHashJoin" in text and "LocalTableScan" in text


def test_counts_combine_before_the_shuffle(spark):
    for name in ("daily_usage", "resources_by_type", "trigger_counts", "first_working_model", "place_models"):
        assert "partial_" in plan(contract.queries()[name](spark, SF))


def test_offers_do_not_need_the_route_tables(spark):
    text = plan(contract.queries()["available_apis"](spark, SF))
    assert text.count("lineitem") == 1


def test_redaction_stays_linear_under_a_filter(spark):
    scrubbed = catalogue._scrubbed(spark, SF).filter("size(redactions) > 2 AND scrubbed_context LIKE '%[[S3%'")
    assert plan(scrubbed).count("regexp_extract_all") <= 8 * 3
    assert shapes.documents(spark, SF).count() == 200


@pytest.mark.parametrize("name", ["key_resources", "typed_resources", "resources_by_type", "stack_outputs", "resource_totals", "scan_summary"])
def test_a_template_is_parsed_once(spark, name):
    text = contract.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("from_json(") == 1
