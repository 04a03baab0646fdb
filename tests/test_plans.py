"""What plans must and mustn't have."""

import pytest

from sparkfrontier import catalog

SF = "/root/testdata/sf0.001"
STREAMS = {"stream_dedup", "stream_guard", "stream_counts"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - STREAMS))
def test_no_cross_joins(spark, name):
    text = plan(catalog.QUERIES[name](spark, SF))
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_caps_are_cut_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["per_domain_cap"](spark, SF))
    assert "WindowGroupLimit" in text


@pytest.mark.parametrize(("name", "columns"), [("refetch_summary", "conv_id"), ("shard_assignment", "c_custkey:bigint,c_name"), ("url_fingerprint", "page_id:bigint,url")])
def test_scans_read_only_what_is_asked_for(spark, name, columns):
    text = plan(catalog.QUERIES[name](spark, SF))
    read = text.split("ReadSchema: struct<")[1].split(">")[0]
    assert read.startswith(columns) and read.count(":") == columns.count(",") + 1


def test_filters_reach_the_scan(spark):
    from sparkfrontier.sources.relations import table

    text = plan(table(spark, SF, "events").where("event_id < 100").select("user_id"))
    assert "PushedFilters: [IsNotNull(event_id), LessThan(event_id,100)]" in text
