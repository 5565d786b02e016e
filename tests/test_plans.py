"""Plan shape: partial top-N before the shuffle, no single-partition windows over rows,
pruned scans and broadcast only where its size is bounded."""

import re

import pytest

from sluice.queries import REGISTRY
from tests.conftest import SF001

# Batch queries only: the streaming ones run their stream when called.
BATCH = sorted(k for k in REGISTRY if not k.startswith("stream_") and k != "sink_with_fallback")
# A06 runs a global running sum over its per-hour delta table (one row per hour boundary).
GLOBAL_WINDOW_OK = {"active_sessions"}

SINGLE_PARTITION_WINDOW = re.compile(r"Window \[[^\n]*\n[^\n]*Sort \[[^\n]*\n[^\n]*Exchange SinglePartition")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", BATCH)
def test_no_single_partition_window(spark, key):
    if key in GLOBAL_WINDOW_OK:
        pytest.skip("window over a table bounded by the time span")
    assert not SINGLE_PARTITION_WINDOW.search(plan(REGISTRY[key](spark, SF001)))


@pytest.mark.parametrize("key", ["latest_state", "delivery_history", "pk_collapse", "latest_entry"])
def test_partial_top_n_before_shuffle(spark, key):
    p = plan(REGISTRY[key](spark, SF001))
    assert "WindowGroupLimit" in p


def test_global_newest_is_take_ordered(spark):
    assert "TakeOrderedAndProject" in plan(REGISTRY["dlq_newest"](spark, SF001))


def test_scan_reads_only_needed_columns(spark):
    """T11 needs ids and times only: neither ``value`` nor ``props`` is read."""
    df = REGISTRY["retention"](spark, SF001)
    schema = re.search(r"ReadSchema: (struct<[^>]*>)", df._jdf.queryExecution().toString()).group(1)
    assert "ts:" in schema and "value" not in schema and "props" not in schema


def test_filters_reach_the_scan(spark):
    """T11's time predicate becomes a parquet filter on the event scan."""
    p = REGISTRY["retention"](spark, SF001)._jdf.queryExecution().toString()
    assert "GreaterThan(ts,2024-01-21T00:00)" in p


def test_point_read_filters_before_any_shuffle(spark):
    """L03 filters on the derived key before the first exchange."""
    p = plan(REGISTRY["clustered_history"](spark, SF001))
    below_filter = p[p.rindex("+- Filter "):]  # the tree prints children after parents
    assert "Exchange" not in below_filter and "Scan parquet" in below_filter


def test_pre_aggregated_side_is_broadcast(spark):
    assert "BroadcastHashJoin" in plan(REGISTRY["fan_out_counts"](spark, SF001))
