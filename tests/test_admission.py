"""C01 against the published counts and a sequential model of the service."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sluice.plans.admission import admission_decisions
from sluice.sources import fixtures as fx
from tests.conftest import SF001, SF01
from tests.sim import load_inputs, simulate

REASONS = ["ok", "duplicate_idempotency_key", "content_required", "rate_limited", "daily_quota_exceeded",
           "stream_backpressure", "retry_stream_backpressure"]

# FIXTURES.md: expected C01 counts at sf0.01 per (limit, quota, main, retry).
EXPECTED = {
    (0, 0, 0, 0): [7740, 2060, 200, 0, 0, 0, 0],
    (1, 50, 3000, 0): [3000, 646, 200, 235, 2073, 3846, 0],
    (0, 50, 0, 500): [1608, 367, 200, 0, 2304, 0, 5521],
    (1, 0, 3000, 800): [3000, 775, 200, 235, 0, 5790, 0],
    (2, 40, 2500, 400): [1001, 199, 200, 7, 3793, 0, 4800],
    (1, 30, 3000, 790): [1569, 231, 200, 235, 5065, 0, 2700],
    (1, 30, 1200, 900): [1200, 177, 200, 235, 5065, 3123, 0],
    (1, 50, 8000, 1900): [5796, 1275, 200, 235, 2073, 0, 421],
}


@pytest.fixture(scope="module")
def inputs01(duck01):
    return load_inputs(duck01)


@pytest.mark.parametrize("params", list(EXPECTED))
def test_sequential_model_matches_published_counts(inputs01, params):
    rows, claims, retry = inputs01
    out = simulate(rows, claims, retry, *params)
    c = Counter(v[0] for v in out.values())
    assert [c.get(r, 0) for r in REASONS] == EXPECTED[params]


def test_failed_publishes_release_their_claims(spark, inputs01):
    """503s: the claim is free again, the next request of the key that publishes takes it, and the stream does not grow."""
    rows, claims, retry = inputs01
    for params in [(1, 50, 3000, 0), (0, 0, 0, 0), (2, 40, 2500, 400)]:
        expected = simulate(rows, claims, retry, *params, publish=True)
        df = admission_decisions(fx.requests(spark, SF01), fx.claims(spark, SF01), fx.retry_entries(spark, SF01), *params, publish="publish_ok")
        got = {r["message_id"]: (r["reason"], r["quota_count"], r["canonical_id"]) for r in df.collect()}
        assert got == expected
        assert Counter(v[0] for v in got.values())["redis_publish_failed"] > 0
    assert {r["http_status"] for r in df.filter("reason = 'redis_publish_failed'").collect()} == {503}


def _spark_decisions(spark, sf, params):
    lim, quota, main, retry = params
    df = admission_decisions(fx.requests(spark, sf), fx.claims(spark, sf), fx.retry_entries(spark, sf),
                             lim, quota, main, retry)
    return {r["message_id"]: (r["reason"], r["quota_count"], r["canonical_id"]) for r in df.collect()}


@pytest.mark.parametrize("params", [(1, 50, 3000, 0), (2, 40, 2500, 400), (1, 30, 1200, 900), (0, 50, 0, 500)])
def test_spark_equals_sequential_model_row_by_row(spark, inputs01, params):
    rows, claims, retry = inputs01
    expected = simulate(rows, claims, retry, *params)
    got = _spark_decisions(spark, SF01, params)
    assert len(got) == len(expected)
    diff = [(k, got[k], expected[k]) for k in expected if got[k] != expected[k]]
    assert diff == []


@pytest.mark.parametrize("params", [(0, 0, 0, 0), (1, 0, 3000, 800), (1, 50, 8000, 1900)])
def test_spark_counts_match_published(spark, params):
    lim, quota, main, retry = params
    df = admission_decisions(fx.requests(spark, SF01), fx.claims(spark, SF01), fx.retry_entries(spark, SF01),
                             lim, quota, main, retry)
    c = {r["reason"]: r["n"] for r in df.groupBy("reason").agg(F.count("*").alias("n")).collect()}
    assert [c.get(r, 0) for r in REASONS] == EXPECTED[params]


def test_gate_closed_from_first_row(spark, duck001):
    """Starting length at or over the limit closes the gate before the first row."""
    rows, claims, retry = load_inputs(duck001)
    expected = simulate(rows, claims, retry, 0, 0, 100, 0, main_start=150)
    df = admission_decisions(fx.requests(spark, SF001), fx.claims(spark, SF001), fx.retry_entries(spark, SF001),
                             0, 0, 100, 0, main_start_len=150)
    got = {r["message_id"]: (r["reason"], r["quota_count"], r["canonical_id"]) for r in df.collect()}
    assert got == expected
    assert Counter(v[0] for v in got.values())["stream_backpressure"] > 0


def test_retry_gate_closed_from_first_row(spark, duck001):
    rows, claims, retry = load_inputs(duck001)
    expected = simulate(rows, claims, retry, 0, 0, 500, 10, retry_start=10)
    df = admission_decisions(fx.requests(spark, SF001), fx.claims(spark, SF001), fx.retry_entries(spark, SF001),
                             0, 0, 500, 10, retry_start_len=10)
    got = {r["message_id"]: (r["reason"], r["quota_count"], r["canonical_id"]) for r in df.collect()}
    assert got == expected


def test_one_row_out_per_row_in(spark):
    df = admission_decisions(fx.requests(spark, SF001), fx.claims(spark, SF001), fx.retry_entries(spark, SF001),
                             1, 5, 300, 50)
    assert df.count() == fx.requests(spark, SF001).count()
    assert df.select("message_id").distinct().count() == df.count()


def test_edge_rows_ties_blank_keys_unicode(spark):
    """Equal timestamps (ties broken by id), blank and missing keys, unicode, empty content."""
    import datetime as dt
    t0 = dt.datetime(2024, 3, 1, 12, 0, 59, 999_999)
    rows = []
    for i in range(60):
        ts = t0 + dt.timedelta(microseconds=(i // 6))  # six requests share every timestamp, across a minute edge
        tenant = ["tënant-α", "tenant-b", "テナント"][i % 3]
        key = [None, "", "k-ü", "k-ü", f"k{i % 4}"][i % 5]
        content = "" if i % 17 == 5 else f"héllo {i}"
        hdr = ["", None, f"h-{i}"][i % 3]
        rows.append(dict(message_id=1000 - i, arrival_ts=ts, tenant_id=tenant, user_field=None, channel_field="c",
                         content=content, header_corr=hdr, body_corr=None, idempotency_key=key))
    schema = ("message_id long, arrival_ts timestamp_ntz, tenant_id string, user_field string, channel_field string, "
              "content string, header_corr string, body_corr string, idempotency_key string")
    df = spark.createDataFrame(rows, schema)
    claims = spark.createDataFrame([("tenant-b", "k1", "")], "tenant_id string, idempotency_key string, "
                                                               "notification_id string")
    retry = spark.createDataFrame([(1, t0), (2, t0 + dt.timedelta(microseconds=3))],
                                  "message_id long, entry_ts timestamp_ntz")
    claim_rows = [dict(tenant_id="tenant-b", idempotency_key="k1", notification_id="")]
    for params in [(4, 9, 20, 0), (3, 0, 0, 2), (0, 5, 12, 2), (1, 1, 1, 1)]:
        expected = simulate(rows, claim_rows, [r["entry_ts"] for r in retry.collect()], *params)
        got = admission_decisions(df, claims, retry, *params)
        got = {r["message_id"]: (r["reason"], r["quota_count"], r["canonical_id"]) for r in got.collect()}
        assert got == expected, params
