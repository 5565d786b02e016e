"""Dispatch counts, reads, files, fan-out plans and validation edge cases."""

import os
import tempfile

from pyspark.sql import functions as F

from sluice.operators import dispatch as dsp
from sluice.operators import fanout, records, state, validation
from sluice.plans.dispatch import dispatch_step
from sluice.sources import fixtures as fx
from tests.conftest import SF001


def test_dispatch_outcomes_match_published(spark):
    o = dispatch_step(fx.consumed(spark, SF001)).outcomes
    c = {r["outcome"]: r["count"] for r in o.groupBy("outcome").count().collect()}
    assert (c["delivered"], c["retry_scheduled"], c["dlq"]) == (774, 174, 52)


def test_status_rows_when_only_push_fails(spark):
    row = [(1, "t", "u", "c", "x", "corr", 0, False, True, True, False, 0, None, "main")]
    df = spark.createDataFrame(row, "message_id long, tenant_id string, user_id string, channel string, "
                                    "content string, correlation_id string, retry_count int, simulate_fail boolean, "
                                    "received_ok boolean, delivered_ok boolean, push_ok boolean, seen_ms long, "
                                    "next_attempt_at_ms long, source_stream string")
    got = [(r["status"], r["attempt"], r["error"]) for r in dsp.status_expand(df).orderBy("step").collect()]
    assert got == [("received", 0, ""), ("delivered", 0, ""), ("retry_scheduled", 1, "gateway_delivery_failed")]


def test_received_failure_wins_over_simulated(spark):
    df = spark.createDataFrame([(True, False, True, True, 3)],
                               "simulate_fail boolean, received_ok boolean, delivered_ok boolean, push_ok boolean, "
                               "retry_count int")
    r = dsp.outcome(df).first()
    assert (r["failure_reason"], r["outcome"]) == ("storage_persist_failed_received", "dlq")


def test_latest_state_point_lookup_and_not_found(spark):
    h = fx.history(spark, SF001)
    one = state.latest_state(h, "tenant-2", "n-7").collect()
    assert len(one) == 1 and one[0]["seq"] == 31
    assert state.latest_state(h, "tenant-2", "n-does-not-exist").count() == 0


def test_history_one_tenant_limit(spark):
    h = fx.history(spark, SF001)
    rows = state.delivery_history(h, "3", tenant_id="tenant-1").collect()
    assert len(rows) == 3 and all(r["tenant_id"] == "tenant-1" for r in rows)
    assert "content" not in rows[0].asDict()


def test_audit_file_round_trip(spark):
    out = os.path.join(tempfile.mkdtemp(prefix="sluice-audit-"), "audit")
    h = fx.history(spark, SF001)
    records.audit_append(h, out)
    back = records.audit_scan(spark, out)
    assert back.count() == h.count()
    assert records.audit_scan(spark, out + "-missing").count() == 0
    joined = back.join(h.select("notification_id", "attempt", "status"), ["notification_id", "attempt", "status"])
    assert joined.count() == h.count()


def test_fan_out_leaves_the_join_to_the_optimizer(spark):
    m = fx.consumed(spark, SF001).select("message_id", "tenant_id", "channel")
    assert "BroadcastHashJoin" in fanout.fan_out(m, fx.sessions(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        assert "SortMergeJoin" in fanout.fan_out(m, fx.sessions(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def test_open_short_and_long_sessions(spark):
    """Sessions without an end, within an hour and over a year."""
    import datetime as dt
    t = lambda s: dt.datetime.fromisoformat(s)
    sessions = spark.createDataFrame(
        [(1, "t", "c", t("2024-01-01 00:10:00"), t("2024-01-01 00:50:00")), (2, "t", "c", t("2024-01-01 00:30:00"), None),
         (3, "t", "c", t("2023-01-05 07:15:00"), t("2024-03-07 01:05:00")), (4, "t", "c", t("2024-01-02 00:00:00"), t("2024-01-02 00:00:00"))],
        "session_id long, tenant_id string, channel string, sub_start timestamp_ntz, sub_end timestamp_ntz")
    times = ["2023-01-05 07:14:59", "2023-01-05 07:15:00", "2024-01-01 00:10:00", "2024-01-01 00:49:59", "2024-01-01 00:50:00",
             "2024-01-02 00:00:00", "2024-03-07 01:04:59", "2024-03-07 01:05:00", "2025-06-01 00:00:00"]
    messages = spark.createDataFrame([(i, "t", "c", t(x)) for i, x in enumerate(times)],
                                     "message_id long, tenant_id string, channel string, arrival_ts timestamp_ntz")
    got = {}
    for r in fanout.fan_out_as_of(messages, sessions).collect():
        got.setdefault(r["message_id"], []).append(r["session_id"])
    want = {1: [3], 2: [1, 3], 3: [1, 2, 3], 4: [2, 3], 5: [2, 3], 6: [2, 3], 7: [2], 8: [2]}
    assert {k: sorted(v) for k, v in got.items()} == want
    active = {str(r["change_ts"]): r["active"] for r in fanout.active_sessions(sessions).collect()}
    assert active == {"2023-01-05 07:15:00": 1, "2024-01-01 00:10:00": 2, "2024-01-01 00:30:00": 3, "2024-01-01 00:50:00": 2,
                      "2024-01-02 00:00:00": 2, "2024-03-07 01:05:00": 1}

def test_as_of_join_equals_plain_range_join(spark):
    m = fx.consumed(spark, SF001).select("message_id", "tenant_id", "channel", "arrival_ts")
    s = fx.sessions(spark, SF001)
    fast = fanout.fan_out_as_of(m, s, bucket_seconds=3600).select("message_id", "session_id")
    slow = (m.join(s, ["tenant_id", "channel"])
             .filter((F.col("sub_start") <= F.col("arrival_ts")) & (F.col("sub_end").isNull() | (F.col("arrival_ts") < F.col("sub_end"))))
             .select("message_id", "session_id"))
    assert sorted(fast.collect()) == sorted(slow.collect())
    coarse = fanout.fan_out_as_of(m, s, bucket_seconds=86_400).select("message_id", "session_id")
    assert sorted(coarse.collect()) == sorted(slow.collect())


def test_empty_secret_rejects_every_token(spark):
    t = validation.token_audit(fx.tokens(spark, SF001), "")
    errs = {r["token_error"] for r in t.filter(F.col("token_status").isNotNull()).collect()}
    assert "invalid JWT signature" in errs
    assert t.filter(F.col("token_status") == "valid").count() == 0


def test_tenant_scope_require_auth(spark):
    df = spark.createDataFrame([(None, None, "t1"), ("valid", "t1", "t1"), ("valid", "t2", "t1"), ("invalid", None, "t1")],
                               "token_status string, token_tenant string, asked_tenant string")
    got = [r["scope"] for r in validation.tenant_scope(df, require_auth=True).collect()]
    assert got == ["unauthorized", "allowed", "forbidden", "unauthorized"]


def test_empty_inputs(spark):
    from sluice.plans.admission import admission_decisions
    empty = fx.requests(spark, SF001).limit(0)
    assert admission_decisions(empty, None, None, 1, 5, 10, 0).count() == 0
    assert dispatch_step(fx.consumed(spark, SF001).limit(0)).outcomes.count() == 0
    assert state.dlq_newest(fx.dead_letters(spark, SF001), 0).count() == 0


def test_chain_position_without_one_task_sort_equals_window(spark):
    """Hot chain: many rows in one second, across midnight, ties broken by seq."""
    from pyspark.sql import Window
    from sluice.operators.metrics import retry_chain_step
    rows = []
    base = 1_704_153_599_000_000  # 2024-01-01 23:59:59 UTC in micros
    for i in range(400):
        corr = "hot" if i % 4 else f"c{i % 7}"
        us = base + (i // 50) * 400_000  # 50 rows share each 0.4 s step, crossing midnight
        rows.append((corr, i, ["received", "delivered", "retry_scheduled"][i % 3], us))
    df = spark.createDataFrame(rows, "correlation_id string, seq long, status string, us long") \
              .withColumn("status_ts", F.timestamp_micros("us").cast("timestamp_ntz")).drop("us")
    got = retry_chain_step(df)
    w = Window.partitionBy("correlation_id").orderBy("status_ts", "seq")
    want = df.select("correlation_id", "seq", F.row_number().over(w).cast("bigint").alias("step"),
                     F.lag("status").over(w).alias("prev_status"),
                     (F.unix_micros(F.col("status_ts").cast("timestamp"))
                      - F.unix_micros(F.lag("status_ts").over(w).cast("timestamp"))).alias("gap_us"))
    cols = ["correlation_id", "seq", "step", "prev_status", "gap_us"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())


def test_chain_position_keeps_rows_without_key_or_time(spark):
    """Null correlation ids form a chain, null times come first in theirs, and the plan moves each row once."""
    from sluice.operators.metrics import retry_chain_step
    rows = [(None, 1, "a", "2024-01-01 00:00:00"), (None, 2, "b", "2024-01-02 00:00:00"), ("x", 3, "c", None), ("x", 4, None, "2024-01-01 00:00:00"),
            ("x", 5, "d", "2024-01-03 10:00:00.5"), ("x", 6, "e", "2024-01-03 10:00:00.5")]
    df = spark.createDataFrame(rows, "correlation_id string, seq long, status string, t string").selectExpr(
        "correlation_id", "seq", "status", "cast(t as timestamp_ntz) as status_ts")
    got = {r.seq: (r.step, r.prev_status, r.gap_us) for r in retry_chain_step(df).collect()}
    day = 86_400_000_000
    assert got == {1: (1, None, None), 2: (2, "a", day), 3: (1, None, None), 4: (2, "c", None),
                   5: (3, None, 2 * day + 36_000_500_000), 6: (4, "d", 0)}
    assert retry_chain_step(df.limit(0)).count() == 0
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = retry_chain_step(fx.history(spark, SF001))._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert plan.count("FileScan") == 1
    assert plan.count("Exchange hashpartitioning") - plan.count("ReusedExchange") <= 5


def most_in_a_task(df):
    """Rows in all tasks and in the fullest one."""
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return sum(n), max(n)


def test_pairs_of_a_hot_key_are_spread_over_tasks(spark):
    """One (tenant, channel), read by one task, makes 16 million pairs; several tasks make them."""
    key = [F.lit("t").alias("tenant_id"), F.lit("c").alias("channel")]
    messages, sessions = (spark.range(0, 4_000, 1, 1).select(F.col("id").alias(c), *key) for c in ("message_id", "session_id"))
    total, most = most_in_a_task(fanout.fan_out(messages, sessions))
    assert total == 16_000_000 and most < total


def test_pairs_of_a_hot_node_are_spread_over_tasks(spark):
    """One (tenant, channel) with all messages in one hour."""
    key = [F.lit("t").alias("tenant_id"), F.lit("c").alias("channel")]
    hour = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    messages = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("message_id"), *key, hour.alias("arrival_ts"))
    sessions = spark.range(0, 4_000, 1, 1).select(F.col("id").alias("session_id"), *key, hour.alias("sub_start"), F.lit(None).cast("timestamp_ntz").alias("sub_end"))
    total, most = most_in_a_task(fanout.fan_out_as_of(messages, sessions))
    assert total == 16_000_000 and most < total


def test_blocks_keep_repeated_rows_and_leave_out_null_keys(spark):
    messages = spark.createDataFrame([(1, "t", "c"), (1, "t", "c"), (2, None, "c"), (3, "t", "d")], "message_id long, tenant_id string, channel string")
    sessions = spark.createDataFrame([(7, "t", "c"), (7, "t", "c"), (8, None, "c"), (None, "t", "d")], "session_id long, tenant_id string, channel string")
    got = sorted((r.message_id, r.session_id) for r in fanout.fan_out(messages, sessions).collect())
    assert got == [(1, 7)] * 4 + [(3, None)]


def final_plan(df):
    """The plan that ran, once all parts were planned by their sizes."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_as_of_join_holds_rows_not_arrays(spark):
    """Rows are sorted and joined, which spills; arrays of a key's rows are built on the heap."""
    m = fx.consumed(spark, SF001).select("message_id", "tenant_id", "channel", "arrival_ts")
    ran = final_plan(fanout.fan_out_as_of(m, fx.sessions(spark, SF001)))
    assert "collect_list" not in ran and "Join" in ran


def test_as_of_join_of_keys_with_several_blocks(spark, monkeypatch):
    """Blocks of three rows; repeated rows, null keys and null times on either side."""
    import datetime as dt
    monkeypatch.setattr(fanout, "JOIN_ROWS", 3)
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    messages = spark.createDataFrame([(i % 17, k, "c", at(None if i == 5 else i / 3)) for i in range(40) for k in ("t", None, "lone")],
                                     "message_id long, tenant_id string, channel string, arrival_ts timestamp_ntz")
    sessions = spark.createDataFrame([(i % 7, k, "c", at(None if i == 3 else i / 2), at(None if i % 5 == 0 else i / 2 + i % 4)) for i in range(20) for k in ("t", None)],
                                     "session_id long, tenant_id string, channel string, sub_start timestamp_ntz, sub_end timestamp_ntz")
    columns = ["message_id", "session_id", "arrival_ts"]
    slow = (messages.join(sessions, ["tenant_id", "channel"])
                    .filter((F.col("sub_start") <= F.col("arrival_ts")) & (F.col("sub_end").isNull() | (F.col("arrival_ts") < F.col("sub_end")))).select(columns))
    assert sorted(fanout.fan_out_as_of(messages, sessions).select(columns).collect()) == sorted(slow.collect())


def test_fan_out_holds_rows_not_arrays(spark):
    """As J03, the blocks of both sides are rows that spill."""
    m = fx.consumed(spark, SF001).select("message_id", "tenant_id", "channel")
    ran = final_plan(fanout.fan_out(m, fx.sessions(spark, SF001)))
    assert "collect_list" not in ran and "Join" in ran


def test_fan_out_of_keys_with_several_blocks(spark, monkeypatch):
    """Blocks of three rows; repeated rows and null keys on either side."""
    monkeypatch.setattr(fanout, "JOIN_ROWS", 3)
    messages = spark.createDataFrame([(i % 11, k, "c") for i in range(30) for k in ("t", None, "lone")], "message_id long, tenant_id string, channel string")
    sessions = spark.createDataFrame([(i % 7, k, "c") for i in range(20) for k in ("t", None)], "session_id long, tenant_id string, channel string")
    got = fanout.fan_out(messages, sessions)
    assert got.columns == ["tenant_id", "channel", "message_id", "session_id"]
    assert sorted(got.collect()) == sorted(messages.join(sessions, ["tenant_id", "channel"]).select(got.columns).collect())
