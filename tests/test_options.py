"""Operator options not covered by the registered queries."""

import os

import pytest

from pyspark.sql import functions as F

from sluice.operators import admission as adm
from sluice.operators import fanout, ledger, records, state
from sluice.session import checkpoint_dir
from sluice.sources import fixtures as fx
from sluice.streaming import jobs
from tests.conftest import SF001


def test_idempotency_header_wins_over_body(spark):
    df = spark.createDataFrame(
        [(1, "h", "b"), (2, "", "b"), (3, None, ""), (4, None, None)],
        "message_id long, idempotency_header string, idempotency_key string") \
        .withColumns({"arrival_ts": F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "user_field": F.lit(None),
                      "channel_field": F.lit(None), "header_corr": F.lit(None), "body_corr": F.lit(None)})
    got = {r["message_id"]: r["idem_key"] for r in adm.normalise_request(df).collect()}
    assert got == {1: "h", 2: "b", 3: None, 4: None}


def test_stage_defaults(spark):
    df = spark.createDataFrame([(None, None, None, None, None, None, None, "")],
                               "tenant_id string, user_id string, channel string, content string, "
                               "correlation_id string, status string, attempt string, error string")
    d = records.normalise(df, "dispatch").first()
    assert (d["tenant_id"], d["user_id"], d["channel"], d["content"]) == ("unknown", "unknown", "default", "")
    r = records.normalise(df, "read").first()
    assert (r["status"], r["attempt"], r["error"]) == ("unknown", "0", "")
    i = records.normalise(df, "ingress").first()
    assert i["user_id"] == "unknown-user"


def test_release_removes_only_exact_matches(spark):
    claims = fx.claims(spark, SF001)
    remaining, results = ledger.idempotency_release(claims, fx.releases(spark, SF001))
    released = results.filter("released").count()
    assert released > 0 and results.filter(~F.col("released")).count() > 0
    assert remaining.count() == claims.count() - released


def test_replay_with_removal(spark):
    dl = fx.dead_letters(spark, SF001)
    replayed, remaining = ledger.dlq_replay(dl, 10, delete_after=True)
    assert replayed.count() == 10
    assert remaining.count() == dl.count() - 10
    assert replayed.join(remaining, "message_id").count() == 0
    assert set(replayed.select("retry_count").distinct().toPandas()["retry_count"]) == {3}


def test_active_at_point_form(spark):
    s = fx.sessions(spark, SF001)
    n = fanout.active_at(s, "2024-01-10 00:00:00").first()["active"]
    series = {r["change_ts"].isoformat(sep=" "): r["active"] for r in fanout.active_sessions(s).collect()}
    last = max(k for k in series if k <= "2024-01-10 00:00:00")
    assert n == series[last]


def test_audit_history_mode_keeps_rows_without_id(spark):
    lines = spark.createDataFrame([('{"ts":1,"record":{"tenant_id":"t","status":"delivered"}}',),
                                   ('{"ts":2,"record":{"status":"x"}}',), ("",), ("{broken",)], "value string")
    assert records.audit_parse(lines, need_id=True).count() == 0
    assert records.audit_parse(lines, need_id=False).count() == 1
    assert records.audit_quarantine(lines).count() == 1


def test_state_log_snapshot_and_compaction(spark):
    base = checkpoint_dir(spark, "test-state-log")
    state_path, snap = os.path.join(base, "deltas"), os.path.join(base, "snapshot")
    rows = spark.createDataFrame(
        [("t", 1, 1, "received"), ("t", 1, 3, "retry_scheduled"), ("t", 2, 1, "received")],
        "tenant_id string, message_id long, step int, status string").withColumn("batch_id", F.lit(0))
    jobs.append_state_delta(rows, state_path, 0)
    later = spark.createDataFrame([("t", 1, 1, "received")], "tenant_id string, message_id long, step int, "
                                  "status string").withColumn("batch_id", F.lit(1))
    jobs.append_state_delta(later, state_path, 1)
    jobs.append_state_delta(later, state_path, 1)  # a re-run batch leaves the same table
    cur = {r["message_id"]: r["status"] for r in jobs.read_state(spark, state_path).collect()}
    assert cur == {1: "received", 2: "received"}
    jobs.compact_state(spark, state_path, snap)
    again = {r["message_id"]: r["status"] for r in jobs.read_state(spark, state_path, snap).collect()}
    assert again == cur
    assert jobs._numbers(spark, state_path, "batch_id=") == [1]  # the newest stays for a re-run, the others are folded
    jobs.append_state_delta(later.withColumn("status", F.lit("dlq")).withColumn("batch_id", F.lit(2)), state_path, 2)
    jobs.compact_state(spark, state_path, snap)
    last = {r["message_id"]: r["status"] for r in jobs.read_state(spark, state_path, snap).collect()}
    assert last == {1: "dlq", 2: "received"} and jobs._numbers(spark, snap, "upto=") == [2]


def test_latest_state_newest_wins_on_ties_by_seq(spark):
    df = spark.createDataFrame([("t", "n", 1, "a"), ("t", "n", 2, "b")], "tenant_id string, notification_id string, "
                               "seq long, status string").withColumn("status_ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    assert state.latest_state(df).first()["status"] == "b"


def test_observed_stream_metrics_equal_batch_counters(spark):
    from sluice.operators import metrics
    from sluice.streaming.harness import run_slices
    collector = jobs.metrics_collector()
    spark.streams.addListener(collector)
    try:
        run_slices(spark, "observe-test", fx.consumed(spark, SF001), "arrival_ts", lambda s, base: (
            jobs.observe_dispatch(s).writeStream.format("noop").trigger(availableNow=True)
            .option("checkpointLocation", os.path.join(base, "ck")).start()))
        import time
        for _ in range(50):  # listener events arrive asynchronously
            if sum(b["consumed"] for b in collector.batches) >= 1000:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(collector)
    want = metrics.dispatch_counters(fx.consumed(spark, SF001)).filter("is_total").first().asDict()
    got = collector.totals()
    assert got and all(got[k] == want[k] for k in got)


def test_clustered_writer_partitions_by_date_and_sorts_newest_first(spark):
    path = os.path.join(checkpoint_dir(spark, "test-clustered"), "history")
    h = fx.history(spark, SF001)
    state.write_clustered(h, path, partitions=4)
    back = spark.read.parquet(path)
    assert back.count() == h.count()
    assert "status_date" in back.columns
    one = state.clustered_history(back, "tenant-2", "n-7").collect()
    assert [r["seq"] for r in one] == sorted([r["seq"] for r in one], reverse=True) and len(one) == 4


def _fails_once_after(sink, batch):
    """The sink, but its first run of ``batch`` raises after all its writes; the run is repeated from the checkpoint."""
    failed = set()

    def run(df, batch_id):
        sink(df, batch_id)
        if batch_id == batch and batch_id not in failed:
            failed.add(batch_id)
            raise RuntimeError("lost after the writes of the batch")

    run.failed = failed
    return run


def _run_with_a_failure(spark, name, df, make, order="time", batch=2):
    """Feed ``df`` slice by slice to ``make(base)``; the batch that fails is started again."""
    from sluice.streaming.registered import each_batch
    from sluice.streaming.harness import run_slices, wait
    start = each_batch(lambda base: _fails_once_after(make(base), batch))

    class Restarted:
        def __init__(self, stream, base):
            try:
                self.q = wait(start(stream, base))
            except Exception:
                self.q = wait(start(stream, base))

        def __getattr__(self, name):
            return getattr(self.q, name)

    base = run_slices(spark, name, df, "arrival_ts", Restarted, order)
    assert start.made["sink"].failed == {batch}
    return base


def test_rate_quota_state_reads_one_table_per_day(spark):
    """Whatever the number of batches, a day holds the newest table and the one a re-run would read."""
    from sluice.streaming.registered import _eligible
    from sluice.session import list_folder
    df = _eligible(spark, SF001).filter("arrival_ts < timestamp_ntz'2024-01-02 00:00:00'")
    base = checkpoint_dir(spark, "test-quota-days")
    sink = jobs.rate_quota_sink(os.path.join(base, "out"), os.path.join(base, "quota"), 1, 5)
    rows = df.select("tenant_id", "message_id", "arrival_ts").orderBy("arrival_ts").collect()
    assert rows
    for k in range(6):
        part = rows[k * len(rows) // 6:(k + 1) * len(rows) // 6]
        sink(spark.createDataFrame(part, "tenant_id string, message_id long, arrival_ts timestamp_ntz"), k)
    for day in list_folder(spark, os.path.join(base, "quota")):
        assert len(list_folder(spark, os.path.join(base, "quota", day))) <= 2


def test_rate_quota_stream_survives_a_failed_batch(spark):
    """T01 + T06: a batch fails after writing its output and state; re-run, it matches the batch answer."""
    from sluice.operators import admission as adm
    from sluice.streaming.registered import _eligible
    base = _run_with_a_failure(spark, "rate-restart", _eligible(spark, SF001), lambda base: jobs.rate_quota_sink(
        os.path.join(base, "out"), os.path.join(base, "quota"), 1, 5))
    got = {r["message_id"]: (r["rate_ok"], r["quota_count"], r["quota_ok"])
           for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    want_df = adm.rate_and_quota(_eligible(spark, SF001).withColumn("eligible", F.lit(True)), 1, 5)
    want = {r["message_id"]: (r["rate_ok"], r["quota_count"], r["quota_ok"]) for r in want_df.collect()}
    assert got == want


def test_dedup_stream_survives_a_failed_batch(spark, duck001):
    """T02 + T06: claims of a batch that runs twice are the same, and unkeyed rows are never dropped."""
    from __spark_entry__ import oracle_sql
    from sluice.streaming.registered import _eligible
    from tests.compare_util import compare
    base = _run_with_a_failure(spark, "dedup-restart", _eligible(spark, SF001), lambda base: jobs.dedup_sink(
        os.path.join(base, "out"), os.path.join(base, "claims"), lambda: fx.claims(spark, SF001)))
    got = spark.read.parquet(os.path.join(base, "out")).drop("batch_id")
    ok, msg = compare(got, duck001, oracle_sql()["stream_dedup"])
    assert ok, msg
    assert got.filter("idem_key is null").count() > 0


def test_retry_stream_survives_a_failed_batch(spark, duck001):
    """T03 + T06: waiting retries survive a failed batch; rows come in mixed order and none is lost."""
    from __spark_entry__ import oracle_sql
    from sluice.streaming.registered import batches_in
    from tests.compare_util import compare
    sinks = []

    def make(base):
        sinks.append(jobs.retry_sink(os.path.join(base, "out"), os.path.join(base, "pending")))
        return sinks[-1]

    base = _run_with_a_failure(spark, "retry-restart", fx.consumed(spark, SF001), make, order="mixed")
    sinks[-1].drain(spark, batches_in(base))
    got = spark.read.parquet(os.path.join(base, "out")).select("message_id", "tenant_id", "attempt", "status")
    ok, msg = compare(got, duck001, oracle_sql()["stream_retry"])
    assert ok, msg


def test_retry_waits_its_backoff(spark):
    """Attempts take place at 250, 500 and 1,000 ms after one another, and not before their time has come."""
    base = checkpoint_dir(spark, "test-backoff")
    out = os.path.join(base, "out")
    sink = jobs.retry_sink(out, os.path.join(base, "pending"))
    schema = "message_id long, tenant_id string, retry_count int, simulate_fail boolean, received_ok boolean, delivered_ok boolean, push_ok boolean, seen_ms long"
    row = lambda i, t, fail=True: (i, "t", 0, fail, True, True, True, t)
    sink(spark.createDataFrame([row(1, 1000)], schema), 0)
    sink(spark.createDataFrame([row(2, 1300, False), row(3, 100, True)], schema), 1)  # message 3 is out of order
    sink.drain(spark, 2)
    got = [(r["batch_id"], r["message_id"], r["attempt"], r["status"], r["at_ms"]) for r in spark.read.parquet(out).collect()]
    s, d = "retry_scheduled", "dlq"
    assert sorted(got) == sorted([(0, 1, 1, s, 1000), (1, 1, 2, s, 1250), (1, 2, 0, "delivered", 1300), (1, 3, 1, s, 100), (1, 3, 2, s, 350), (1, 3, 3, s, 850),
                                  (2, 1, 3, s, 1750), (2, 1, 4, d, 2750), (2, 3, 4, d, 1850)])


def test_late_rows_are_counted_and_kept(spark):
    """A row far behind is late; it enters the totals."""
    base = checkpoint_dir(spark, "test-late")
    rows = jobs.with_event_time(fx.requests(spark, SF001).filter(F.length("content") > 0).select("message_id", "tenant_id", "arrival_ts"))
    sink = jobs.usage_sink(os.path.join(base, "out"), os.path.join(base, "clock"))
    first = rows.orderBy("arrival_ts").limit(1)
    sink(rows.join(first, "message_id", "left_anti"), 0)
    sink(first, 1)
    got = jobs.read_usage(spark, os.path.join(base, "out"))
    assert got.agg(F.sum("seen"), F.sum("late")).first()[:] == (rows.count(), 1)


def test_a_session_that_appears_mid_stream_is_matched(spark):
    """The session table is read anew for every micro-batch."""
    base = checkpoint_dir(spark, "test-sessions")
    table = os.path.join(base, "sessions")
    schema = "session_id long, tenant_id string, channel string"
    spark.createDataFrame([(1, "t", "c")], schema).write.mode("append").parquet(table)
    sink = jobs.fan_out_sink(os.path.join(base, "out"), lambda: spark.read.parquet(table))
    messages = spark.createDataFrame([(7, "t", "c")], "message_id long, tenant_id string, channel string")
    sink(messages, 0)
    spark.createDataFrame([(2, "t", "c")], schema).write.mode("append").parquet(table)
    sink(messages, 1)
    got = {(r["batch_id"], r["session_id"]) for r in spark.read.parquet(os.path.join(base, "out")).collect()}
    assert got == {(0, 1), (1, 1), (1, 2)}


def test_a_run_that_is_cut_off_raises(spark):
    from sluice.streaming.harness import read_files_stream, run_to_end, scratch
    base = scratch(spark, "cut-off")
    spark.range(10).write.parquet(os.path.join(base, "in"))
    s = read_files_stream(spark, os.path.join(base, "in"), spark.range(1).schema)

    def slow(batch, batch_id):
        import time
        time.sleep(5)

    with pytest.raises(TimeoutError):
        run_to_end(s.writeStream.foreachBatch(slow).option("checkpointLocation", os.path.join(base, "ck")), timeout_s=1)


def test_fallback_takes_over_on_storage_errors_only(spark):
    """An unreachable store goes to the fallback; any other failure is raised."""
    base = checkpoint_dir(spark, "test-fallback")
    paths = {t: os.path.join(base, t) for t in ("history", "audit", "dlq", "retry", "metrics", "state")}
    batch = fx.consumed(spark, SF001).limit(50)
    refused = {**paths, "history": "unreachable-store://primary/history"}
    jobs.status_fan_write(refused, fallback={"history": os.path.join(base, "history-2")})(batch, 0)
    assert {r["sink"] for r in spark.read.parquet(os.path.join(base, "history-2")).collect()} == {"fallback"}
    with pytest.raises(Exception):
        jobs.status_fan_write(paths, fallback={"history": os.path.join(base, "history-3")})(batch.withColumn("retry_count", F.expr("1 div (message_id - message_id)")), 1)
    assert not os.path.exists(os.path.join(base, "history-3"))


def test_scratch_needs_a_shared_folder_off_local_masters():
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        checkpoint_dir(Session())
