"""Failed checks, log lines, purge, point reads, audit files, stored sketches and start positions."""

import datetime as dt
import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from sluice import queries
from sluice.operators import metrics, ordering, records, state
from sluice.plans.admission import admission_decisions
from sluice.session import checkpoint_dir, list_folder, rename_folder
from sluice.sources import fixtures as fx
from sluice.sources import streams
from tests.conftest import SF001, SF01
from tests.sim import load_inputs, simulate


def folder(spark, name):
    return checkpoint_dir(spark, f"test-{name}-{uuid.uuid4().hex[:8]}")


@pytest.mark.parametrize("params", [(2, 40, 3000, 800), (0, 0, 0, 0), (1, 0, 500, 0), (3, 5, 0, 100)])
def test_failed_checks_equal_the_sequential_model(spark, duck01, params):
    """Row by row: a failed check is a 503 where it happens and uses nothing up."""
    rows, claims, retry = load_inputs(duck01)
    moduli = {"quota": (13, 6), "main_backlog": (17, 9), "retry_backlog": (19, 11), "claim": (23, 13)}
    expected = simulate(rows, claims, retry, *params, publish=True, made=lambda step, r: r["message_id"] % moduli[step][0] != moduli[step][1])
    flags = {f"{s}_made": F.col("message_id") % m != k for s, (m, k) in moduli.items()}
    got = {r.message_id: (r.reason, r.quota_count if params[1] > 0 else None, r.canonical_id, r.http_status) for r in admission_decisions(
        fx.requests(spark, SF01).withColumns(flags), fx.claims(spark, SF01), fx.retry_entries(spark, SF01), *params, publish="publish_ok",
        checks={s: f"{s}_made" for s in moduli}).collect()}
    assert {k: v[:3] for k, v in got.items()} == expected
    failed = {v[0] for v in got.values() if v[0].endswith("_check_failed") or v[0] == "idempotency_claim_failed"}
    on = {"quota_check_failed": params[1], "backpressure_check_failed": params[2], "retry_backpressure_check_failed": params[3], "idempotency_claim_failed": 1}
    assert failed == {k for k, v in on.items() if v > 0}
    assert all(v[3] == 503 for v in got.values() if v[0] in failed)


def test_every_reason_has_its_log_line(spark):
    lines = {r.message_id: json.loads(r.log_line) for r in queries.q_event_log_failed_checks(spark, SF01).collect()}
    outcomes = {v["outcome"] for v in lines.values()}
    assert outcomes >= {"quota_check_failed", "backpressure_check_failed", "idempotency_claim_failed", "retry_stream_backpressure", "ok"}
    lengths = [int(v["detail"].split("length=")[1]) for v in lines.values() if v["outcome"] == "retry_stream_backpressure"]
    assert lengths and min(lengths) >= 800 and len(set(lengths)) > 10
    assert all(("correlation_id" in v) == (v["outcome"] in ("ok", "duplicate_idempotency_key", "redis_publish_failed", "idempotency_claim_failed")) for v in lines.values())


def test_entries_before(spark):
    t0 = dt.datetime(2024, 1, 1, 23, 59, 58)
    entries = [t0 + dt.timedelta(milliseconds=250 * i) for i in range(40)] + [t0 - dt.timedelta(days=400), t0 + dt.timedelta(hours=30)] + [t0] * 5
    rows = [(i, t0 + dt.timedelta(milliseconds=125 * i)) for i in range(100)] + [(900, t0 - dt.timedelta(days=500)), (901, t0 + dt.timedelta(days=9))]
    got = {r.message_id: r.n_before for r in ordering.entries_before(
        spark.createDataFrame(rows, "message_id long, ts timestamp_ntz"), spark.createDataFrame([(e,) for e in entries], "entry_ts timestamp_ntz"), "ts", "entry_ts").collect()}
    assert got == {i: sum(e < t for e in entries) for i, t in rows}
    none = spark.createDataFrame([], "entry_ts timestamp_ntz")
    assert {r.n_before for r in ordering.entries_before(spark.createDataFrame(rows, "message_id long, ts timestamp_ntz"), none, "ts", "entry_ts").collect()} == {0}


def test_dispatcher_lines(spark):
    rows = [(1, "t", "c-1", 0, False, True, 1_704_067_200_005), (2, "t", "", 1, True, True, 1_704_067_200_120), (3, "t", "c-3", 3, True, True, 1_704_067_201_000),
            (4, "t", "c-4", 0, False, False, 1_704_067_201_000)]
    df = spark.createDataFrame(rows, "message_id long, tenant_id string, correlation_id string, retry_count int, simulate_fail boolean, ack_ok boolean, seen_ms long")
    got = {r.message_id: json.loads(r.log_line) for r in records.dispatch_log(df).collect()}
    base = {"service": "notification-dispatcher", "event": "notification_dispatch", "tenant_id": "t"}
    assert got == {
        1: base | {"ts": "2024-01-01T00:00:00.005Z", "outcome": "delivered", "notification_id": "1", "correlation_id": "c-1", "retry_count": 0},
        2: base | {"ts": "2024-01-01T00:00:00.120Z", "outcome": "retry_scheduled", "notification_id": "2", "reason": "simulated_failure,backoff_ms=500", "retry_count": 2},
        3: base | {"ts": "2024-01-01T00:00:01.000Z", "outcome": "dlq_routed", "notification_id": "3", "correlation_id": "c-3", "reason": "simulated_failure", "retry_count": 4}}


def files_below(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_purge_drops_days_and_rewrites_the_boundary_only(spark):
    path = folder(spark, "purge")
    h = fx.history(spark, SF001)
    state.write_clustered(h, path, buckets=2)
    before = files_below(path)
    as_of, ttl = "2024-01-31 12:00:00", 10 * 86400
    done = state.purge(spark, path, as_of, ttl)
    want = sorted(r.seq for r in state.retention(h, as_of, ttl).collect())
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == want and want
    assert done["rewritten"] == ["2024-01-21"] and done["dropped"] and max(done["dropped"]) < "2024-01-21"
    after = files_below(path)
    assert {f: t for f, t in after.items() if "2024-01-21" not in f} == {f: t for f, t in before.items() if f.split("status_date=")[1][:10] > "2024-01-21"}
    assert state.purge(spark, path, as_of, ttl) == {"dropped": [], "rewritten": []} and files_below(path) == after
    assert state.purge(spark, path, as_of, 0) == {"dropped": [], "rewritten": []}


@pytest.mark.parametrize("new_is_ready", [True, False])
def test_purge_that_was_cut_short_is_finished(spark, new_is_ready):
    """The old day was moved away and the new one not yet moved in."""
    path = folder(spark, "purge-cut")
    h = fx.history(spark, SF001)
    state.write_clustered(h, path)
    day = "status_date=2024-01-21"
    if new_is_ready:
        spark.read.parquet(os.path.join(path, day)).filter("status_ts > timestamp_ntz'2024-01-21 12:00:00'").write.parquet(os.path.join(path, "_purge_new", day))
    rename_folder(spark, os.path.join(path, day), os.path.join(path, "_purge_old", day))
    state.purge(spark, path, "2024-01-31 12:00:00", 10 * 86400)
    want = sorted(r.seq for r in state.retention(h, "2024-01-31 12:00:00", 10 * 86400).collect())
    assert sorted(r.seq for r in spark.read.parquet(path).collect()) == want
    assert not [n for n in list_folder(spark, path) if n.startswith("_purge")]


def test_point_read_opens_a_small_share_of_the_files(spark):
    path = folder(spark, "points")
    state.write_clustered(fx.history(spark, SF01), path, buckets=16)
    rows = state.point_rows(spark, path, "tenant-2", "n-7", 16)
    assert sorted(r.seq for r in rows.collect()) == [28, 29, 30, 31]
    plan = rows._jdf.queryExecution().executedPlan()
    while plan.children().size():
        plan = plan.children().head()
    rows._jdf.queryExecution().toRdd().count()
    read, every = plan.metrics().apply("numFiles").value(), len(files_below(path))
    assert 0 < read <= every / 8
    assert "PushedFilters" in plan.toString() or "PushedFilters" in rows._jdf.queryExecution().toString()
    assert state.point_rows(spark, path, "tenant-2", "none", 16).count() == 0


def test_audit_files_are_split_in_one_pass(spark):
    base = folder(spark, "audit")
    record = {"tenant_id": "t", "notification_id": "n", "status": "sent", "attempt": "3abc"}
    lines = [json.dumps({"ts": 5, "record": record}), "", "   ", "{broken", json.dumps({"ts": 6, "record": {"tenant_id": "t"}}), json.dumps({"record": {"notification_id": "n"}}), "7", "null"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(os.path.join(base, "in", "a"))
    spark.createDataFrame([(lines[0],)], "value string").coalesce(1).write.text(os.path.join(base, "in", "b"))
    good, bad = records.audit_split(spark, os.path.join(base, "in"), os.path.join(base, "out"))
    assert [(r.ts, r.tenant_id, r.notification_id, r.status, r.attempt) for r in good.collect()] == [(5, "t", "n", "sent", 3)] * 2
    assert sorted(r.line for r in bad.collect()) == sorted(lines[3:])
    assert good.select("file").distinct().count() == 2 and all("/in/a/" in r.file for r in bad.collect())
    history, rest = records.audit_split(spark, os.path.join(base, "in"), os.path.join(base, "out-2"), need_id=False)
    assert history.count() == 3 and rest.count() == 4


def test_sketches_are_within_their_error_and_merge(spark):
    rows = fx.consumed(spark, SF01).select("tenant_id", "arrival_ts", "duration_ms")
    odd = rows.unionByName(spark.createDataFrame([("odd", dt.datetime(2024, 1, 1), v) for v in (None, 0, -5, 1, 10 ** 12)], "tenant_id string, arrival_ts timestamp_ntz, duration_ms long"))
    sketches = metrics.latency_sketches(odd)
    got = {r.tenant_id: r for r in metrics.sketch_quantiles(sketches, [0.5, 0.95, 0.99]).collect()}
    values = {}
    for r in odd.collect():
        if r.duration_ms is not None:
            values.setdefault(r.tenant_id, []).append(r.duration_ms)
    for tenant, v in values.items():
        v.sort()
        for p in (0.5, 0.95, 0.99):
            exact = max(0, v[int(p * (len(v) - 1))])
            assert abs(got[tenant][f"p{int(p * 100)}"] - exact) <= metrics.SKETCH_ERROR * exact + 1e-9
        assert got[tenant].messages == len(v)
    early, late = sketches.filter("hour < '2024-01-10'"), sketches.filter("hour >= '2024-01-10'")
    again = {r.tenant_id: r for r in metrics.sketch_quantiles(early.unionByName(late), [0.5, 0.95, 0.99]).collect()}
    assert again == got and early.count() and late.count()


def test_a_new_query_starts_at_latest_and_a_known_one_resumes(spark):
    base = folder(spark, "latest")
    inp, checkpoint, out = (os.path.join(base, n) for n in ("in", "checkpoint", "out"))
    schema = "id long"
    put = lambda lo, hi: spark.range(lo, hi).coalesce(1).write.mode("append").parquet(inp)

    def run():
        stream = streams.stream_read(spark, inp, spark.createDataFrame([], schema).schema)
        new = streams.start_at_latest(stream, checkpoint)
        (stream.writeStream.foreachBatch(lambda b, k: b.write.mode("overwrite").parquet(os.path.join(out, f"batch_id={k}")))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
        return new

    seen = lambda: sorted(r.id for r in spark.read.schema(schema).parquet(out).collect()) if os.path.isdir(out) else []
    put(0, 10)
    assert run() is True and seen() == []  # what lay there before the first start is skipped
    put(10, 13)
    assert run() is False and seen() == [10, 11, 12]
    put(13, 15)
    put(15, 16)
    assert run() is False and seen() == [10, 11, 12, 13, 14, 15]
