"""Streams whose state is bounded: intervals, windows, the claim table, counters that expire, lag."""

import os
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluice.operators import fanout
from sluice.session import checkpoint_dir, list_folder
from sluice.sources import fixtures as fx
from sluice.streaming import claims, intervals, jobs, windows
from tests.conftest import SF001

T0 = datetime(2024, 1, 1)
MESSAGES = "message_id long, tenant_id string, channel string, arrival_ts timestamp_ntz"
SESSIONS = "session_id long, tenant_id string, channel string, sub_start timestamp_ntz, sub_end timestamp_ntz"


def folder(spark, name):
    return checkpoint_dir(spark, f"test-{name}-{uuid.uuid4().hex[:8]}")


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def interval_run(spark, batches, lateness_ms=600_000):
    """Feed (messages, sessions) batches; returns (base, rows held after every batch)."""
    base = folder(spark, "intervals")
    sink = intervals.as_of_sink(*(os.path.join(base, n) for n in ("out", "held", "late")), lateness_ms)
    held = []
    for k, (m, s) in enumerate(batches):
        sink(intervals.both_sides(spark.createDataFrame(m, MESSAGES), spark.createDataFrame(s, SESSIONS)), k)
        held.append({(r.side, r.message_id or r.session_id) for r in intervals.held_rows(spark, os.path.join(base, "held")).collect()})
    return base, held


def pairs_of(spark, base):
    return sorted((r.message_id, r.session_id) for r in spark.read.parquet(os.path.join(base, "out")).collect())


def test_intervals_leave_the_state_once_they_lie_behind(spark):
    """Closed intervals and old messages go as both clocks move on; an open session and what may still be met stay."""
    session = lambda i, a, b: (i, "t", "c", at(a), None if b is None else at(b))
    message = lambda i, a: (i, "t", "c", at(a))
    base, held = interval_run(spark, [
        ([message(1, 5), message(2, 30)], [session(10, 0, 20), session(11, 0, None), session(12, 25, 40)]),
        ([message(3, 60)], [session(13, 55, 58)]),
        ([message(4, 200)], [session(14, 190, 300)]),
        ([message(5, 250)], [session(15, 240, 245)])])
    assert pairs_of(spark, base) == [(1, 10), (1, 11), (2, 11), (2, 12), (3, 11), (4, 11), (4, 14), (5, 11), (5, 14)]
    assert held[0] >= {("session", 10), ("session", 11), ("message", 2)}
    assert held[1] == {("session", 11), ("session", 13), ("message", 3)}  # watermark: 55 - 10 minutes
    assert held[2] == {("session", 11), ("session", 14), ("message", 4)}
    assert held[3] == {("session", 11), ("session", 14), ("session", 15), ("message", 5)}
    assert spark.read.parquet(os.path.join(base, "late")).count() == 0


def test_sessions_that_arrive_after_their_messages(spark):
    """A message waits until no session can begin before it any more; a row behind the watermark is kept as late."""
    base, held = interval_run(spark, [
        ([(1, "t", "c", at(100))], []),
        ([], [(10, "t", "c", at(95), at(105)), (11, "t", "other", at(95), at(105))]),
        ([(2, "t", "c", at(400))], [(12, "t", "c", at(395), None)]),
        ([(3, "t", "c", at(101))], [(13, "t", "c", at(99), at(500))])])
    assert pairs_of(spark, base) == [(1, 10), (2, 12), (2, 13), (3, 13)]
    late = {(r.side, r.message_id or r.session_id) for r in spark.read.parquet(os.path.join(base, "late")).collect()}
    assert late == {("message", 3), ("session", 13)}
    assert ("message", 1) in held[1] and ("message", 1) not in held[2]


def test_interval_batch_that_runs_again(spark):
    base, _ = interval_run(spark, [([(1, "t", "c", at(5))], [(10, "t", "c", at(0), None)]), ([(2, "t", "c", at(6))], [])])
    sink = intervals.as_of_sink(*(os.path.join(base, n) for n in ("out", "held", "late")))
    sink(intervals.both_sides(spark.createDataFrame([(2, "t", "c", at(6))], MESSAGES), spark.createDataFrame([], SESSIONS)), 1)
    assert pairs_of(spark, base) == [(1, 10), (2, 10)]


def test_intervals_in_any_order_of_arrival_equal_the_batch_join(spark):
    """With enough lateness allowed, rows dealt to batches at random give J03's rows."""
    messages, sessions = fx.consumed(spark, SF001).select("message_id", "tenant_id", "channel", "arrival_ts"), fx.sessions(spark, SF001)
    both = intervals.both_sides(messages, sessions).withColumn("k", F.pmod(F.xxhash64("message_id", "session_id"), F.lit(3))).cache()
    base = folder(spark, "intervals-mixed")
    sink = intervals.as_of_sink(*(os.path.join(base, n) for n in ("out", "held", "late")), lateness_ms=10 ** 12)
    for k in range(3):
        sink(both.filter(F.col("k") == k).drop("k"), k)
    want = sorted((r.message_id, r.session_id) for r in fanout.fan_out_as_of(messages, sessions).collect())
    assert pairs_of(spark, base) == want and want


def test_open_windows_are_not_emitted_and_no_row_is_lost(spark):
    base = folder(spark, "windows")
    sink = windows.route_sink(base)

    def feed(k, minutes):
        rows = spark.createDataFrame([("t", at(m)) for m in minutes], "tenant_id string, arrival_ts timestamp_ntz")
        sink(jobs.with_event_time(rows), k)
        q = windows.start_windows(spark, base)
        q.awaitTermination()
        dropped = sum(int(o.numRowsDroppedByWatermark) for p in q.recentProgress for o in p.stateOperators)
        return dropped, {(r.minute_start - T0).seconds // 60: r.seen for r in windows.closed(spark, base).collect()}

    assert feed(0, [0.1, 0.5, 1.2, 3.0])[0] == 0
    dropped, seen = feed(1, [0.9, 10.0])  # the clock says 3 less 2: minute 0 has ended, its row is late
    assert dropped == 0 and 10 not in seen
    dropped, seen = feed(2, [9.5, 10.1, 30.0, 2.2])  # 10 less 2: minute 2 has ended, minutes 9 and 10 are open
    assert dropped == 0 and 30 not in seen and seen[0] == 2 and seen[1] == 1 and seen[3] == 1
    before = windows.closed(spark, base).count()
    windows.close_all(spark, base)
    rows = [(r.minute_start, r.tenant_id) for r in windows.closed(spark, base).collect()]
    assert len(rows) > before and len(rows) == len(set(rows)) and all(t is not None for _, t in rows)  # each window once, no marker
    total = {(r.minute_start - T0).seconds // 60: r.seen for r in windows.totals(spark, base).collect()}
    assert total == {0: 3, 1: 1, 2: 1, 3: 1, 9: 1, 10: 2, 30: 1}
    late = spark.read.schema(windows.COUNTED).parquet(os.path.join(base, "late"))
    assert late.agg(F.sum("seen")).first()[0] == 2


def test_a_routed_batch_that_runs_again_appears_once(spark):
    base = folder(spark, "windows-again")
    rows = jobs.with_event_time(spark.createDataFrame([("t", at(1)), ("t", at(2))], "tenant_id string, arrival_ts timestamp_ntz"))
    for _ in range(2):
        windows.route_sink(base)(rows, 0)
    assert spark.read.parquet(os.path.join(base, "on_time")).count() == 2
    windows.start_windows(spark, base).awaitTermination()
    windows.close_all(spark, base)
    assert windows.totals(spark, base).agg(F.sum("seen")).first()[0] == 2


REQUESTS = "message_id long, tenant_id string, idem_key string, correlation_id string, arrival_ts timestamp_ntz"


def claim_batch(spark, k, keys):
    return spark.createDataFrame([(1000 * k + i, "t", key, f"c-{k}-{i}", at(k)) for i, key in enumerate(keys)], REQUESTS)


def test_bytes_read_do_not_grow_with_the_batches(spark):
    """Every batch brings four new keys and one old one: what it reads of the claim table is its own buckets, folded now and then."""
    base = folder(spark, "claims")
    out, table = os.path.join(base, "out"), os.path.join(base, "claims")
    sink = jobs.dedup_sink(out, table, compact_every=4)
    read, whole = [], []
    for k in range(12):
        batch = claim_batch(spark, k, [f"key-{k}-{i}" for i in range(4)] + ["key-0-0"])
        wanted = [r["b"] for r in batch.select(claims.bucket_of("idem_key").alias("b")).distinct().collect()]
        size = lambda paths: sum(os.path.getsize(os.path.join(d, f)) for p in paths for d, _, fs in os.walk(p) for f in fs if f.endswith(".parquet"))
        read.append(size(claims.folders(spark, table, wanted, k)))
        whole.append(size([table]))
        sink(batch, k)
    got = {r.message_id: (r.claimed, r.duplicate, r.canonical_id) for r in spark.read.parquet(out).collect()}
    assert all(got[1000 * k + 4] == (False, True, "c-0-0") for k in range(12))
    assert all(got[1000 * k + i][0] for k in range(12) for i in range(4))
    assert max(read[6:]) < 0.5 * whole[-1] and sum(read[8:]) / 4 < 2.5 * sum(read[2:6]) / 4 and whole[-1] > 2 * whole[3]


def test_claims_on_file_enter_once_and_survive_compaction_and_reruns(spark):
    base = folder(spark, "claims-file")
    out, table = os.path.join(base, "out"), os.path.join(base, "claims")
    asked = []

    def prior():
        asked.append(1)
        return spark.createDataFrame([("t", "old", "claim-1", at(0))], claims.CLAIM_SCHEMA)

    sink = jobs.dedup_sink(out, table, prior, buckets=2, compact_every=2)
    for k in range(5):
        for _ in range(2):  # every batch runs twice
            sink(claim_batch(spark, k, ["old", f"new-{k}", "new-0", None]), k)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 20
    verdict = {r.message_id: (r.claimed, r.duplicate, r.canonical_id) for r in rows}
    assert all(verdict[1000 * k] == (False, True, "claim-1") for k in range(5))
    assert verdict[1] == (True, False, "c-0-1") and all(verdict[1000 * k + 2][1] for k in range(5))
    assert all(verdict[1000 * k + 3][:2] == (None, False) for k in range(5))
    held = claims.held(spark, table, [0, 1], 99)
    assert held.count() == held.select("tenant_id", "idempotency_key").distinct().count() == 6
    assert any(n.startswith("upto=") for b in (0, 1) for n in list_folder(spark, os.path.join(table, f"bucket={b}")))


def test_all_buckets_are_folded_in_one_job(spark):
    base = folder(spark, "claims-fold")
    table = os.path.join(base, "claims")
    rows = spark.createDataFrame([("t", f"key-{i}", f"c-{i}", at(i)) for i in range(60)], claims.CLAIM_SCHEMA)
    for k in range(3):
        claims.add(rows.filter(F.substring("idempotency_key", 5, 9).cast("int") % 3 == k), table, k, 12)
    spark.sparkContext.setJobGroup("claims-fold", "")
    claims.compact(spark, table, 3, 12)
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("claims-fold"))
    spark.sparkContext.setJobGroup("", "")
    assert 0 < jobs_run < 6
    assert all(len(claims.folders(spark, table, [b], 3)) <= 1 for b in range(12))
    assert sorted(map(tuple, claims.held(spark, table, list(range(12)), 3).collect())) == sorted(map(tuple, rows.collect()))


def test_verdicts_are_decided_by_a_task_per_core(spark):
    base = folder(spark, "claims-tasks")
    said = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(5 * cores))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # a stream's batches may run without it
    try:
        jobs.dedup_sink(os.path.join(base, "out"), os.path.join(base, "claims"))(claim_batch(spark, 0, [f"k-{i}" for i in range(300)]), 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", said)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    written = [f for f in os.listdir(os.path.join(base, "out", "batch_id=0")) if f.endswith(".parquet")]
    assert len(written) <= cores
    assert spark.read.parquet(os.path.join(base, "out")).filter("claimed").count() == 300


def test_windows_keep_state_in_a_partition_per_core(spark):
    base = folder(spark, "windows-state")
    rows = jobs.with_event_time(spark.createDataFrame([("t", at(1)), ("t", at(2))], "tenant_id string, arrival_ts timestamp_ntz"))
    windows.route_sink(base)(rows, 0)
    said = spark.conf.get("spark.sql.shuffle.partitions")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.shuffle.partitions", str(3 * cores))
    try:
        windows.start_windows(spark, base).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == str(3 * cores)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", said)
    held = [n for n in os.listdir(os.path.join(base, "checkpoint-windows", "state", "0")) if n.isdigit()]
    assert 0 < len(held) <= cores


def test_a_small_fold_leaves_a_large_snapshot_alone(spark):
    base = folder(spark, "state-folds")
    log, snap = os.path.join(base, "state"), os.path.join(base, "snapshot")
    written = []
    for k in range(12):
        rows = spark.createDataFrame([("t", m, 1, f"{k}") for m in (k, k + 1)], "tenant_id string, message_id long, step int, status string")
        jobs.append_state_delta(rows.withColumn("batch_id", F.lit(k)), log, k)
        jobs.compact_state(spark, log, snap)
        written.append(spark.read.parquet(os.path.join(snap, f"upto={k}")).count())
        assert {r.message_id: r.status for r in jobs.read_state(spark, log, snap).collect()} == {m: str(min(m, k)) for m in range(k + 2)}
    assert 1 < len(jobs._numbers(spark, snap, "upto=")) <= 4
    assert sum(written) < sum(k + 2 for k in range(12))  # every snapshot written whole


def test_counters_expire_by_event_day(spark):
    """State of days more than two behind the newest is removed; ranks are those of one run over all rows."""
    base = folder(spark, "quota-days")
    out, state = os.path.join(base, "out"), os.path.join(base, "state")
    sink = jobs.rate_quota_sink(out, state, 2, 3)
    rows = [(100 * d + i, "t", T0 + timedelta(days=d, minutes=i // 2)) for d in range(5) for i in range(8)]
    batches = [[r for r in rows if r[0] // 100 == d and r[0] % 100 < 5] + [r for r in rows if r[0] // 100 == d - 1 and r[0] % 100 >= 5] for d in range(6)]
    for k, b in enumerate(batches):  # the end of every day comes with the next one
        sink(spark.createDataFrame(b, "message_id long, tenant_id string, arrival_ts timestamp_ntz"), k)
    days = sorted(int(n[11:]) for n in list_folder(spark, state) if n.startswith("bucket_day="))
    first = 19723  # 2024-01-01
    assert days == [first + d for d in (2, 3, 4)]
    got = {r.message_id: (r.rank_in_minute, r.quota_count) for r in spark.read.parquet(out).collect()}
    assert got == {100 * d + i: (i % 2 + 1, i + 1) for d in range(5) for i in range(8)}


@pytest.mark.parametrize("key", ["stream_lag"])
def test_lag_goes_to_zero_and_counts_every_entry(spark, key):
    from __spark_entry__ import queries
    rows = sorted(queries()[key](spark, SF001).collect())
    total = fx.consumed(spark, SF001).count()
    assert [r.batch_id for r in rows] == list(range(len(rows))) and rows[-1].lag == 0
    taken = 0
    for r in rows:
        taken += r.consumed
        assert r.lag == total - taken


def test_lag_of_a_batch_that_runs_again(spark):
    base = folder(spark, "lag")
    spark.range(10).coalesce(1).write.parquet(os.path.join(base, "in", "part=0"))
    spark.range(7).coalesce(1).write.parquet(os.path.join(base, "in", "part=1"))
    first = spark.read.parquet(os.path.join(base, "in", "part=0")).select(F.col("_metadata.file_path").alias("file"))
    for _ in range(2):
        jobs.lag_sink(*(os.path.join(base, n) for n in ("in", "out", "taken")))(first, 0)
    assert [(r.consumed, r.lag) for r in spark.read.parquet(os.path.join(base, "out")).collect()] == [(10, 7)]


def test_slices_are_bounded(spark):
    from sluice.streaming import harness
    df = spark.range(400).select(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).cast("timestamp_ntz").alias("ts"))
    out = folder(spark, "slices")
    assert harness.stage_slices(df, "ts", out, rows_per_slice=1) == harness.MAX_SLICES
    assert spark.read.parquet(out).count() == 400


def test_fan_out_stream_stores_blocks_not_pairs(spark):
    """What a batch stores grows with its rows; reading makes the pairs."""
    base = folder(spark, "fan-out-blocks")
    key = [F.lit("t").alias("tenant_id"), F.lit("c").alias("channel")]
    sink = jobs.fan_out_sink(base, lambda: spark.range(300).select(F.col("id").alias("session_id"), *key), in_blocks=True)
    sink(spark.range(400).select(F.col("id").alias("message_id"), *key), 0)
    stored = spark.read.parquet(base)
    assert stored.count() == 1
    assert fanout.pairs(stored).distinct().count() == 300 * 400


def test_pairs_of_a_stored_block_are_passed_on_message_by_message(spark):
    """The explodes are in two stages of generated code; one alone holds all pairs of a block before it passes the first on."""
    import re
    base = folder(spark, "fan-out-parted")
    key = [F.lit("t").alias("tenant_id"), F.lit("c").alias("channel")]
    sink = jobs.fan_out_sink(base, lambda: spark.range(30).select(F.col("id").alias("session_id"), *key), in_blocks=True)
    sink(spark.range(40).select(F.col("id").alias("message_id"), *key), 0)
    made = fanout.pairs(spark.read.parquet(base))
    assert len({(r.message_id, r.session_id) for r in made.collect()}) == 30 * 40
    stages = re.findall(r"\*\((\d+)\) Generate ", made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])
    assert len(stages) == len(set(stages)) == 2


def test_interval_blocks_equal_the_pairs(spark):
    """J03 on streams: the blocks of all batches hold the same pairs; reading tests the exact range."""
    batches = [([(1, "t", "c", at(5)), (2, "t", "c", at(30))], [(10, "t", "c", at(0), at(20)), (11, "t", "c", at(0), None)]),
               ([(3, "t", "c", at(60))], [(12, "t", "c", at(25), at(40))])]
    base, _ = interval_run(spark, batches)
    other = folder(spark, "interval-blocks")
    sink = intervals.as_of_sink(*(os.path.join(other, n) for n in ("out", "held", "late")), in_blocks=True)
    for k, (m, s) in enumerate(batches):
        sink(intervals.both_sides(spark.createDataFrame(m, MESSAGES), spark.createDataFrame(s, SESSIONS)), k)
    got = fanout.as_of_pairs(spark.read.parquet(os.path.join(other, "out")))
    assert sorted((r.message_id, r.session_id) for r in got.collect()) == pairs_of(spark, base) == [(1, 10), (1, 11), (2, 11), (2, 12), (3, 11)]


def test_writes_of_a_batch_run_at_the_same_time(spark):
    """Neither write ends before the other has begun; a failed one is raised after the others are done."""
    import threading
    both, done = threading.Barrier(2, timeout=60), []
    jobs.together(both.wait, both.wait)
    with pytest.raises(ZeroDivisionError):
        jobs.together(lambda: 1 // 0, lambda: done.append(spark.range(3).count()))
    assert done == [3]
