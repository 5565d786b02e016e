"""Registered streaming queries.

Each feeds its input view slice by slice (see :mod:`sluice.streaming.harness`)
to a query that resumes from its checkpoint for every slice, and returns the
tables it has written, so it can be compared with the batch answer.
"""

from __future__ import annotations

import os

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.operators import admission as adm
from sluice.operators import fanout
from sluice.registry import register
from sluice.session import delete_folder, write_file
from sluice.sources import fixtures as fx
from sluice.sources.streams import stream_append
from sluice.streaming import intervals, jobs, windows
from sluice.streaming.harness import run_backlog, run_slices, wait

DISPATCH_TABLES = ("history", "audit", "audit_table", "dlq", "retry", "metrics", "state")


def each_batch(sink):
    """A ``start`` function for :func:`run_slices` around a ``foreachBatch`` sink made for the run's folder."""
    made: dict = {}

    def start(stream: DataFrame, base: str):
        made.setdefault("sink", sink(base))
        return (stream.writeStream.foreachBatch(made["sink"]).trigger(availableNow=True)
                .option("checkpointLocation", os.path.join(base, "checkpoint")).start())

    start.made = made
    return start


def _append(stream: DataFrame, base: str):
    return stream_append(stream, os.path.join(base, "out"), os.path.join(base, "checkpoint"), {"availableNow": True})


def _eligible(spark, sf_dir):
    df = adm.content_required(adm.normalise_request(fx.requests(spark, sf_dir)))
    return jobs.with_event_time(df.filter(F.col("content_ok") & F.col("tenant_id").isNotNull()))


def batches_in(base: str) -> int:
    """A batch number after every batch of a run (batches are numbered from 0, one or more for each slice)."""
    offsets = os.path.join(base, "checkpoint", "commits")
    return 1 + max(int(n) for n in jobs.list_folder(SparkSession.active(), offsets) if n.isdigit())


@register("stream_read")
def q_stream_read(spark, sf_dir):
    """S01 + S04: read the consumed stream slice by slice and append it to a sink."""
    base = run_slices(spark, "read", fx.consumed(spark, sf_dir), "arrival_ts", _append)
    return spark.read.parquet(os.path.join(base, "out")).select("message_id", "source_stream", "retry_count", "arrival_ts")


@register("stream_rate_quota")
def q_stream_rate_quota(spark, sf_dir):
    """Rate limit (2/minute) and daily quota (40) carried across micro-batches."""
    start = each_batch(lambda base: jobs.rate_quota_sink(os.path.join(base, "out"), os.path.join(base, "quota"), 2, 40))
    base = run_slices(spark, "rate-quota", _eligible(spark, sf_dir), "arrival_ts", start)
    return spark.read.parquet(os.path.join(base, "out")).select("message_id", "tenant_id", "rank_in_minute", "rate_ok",
                                                                "quota_count", "quota_ok")


@register("stream_dedup")
def q_stream_dedup(spark, sf_dir):
    """Every request's claim verdict against claims on file and those of earlier batches."""
    start = each_batch(lambda base: jobs.dedup_sink(os.path.join(base, "out"), os.path.join(base, "claims"),
                                                    lambda: fx.claims(spark, sf_dir)))
    base = run_slices(spark, "dedup", _eligible(spark, sf_dir), "arrival_ts", start)
    return spark.read.parquet(os.path.join(base, "out")).select("message_id", "tenant_id", "idem_key", "claimed", "duplicate", "canonical_id")


@register("stream_retry")
def q_stream_retry(spark, sf_dir):
    """Attempts of every message, read in mixed order, until delivered or dead-lettered."""
    start = each_batch(lambda base: jobs.retry_sink(os.path.join(base, "out"), os.path.join(base, "pending")))
    base = run_slices(spark, "retry", fx.consumed(spark, sf_dir), "arrival_ts", start, order="mixed")
    start.made["sink"].drain(spark, batches_in(base))
    return spark.read.parquet(os.path.join(base, "out")).select("message_id", "tenant_id", "attempt", "status")


@register("stream_fan_out")
def q_stream_fan_out(spark, sf_dir):
    """Arriving messages joined with the session table of the moment."""
    msgs = fx.consumed(spark, sf_dir).select("message_id", "tenant_id", "channel", "arrival_ts")
    start = each_batch(lambda base: jobs.fan_out_sink(os.path.join(base, "out"), lambda: fx.sessions(spark, sf_dir), in_blocks=True))
    base = run_slices(spark, "fan-out", msgs, "arrival_ts", start)
    return fanout.pairs(spark.read.parquet(os.path.join(base, "out"))).select("message_id", "session_id", "tenant_id", "channel")


@register("stream_usage_windows")
def q_stream_usage_windows(spark, sf_dir):
    """Per-minute request counts per tenant from rows in mixed order; late ones are counted too."""
    start = each_batch(lambda base: jobs.usage_sink(os.path.join(base, "out"), os.path.join(base, "clock")))
    base = run_slices(spark, "usage", _eligible(spark, sf_dir), "arrival_ts", start, order="mixed")
    return jobs.read_usage(spark, os.path.join(base, "out")).drop("late")


@register("stream_closed_windows")
def q_stream_closed_windows(spark, sf_dir):
    """T09 in the state store: every window once when it closes, late rows merged in on reading."""
    route = each_batch(windows.route_sink)

    def start(stream: DataFrame, base: str):
        wait(route(stream, base))
        return windows.start_windows(spark, base)

    base = run_slices(spark, "closed-windows", _eligible(spark, sf_dir), "arrival_ts", start, order="mixed")
    windows.close_all(spark, base)
    return windows.totals(spark, base)


@register("stream_fan_out_as_of")
def q_stream_fan_out_as_of(spark, sf_dir):
    """J03 on streams: arriving messages met with arriving session intervals."""
    both = intervals.both_sides(fx.consumed(spark, sf_dir), fx.sessions(spark, sf_dir))
    start = each_batch(lambda base: intervals.as_of_sink(*(os.path.join(base, n) for n in ("out", "held", "late")), in_blocks=True))
    base = run_slices(spark, "fan-out-as-of", both, "at", start)
    return fanout.as_of_pairs(spark.read.parquet(os.path.join(base, "out"))).select("message_id", "session_id", "arrival_ts")


@register("stream_lag")
def q_stream_lag(spark, sf_dir):
    """T10 per batch: entries taken and entries that still wait in the stream, while a backlog is worked off."""
    count = each_batch(lambda base: jobs.lag_sink(os.path.join(base, "in"), os.path.join(base, "out"), os.path.join(base, "taken")))
    base = run_backlog(spark, "lag", fx.consumed(spark, sf_dir), "arrival_ts",
                       lambda stream, base: count(stream.select(F.col("_metadata.file_path").alias("file")), base))
    return spark.read.parquet(os.path.join(base, "out")).select(F.col("batch_id").cast("long").alias("batch_id"), "consumed", "lag")


def losing_once(sink):
    """A sink whose every batch is lost once after its writes."""
    lost: set[int] = set()

    def run(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if batch_id not in lost:
            lost.add(batch_id)
            raise RuntimeError(f"batch {batch_id} is lost after its writes")

    return run


def restarted(start):
    """Starts a query again from its checkpoint for as long as its batches are lost."""
    def run(stream: DataFrame, base: str):
        while True:
            try:
                return wait(start(stream, base))
            except StreamingQueryException as e:
                if "is lost after its writes" not in str(e):
                    raise

    return run


def refused_at_first(start, table: str, slices: int):
    """Storage refuses a table's folder (a plain file is in its place) for the first slices of a run."""
    seen: list[str] = []

    def run(stream: DataFrame, base: str):
        folder = os.path.join(base, table)
        if not seen:
            write_file(stream.sparkSession, folder)
        elif len(seen) == slices:
            delete_folder(stream.sparkSession, folder)
        seen.append(base)
        return start(stream, base)

    return run


def _dispatch(spark, sf_dir, name: str, around=lambda start: start, wrap=lambda sink: sink) -> dict:
    """Run the dispatcher sink over the consumed stream; return the paths of its tables."""
    paths: dict = {}

    def sink(base: str):
        paths.update({t: os.path.join(base, t) for t in (*DISPATCH_TABLES, "snapshot", "history-fallback")})
        return wrap(jobs.status_fan_write({t: paths[t] for t in DISPATCH_TABLES}, fallback={"history": paths["history-fallback"]},
                                          snapshot_path=paths["snapshot"], compact_every=3))

    run_slices(spark, name, fx.consumed(spark, sf_dir), "arrival_ts", around(each_batch(sink)))
    return paths


@register("stream_status_tables")
def q_stream_status_tables(spark, sf_dir):
    """T05 + S05: latest status per message over the snapshot and the micro-batches after it."""
    paths = _dispatch(spark, sf_dir, "status")
    return jobs.read_state(spark, paths["state"], paths["snapshot"]).select("tenant_id", "message_id", "step", "status", "attempt")


@register("stream_audit_table")
def q_stream_audit_table(spark, sf_dir):
    """The audit table (P07 text) that the dispatcher stream appends."""
    paths = _dispatch(spark, sf_dir, "audit-table")
    return spark.read.parquet(paths["audit_table"]).select("tenant_id", "event_time", "event_type", "notification_id", "details")


@register("stream_dlq")
def q_stream_dlq(spark, sf_dir):
    """Dead letters written as a side output of the dispatcher stream."""
    paths = _dispatch(spark, sf_dir, "dlq")
    return spark.read.parquet(paths["dlq"]).select(
        "message_id", "tenant_id", "retry_count", "failure_reason", "original_stream_id", "final_retry_count")


@register("stream_metrics")
def q_stream_metrics(spark, sf_dir):
    """Per-batch dispatcher counters summed over the whole stream."""
    m = spark.read.parquet(_dispatch(spark, sf_dir, "metrics")["metrics"])
    return m.agg(*[F.sum(c).cast("bigint").alias(c) for c in
                   ("consumed", "delivered", "retry_scheduled", "dead_lettered", "processing_errors", "storage_write_failures",
                    "gateway_delivery_failures")])


@register("stream_recovery")
def q_stream_recovery(spark, sf_dir):
    """Every batch is lost once after its writes and run again from the checkpoint; each status row is there once."""
    paths = _dispatch(spark, sf_dir, "recovery", restarted, losing_once)
    return spark.read.parquet(paths["history"]).select(
        "message_id", "tenant_id", "correlation_id", "step", "status", "attempt", "error")


@register("sink_with_fallback")
def q_sink_with_fallback(spark, sf_dir):
    """Storage refuses the primary history for the first two slices, whose rows the fallback takes; then it works again."""
    paths = _dispatch(spark, sf_dir, "fallback", lambda start: refused_at_first(start, "history", 2))
    return spark.read.parquet(paths["history"]).unionByName(spark.read.parquet(paths["history-fallback"])).select(
        "message_id", "tenant_id", "correlation_id", "step", "status", "attempt", "error", "sink")
