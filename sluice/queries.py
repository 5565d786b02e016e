"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

Each one reads the given tables (through the fixture views) and runs one
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from sluice.operators import admission as adm
from sluice.operators import dispatch as dsp
from sluice.operators import fanout, ledger, metrics, records, validation
from sluice.operators import state
from sluice.plans.admission import admission_decisions
from sluice.plans import audit as audit_report
from sluice.plans.dispatch import dispatch_step
from sluice.registry import REGISTRY, register  # noqa: F401
from sluice.session import checkpoint_dir, delete_on_exit, materialize
from sluice.sources import fixtures as fx
from sluice.sources import streams

# Threshold set used by the registered admission queries (FIXTURES.md, row 2):
# 1 request/minute, 50/day, main backlog 3,000, retry backlog off.
C01_PARAMS = dict(limit_per_minute=1, daily_quota=50, main_backlog=3000, retry_backlog=0, publish="publish_ok")


# ---- W04-W06, L01-L03, T11 ------------------------------------------------

@register("latest_state")
def q_latest_state(spark, sf_dir):
    """Newest status record per (tenant, notification)."""
    h = fx.history(spark, sf_dir)
    return state.latest_state(h).select("tenant_id", "notification_id", "status", "attempt",
                                        "seq", "status_ts", "error")


@register("admission_decisions")
def q_admission(spark, sf_dir):
    """Admission decision of every request."""
    return admission_decisions(fx.requests(spark, sf_dir), fx.claims(spark, sf_dir),
                               fx.retry_entries(spark, sf_dir), **C01_PARAMS)


# ---- F01, W01-W03, J04, W07, P02-P04 ---------------------------------------

def _eligible_requests(spark, sf_dir):
    df = adm.normalise_request(fx.requests(spark, sf_dir))
    df = adm.content_required(df)
    df = adm.resolve_tenant(df)
    return df.withColumn("eligible", F.col("content_ok") & F.col("auth_reason").isNull())


@register("content_required")
def q_content_required(spark, sf_dir):
    """requests refused for missing or empty content."""
    df = adm.content_required(fx.requests(spark, sf_dir))
    return df.select("message_id", "tenant_id", "content_ok")


@register("rate_limit")
def q_rate_limit(spark, sf_dir):
    """First request per (tenant, minute) passes, the rest are limited."""
    df = adm.rate_and_quota(_eligible_requests(spark, sf_dir), 1, 0)
    return df.select("message_id", "tenant_id", "rank_in_minute", "rate_ok")


@register("daily_quota")
def q_daily_quota(spark, sf_dir):
    """Daily counter over rate-passed rows (2/minute, 40/day)."""
    df = adm.rate_and_quota(_eligible_requests(spark, sf_dir), 2, 40)
    return df.select("message_id", "tenant_id", "quota_count", F.col("quota_ok").alias("survivor"))


@register("first_claim")
def q_first_claim(spark, sf_dir):
    """First request per (tenant, idempotency key) wins."""
    df = adm.first_claim(_eligible_requests(spark, sf_dir), eligible="eligible")
    return df.select("message_id", "tenant_id", "idem_key", "winner_id",
                     (F.col("winner_id") == F.col("message_id")).alias("is_first"))


@register("idempotency_claim")
def q_idempotency_claim(spark, sf_dir):
    """Claim against prior claims plus first-wins in the batch."""
    df = adm.idempotency_claim(_eligible_requests(spark, sf_dir), fx.claims(spark, sf_dir),
                               eligible="eligible")
    return df.select("message_id", "tenant_id", "idem_key", "claimed", "duplicate", "canonical_id")


@register("backlog_gate")
def q_backlog_gate(spark, sf_dir):
    """Main backlog 3,000 and retry backlog 800, no rate or quota limit."""
    df = admission_decisions(fx.requests(spark, sf_dir), fx.claims(spark, sf_dir),
                             fx.retry_entries(spark, sf_dir), 0, 0, 3000, 800, keep_columns=True)
    return df.select("message_id", "gate_reason")


@register("normalise_envelope")
def q_normalise_envelope(spark, sf_dir):
    """P02 (ingress stage): user and channel defaults."""
    df = adm.normalise_request(fx.requests(spark, sf_dir))
    return df.select("message_id", "tenant_id", "user_id", "channel", "content")


@register("correlation_id")
def q_correlation_id(spark, sf_dir):
    """Header, else body, else generated correlation id."""
    return adm.normalise_request(fx.requests(spark, sf_dir)).select("message_id", "correlation_id")


@register("idempotency_key")
def q_idempotency_key(spark, sf_dir):
    """Idempotency key, blank = none."""
    return adm.normalise_request(fx.requests(spark, sf_dir)).select("message_id", "idem_key")


# ---- C02, F07, F08, P08, P09, S08 ------------------------------------------

DUE_AT_MS = 1_705_276_800_000  # 2024-01-15 00:00:00 UTC


@register("dispatch_step")
def q_dispatch_step(spark, sf_dir):
    """Outcome of one dispatcher pass per consumed row."""
    return dispatch_step(fx.consumed(spark, sf_dir)).outcomes


@register("failure_reason")
def q_failure_reason(spark, sf_dir):
    """failure reason of each consumed row."""
    return dsp.failure_reason(fx.consumed(spark, sf_dir)).select("message_id", "failure_reason")


@register("status_expand")
def q_status_expand(spark, sf_dir):
    """Status rows written for each consumed row."""
    return dsp.status_expand(fx.consumed(spark, sf_dir)).select(
        "message_id", "tenant_id", "correlation_id", "step", "status", "attempt", "error")


@register("retry_schedule")
def q_retry_schedule(spark, sf_dir):
    """Rows re-published to the retry stream with their backoff."""
    return dsp.retry_schedule(fx.consumed(spark, sf_dir)).select(
        "message_id", "previous_stream_id", "retry_count", "retry_backoff_ms",
        "next_attempt_at_ms", "retry_reason")


@register("dlq_write")
def q_dlq_write(spark, sf_dir):
    """Dead-letter rows with failure reason and final retry count."""
    return dsp.dlq_rows(fx.consumed(spark, sf_dir)).select(
        "message_id", "tenant_id", "retry_count", "failure_reason", "original_stream_id",
        "final_retry_count")


@register("due_retries")
def q_due_retries(spark, sf_dir):
    """rows ready at 2024-01-15 00:00 UTC (5 s wait cap)."""
    return dsp.due_retries(fx.consumed(spark, sf_dir), DUE_AT_MS).select(
        "message_id", "source_stream", "due_at_ms")


# ---- W05, W06, L01-L03, T11, W08, A11 --------------------------------------

@register("delivery_history")
def q_delivery_history(spark, sf_dir):
    """Newest 20 status rows of every tenant."""
    return state.delivery_history(fx.history(spark, sf_dir), 20)


@register("pk_collapse")
def q_pk_collapse(spark, sf_dir):
    """History as stored under a (tenant, notification, hour) key, last write wins."""
    return state.pk_collapse(fx.history(spark, sf_dir), ["tenant_id", "notification_id"],
                             grain="hour").select("tenant_id", "notification_id", "pk_ts", "seq", "status")


@register("dlq_newest")
def q_dlq_newest(spark, sf_dir):
    """Newest 50 dead letters."""
    return state.dlq_newest(fx.dead_letters(spark, sf_dir), 50).select(
        "message_id", "tenant_id", "arrival_ts", "failure_reason")


@register("latest_entry")
def q_latest_entry(spark, sf_dir):
    """Newest entry of each stream."""
    return state.latest_entry(fx.consumed(spark, sf_dir)).select("source_stream", "message_id", "arrival_ts")


@register("clustered_history")
def q_clustered_history(spark, sf_dir):
    """Full history of notification n-7 of tenant-2, newest first."""
    return state.clustered_history(fx.history(spark, sf_dir), "tenant-2", "n-7")


@register("retention")
def q_retention(spark, sf_dir):
    """Status rows alive on 2024-01-31 under a 10-day TTL."""
    return state.retention(fx.history(spark, sf_dir), "2024-01-31 00:00:00", 10 * 86400).select(
        "tenant_id", "notification_id", "seq", "status_ts")


@register("retry_chain_step")
def q_retry_chain_step(spark, sf_dir):
    """Step, gap and previous status inside each correlation chain."""
    return metrics.retry_chain_step(fx.history(spark, sf_dir))


@register("correlation_trace")
def q_correlation_trace(spark, sf_dir):
    """Per correlation id: records, attempts, first/last status and time."""
    return metrics.correlation_trace(fx.history(spark, sf_dir))


# ---- J01-J03, A06 -----------------------------------------------------------

def _messages(spark, sf_dir):
    return fx.consumed(spark, sf_dir).select("message_id", "tenant_id", "channel", "arrival_ts")


@register("fan_out")
def q_fan_out(spark, sf_dir):
    """One row per (message, subscribed session)."""
    return fanout.fan_out(_messages(spark, sf_dir), fx.sessions(spark, sf_dir)).select(
        "message_id", "session_id", "tenant_id", "channel")


@register("fan_out_counts")
def q_fan_out_counts(spark, sf_dir):
    """Clients reached per message, 0 included (no sessions for its (tenant, channel))."""
    return fanout.fan_out_counts(_messages(spark, sf_dir), fx.sessions(spark, sf_dir)).select(
        "message_id", "tenant_id", "channel", "clients")


@register("fan_out_as_of")
def q_fan_out_as_of(spark, sf_dir):
    """Sessions live when the message is delivered."""
    return fanout.fan_out_as_of(_messages(spark, sf_dir), fx.sessions(spark, sf_dir)).select(
        "message_id", "session_id", "arrival_ts")


@register("active_sessions")
def q_active_sessions(spark, sf_dir):
    """Open sessions at every hour where the count changes."""
    return fanout.active_sessions(fx.sessions(spark, sf_dir))


# ---- J05-J09, S02 -----------------------------------------------------------

@register("idempotency_release")
def q_idempotency_release(spark, sf_dir):
    """Release requests and whether each removed its claim."""
    _, results = ledger.idempotency_release(fx.claims(spark, sf_dir), fx.releases(spark, sf_dir))
    return results.select("tenant_id", "idempotency_key", "notification_id", "released")


@register("pending_entries")
def q_pending_entries(spark, sf_dir):
    """Read but not acknowledged."""
    return ledger.pending_entries(fx.reads(spark, sf_dir), fx.acks(spark, sf_dir)).select(
        "source_stream", "message_id")


@register("stream_state_reconcile")
def q_reconcile(spark, sf_dir):
    """Stream entries vs persisted state."""
    c = fx.consumed(spark, sf_dir).select("tenant_id", "message_id", "content")
    return ledger.stream_state_reconcile(c, fx.persisted(spark, sf_dir)).select(
        "tenant_id", "message_id", "verdict")


@register("dlq_replay")
def q_dlq_replay(spark, sf_dir):
    """Newest 50 dead letters re-published to the retry stream."""
    replayed, _ = ledger.dlq_replay(fx.dead_letters(spark, sf_dir), 50)
    return replayed.select("message_id", "replayed_from", "retry_count", "failure_reason",
                           "correlation_id", "source_stream")


@register("retry_lineage")
def q_retry_lineage(spark, sf_dir):
    """Each retry entry linked to the entry it came from."""
    return ledger.retry_lineage(fx.consumed(spark, sf_dir)).select(
        "message_id", "previous_stream_id", "parent_ts", "parent_retry_count", "parent_stream", "parent_missing")


@register("main_retry_union")
def q_main_retry_union(spark, sf_dir):
    """Main and retry entries read as one tagged input."""
    c = fx.consumed(spark, sf_dir).drop("source_stream")
    u = streams.union_streams(c.filter(F.col("retry_count") == 0), c.filter(F.col("retry_count") > 0))
    return u.select("message_id", "source_stream", "retry_count")


# ---- A01-A05, A07-A10 -------------------------------------------------------

@register("admission_counters")
def q_admission_counters(spark, sf_dir):
    """Ingress counters per tenant and in total."""
    return metrics.admission_counters(q_admission(spark, sf_dir))


@register("dispatch_counters")
def q_dispatch_counters(spark, sf_dir):
    """Dispatcher counters per tenant and in total."""
    return metrics.dispatch_counters(fx.consumed(spark, sf_dir))


@register("processing_duration")
def q_processing_duration(spark, sf_dir):
    """Duration sum, count and mean per tenant and in total."""
    return metrics.processing_duration(fx.consumed(spark, sf_dir))


@register("stream_length")
def q_stream_length(spark, sf_dir):
    """Entries in the main, retry and dead-letter streams."""
    c = fx.consumed(spark, sf_dir).select("source_stream", "message_id")
    d = fx.dead_letters(spark, sf_dir).select("source_stream", "message_id")
    return metrics.stream_length(c.unionByName(d))


@register("consumer_lag")
def q_consumer_lag(spark, sf_dir):
    """Lag per stream and in total."""
    pend = ledger.pending_entries(fx.reads(spark, sf_dir), fx.acks(spark, sf_dir))
    return metrics.consumer_lag(fx.reads(spark, sf_dir), fx.group_positions(spark, sf_dir), pend)


@register("tenant_minute_usage")
def q_tenant_minute_usage(spark, sf_dir):
    """Per tenant and minute: seen, allowed (1/minute), limited."""
    return metrics.tenant_minute_usage(_eligible_requests(spark, sf_dir), 1)


@register("tenant_daily_usage")
def q_tenant_daily_usage(spark, sf_dir):
    """Per tenant and day: quota counter and over-quota count (1/minute, 50/day)."""
    ranked = adm.rate_and_quota(_eligible_requests(spark, sf_dir), 1, 0)
    return metrics.tenant_daily_usage(ranked, 50)


@register("duplicate_audit")
def q_duplicate_audit(spark, sf_dir):
    """(tenant, idempotency key) pairs seen other than exactly once."""
    return metrics.duplicate_audit(adm.normalise_request(fx.requests(spark, sf_dir)))


@register("slo_report")
def q_slo_report(spark, sf_dir):
    """A10: latency percentiles, success rate and objective per tenant."""
    pend = ledger.pending_entries(fx.reads(spark, sf_dir), fx.acks(spark, sf_dir))
    return metrics.slo_report(fx.consumed(spark, sf_dir), pending=pend)


# ---- F02-F06, F09 -----------------------------------------------------------

def _audited_requests(spark, sf_dir):
    df = fx.authed_requests(spark, sf_dir)
    return validation.token_audit(df, fx.TOKEN_SECRET)


@register("token_audit")
def q_token_audit(spark, sf_dir):
    """verdict of every bearer token (HS256, 60 s skew)."""
    t = validation.token_audit(fx.tokens(spark, sf_dir), fx.TOKEN_SECRET)
    return t.select("message_id", "token_status", "token_error", "token_tenant")


@register("resolve_tenant")
def q_resolve_tenant(spark, sf_dir):
    """tenant from a valid token, else from the body; invalid token -> 401."""
    df = adm.resolve_tenant(_audited_requests(spark, sf_dir), require_auth=False)
    return df.select("message_id", "tenant_id", "auth_reason")


@register("tenant_scope")
def q_tenant_scope(spark, sf_dir):
    """read scope of each request for the tenant it asks about."""
    df = _audited_requests(spark, sf_dir).withColumnRenamed("tenant_id", "asked_tenant")
    return validation.tenant_scope(df).select("message_id", "asked_tenant", "scope", "scope_status")


@register("required_fields")
def q_required_fields(spark, sf_dir):
    """storage request validation by kind."""
    return validation.required_fields(fx.store_records(spark, sf_dir)).select(
        "record_id", "kind", "valid", "reject_reason")


@register("subscription_accept")
def q_subscription_accept(spark, sf_dir):
    """verdict of every subscription frame."""
    return validation.subscription_frames(fx.session_events(spark, sf_dir)).select(
        "session_id", "seq", "verdict")


@register("route_requests")
def q_route_requests(spark, sf_dir):
    """route, status, id, tenant and limit of every access-log request."""
    return validation.route_requests(fx.access_log(spark, sf_dir)).select(
        "request_id", "route", "http_status", "resource_id", "tenant_id", "limit")


# ---- P01, P05-P07, S03, S06, S09, C03 ---------------------------------------

@register("parse_payload")
def q_parse_payload(spark, sf_dir):
    """JSON status payloads -> typed columns, broken lines flagged."""
    return records.parse_payload(fx.payload_lines(spark, sf_dir)).select(
        "seq", "valid", "tenant_id", "notification_id", "status", "attempt", "error")


@register("pairs_to_map")
def q_pairs_to_map(spark, sf_dir):
    """key/value arrays -> maps (last value wins, odd key dropped), one row per entry."""
    m = fx.kv_arrays(spark, sf_dir).select("event_id", records.pairs_to_map("arr").alias("m"))
    return m.select("event_id", F.explode("m").alias("key", "value"))


@register("status_record")
def q_status_record(spark, sf_dir):
    """Status JSON body of every status row of a dispatcher pass."""
    rows = dsp.status_expand(fx.consumed(spark, sf_dir))
    return rows.select("message_id", "step", records.status_record(rows).alias("body"))


@register("audit_details")
def q_audit_details(spark, sf_dir):
    """Audit detail text of every status record."""
    h = fx.history(spark, sf_dir)
    return h.select("seq", records.audit_details(h).alias("details"))


@register("audit_scan")
def q_audit_scan(spark, sf_dir):
    """Audit lines -> records (blank and broken lines skipped)."""
    return records.audit_parse(fx.audit_lines(spark, sf_dir)).select(
        "ts", "tenant_id", "notification_id", "status", "attempt", "error")


@register("audit_append")
def q_audit_append(spark, sf_dir):
    """The audit line written for every status record."""
    h = fx.history(spark, sf_dir)
    return h.select("seq", records.audit_line(h).alias("value"))


@register("event_log")
def q_event_log(spark, sf_dir):
    """JSON log row per logged admission decision."""
    d = admission_decisions(fx.requests(spark, sf_dir), fx.claims(spark, sf_dir),
                            fx.retry_entries(spark, sf_dir), keep_columns=True, **C01_PARAMS)
    return records.event_log(d, main_backlog=C01_PARAMS["main_backlog"], retry_entries=fx.retry_entries(spark, sf_dir))


# All checks on, and for fixed moduli of the id one of the checks cannot be made.
CHECKED_PARAMS = dict(limit_per_minute=2, daily_quota=40, main_backlog=3000, retry_backlog=800, publish="publish_ok")
UNMADE = {"quota": (223, 6), "main_backlog": (227, 9), "retry_backlog": (229, 11), "claim": (233, 13)}


def _with_failed_checks(spark, sf_dir, **how):
    flags = {f"{step}_made": F.col("message_id") % m != k for step, (m, k) in UNMADE.items()}
    return admission_decisions(fx.requests(spark, sf_dir).withColumns(flags), fx.claims(spark, sf_dir), fx.retry_entries(spark, sf_dir),
                               checks={step: f"{step}_made" for step in UNMADE}, **CHECKED_PARAMS, **how)


@register("admission_failed_checks")
def q_admission_failed_checks(spark, sf_dir):
    """C01 where some quota, backlog and claim checks fail: 503, and no counter, stream or key is used."""
    return _with_failed_checks(spark, sf_dir)


@register("admission_failed_counters")
def q_admission_failed_counters(spark, sf_dir):
    """A01 over the same: failed checks are rejections, but neither rate-limited nor backpressure."""
    return metrics.admission_counters(_with_failed_checks(spark, sf_dir))


@register("event_log_failed_checks")
def q_event_log_failed_checks(spark, sf_dir):
    """S09 over the same: a line for every failed check, and the retry stream's length where it refuses."""
    d = _with_failed_checks(spark, sf_dir, keep_columns=True)
    return records.event_log(d, main_backlog=CHECKED_PARAMS["main_backlog"], retry_entries=fx.retry_entries(spark, sf_dir))


@register("dispatch_log")
def q_dispatch_log(spark, sf_dir):
    """S09 (dispatcher): JSON log row per message whose last step worked."""
    return records.dispatch_log(fx.consumed(spark, sf_dir))


POINT_BUCKETS = 16


def _clustered(spark, sf_dir):
    path = checkpoint_dir(spark, os.path.join("tables", f"clustered-{uuid.uuid4().hex}"))
    state.write_clustered(fx.history(spark, sf_dir), path, buckets=POINT_BUCKETS)
    delete_on_exit(spark, path)
    return path


@register("clustered_point_read")
def q_clustered_point_read(spark, sf_dir):
    """L03 on the table that its writer makes: one (tenant, notification) through folder and row-group pruning."""
    rows = state.point_rows(spark, _clustered(spark, sf_dir), "tenant-2", "n-7", POINT_BUCKETS)
    return rows.orderBy(F.col("status_ts").desc(), F.col("seq").desc())


@register("purged_history")
def q_purged_history(spark, sf_dir):
    """T11 as a job: the clustered table after expired days are dropped and the boundary day is rewritten."""
    path = _clustered(spark, sf_dir)
    state.purge(spark, path, "2024-01-31 00:00:00", 10 * 86400)
    return spark.read.parquet(path).select("tenant_id", "notification_id", "seq", "status_ts")


@register("audit_files")
def q_audit_files(spark, sf_dir):
    """S03 on files: records and quarantined lines of every folder of audit files, from one pass."""
    base = checkpoint_dir(spark, os.path.join("tables", f"audit-{uuid.uuid4().hex}"))
    fx.audit_lines(spark, sf_dir).select("value", (F.col("seq") % 4).alias("part")).write.partitionBy("part").text(os.path.join(base, "lines"))
    delete_on_exit(spark, base)
    good, bad = records.audit_split(spark, os.path.join(base, "lines"), os.path.join(base, "split"))
    kinds = good.select("file", F.lit(1).alias("good")).unionByName(bad.select("file", F.lit(0).alias("good")))
    return kinds.groupBy(F.regexp_extract("file", "part=(\\d+)", 1).cast("long").alias("part")).agg(
        F.count_if(F.col("good") == 1).alias("records"), F.count_if(F.col("good") == 0).alias("quarantined"))


@register("slo_sketches")
def q_slo_sketches(spark, sf_dir):
    """A10 at scale: quantiles (microseconds) from stored hourly sketches, within 1 % of the exact ones."""
    sketches = materialize(metrics.latency_sketches(fx.consumed(spark, sf_dir)), "sketches")
    q = metrics.sketch_quantiles(sketches, [0.5, 0.95, 0.99])
    return q.select("tenant_id", F.col("messages").cast("long").alias("messages"),
                    *[F.round(F.col(p) * 1000).cast("long").alias(f"{p}_us") for p in ("p50", "p95", "p99")])


@register("tenant_audit_report")
def q_tenant_audit_report(spark, sf_dir):
    """Per tenant and status: records, newest time, dead-letter share; totals."""
    return audit_report.tenant_audit_report(fx.history(spark, sf_dir))


@register("normalise_stages")
def q_normalise_stages(spark, sf_dir):
    """P02 (dispatch, storage and read stages): defaults over records with gaps."""
    h = fx.gapped_records(spark, sf_dir)
    stages = [records.normalise(h, stage).withColumn("stage", F.lit(stage)) for stage in ("dispatch", "storage", "read")]
    return stages[0].unionByName(stages[1]).unionByName(stages[2])


@register("admission_with_tokens")
def q_admission_with_tokens(spark, sf_dir):
    """C01 with bearer tokens: a valid token names the tenant, an invalid one is a 401."""
    return admission_decisions(_audited_requests(spark, sf_dir), fx.claims(spark, sf_dir),
                               fx.retry_entries(spark, sf_dir), **C01_PARAMS)


@register("route_storage_requests")
def q_route_storage_requests(spark, sf_dir):
    """F09 (storage service): route, status, id, tenant and limit of every request."""
    return validation.route_requests(fx.storage_log(spark, sf_dir), service="storage").select(
        "request_id", "route", "http_status", "resource_id", "tenant_id", "limit")
