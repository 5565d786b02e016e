"""Sequential request-by-request model of the ingress checks (test oracle).

Walks requests in arrival order with the service's own state: a per-tenant
minute window, a per-(tenant, day) counter, the stream lengths and the
claim table.  Used only to check the set-based Spark job.
"""

from __future__ import annotations

import bisect
import datetime as dt

EPOCH = dt.datetime(1970, 1, 1)


def _micros(ts: dt.datetime) -> int:
    return (ts - EPOCH) // dt.timedelta(microseconds=1)


def simulate(rows, claims, retry_times, limit, quota, main, retry, main_start=0, retry_start=0, publish=False, made=None):
    """``made(step, row)`` says whether a check can be made.  rows: dicts with the ``requests`` columns; returns {message_id: (reason, quota_count, canonical)}."""
    made = made or (lambda step, row: True)
    window: dict[str, list[int]] = {}
    daily: dict[tuple[str, int], int] = {}
    stored = {(c["tenant_id"], c["idempotency_key"]): c["notification_id"] for c in claims}
    retry_sorted = sorted(retry_times)
    main_len = main_start
    out = {}
    for r in sorted(rows, key=lambda x: (x["arrival_ts"], x["message_id"])):
        mid, us = r["message_id"], _micros(r["arrival_ts"])
        if not r["content"]:
            out[mid] = ("content_required", None, None)
            continue
        tenant = r["tenant_id"]
        if limit > 0:
            minute = us // 60_000_000
            w = window.get(tenant)
            if w is None or w[0] != minute:
                w = window[tenant] = [minute, 0]
            if w[1] >= limit:
                out[mid] = ("rate_limited", None, None)
                continue
            w[1] += 1
        qc = None
        if quota > 0:
            if not made("quota", r):
                out[mid] = ("quota_check_failed", None, None)
                continue
            k = (tenant, us // 86_400_000_000)
            daily[k] = daily.get(k, 0) + 1
            qc = daily[k]
            if qc > quota:
                out[mid] = ("daily_quota_exceeded", qc, None)
                continue
        if main > 0 and not made("main_backlog", r):
            out[mid] = ("backpressure_check_failed", qc, None)
            continue
        if main > 0 and main_len >= main:
            out[mid] = ("stream_backpressure", qc, None)
            continue
        if retry > 0:
            if not made("retry_backlog", r):
                out[mid] = ("retry_backpressure_check_failed", qc, None)
                continue
            retry_len = retry_start + bisect.bisect_left(retry_sorted, r["arrival_ts"])
            if retry_len >= retry:
                out[mid] = ("retry_stream_backpressure", qc, None)
                continue
        corr = r["header_corr"] or r["body_corr"] or f"corr-{us // 1_000_000}-{mid}"
        key = r["idempotency_key"] or None
        if key is not None:
            if not made("claim", r):
                out[mid] = ("idempotency_claim_failed", qc, None)
                continue
            if (tenant, key) in stored:
                out[mid] = ("duplicate_idempotency_key", qc, stored[(tenant, key)] or corr)
                continue
        if publish and not r["publish_ok"]:  # the claim it took is released again
            out[mid] = ("redis_publish_failed", qc, None)
            continue
        if key is not None:
            stored[(tenant, key)] = corr
        main_len += 1
        out[mid] = ("ok", qc, corr)
    return out


def load_inputs(con):
    """requests, claims and retry times from DuckDB fixture views."""
    from sluice.oracle import with_views
    cur = con.execute(with_views("SELECT * FROM requests", "requests"))
    cols = [d[0] for d in cur.description]
    rows = [dict(zip(cols, r)) for r in cur.fetchall()]
    cur = con.execute(with_views("SELECT tenant_id, idempotency_key, notification_id FROM claims", "claims"))
    claims = [dict(zip(["tenant_id", "idempotency_key", "notification_id"], r)) for r in cur.fetchall()]
    retry = [r[0] for r in con.execute(with_views("SELECT entry_ts FROM retry_entries", "retry_entries")).fetchall()]
    return rows, claims, retry
