"""Oracle SQL per registered query (DuckDB dialect, fixture views as CTEs)."""

from __future__ import annotations

from sluice.oracle import admission_sql, with_views

SQL: dict[str, str] = {}

SQL["latest_state"] = with_views("""
SELECT tenant_id, notification_id, status, attempt, seq, status_ts, error FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, notification_id
                               ORDER BY status_ts DESC, seq DESC) AS rn
  FROM history) WHERE rn = 1""", "history")

SQL["admission_decisions"] = admission_sql(1, 50, 3000, 0, publish=True)

SQL["content_required"] = with_views("""
SELECT message_id, tenant_id, coalesce(length(content), 0) > 0 AS content_ok FROM requests""",
                                     "requests")

SQL["rate_limit"] = admission_sql(1, 0, 0, 0, body="""
SELECT message_id, tenant_id, rank_in_minute, CASE WHEN rate_ok THEN true ELSE false END AS rate_ok
FROM decided""")

SQL["daily_quota"] = admission_sql(2, 40, 0, 0, body="""
SELECT message_id, tenant_id, quota_count, CASE WHEN survivor THEN true ELSE false END AS survivor
FROM decided""")

SQL["first_claim"] = admission_sql(0, 0, 0, 0, body="""
SELECT message_id, tenant_id, idem_key, winner_id, winner_id = message_id AS is_first FROM decided""")

SQL["idempotency_claim"] = admission_sql(0, 0, 0, 0, body="""
SELECT message_id, tenant_id, idem_key, claimed, coalesce(NOT claimed, false) AS duplicate,
       CASE WHEN claimed IS NOT NULL THEN canonical_id END AS canonical_id
FROM decided""")

SQL["backlog_gate"] = admission_sql(0, 0, 3000, 800, body="SELECT message_id, gate_reason FROM decided")

SQL["normalise_envelope"] = with_views("""
SELECT message_id, tenant_id, coalesce(user_field, 'unknown-user') AS user_id,
       coalesce(channel_field, 'default') AS channel, content
FROM requests""", "requests")

SQL["correlation_id"] = with_views("""
SELECT message_id,
       coalesce(nullif(header_corr, ''), nullif(body_corr, ''),
                'corr-' || CAST(epoch_us(arrival_ts) // 1000000 AS VARCHAR) || '-' || CAST(message_id AS VARCHAR))
         AS correlation_id
FROM requests""", "requests")

SQL["idempotency_key"] = with_views("""
SELECT message_id, nullif(idempotency_key, '') AS idem_key FROM requests""", "requests")

# Dispatcher pass: failure reason and outcome per consumed row.
_DISPATCH = """
, judged AS (
  SELECT *,
    CASE WHEN NOT received_ok THEN 'storage_persist_failed_received'
         WHEN simulate_fail THEN 'simulated_failure'
         WHEN NOT delivered_ok THEN 'storage_persist_failed_delivered'
         WHEN NOT push_ok THEN 'gateway_delivery_failed' END AS failure_reason
  FROM consumed),
outcomes AS (
  SELECT *,
    CASE WHEN failure_reason IS NULL THEN 'delivered'
         WHEN retry_count + 1 > 3 THEN 'dlq' ELSE 'retry_scheduled' END AS outcome,
    greatest(1, least(10000, 250 * (CAST(1 AS BIGINT) << greatest(0, least(retry_count, 20))))) AS backoff
  FROM judged)
"""


def _dispatch(body: str) -> str:
    return with_views(_DISPATCH + body, "consumed")


SQL["dispatch_step"] = _dispatch("""
SELECT message_id, tenant_id, correlation_id, source_stream, retry_count, outcome, failure_reason,
       CAST(CASE WHEN outcome = 'delivered' THEN retry_count ELSE retry_count + 1 END AS INTEGER) AS attempt,
       CASE WHEN outcome = 'retry_scheduled' THEN seen_ms + backoff END AS next_attempt_at_ms,
       CASE WHEN outcome = 'retry_scheduled' THEN backoff END AS retry_backoff_ms
FROM outcomes""")

SQL["failure_reason"] = _dispatch("SELECT message_id, failure_reason FROM judged")

SQL["status_expand"] = _dispatch("""
SELECT message_id, tenant_id, correlation_id, 1 AS step, 'received' AS status, retry_count AS attempt,
       '' AS error
FROM outcomes WHERE received_ok
UNION ALL
SELECT message_id, tenant_id, correlation_id, 2, 'delivered', retry_count, ''
FROM outcomes WHERE received_ok AND NOT simulate_fail AND delivered_ok
UNION ALL
SELECT message_id, tenant_id, correlation_id, 3, outcome, CAST(retry_count + 1 AS INTEGER), failure_reason
FROM outcomes WHERE outcome <> 'delivered'""")

SQL["retry_schedule"] = _dispatch("""
SELECT message_id, message_id AS previous_stream_id, CAST(retry_count + 1 AS INTEGER) AS retry_count,
       backoff AS retry_backoff_ms, seen_ms + backoff AS next_attempt_at_ms,
       failure_reason AS retry_reason
FROM outcomes WHERE outcome = 'retry_scheduled'""")

SQL["dlq_write"] = _dispatch("""
SELECT message_id, tenant_id, retry_count, failure_reason, message_id AS original_stream_id,
       CAST(retry_count + 1 AS INTEGER) AS final_retry_count
FROM outcomes WHERE outcome = 'dlq'""")

SQL["due_retries"] = with_views("""
SELECT message_id, source_stream,
       CASE WHEN source_stream = 'retry'
            THEN least(coalesce(next_attempt_at_ms, 0), seen_ms + 5000) ELSE 0 END AS due_at_ms
FROM consumed
WHERE source_stream <> 'retry' OR least(coalesce(next_attempt_at_ms, 0), seen_ms + 5000) <= 1705276800000""",
                                "consumed")

SQL["delivery_history"] = with_views("""
SELECT tenant_id, notification_id, user_id, channel, status, attempt, correlation_id, status_ts, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY status_ts DESC, seq DESC) AS rn
  FROM history) WHERE rn <= 20""", "history")

SQL["pk_collapse"] = with_views("""
SELECT tenant_id, notification_id, pk_ts, seq, status FROM (
  SELECT *, date_trunc('hour', status_ts) AS pk_ts,
         row_number() OVER (PARTITION BY tenant_id, notification_id, date_trunc('hour', status_ts)
                            ORDER BY seq DESC) AS rn
  FROM history) WHERE rn = 1""", "history")

SQL["dlq_newest"] = with_views("""
SELECT message_id, tenant_id, arrival_ts, failure_reason FROM dead_letters
ORDER BY arrival_ts DESC, message_id DESC LIMIT 50""", "dead_letters")

SQL["latest_entry"] = with_views("""
SELECT source_stream, message_id, arrival_ts FROM (
  SELECT *, row_number() OVER (PARTITION BY source_stream ORDER BY arrival_ts DESC, message_id DESC) AS rn
  FROM consumed) WHERE rn = 1""", "consumed")

SQL["clustered_history"] = with_views("""
SELECT * FROM history WHERE tenant_id = 'tenant-2' AND notification_id = 'n-7'
ORDER BY status_ts DESC, seq DESC""", "history")

SQL["retention"] = with_views("""
SELECT tenant_id, notification_id, seq, status_ts FROM history
WHERE status_ts > TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 10 DAY""", "history")

SQL["retry_chain_step"] = with_views("""
SELECT correlation_id, seq, status, status_ts,
       row_number() OVER w AS step,
       lag(status) OVER w AS prev_status,
       epoch_us(status_ts) - epoch_us(lag(status_ts) OVER w) AS gap_us
FROM history
WINDOW w AS (PARTITION BY correlation_id ORDER BY status_ts, seq)""", "history")

SQL["correlation_trace"] = with_views("""
SELECT correlation_id, count(*) AS records, max(attempt) AS max_attempt,
       first(status ORDER BY status_ts, seq) AS first_status,
       last(status ORDER BY status_ts, seq) AS last_status,
       min(status_ts) AS first_ts, max(status_ts) AS last_ts,
       count(*) FILTER (WHERE status = 'dlq') AS dead_letters
FROM history GROUP BY correlation_id""", "history")

SQL["fan_out"] = with_views("""
SELECT c.message_id, s.session_id, c.tenant_id, c.channel
FROM consumed c JOIN sessions s ON c.tenant_id = s.tenant_id AND c.channel = s.channel""",
                            "consumed", "sessions")

SQL["fan_out_counts"] = with_views("""
SELECT c.message_id, c.tenant_id, c.channel,
       (SELECT count(*) FROM sessions s WHERE s.tenant_id = c.tenant_id AND s.channel = c.channel) AS clients
FROM consumed c""", "consumed", "sessions")

SQL["fan_out_as_of"] = with_views("""
SELECT c.message_id, s.session_id, c.arrival_ts
FROM consumed c JOIN sessions s ON c.tenant_id = s.tenant_id AND c.channel = s.channel
 AND s.sub_start <= c.arrival_ts AND (s.sub_end IS NULL OR c.arrival_ts < s.sub_end)""", "consumed", "sessions")

SQL["active_sessions"] = with_views("""
, pts AS (SELECT sub_start AS change_ts FROM sessions UNION SELECT sub_end FROM sessions WHERE sub_end IS NOT NULL)
SELECT change_ts,
       (SELECT count(*) FROM sessions s WHERE s.sub_start <= pts.change_ts AND (s.sub_end IS NULL OR s.sub_end > pts.change_ts))
         AS active
FROM pts""", "sessions")

SQL["idempotency_release"] = with_views("""
SELECT r.tenant_id, r.idempotency_key, r.notification_id,
       EXISTS (SELECT 1 FROM claims c WHERE c.tenant_id = r.tenant_id
                 AND c.idempotency_key = r.idempotency_key AND c.notification_id = r.notification_id)
         AS released
FROM releases r""", "releases")

SQL["pending_entries"] = with_views("""
SELECT source_stream, message_id FROM reads
EXCEPT ALL SELECT source_stream, message_id FROM acks""", "reads", "acks")

SQL["stream_state_reconcile"] = with_views("""
SELECT coalesce(c.tenant_id, p.tenant_id) AS tenant_id, coalesce(c.message_id, p.message_id) AS message_id,
       CASE WHEN p.message_id IS NULL THEN 'missing_state'
            WHEN c.message_id IS NULL THEN 'orphan_state'
            WHEN c.content IS DISTINCT FROM p.content THEN 'content_mismatch'
            ELSE 'ok' END AS verdict
FROM consumed c FULL OUTER JOIN persisted p ON c.tenant_id = p.tenant_id AND c.message_id = p.message_id""",
                                           "consumed", "persisted")

SQL["dlq_replay"] = with_views("""
SELECT message_id, message_id AS replayed_from, retry_count, failure_reason, correlation_id,
       'retry' AS source_stream
FROM dead_letters ORDER BY arrival_ts DESC, message_id DESC LIMIT 50""", "dead_letters")

SQL["retry_lineage"] = with_views("""
SELECT c.message_id, c.previous_stream_id, p.arrival_ts AS parent_ts, p.retry_count AS parent_retry_count,
       p.source_stream AS parent_stream, p.message_id IS NULL AS parent_missing
FROM consumed c LEFT JOIN consumed p ON c.previous_stream_id = p.message_id
WHERE c.previous_stream_id IS NOT NULL""", "consumed")

SQL["main_retry_union"] = with_views("""
SELECT message_id, 'main' AS source_stream, retry_count FROM consumed WHERE retry_count = 0
UNION ALL
SELECT message_id, 'retry', retry_count FROM consumed WHERE retry_count > 0""", "consumed")

SQL["admission_counters"] = admission_sql(1, 50, 3000, 0, publish=True, body="""
SELECT tenant_id, count(*) AS requests,
       count(*) FILTER (WHERE reason = 'ok') AS accepted,
       count(*) FILTER (WHERE reason = 'duplicate_idempotency_key') AS duplicates,
       count(*) FILTER (WHERE reason IN ('rate_limited', 'daily_quota_exceeded', 'stream_backpressure',
                                         'retry_stream_backpressure', 'redis_publish_failed')) AS rejected,
       count(*) FILTER (WHERE reason = 'rate_limited') AS rate_limited,
       count(*) FILTER (WHERE reason IN ('stream_backpressure', 'retry_stream_backpressure'))
         AS backpressure_rejected,
       grouping(tenant_id) = 1 AS is_total
FROM decided GROUP BY ROLLUP (tenant_id)""")

SQL["admission_failed_counters"] = admission_sql(2, 40, 3000, 800, publish=True, checks=True, body="""
SELECT tenant_id, count(*) AS requests,
       count(*) FILTER (WHERE reason = 'ok') AS accepted,
       count(*) FILTER (WHERE reason = 'duplicate_idempotency_key') AS duplicates,
       count(*) FILTER (WHERE http_status IN (429, 503)) AS rejected,
       count(*) FILTER (WHERE reason = 'rate_limited') AS rate_limited,
       count(*) FILTER (WHERE reason IN ('stream_backpressure', 'retry_stream_backpressure'))
         AS backpressure_rejected,
       grouping(tenant_id) = 1 AS is_total
FROM decided GROUP BY ROLLUP (tenant_id)""")

SQL["dispatch_counters"] = with_views("""
SELECT tenant_id, count(*) AS consumed,
       count(*) FILTER (WHERE outcome = 'delivered' AND ack_ok) AS delivered,
       count(*) FILTER (WHERE outcome = 'retry_scheduled' AND ack_ok) AS retry_scheduled,
       count(*) FILTER (WHERE outcome = 'dlq' AND ack_ok) AS dead_lettered,
       count(*) FILTER (WHERE NOT ack_ok) AS processing_errors,
       count(*) FILTER (WHERE NOT received_ok)
         + count(*) FILTER (WHERE received_ok AND NOT simulate_fail AND NOT delivered_ok)
         AS storage_write_failures,
       count(*) FILTER (WHERE received_ok AND NOT simulate_fail AND delivered_ok AND NOT push_ok)
         AS gateway_delivery_failures,
       grouping(tenant_id) = 1 AS is_total
FROM dispatched GROUP BY ROLLUP (tenant_id)""", "dispatched")

SQL["processing_duration"] = with_views("""
SELECT tenant_id, CAST(sum(duration_ms) AS BIGINT) AS duration_ms_sum, count(duration_ms) AS duration_ms_count,
       grouping(tenant_id) = 1 AS is_total,
       CAST(sum(duration_ms) AS DOUBLE) / nullif(count(duration_ms), 0) AS duration_ms_mean
FROM consumed GROUP BY ROLLUP (tenant_id)""", "consumed")

SQL["stream_length"] = with_views("""
SELECT source_stream, count(*) AS length FROM (
  SELECT source_stream FROM consumed UNION ALL SELECT source_stream FROM dead_letters)
GROUP BY source_stream""", "consumed", "dead_letters")

SQL["consumer_lag"] = with_views("""
, per AS (
  SELECT g.source_stream,
         greatest(0, coalesce(CASE WHEN g.last_delivered IS NOT NULL THEN
           (SELECT count(*) FROM reads r WHERE r.source_stream = g.source_stream
              AND r.message_id > g.last_delivered) END,
           (SELECT count(*) FROM (SELECT source_stream, message_id FROM reads
                                  EXCEPT ALL SELECT source_stream, message_id FROM acks) p
             WHERE p.source_stream = g.source_stream), 0)) AS consumer_lag,
         (SELECT count(*) FROM (SELECT source_stream, message_id FROM reads
                                EXCEPT ALL SELECT source_stream, message_id FROM acks) p
           WHERE p.source_stream = g.source_stream) AS pending
  FROM group_positions g)
SELECT source_stream, CAST(sum(consumer_lag) AS BIGINT) AS consumer_lag, CAST(sum(pending) AS BIGINT) AS pending,
       grouping(source_stream) = 1 AS is_total
FROM per GROUP BY ROLLUP (source_stream)""", "reads", "acks", "group_positions")

SQL["tenant_minute_usage"] = with_views("""
SELECT tenant_id, date_trunc('minute', arrival_ts) AS minute_start, count(*) AS seen,
       least(count(*), 1) AS allowed, count(*) - least(count(*), 1) AS limited
FROM requests WHERE coalesce(length(content), 0) > 0
GROUP BY tenant_id, date_trunc('minute', arrival_ts)""", "requests")

SQL["tenant_daily_usage"] = admission_sql(1, 0, 0, 0, body="""
SELECT tenant_id, CAST(arrival_ts AS DATE) AS day, count(*) AS quota_count,
       CAST(greatest(count(*) - 50, 0) AS BIGINT) AS over_quota
FROM decided WHERE rate_ok GROUP BY tenant_id, CAST(arrival_ts AS DATE)""")

SQL["duplicate_audit"] = with_views("""
SELECT tenant_id, nullif(idempotency_key, '') AS idem_key, count(*) AS n
FROM requests WHERE nullif(idempotency_key, '') IS NOT NULL
GROUP BY tenant_id, nullif(idempotency_key, '') HAVING count(*) <> 1""", "requests")

SQL["slo_report"] = with_views("""
SELECT tenant_id, count(*) AS messages,
       avg(CASE WHEN outcome = 'delivered' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS success_rate,
       max(duration_ms) AS max_duration_ms,
       quantile_cont(duration_ms, 0.5) AS p50, quantile_cont(duration_ms, 0.9) AS p90,
       quantile_cont(duration_ms, 0.95) AS p95, quantile_cont(duration_ms, 0.99) AS p99,
       avg(CASE WHEN outcome = 'delivered' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) > 0.99 AS slo_pass,
       (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM reads r WHERE r.tenant_id = d.tenant_id
          AND NOT EXISTS (SELECT 1 FROM acks a WHERE a.source_stream = r.source_stream AND a.message_id = r.message_id)
          GROUP BY r.source_stream)) AS max_lag
FROM dispatched d GROUP BY tenant_id""", "dispatched", "reads", "acks")

# Token verdicts by construction (the defect injected per event id).
_TOKEN_VERDICT = """
, verdict AS (
  SELECT event_id AS message_id, user_id,
    CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 10 <= 2 THEN 'valid' ELSE 'invalid' END AS token_status,
    CASE WHEN event_id % 13 = 0 THEN NULL ELSE
      CASE event_id % 10 WHEN 3 THEN 'invalid JWT format' WHEN 4 THEN 'unsupported JWT alg'
        WHEN 5 THEN 'invalid JWT signature' WHEN 6 THEN 'missing exp claim' WHEN 7 THEN 'token expired'
        WHEN 8 THEN 'token not yet valid' WHEN 9 THEN 'tenant claim missing in JWT' END END AS token_error,
    CASE WHEN event_id % 13 <> 0 AND event_id % 10 <= 2
         THEN 'tenant-' || CAST((user_id + event_id % 3) % 5 AS VARCHAR) END AS token_tenant,
    'tenant-' || CAST(user_id % 5 AS VARCHAR) AS body_tenant
  FROM events)
"""

SQL["token_audit"] = "WITH " + _TOKEN_VERDICT.lstrip().lstrip(",").lstrip() + """
SELECT message_id, token_status, token_error, token_tenant FROM verdict"""

SQL["resolve_tenant"] = "WITH " + _TOKEN_VERDICT.lstrip().lstrip(",").lstrip() + """
SELECT message_id,
       CASE WHEN token_status = 'valid' THEN token_tenant WHEN token_status = 'invalid' THEN NULL
            ELSE body_tenant END AS tenant_id,
       CASE WHEN token_status = 'invalid' THEN 'invalid_bearer_token' END AS auth_reason
FROM verdict"""

SQL["tenant_scope"] = "WITH " + _TOKEN_VERDICT.lstrip().lstrip(",").lstrip() + """
SELECT message_id, body_tenant AS asked_tenant,
       CASE WHEN token_status = 'invalid' THEN 'unauthorized'
            WHEN token_status = 'valid' AND token_tenant <> body_tenant THEN 'forbidden'
            ELSE 'allowed' END AS scope,
       CAST(CASE WHEN token_status = 'invalid' THEN 401
            WHEN token_status = 'valid' AND token_tenant <> body_tenant THEN 403 ELSE 200 END AS INTEGER)
         AS scope_status
FROM verdict"""

SQL["required_fields"] = with_views("""
, recs AS (
  SELECT seq AS record_id,
         CASE seq % 3 WHEN 0 THEN 'store' WHEN 1 THEN 'claim' ELSE 'release' END AS kind,
         CASE WHEN seq % 19 <> 0 THEN tenant_id END AS tenant_id,
         CASE WHEN seq % 23 = 0 THEN '' ELSE notification_id END AS notification_id,
         status,
         CASE WHEN seq % 29 <> 0 THEN correlation_id END AS idempotency_key
  FROM history),
judged AS (
  SELECT record_id, kind,
    CASE WHEN kind = 'store' AND (tenant_id IS NULL OR status IS NULL OR notification_id IS NULL)
           THEN 'tenant_id, status and notification_id are required'
         WHEN kind IN ('claim', 'release') AND (coalesce(tenant_id, '') = '' OR coalesce(idempotency_key, '') = ''
                                                OR coalesce(notification_id, '') = '')
           THEN 'tenant_id, idempotency_key and notification_id are required' END AS reject_reason
  FROM recs)
SELECT record_id, kind, reject_reason IS NULL AS valid, reject_reason FROM judged""", "history")

SQL["subscription_accept"] = """
WITH frames AS (
  SELECT conv_id AS session_id, turn AS seq,
         CASE WHEN role = 'user' THEN 'subscribe' ELSE 'noop' END AS type,
         CASE WHEN conv_id % 7 <> 0 THEN 'tenant-' || CAST(conv_id % 5 AS VARCHAR) END AS auth_tenant,
         CASE WHEN conv_id % 11 = 0 THEN 'tenant-' || CAST((conv_id + 1) % 5 AS VARCHAR)
              ELSE 'tenant-' || CAST(conv_id % 5 AS VARCHAR) END AS tenant_id,
         CASE WHEN turn = 3 THEN '' ELSE (['view', 'click', 'purchase', 'signup', 'error'])[turn % 5 + 1] END
           AS channel
  FROM conversations),
v AS (
  SELECT *, CASE WHEN NOT (type = 'subscribe' AND coalesce(tenant_id, '') <> '' AND coalesce(channel, '') <> '')
                   THEN 'ignore'
                 WHEN coalesce(auth_tenant, '') <> '' AND auth_tenant <> tenant_id THEN 'close'
                 ELSE 'accept' END AS v0
  FROM frames),
c AS (SELECT session_id, min(seq) AS closed_at FROM v WHERE v0 = 'close' GROUP BY session_id)
SELECT v.session_id, v.seq,
       CASE WHEN c.closed_at IS NOT NULL AND v.seq > c.closed_at THEN 'after_close' ELSE v.v0 END AS verdict
FROM v LEFT JOIN c ON v.session_id = c.session_id"""

SQL["route_requests"] = """
WITH log AS (
  SELECT event_id AS request_id,
         CASE WHEN event_id % 10 IN (7, 8) THEN 'POST' ELSE 'GET' END AS method,
         CASE event_id % 10
           WHEN 0 THEN '/health' WHEN 1 THEN '/metrics'
           WHEN 2 THEN '/ws?access_token=tok-' || CAST(event_id AS VARCHAR)
           WHEN 3 THEN '/v1/notifications/n-' || CAST(event_id // 4 AS VARCHAR) || '?tenant_id=tenant-'
                       || CAST(user_id % 5 AS VARCHAR)
           WHEN 4 THEN '/v1/notifications/n-' || CAST(event_id // 4 AS VARCHAR)
                       || CASE WHEN event_id % 20 = 14 THEN '?tenant_id=' ELSE '' END
           WHEN 5 THEN '/v1/tenants/tenant-' || CAST(user_id % 5 AS VARCHAR) || '/deliveries?limit='
                       || (['7', '0', '9999', 'abc'])[(event_id // 10) % 4 + 1]
           WHEN 6 THEN '/v1/tenants/tenant-' || CAST(user_id % 5 AS VARCHAR) || '/deliveries'
           WHEN 7 THEN '/v1/notifications' WHEN 8 THEN '/v1/internal/deliver'
           ELSE '/v1/tenants/tenant-' || CAST(user_id % 5 AS VARCHAR) END AS path
  FROM events
  UNION ALL
  SELECT page_id + 1000000000, 'GET', regexp_extract(url, '^[a-z]+://[^/]+(/[^#]*)', 1) FROM pages),
parts AS (
  SELECT *, split_part(path, '?', 1) AS bare,
         CASE WHEN strpos(path, '?') > 0 THEN substr(path, strpos(path, '?') + 1) END AS q
  FROM log),
p2 AS (
  SELECT *,
    CASE WHEN regexp_matches(q, '(^|&)tenant_id=([^&]*)') THEN regexp_extract(q, '(^|&)tenant_id=([^&]*)', 2) END AS qt,
    CASE WHEN regexp_matches(q, '(^|&)limit=([^&]*)') THEN regexp_extract(q, '(^|&)limit=([^&]*)', 2) END AS ql,
    substr(bare, 13) AS tenant_part
  FROM parts),
routed AS (
  SELECT *,
    CASE WHEN method = 'GET' AND bare = '/health' THEN 'health'
         WHEN method = 'GET' AND bare = '/metrics' THEN 'metrics'
         WHEN method = 'GET' AND bare = '/ws' THEN 'websocket'
         WHEN method = 'GET' AND starts_with(bare, '/v1/notifications/') AND length(bare) > 18 THEN 'notification_state'
         WHEN method = 'GET' AND starts_with(bare, '/v1/tenants/') AND length(tenant_part) > 11
              AND ends_with(tenant_part, '/deliveries') THEN 'tenant_deliveries'
         WHEN method = 'POST' AND bare = '/v1/internal/deliver' THEN 'internal_deliver'
         WHEN method = 'POST' AND bare = '/v1/notifications' THEN 'submit'
         ELSE 'not_found' END AS route
  FROM p2)
SELECT request_id, route,
       CAST(CASE route WHEN 'health' THEN 200 WHEN 'metrics' THEN 200 WHEN 'websocket' THEN 101
            WHEN 'notification_state' THEN CASE WHEN coalesce(qt, '') = '' THEN 400 ELSE 200 END
            WHEN 'tenant_deliveries' THEN 200 WHEN 'internal_deliver' THEN 200 WHEN 'submit' THEN 202
            ELSE 404 END AS INTEGER) AS http_status,
       CASE WHEN route = 'notification_state' THEN substr(bare, 19) END AS resource_id,
       CASE WHEN route = 'notification_state' THEN qt
            WHEN route = 'tenant_deliveries' THEN substr(tenant_part, 1, length(tenant_part) - 11) END AS tenant_id,
       CASE WHEN route = 'tenant_deliveries' THEN
         CAST(greatest(1, least(500, CASE
           WHEN TRY_CAST(regexp_extract(ql, '^\\s*([+-]?\\d+)', 1) AS INTEGER) IS NULL THEN 50
           ELSE TRY_CAST(regexp_extract(ql, '^\\s*([+-]?\\d+)', 1) AS INTEGER) END)) AS INTEGER) END AS "limit"
FROM routed"""

_PAYLOAD = """
, lines AS (
  SELECT seq, status_ts,
    CASE WHEN seq % 31 = 0 THEN ''
         WHEN seq % 29 = 0 THEN substr(js, 1, CAST(floor(length(js) / 2) AS INTEGER))
         ELSE js END AS payload
  FROM (SELECT *, '{"tenant_id":"' || tenant_id || '","notification_id":"' || notification_id
                  || '","status":"' || status || '","attempt":' || CAST(attempt AS VARCHAR)
                  || ',"error":"' || error || '"}' AS js FROM history))
"""

SQL["parse_payload"] = with_views(_PAYLOAD + """
SELECT seq, json_valid(payload) AS valid,
       CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.tenant_id') END AS tenant_id,
       CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.notification_id') END AS notification_id,
       CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.status') END AS status,
       CASE WHEN json_valid(payload) THEN coalesce(TRY_CAST(json_extract_string(payload, '$.attempt') AS BIGINT), 0)
         END AS attempt,
       CASE WHEN json_valid(payload) THEN json_extract_string(payload, '$.error') END AS error
FROM lines WHERE length(trim(payload)) > 0""", "history")

SQL["audit_scan"] = with_views(_PAYLOAD + """
, audit AS (
  SELECT CASE WHEN payload = '' THEN ''
              ELSE '{"ts":' || CAST(epoch_us(status_ts) // 1000000 AS VARCHAR) || ',"record":' || payload || '}'
         END AS value
  FROM lines)
SELECT CAST(json_extract_string(value, '$.ts') AS BIGINT) AS ts,
       json_extract_string(value, '$.record.tenant_id') AS tenant_id,
       json_extract_string(value, '$.record.notification_id') AS notification_id,
       json_extract_string(value, '$.record.status') AS status,
       coalesce(TRY_CAST(json_extract_string(value, '$.record.attempt') AS BIGINT), 0) AS attempt,
       json_extract_string(value, '$.record.error') AS error
FROM audit WHERE length(trim(value)) > 0 AND json_valid(value)
  AND json_extract_string(value, '$.record.tenant_id') IS NOT NULL
  AND json_extract_string(value, '$.record.notification_id') IS NOT NULL""", "history")

SQL["pairs_to_map"] = """
WITH kv AS (
  SELECT event_id,
         CASE WHEN event_id % 3 = 0
              THEN ['a', CAST(user_id AS VARCHAR), 'b', event_type, 'a', CAST(event_id AS VARCHAR), 'c']
              ELSE ['a', CAST(user_id AS VARCHAR), 'b', event_type, 'a', CAST(event_id AS VARCHAR)] END AS arr
  FROM events),
pairs AS (
  SELECT event_id, arr[2 * i + 1] AS key, arr[2 * i + 2] AS value, i
  FROM (SELECT event_id, arr, unnest(range(0, len(arr) // 2)) AS i FROM kv))
SELECT event_id, key, value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id, key ORDER BY i DESC) AS rn FROM pairs) WHERE rn = 1"""

SQL["status_record"] = _dispatch("""
, rows AS (
  SELECT message_id, 1 AS step, tenant_id, user_id, channel, content, correlation_id, 'received' AS status,
         retry_count AS attempt, '' AS error
  FROM outcomes WHERE received_ok
  UNION ALL
  SELECT message_id, 2, tenant_id, user_id, channel, content, correlation_id, 'delivered', retry_count, ''
  FROM outcomes WHERE received_ok AND NOT simulate_fail AND delivered_ok
  UNION ALL
  SELECT message_id, 3, tenant_id, user_id, channel, content, correlation_id, outcome, retry_count + 1,
         failure_reason
  FROM outcomes WHERE outcome <> 'delivered')
SELECT message_id, step,
       json_object('tenant_id', tenant_id, 'notification_id', CAST(message_id AS VARCHAR), 'user_id', user_id,
                   'channel', channel, 'content', content, 'correlation_id', correlation_id, 'status', status,
                   'attempt', CAST(attempt AS INTEGER), 'error', error)::VARCHAR AS body
FROM rows""")

SQL["audit_details"] = with_views("""
SELECT seq, 'channel=' || channel || ',attempt=' || CAST(attempt AS VARCHAR) || ',error=' || error
            || ',correlation_id=' || correlation_id AS details
FROM history""", "history")

SQL["audit_append"] = with_views("""
SELECT seq, json_object('ts', epoch_us(status_ts) // 1000000,
                        'record', json_object('tenant_id', tenant_id, 'notification_id', notification_id,
                                              'user_id', user_id, 'channel', channel, 'content', content,
                                              'correlation_id', correlation_id, 'status', status,
                                              'attempt', attempt, 'error', error))::VARCHAR AS value
FROM history""", "history")


def _event_log(main: int, params: tuple, **how) -> str:
    return admission_sql(*params, publish=True, body=f"""
SELECT message_id,
  '{{"ts":' || CAST(epoch_us(arrival_ts) // 1000000 AS VARCHAR) || ',"service":"gateway","event":"'
  || CASE WHEN reason IN ('ok', 'duplicate_idempotency_key') THEN 'notification_accepted'
          ELSE 'notification_rejected' END
  || '","outcome":"' || reason || '","tenant_id":"' || tenant_id || '"'
  || CASE WHEN reason IN ('ok', 'redis_publish_failed', 'idempotency_claim_failed') AND coalesce(correlation_id, '') <> ''
            THEN ',"correlation_id":"' || correlation_id || '"'
          WHEN reason = 'duplicate_idempotency_key' AND coalesce(canonical_id, '') <> ''
            THEN ',"correlation_id":"' || canonical_id || '"' ELSE '' END
  || CASE WHEN reason = 'daily_quota_exceeded' THEN ',"detail":"quota_count=' || CAST(quota_count AS VARCHAR) || '"'
          WHEN reason = 'stream_backpressure' THEN ',"detail":"stream=notifications_stream,length={main}"'
          WHEN reason = 'retry_stream_backpressure' THEN ',"detail":"stream=notifications_retry_stream,length='
            || CAST((SELECT count(*) FROM retry_entries x WHERE x.entry_ts < decided.arrival_ts) AS VARCHAR) || '"'
          ELSE '' END
  || '}}' AS log_line
FROM decided
WHERE reason IN ('ok', 'duplicate_idempotency_key', 'rate_limited', 'daily_quota_exceeded',
                 'stream_backpressure', 'retry_stream_backpressure', 'redis_publish_failed', 'quota_check_failed',
                 'backpressure_check_failed', 'retry_backpressure_check_failed', 'idempotency_claim_failed')""", **how)


SQL["event_log"] = _event_log(3000, (1, 50, 3000, 0))

# All checks on, and some of each that cannot be made.
_CHECKED = (2, 40, 3000, 800)

SQL["admission_failed_checks"] = admission_sql(*_CHECKED, publish=True, checks=True)

SQL["event_log_failed_checks"] = _event_log(3000, _CHECKED, checks=True)

SQL["dispatch_log"] = with_views("""
SELECT message_id,
  '{"ts":"' || strftime(epoch_ms(seen_ms), '%Y-%m-%dT%H:%M:%S.%g') || 'Z","service":"notification-dispatcher","event":"notification_dispatch","outcome":"'
  || CASE outcome WHEN 'dlq' THEN 'dlq_routed' ELSE outcome END || '","tenant_id":"' || tenant_id || '","notification_id":"' || message_id
  || '","correlation_id":"' || correlation_id || '"'
  || CASE outcome WHEN 'delivered' THEN ''
       WHEN 'dlq' THEN ',"reason":"' || failure_reason || '"'
       ELSE ',"reason":"' || failure_reason || ',backoff_ms=' || CAST(CAST(greatest(1, least(10000, 250 * power(2, retry_count))) AS BIGINT) AS VARCHAR) || '"' END
  || ',"retry_count":' || CAST(CASE outcome WHEN 'delivered' THEN retry_count ELSE retry_count + 1 END AS VARCHAR) || '}' AS log_line
FROM dispatched WHERE ack_ok""", "dispatched")

SQL["purged_history"] = SQL["retention"]

SQL["clustered_point_read"] = SQL["clustered_history"]

SQL["audit_files"] = with_views(_PAYLOAD + """
, audit AS (
  SELECT seq, CASE WHEN payload = '' THEN ''
              ELSE '{"ts":' || CAST(epoch_us(status_ts) // 1000000 AS VARCHAR) || ',"record":' || payload || '}'
         END AS value
  FROM lines),
judged AS (
  SELECT seq % 4 AS part, json_valid(value) AND json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.record.tenant_id') IS NOT NULL
         AND json_extract_string(CASE WHEN json_valid(value) THEN value END, '$.record.notification_id') IS NOT NULL AS good
  FROM audit WHERE length(trim(value)) > 0)
SELECT part, count(*) FILTER (WHERE good) AS records, count(*) FILTER (WHERE NOT good) AS quarantined FROM judged GROUP BY part""",
                                "history")

SQL["slo_sketches"] = with_views("""
, binned AS (
  SELECT tenant_id, CASE WHEN duration_ms > 0 THEN CAST(ceil(ln(CAST(duration_ms AS DOUBLE)) / ln(1.01 / 0.99)) AS INTEGER) END AS bin, count(*) AS n
  FROM consumed WHERE duration_ms IS NOT NULL GROUP BY ALL),
run AS (
  SELECT *, sum(n) OVER (PARTITION BY tenant_id ORDER BY bin NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY tenant_id) AS total,
         CASE WHEN bin IS NULL THEN 0.0::DOUBLE ELSE 2 * power(1.01 / 0.99, bin) / (1.01 / 0.99 + 1) END AS middle FROM binned)
SELECT tenant_id, CAST(max(total) AS BIGINT) AS messages,
       CAST(round(min(middle) FILTER (WHERE upto > floor(0.5::DOUBLE * (total - 1))) * 1000) AS BIGINT) AS p50_us,
       CAST(round(min(middle) FILTER (WHERE upto > floor(0.95::DOUBLE * (total - 1))) * 1000) AS BIGINT) AS p95_us,
       CAST(round(min(middle) FILTER (WHERE upto > floor(0.99::DOUBLE * (total - 1))) * 1000) AS BIGINT) AS p99_us
FROM run GROUP BY tenant_id""", "consumed")

SQL["tenant_audit_report"] = with_views("""
SELECT tenant_id, status, count(*) AS records, max(status_ts) AS newest_ts,
       avg(CASE WHEN status = 'dlq' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS dlq_share,
       CAST(grouping(tenant_id, status) AS INTEGER) AS level
FROM history GROUP BY ROLLUP (tenant_id, status)""", "history")

# ---- streaming: each equals the batch answer of its operator ----------------

SQL["stream_read"] = with_views("""
SELECT message_id, source_stream, retry_count, arrival_ts FROM consumed""", "consumed")

SQL["stream_rate_quota"] = admission_sql(2, 40, 0, 0, body="""
SELECT message_id, tenant_id, rank_in_minute, rate_ok, quota_count, survivor AS quota_ok
FROM decided WHERE rank_in_minute IS NOT NULL""")

SQL["stream_dedup"] = admission_sql(0, 0, 0, 0, body="""
SELECT message_id, tenant_id, idem_key, claimed, coalesce(NOT claimed, false) AS duplicate,
       CASE WHEN claimed IS NOT NULL THEN canonical_id END AS canonical_id
FROM decided WHERE survivor""")

SQL["stream_retry"] = with_views("""
, m AS (
  SELECT message_id, tenant_id, retry_count AS a, simulate_fail AS p,
         simulate_fail OR NOT (received_ok AND delivered_ok AND push_ok) AS failed
  FROM consumed),
tried AS (
  SELECT message_id, tenant_id, k, CASE WHEN k = a THEN failed ELSE p END AS failed
  FROM (SELECT *, unnest(range(a, CASE WHEN NOT failed THEN a WHEN p THEN greatest(a, 3)
                                       ELSE least(a + 1, greatest(a, 3)) END + 1)) AS k FROM m))
SELECT message_id, tenant_id, CAST(CASE WHEN failed THEN k + 1 ELSE k END AS INTEGER) AS attempt,
       CASE WHEN NOT failed THEN 'delivered' WHEN k + 1 > 3 THEN 'dlq' ELSE 'retry_scheduled' END AS status
FROM tried""", "consumed")

SQL["stream_fan_out"] = SQL["fan_out"]

SQL["stream_usage_windows"] = with_views("""
SELECT tenant_id, date_trunc('minute', arrival_ts) AS minute_start, count(*) AS seen
FROM requests WHERE coalesce(length(content), 0) > 0
GROUP BY tenant_id, date_trunc('minute', arrival_ts)""", "requests")

SQL["stream_status_tables"] = _dispatch("""
, rows AS (
  SELECT message_id, tenant_id, 1 AS step, 'received' AS status, retry_count AS attempt
  FROM outcomes WHERE received_ok
  UNION ALL
  SELECT message_id, tenant_id, 2, 'delivered', retry_count
  FROM outcomes WHERE received_ok AND NOT simulate_fail AND delivered_ok
  UNION ALL
  SELECT message_id, tenant_id, 3, outcome, CAST(retry_count + 1 AS INTEGER)
  FROM outcomes WHERE outcome <> 'delivered')
SELECT tenant_id, message_id, step, status, attempt FROM (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, message_id ORDER BY step DESC) AS rn FROM rows)
WHERE rn = 1""")

SQL["stream_dlq"] = SQL["dlq_write"]

SQL["stream_metrics"] = with_views("""
SELECT count(*) AS consumed,
       count(*) FILTER (WHERE outcome = 'delivered' AND ack_ok) AS delivered,
       count(*) FILTER (WHERE outcome = 'retry_scheduled' AND ack_ok) AS retry_scheduled,
       count(*) FILTER (WHERE outcome = 'dlq' AND ack_ok) AS dead_lettered,
       count(*) FILTER (WHERE NOT ack_ok) AS processing_errors,
       count(*) FILTER (WHERE NOT received_ok)
         + count(*) FILTER (WHERE received_ok AND NOT simulate_fail AND NOT delivered_ok)
         AS storage_write_failures,
       count(*) FILTER (WHERE received_ok AND NOT simulate_fail AND delivered_ok AND NOT push_ok)
         AS gateway_delivery_failures
FROM dispatched""", "dispatched")

SQL["stream_recovery"] = SQL["status_expand"]

# The slices that the streaming harness cuts: at least 4, at most 32 time ranges of about 25,000 rows.
_SLICES = """
, size AS (
  SELECT min(epoch_us(arrival_ts)) AS lo, max(epoch_us(arrival_ts)) AS hi, least(32, greatest(4, (count(*) + 24999) // 25000)) AS n FROM consumed),
ranged AS (
  SELECT c.message_id, least(CAST(floor((epoch_us(c.arrival_ts) - lo) / ((hi - lo + 1) / n)) AS INTEGER), n - 1) AS slice FROM consumed c, size),
sliced AS (SELECT message_id, dense_rank() OVER (ORDER BY slice) - 1 AS batch_id FROM ranged)"""

SQL["sink_with_fallback"] = _dispatch(_SLICES + """
, rows AS (
SELECT message_id, tenant_id, correlation_id, 1 AS step, 'received' AS status, retry_count AS attempt, '' AS error
FROM outcomes WHERE received_ok
UNION ALL
SELECT message_id, tenant_id, correlation_id, 2, 'delivered', retry_count, ''
FROM outcomes WHERE received_ok AND NOT simulate_fail AND delivered_ok
UNION ALL
SELECT message_id, tenant_id, correlation_id, 3, outcome, CAST(retry_count + 1 AS INTEGER), failure_reason
FROM outcomes WHERE outcome <> 'delivered')
SELECT rows.*, CASE WHEN batch_id < 2 THEN 'fallback' ELSE 'primary' END AS sink FROM rows JOIN sliced USING (message_id)""")

SQL["stream_lag"] = with_views(_SLICES + """
SELECT batch_id, count(*) AS consumed, CAST((SELECT count(*) FROM consumed) - sum(count(*)) OVER (ORDER BY batch_id) AS BIGINT) AS lag
FROM sliced GROUP BY batch_id""", "consumed")

SQL["stream_closed_windows"] = SQL["stream_usage_windows"]

SQL["stream_fan_out_as_of"] = SQL["fan_out_as_of"]

SQL["stream_audit_table"] = _dispatch("""
, rows AS (
  SELECT *, 'received' AS status, retry_count AS attempt, '' AS error FROM outcomes WHERE received_ok
  UNION ALL
  SELECT *, 'delivered', retry_count, '' FROM outcomes WHERE received_ok AND NOT simulate_fail AND delivered_ok
  UNION ALL
  SELECT *, outcome, CAST(retry_count + 1 AS INTEGER), failure_reason FROM outcomes WHERE outcome <> 'delivered')
SELECT tenant_id, arrival_ts AS event_time, status AS event_type, CAST(message_id AS VARCHAR) AS notification_id,
       'channel=' || channel || ',attempt=' || CAST(attempt AS VARCHAR) || ',error=' || error
         || ',correlation_id=' || correlation_id AS details
FROM rows""")

SQL["normalise_stages"] = with_views("""
, gaps AS (
  SELECT seq, CASE WHEN seq % 3 <> 0 THEN tenant_id END AS tenant_id, CASE WHEN seq % 5 <> 0 THEN user_id END AS user_id,
         CASE WHEN seq % 7 <> 0 THEN channel END AS channel, CASE WHEN seq % 11 <> 0 THEN content END AS content,
         CASE WHEN seq % 13 <> 0 THEN correlation_id END AS correlation_id, CASE WHEN seq % 2 <> 0 THEN error END AS error,
         CASE WHEN seq % 17 <> 0 THEN attempt END AS attempt, CASE WHEN seq % 19 <> 0 THEN status END AS status
  FROM history)
SELECT seq, 'dispatch' AS stage, coalesce(tenant_id, 'unknown') AS tenant_id, coalesce(user_id, 'unknown') AS user_id,
       coalesce(channel, 'default') AS channel, coalesce(content, '') AS content, coalesce(correlation_id, '') AS correlation_id,
       error, attempt, status FROM gaps
UNION ALL
SELECT seq, 'storage', tenant_id, coalesce(user_id, 'unknown'), coalesce(channel, 'default'), coalesce(content, ''),
       coalesce(correlation_id, ''), coalesce(error, ''), coalesce(attempt, 0), status FROM gaps
UNION ALL
SELECT seq, 'read', tenant_id, coalesce(user_id, 'unknown'), coalesce(channel, 'default'), coalesce(content, ''),
       coalesce(correlation_id, ''), coalesce(error, ''), coalesce(attempt, 0), coalesce(status, 'unknown') FROM gaps""", "history")

SQL["admission_with_tokens"] = admission_sql(1, 50, 3000, 0, publish=True, tokens=True)

SQL["route_storage_requests"] = """
WITH log AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 10 IN (1, 2, 3) AND event_id % 30 < 20 THEN 'POST' ELSE 'GET' END AS method,
         CASE event_id % 10
           WHEN 0 THEN '/health' WHEN 1 THEN '/v1/internal/idempotency/claim' WHEN 2 THEN '/v1/internal/idempotency/release'
           WHEN 3 THEN '/v1/internal/store'
           WHEN 4 THEN '/v1/internal/notifications/n-' || CAST(event_id // 4 AS VARCHAR) || '?tenant_id=tenant-' || CAST(user_id % 5 AS VARCHAR)
           WHEN 5 THEN '/v1/internal/notifications/n-' || CAST(event_id // 4 AS VARCHAR)
           WHEN 6 THEN '/v1/internal/tenants/tenant-' || CAST(user_id % 5 AS VARCHAR) || '/deliveries?limit='
                       || (['7', '0', '9999', 'abc'])[(event_id // 10) % 4 + 1]
           WHEN 7 THEN '/v1/internal/tenants/tenant-' || CAST(user_id % 5 AS VARCHAR) || '/deliveries'
           WHEN 8 THEN '/v1/notifications' ELSE '/v1/internal/tenants/tenant-' || CAST(user_id % 5 AS VARCHAR) END AS path,
         event_id, user_id
  FROM events),
routed AS (
  SELECT *, CASE event_id % 10 WHEN 0 THEN 'health' WHEN 4 THEN 'notification_state' WHEN 5 THEN 'notification_state'
                 WHEN 6 THEN 'tenant_deliveries' WHEN 7 THEN 'tenant_deliveries' ELSE
            CASE WHEN method = 'POST' AND path = '/v1/internal/idempotency/claim' THEN 'claim'
                 WHEN method = 'POST' AND path = '/v1/internal/idempotency/release' THEN 'release'
                 WHEN method = 'POST' AND path = '/v1/internal/store' THEN 'store' ELSE 'not_found' END END AS route
  FROM log)
SELECT request_id, route,
       CAST(CASE WHEN route = 'not_found' THEN 404 WHEN event_id % 10 = 5 THEN 400 ELSE 200 END AS INTEGER) AS http_status,
       CASE WHEN route = 'notification_state' THEN 'n-' || CAST(event_id // 4 AS VARCHAR) END AS resource_id,
       CASE WHEN event_id % 10 IN (4, 6, 7) THEN 'tenant-' || CAST(user_id % 5 AS VARCHAR) END AS tenant_id,
       CAST(CASE event_id % 10 WHEN 7 THEN 50 WHEN 6 THEN (ARRAY[7, 1, 500, 50])[(event_id // 10) % 4 + 1] END AS INTEGER) AS "limit"
FROM routed"""
