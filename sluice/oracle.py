"""DuckDB oracle SQL: the fixture views of FIXTURES.md part B as CTEs.

``with_views(sql, *names)`` prefixes a query with the CTEs it needs.  The
definitions must stay identical to :mod:`sluice.sources.fixtures`.
"""

from __future__ import annotations

# Fixed values of the fixture definition (FIXTURES.md part B).
VIEWS: dict[str, str] = {
    "requests": """
  SELECT event_id AS message_id,
         ts AS arrival_ts,
         'tenant-' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         CASE WHEN event_id % 20 <> 3 THEN CAST(user_id AS VARCHAR) END AS user_field,
         CASE WHEN event_id % 25 <> 4 THEN event_type END AS channel_field,
         CASE WHEN event_id % 50 = 7 THEN '' ELSE props END AS content,
         CASE WHEN event_id % 4 = 0 THEN 'corr-h-' || CAST(event_id AS VARCHAR)
              WHEN event_id % 4 = 1 THEN '' END AS header_corr,
         CASE WHEN event_id % 4 IN (1, 2) THEN 'corr-b-' || CAST(event_id AS VARCHAR) END AS body_corr,
         CASE WHEN event_id % 10 <> 0 THEN
              concat_ws('#', CAST(user_id AS VARCHAR), event_type, CAST(CAST(ts AS DATE) AS VARCHAR)) END
           AS idempotency_key,
         event_id % 211 <> 5 AS publish_ok
  FROM events""",
    "claims": """
  SELECT tenant_id, idempotency_key,
         'claim-' || CAST(min(message_id) AS VARCHAR) AS notification_id,
         min(arrival_ts) AS created_ts
  FROM requests
  WHERE message_id % 17 = 3 AND idempotency_key IS NOT NULL
  GROUP BY tenant_id, idempotency_key""",
    "retry_entries": """
  SELECT event_id AS message_id, ts AS entry_ts FROM events WHERE event_type = 'error'""",
    "consumed": """
  SELECT event_id AS message_id,
         'tenant-' || CAST(user_id % 5 AS VARCHAR) AS tenant_id,
         CAST(user_id AS VARCHAR) AS user_id,
         event_type AS channel,
         props AS content,
         ts AS arrival_ts,
         'corr-' || CAST(event_id // 4 AS VARCHAR) AS correlation_id,
         CAST(event_id % 4 AS INTEGER) AS retry_count,
         event_type = 'error' AS simulate_fail,
         event_id % 101 <> 0 AS received_ok,
         event_id % 103 <> 0 AS delivered_ok,
         event_id % 97 <> 0 AS push_ok,
         event_id % 107 <> 0 AS ack_ok,
         (epoch_us(ts) // 1000) AS seen_ms,
         CASE WHEN event_id % 4 > 0 THEN (epoch_us(ts) // 1000) + CAST(floor(value * 100) AS BIGINT) END
           AS next_attempt_at_ms,
         CASE WHEN event_id % 4 > 0 THEN 'retry' ELSE 'main' END AS source_stream,
         CASE WHEN event_id % 4 > 0 THEN CASE WHEN event_id % 43 = 5 THEN event_id + 1000000000000 ELSE event_id - 1 END END
           AS previous_stream_id,
         CAST(floor(value) AS BIGINT) AS duration_ms
  FROM events""",
    "history": """
  SELECT 'tenant-' || CAST((event_id // 4) % 5 AS VARCHAR) AS tenant_id,
         'n-' || CAST(event_id // 4 AS VARCHAR) AS notification_id,
         CAST(user_id AS VARCHAR) AS user_id,
         CAST(event_id % 4 AS INTEGER) AS attempt,
         event_id AS seq,
         ts AS status_ts,
         CASE WHEN event_id % 4 = 0 THEN 'received'
              WHEN event_id % 4 = 3 THEN CASE WHEN event_type = 'error' THEN 'dlq' ELSE 'delivered' END
              WHEN event_type = 'error' THEN 'retry_scheduled'
              ELSE 'delivered' END AS status,
         event_type AS channel,
         props AS content,
         'corr-' || CAST(event_id // 4 AS VARCHAR) AS correlation_id,
         CASE WHEN event_type = 'error' THEN 'simulated_failure' ELSE '' END AS error
  FROM events""",
    "sessions": """
  SELECT s_suppkey AS session_id,
         'tenant-' || CAST(s_suppkey % 5 AS VARCHAR) AS tenant_id,
         (['view', 'click', 'purchase', 'signup', 'error'])[s_nationkey % 5 + 1] AS channel,
         CASE WHEN s_suppkey % 10 = 4 THEN hour + INTERVAL 10 MINUTE ELSE hour END AS sub_start,
         CASE WHEN s_suppkey % 10 = 4 THEN hour + INTERVAL 50 MINUTE
              WHEN s_suppkey % 10 = 6 THEN hour + INTERVAL 400 DAY
              WHEN s_suppkey % 10 <> 3 THEN hour + to_hours(CAST(24 + s_nationkey AS BIGINT)) END AS sub_end
  FROM (SELECT *, TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((s_suppkey * 7) % 720 AS BIGINT)) AS hour FROM supplier)""",
    "dispatched": """
  SELECT *,
    CASE WHEN failure_reason IS NULL THEN 'delivered'
         WHEN retry_count + 1 > 3 THEN 'dlq' ELSE 'retry_scheduled' END AS outcome,
    greatest(1, least(10000, 250 * (CAST(1 AS BIGINT) << greatest(0, least(retry_count, 20))))) AS backoff
  FROM (
    SELECT *,
      CASE WHEN NOT received_ok THEN 'storage_persist_failed_received'
           WHEN simulate_fail THEN 'simulated_failure'
           WHEN NOT delivered_ok THEN 'storage_persist_failed_delivered'
           WHEN NOT push_ok THEN 'gateway_delivery_failed' END AS failure_reason
    FROM consumed)""",
    "dead_letters": """
  SELECT * EXCLUDE (outcome, backoff, source_stream), message_id AS original_stream_id,
         CAST(retry_count + 1 AS INTEGER) AS final_retry_count, 'dlq' AS source_stream
  FROM dispatched WHERE outcome = 'dlq'""",
    "reads": """
  SELECT source_stream, message_id, tenant_id, arrival_ts FROM consumed""",
    "acks": """
  SELECT source_stream, message_id FROM reads WHERE message_id % 10 < 7""",
    "group_positions": """
  SELECT source_stream, CASE WHEN source_stream = 'main' THEN max(message_id) * 9 // 10 END AS last_delivered FROM consumed GROUP BY source_stream""",
    "persisted": """
  SELECT tenant_id, message_id,
         CASE WHEN message_id % 41 = 6 THEN content || '#altered' ELSE content END AS content
  FROM consumed WHERE message_id % 37 <> 5
  UNION ALL SELECT tenant_id, message_id + 1000000000000, content FROM consumed WHERE message_id % 53 = 7""",
    "releases": """
  SELECT tenant_id, idempotency_key,
         CASE WHEN length(idempotency_key) % 2 = 0 THEN notification_id
              ELSE notification_id || '-other' END AS notification_id
  FROM claims""",
}

# Which views each view reads (so CTEs are emitted in dependency order).
DEPENDS: dict[str, tuple[str, ...]] = {
    "claims": ("requests",),
    "dispatched": ("consumed",),
    "dead_letters": ("dispatched",),
    "reads": ("consumed",),
    "acks": ("reads",),
    "group_positions": ("consumed",),
    "persisted": ("consumed",),
    "releases": ("claims",),
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with CTEs for the named fixture views (and their inputs).

    ``sql`` may start with ``, name AS (...)`` to add CTEs of its own.
    """
    order: list[str] = []

    def visit(n: str) -> None:
        for d in DEPENDS.get(n, ()):
            visit(d)
        if n not in order:
            order.append(n)

    for n in names:
        visit(n)
    if not order:
        return sql
    ctes = ",\n".join(f"{n} AS ({VIEWS[n]}\n)" for n in order)
    if sql.lstrip().startswith(","):
        return f"WITH {ctes}\n{sql.lstrip()}"
    return f"WITH {ctes}\n{sql}"


def admission_sql(limit: int, quota: int, main: int, retry: int, body: str | None = None, publish: bool = False,
                  tokens: bool = False, checks: bool = False) -> str:
    """Set-based C01 with plain windows; ``body`` selects from CTE ``decided``.

    ``publish``: a request whose ``publish_ok`` is false fails to publish and releases its claim.
    ``tokens``: a valid bearer token names the tenant and an invalid one refuses the request.
    ``checks``: the checks of some requests cannot be made (fixed moduli of message_id).
    """
    quota_made, main_made, retry_made, claim_made = (
        f"r.message_id % {m} <> {k}" if checks and on else "true" for m, k, on in
        ((223, 6, quota > 0), (227, 9, main > 0), (229, 11, retry > 0), (233, 13, True)))
    tenant = "CASE v.token_status WHEN 'valid' THEN v.token_tenant WHEN 'invalid' THEN NULL ELSE r.tenant_id END" if tokens else "r.tenant_id"
    auth = "CASE WHEN v.token_status = 'invalid' THEN 'invalid_bearer_token' " if tokens else "CASE "
    verdicts = """ JOIN (
    SELECT event_id, CASE WHEN event_id % 13 = 0 THEN NULL WHEN event_id % 10 <= 2 THEN 'valid' ELSE 'invalid' END AS token_status,
           'tenant-' || CAST((user_id + event_id % 3) % 5 AS VARCHAR) AS token_tenant FROM events) v ON v.event_id = r.message_id""" if tokens else ""
    body = body or """SELECT message_id, tenant_id, correlation_id, decision, reason,
       http_status, quota_count, canonical_id FROM decided"""
    main_cut = (f"""(SELECT arrival_ts AS cut_ts, message_id AS cut_id FROM flagged WHERE publishable
          ORDER BY arrival_ts, message_id LIMIT 1 OFFSET {main - 1})""" if main > 0 else
                "(SELECT NULL::TIMESTAMP AS cut_ts, NULL::BIGINT AS cut_id WHERE false)")
    retry_cut = (f"""(SELECT entry_ts AS rcut_ts FROM retry_entries
          ORDER BY entry_ts, message_id LIMIT 1 OFFSET {retry - 1})""" if retry > 0 else
                 "(SELECT NULL::TIMESTAMP AS rcut_ts WHERE false)")
    sql = f"""
, base AS (
  SELECT message_id, arrival_ts, {tenant} AS tenant_id, {auth}WHEN r.tenant_id IS NULL THEN 'tenant_missing' END AS auth_reason,
         coalesce(nullif(header_corr, ''), nullif(body_corr, ''),
                  'corr-' || CAST(epoch_us(arrival_ts) // 1000000 AS VARCHAR) || '-' || CAST(message_id AS VARCHAR))
           AS correlation_id,
         nullif(idempotency_key, '') AS idem_key,
         coalesce(length(content), 0) > 0 AS content_ok,
         {'publish_ok' if publish else 'true'} AS can_publish,
         {quota_made} AS quota_made, {main_made} AS main_made, {retry_made} AS retry_made, {claim_made} AS claim_made
  FROM requests r{verdicts}),
el AS (SELECT *, content_ok AND auth_reason IS NULL AS eligible FROM base),
rk AS (
  SELECT *, CASE WHEN eligible THEN row_number() OVER (
           PARTITION BY eligible, tenant_id, epoch_us(arrival_ts) // 60000000
           ORDER BY arrival_ts, message_id) END AS rank_in_minute
  FROM el),
rl AS (SELECT *, eligible AND ({limit} <= 0 OR rank_in_minute <= {limit}) AS rate_ok FROM rk),
qd AS (
  SELECT *, CASE WHEN rate_ok AND quota_made THEN row_number() OVER (
           PARTITION BY rate_ok AND quota_made, tenant_id, epoch_us(arrival_ts) // 86400000000
           ORDER BY arrival_ts, message_id) END AS rank_in_day
  FROM rl),
kept AS (SELECT *, rate_ok AND quota_made AND ({quota} <= 0 OR rank_in_day <= {quota}) AS survivor FROM qd),
sv AS (
  SELECT *, unmade IS NULL AND survivor AS reaches FROM (
    SELECT *, CASE WHEN rate_ok AND NOT quota_made THEN 'quota_check_failed' WHEN NOT survivor THEN NULL
                   WHEN NOT main_made THEN 'backpressure_check_failed' WHEN NOT retry_made THEN 'retry_backpressure_check_failed'
                   WHEN idem_key IS NOT NULL AND NOT claim_made THEN 'idempotency_claim_failed' END AS unmade
    FROM kept)),
win AS (
  SELECT tenant_id, idem_key, message_id AS winner_id, correlation_id AS winner_corr, arrival_ts AS winner_ts FROM (
    SELECT *, row_number() OVER (PARTITION BY tenant_id, idem_key ORDER BY arrival_ts, message_id) AS rn
    FROM sv WHERE reaches AND can_publish AND idem_key IS NOT NULL) WHERE rn = 1),
flagged AS (
  SELECT sv.*, w.winner_id, w.winner_corr, c.notification_id AS prior_id,
         c.tenant_id IS NOT NULL AS has_prior,
         CASE WHEN sv.reaches AND sv.idem_key IS NOT NULL THEN
              c.tenant_id IS NULL AND coalesce(sv.message_id = w.winner_id, false) END AS claimed,
         sv.reaches AND sv.can_publish AND (sv.idem_key IS NULL OR (c.tenant_id IS NULL AND sv.message_id = w.winner_id))
           AS publishable,
         sv.reaches AND NOT sv.can_publish AND (sv.idem_key IS NULL OR (c.tenant_id IS NULL AND (w.winner_id IS NULL
           OR (sv.arrival_ts, sv.message_id) < (w.winner_ts, w.winner_id)))) AS publish_failed
  FROM sv
  LEFT JOIN win w ON sv.reaches AND sv.tenant_id = w.tenant_id AND sv.idem_key = w.idem_key
  LEFT JOIN claims c ON sv.reaches AND sv.tenant_id = c.tenant_id AND sv.idem_key = c.idempotency_key),
mcut AS {main_cut},
rcut AS {retry_cut},
gated AS (
  SELECT f.*,
    CASE WHEN NOT f.survivor THEN NULL
         WHEN {'true' if main > 0 else 'false'}
              AND ({'true' if main <= 0 else 'false'} OR (
                   (SELECT count(*) FROM mcut) = 1
                   AND ((SELECT count(*) FROM rcut) = 0 OR (SELECT cut_ts FROM mcut) <= (SELECT rcut_ts FROM rcut))))
              AND ({'true' if main <= 0 else 'false'} OR f.arrival_ts > (SELECT cut_ts FROM mcut)
                   OR (f.arrival_ts = (SELECT cut_ts FROM mcut) AND f.message_id > (SELECT cut_id FROM mcut)))
           THEN 'stream_backpressure'
         WHEN {'true' if retry > 0 else 'false'}
              AND f.arrival_ts > (SELECT rcut_ts FROM rcut)
           THEN 'retry_stream_backpressure'
    END AS gate_reason
  FROM flagged f),
reasoned AS (
  SELECT *,
    CASE WHEN NOT content_ok THEN 'content_required'
         WHEN auth_reason IS NOT NULL THEN auth_reason
         WHEN NOT rate_ok THEN 'rate_limited'
         WHEN unmade = 'quota_check_failed' THEN unmade
         WHEN NOT survivor THEN 'daily_quota_exceeded'
         WHEN unmade = 'backpressure_check_failed' THEN unmade
         WHEN gate_reason = 'stream_backpressure' THEN gate_reason
         WHEN unmade = 'retry_backpressure_check_failed' THEN unmade
         WHEN gate_reason IS NOT NULL THEN gate_reason
         WHEN unmade IS NOT NULL THEN unmade
         WHEN publish_failed THEN 'redis_publish_failed'
         WHEN idem_key IS NOT NULL AND NOT claimed THEN 'duplicate_idempotency_key'
         ELSE 'ok' END AS reason
  FROM gated),
decided AS (
  SELECT message_id, CASE WHEN auth_reason IS NULL THEN tenant_id END AS tenant_id,
         correlation_id, reason,
         CASE reason WHEN 'ok' THEN 'accepted' WHEN 'duplicate_idempotency_key' THEN 'duplicate'
              ELSE 'rejected' END AS decision,
         CAST(CASE WHEN reason IN ('ok', 'duplicate_idempotency_key') THEN 202
              WHEN reason = 'content_required' THEN 400
              WHEN reason = 'redis_publish_failed' OR reason = unmade THEN 503
              WHEN reason = auth_reason THEN 401 ELSE 429 END AS INTEGER) AS http_status,
         CASE WHEN rate_ok AND quota_made AND {quota} > 0 THEN rank_in_day END AS quota_count,
         CASE WHEN reason = 'ok' THEN correlation_id
              WHEN reason = 'duplicate_idempotency_key' THEN
                coalesce(nullif(CASE WHEN has_prior THEN prior_id ELSE winner_corr END, ''), correlation_id)
         END AS canonical_id,
         rank_in_minute, rank_in_day, rate_ok, survivor, claimed, publishable, gate_reason,
         winner_id, idem_key, arrival_ts
  FROM reasoned)
{body}"""
    return with_views(sql, "requests", "claims", "retry_entries")
