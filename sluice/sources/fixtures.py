"""Operator inputs derived from the given tables (see FIXTURES.md, part B).

Each view is a pure projection / filter / aggregate of ``events``,
``supplier``, ``conversations`` or ``pages``, so it scales with them and is
planned together with the operator that reads it.  The matching DuckDB
definitions live in :mod:`sluice.oracle`; both sides must stay identical.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import epoch_ms
from sluice.sources.tables import table

# Fixed values of the fixture definition (FIXTURES.md part B).
CHANNELS_BY_NATION = ["view", "click", "purchase", "signup", "error"]
SESSION_EPOCH = "2024-01-01 00:00:00"
MISSING_PARENT = 1_000_000_000_000  # offset of previous_stream_id values that no entry has
ORPHAN_STATE = 1_000_000_000_000  # offset of persisted ids that no entry has


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def _tenant_of(c: Column) -> Column:
    return F.concat(F.lit("tenant-"), (c % 5).cast("string"))


def _request_columns() -> list:
    eid = F.col("event_id")
    m4 = eid % 4
    return [
        eid.alias("message_id"),
        F.col("ts").alias("arrival_ts"),
        _tenant_of(F.col("user_id")).alias("tenant_id"),
        F.when(eid % 20 != 3, F.col("user_id").cast("string")).alias("user_field"),
        F.when(eid % 25 != 4, F.col("event_type")).alias("channel_field"),
        F.when(eid % 50 == 7, F.lit("")).otherwise(F.col("props")).alias("content"),
        F.when(m4 == 0, F.concat(F.lit("corr-h-"), eid.cast("string")))
         .when(m4 == 1, F.lit("")).alias("header_corr"),
        F.when(m4.isin(1, 2), F.concat(F.lit("corr-b-"), eid.cast("string"))).alias("body_corr"),
        F.when(eid % 10 != 0,
               F.concat_ws("#", F.col("user_id").cast("string"), F.col("event_type"),
                           F.to_date("ts").cast("string"))).alias("idempotency_key"),
        (eid % 211 != 5).alias("publish_ok"),
    ]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ingress requests, one per event, with injected gaps."""
    return _events(spark, sf_dir).select(*_request_columns())


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prior idempotency claims: one row per (tenant, key)."""
    r = requests(spark, sf_dir)
    return (r.filter((F.col("message_id") % 17 == 3)
                     & F.col("idempotency_key").isNotNull())
             .groupBy("tenant_id", "idempotency_key")
             .agg(F.concat(F.lit("claim-"), F.min("message_id").cast("string")).alias("notification_id"),
                  F.min("arrival_ts").alias("created_ts")))


def retry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the retry stream (failed events)."""
    e = _events(spark, sf_dir)
    return (e.filter(F.col("event_type") == "error")
             .select(F.col("event_id").alias("message_id"), F.col("ts").alias("entry_ts")))


def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows the dispatcher reads, with outcome switches of the side effects."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    rc = (eid % 4).cast("int")
    seen = epoch_ms("ts")
    return e.select(
        eid.alias("message_id"),
        _tenant_of(F.col("user_id")).alias("tenant_id"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("channel"),
        F.col("props").alias("content"),
        F.col("ts").alias("arrival_ts"),
        F.concat(F.lit("corr-"), F.expr("event_id div 4").cast("string")).alias("correlation_id"),
        rc.alias("retry_count"),
        (F.col("event_type") == "error").alias("simulate_fail"),
        (eid % 101 != 0).alias("received_ok"),
        (eid % 103 != 0).alias("delivered_ok"),
        (eid % 97 != 0).alias("push_ok"),
        (eid % 107 != 0).alias("ack_ok"),
        seen.alias("seen_ms"),
        F.when(rc > 0, seen + F.floor(F.col("value") * 100).cast("bigint")).alias("next_attempt_at_ms"),
        F.when(rc > 0, F.lit("retry")).otherwise(F.lit("main")).alias("source_stream"),
        F.when(rc > 0, F.when(eid % 43 == 5, eid + MISSING_PARENT).otherwise(eid - 1)).alias("previous_stream_id"),
        F.floor(F.col("value")).cast("bigint").alias("duration_ms"),
    )


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status records: four attempts per notification."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    attempt = (eid % 4).cast("int")
    err = F.col("event_type") == "error"
    nid = F.expr("event_id div 4")
    return e.select(
        _tenant_of(nid).alias("tenant_id"),
        F.concat(F.lit("n-"), nid.cast("string")).alias("notification_id"),
        F.col("user_id").cast("string").alias("user_id"),
        attempt.alias("attempt"),
        eid.alias("seq"),
        F.col("ts").alias("status_ts"),
        F.when(attempt == 0, F.lit("received"))
         .when(attempt == 3, F.when(err, F.lit("dlq")).otherwise(F.lit("delivered")))
         .when(err, F.lit("retry_scheduled")).otherwise(F.lit("delivered")).alias("status"),
        F.col("event_type").alias("channel"),
        F.col("props").alias("content"),
        F.concat(F.lit("corr-"), nid.cast("string")).alias("correlation_id"),
        F.when(err, F.lit("simulated_failure")).otherwise(F.lit("")).alias("error"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscriptions: one session per supplier."""
    s = table(spark, sf_dir, "supplier")
    chan = F.element_at(F.array(*[F.lit(c) for c in CHANNELS_BY_NATION]),
                        (F.col("s_nationkey") % 5 + 1).cast("int"))
    kind = F.col("s_suppkey") % 10  # 3 still open, 4 within an hour, 6 longer than a year
    hour = F.lit(SESSION_EPOCH).cast("timestamp_ntz") + F.make_dt_interval(hours=(F.col("s_suppkey") * 7) % 720)
    start = F.when(kind == 4, hour + F.make_dt_interval(mins=F.lit(10))).otherwise(hour)
    end = (F.when(kind == 4, hour + F.make_dt_interval(mins=F.lit(50)))
            .when(kind == 6, hour + F.make_dt_interval(days=F.lit(400)))
            .when(kind != 3, hour + F.make_dt_interval(hours=F.lit(24) + F.col("s_nationkey"))))
    return s.select(
        F.col("s_suppkey").alias("session_id"),
        _tenant_of(F.col("s_suppkey")).alias("tenant_id"),
        chan.alias("channel"),
        start.alias("sub_start"),
        end.alias("sub_end"),
    )


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consumed rows whose dispatch outcome is the dead-letter stream (S08 rows)."""
    from sluice.operators.dispatch import dlq_rows
    return dlq_rows(consumed(spark, sf_dir))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries the consumer group has read: every consumed row."""
    return consumed(spark, sf_dir).select("source_stream", "message_id", "tenant_id", "arrival_ts")


def acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Acknowledged entries: ``message_id % 10 < 7``."""
    return reads(spark, sf_dir).filter(F.col("message_id") % 10 < 7).select("source_stream", "message_id")


def group_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last delivered id of the consumer group; the retry stream has none yet."""
    return (consumed(spark, sf_dir).groupBy("source_stream")
            .agg(F.expr("max(message_id) * 9 div 10").alias("last_delivered"))
            .withColumn("last_delivered", F.when(F.col("source_stream") == "main", F.col("last_delivered"))))


def persisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persisted state rows: some missing, some with altered content, some without an entry."""
    c = consumed(spark, sf_dir)
    held = (c.filter(F.col("message_id") % 37 != 5)
             .select("tenant_id", "message_id",
                     F.when(F.col("message_id") % 41 == 6, F.concat(F.col("content"), F.lit("#altered")))
                      .otherwise(F.col("content")).alias("content")))
    orphans = c.filter(F.col("message_id") % 53 == 7).select("tenant_id", (F.col("message_id") + ORPHAN_STATE).alias("message_id"), "content")
    return held.unionByName(orphans)


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release requests, one per prior claim; half carry a different id."""
    c = claims(spark, sf_dir)
    return c.select("tenant_id", "idempotency_key",
                    F.when(F.length("idempotency_key") % 2 == 0, F.col("notification_id"))
                     .otherwise(F.concat(F.col("notification_id"), F.lit("-other"))).alias("notification_id"))


# Fixed values of the token fixture: the signing secret (the local default
# of the reference deployment), a wrong one, the audit delay and skew.
TOKEN_SECRET = "change-me"
WRONG_SECRET = "not-the-secret"
TOKEN_CHECK_DELAY_S = 30


def _token_columns(e: DataFrame) -> list:
    """``authorization`` header and ``checked_at_s`` for each event.

    Defect by ``event_id % 10``: 0-2 none (2 uses the ``tid`` claim), 3
    format, 4 alg, 5 signature, 6 no exp, 7 expired, 8 nbf in the future,
    9 no tenant claim.  No header at all when ``event_id % 13 = 0``.
    """
    from sluice.operators.validation import b64url_encode
    eid = F.col("event_id")
    d = eid % 10
    t0 = F.unix_seconds(F.col("ts").cast("timestamp"))
    tok_tenant = F.concat(F.lit("tenant-"), ((F.col("user_id") + eid % 3) % 5).cast("string"))
    header = F.when(d == 4, F.lit('{"alg":"none","typ":"JWT"}')).otherwise(F.lit('{"alg":"HS256","typ":"JWT"}'))
    tenant_claim = (F.when(d == 9, F.lit(""))
                     .when(d == 2, F.concat(F.lit('"tid":"'), tok_tenant, F.lit('",')))
                     .otherwise(F.concat(F.lit('"tenant_id":"'), tok_tenant, F.lit('",'))))
    nbf = F.when(d == 8, t0 + 600).otherwise(t0)
    exp = F.when(d == 7, t0 - 600).otherwise(t0 + 3600)
    payload = F.concat(F.lit("{"), tenant_claim, F.lit('"sub":"user-'), F.col("user_id").cast("string"),
                       F.lit('","iat":'), t0.cast("string"), F.lit(',"nbf":'), nbf.cast("string"),
                       F.when(d == 6, F.lit("")).otherwise(F.concat(F.lit(',"exp":'), exp.cast("string"))),
                       F.lit("}"))
    signing = F.concat(b64url_encode(F.encode(header, "UTF-8")), F.lit("."),
                       b64url_encode(F.encode(payload, "UTF-8")))
    return [signing.alias("_signing"), d.alias("_defect"), (t0 + TOKEN_CHECK_DELAY_S).alias("checked_at_s")]


def _with_token(df: DataFrame) -> DataFrame:
    """Sign ``_signing`` (wrong secret for defect 5) and build the header."""
    from sluice.operators.validation import b64url_encode, hmac_sha256
    signing, d = F.col("_signing"), F.col("_defect")
    secret_ok = hmac_sha256(TOKEN_SECRET, signing)
    secret_bad = hmac_sha256(WRONG_SECRET, signing)
    sig = b64url_encode(F.when(d == 5, secret_bad).otherwise(secret_ok))
    token = F.when(d == 3, signing).otherwise(F.concat(signing, F.lit("."), sig))
    auth = F.when(F.col("message_id") % 13 != 0, F.concat(F.lit("Bearer "), token))
    return df.withColumn("authorization", auth).drop("_signing", "_defect")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bearer tokens with injected defects, one per event."""
    e = _events(spark, sf_dir)
    return _with_token(e.select(F.col("event_id").alias("message_id"), *_token_columns(e)))


def authed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``requests`` plus the bearer token of each request (one scan)."""
    e = _events(spark, sf_dir)
    return _with_token(e.select(*_request_columns(), *_token_columns(e)))


def store_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Storage requests (store / claim / release) with missing fields."""
    h = history(spark, sf_dir)
    s = F.col("seq")
    return h.select(
        s.alias("record_id"),
        F.when(s % 3 == 0, F.lit("store")).when(s % 3 == 1, F.lit("claim")).otherwise(F.lit("release")).alias("kind"),
        F.when(s % 19 != 0, F.col("tenant_id")).alias("tenant_id"),
        F.when(s % 23 == 0, F.lit("")).otherwise(F.col("notification_id")).alias("notification_id"),
        "status",
        F.when(s % 29 != 0, F.col("correlation_id")).alias("idempotency_key"))


def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subscription frames of client sessions (one conversation = one session)."""
    c = table(spark, sf_dir, "conversations")
    cid, turn = F.col("conv_id"), F.col("turn")
    chan = F.element_at(F.array(*[F.lit(x) for x in CHANNELS_BY_NATION]), (turn % 5 + 1).cast("int"))
    return c.select(
        cid.alias("session_id"), turn.alias("seq"),
        F.when(F.col("role") == "user", F.lit("subscribe")).otherwise(F.lit("noop")).alias("type"),
        F.when(cid % 7 != 0, F.concat(F.lit("tenant-"), (cid % 5).cast("string"))).alias("auth_tenant"),
        F.when(cid % 11 == 0, F.concat(F.lit("tenant-"), ((cid + 1) % 5).cast("string")))
         .otherwise(F.concat(F.lit("tenant-"), (cid % 5).cast("string"))).alias("tenant_id"),
        F.when(turn == 3, F.lit("")).otherwise(chan).alias("channel"))


# Fixed values of the access-log fixture: limit texts cycled through.
LIMIT_TEXTS = ["7", "0", "9999", "abc"]
PAGE_REQUEST_BASE = 1_000_000_000


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP requests covering every route, plus the paths of ``pages.url``."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    d = eid % 10
    ten = F.concat(F.lit("tenant-"), (F.col("user_id") % 5).cast("string"))
    nid = F.concat(F.lit("n-"), F.expr("event_id div 4").cast("string"))
    lim = F.element_at(F.array(*[F.lit(x) for x in LIMIT_TEXTS]), (F.expr("event_id div 10") % 4 + 1).cast("int"))
    path = (F.when(d == 0, F.lit("/health"))
             .when(d == 1, F.lit("/metrics"))
             .when(d == 2, F.concat(F.lit("/ws?access_token=tok-"), eid.cast("string")))
             .when(d == 3, F.concat(F.lit("/v1/notifications/"), nid, F.lit("?tenant_id="), ten))
             .when(d == 4, F.concat(F.lit("/v1/notifications/"), nid,
                                    F.when(eid % 20 == 14, F.lit("?tenant_id=")).otherwise(F.lit(""))))
             .when(d == 5, F.concat(F.lit("/v1/tenants/"), ten, F.lit("/deliveries?limit="), lim))
             .when(d == 6, F.concat(F.lit("/v1/tenants/"), ten, F.lit("/deliveries")))
             .when(d == 7, F.lit("/v1/notifications"))
             .when(d == 8, F.lit("/v1/internal/deliver"))
             .otherwise(F.concat(F.lit("/v1/tenants/"), ten)))
    method = F.when(d.isin(7, 8), F.lit("POST")).otherwise(F.lit("GET"))
    ev = e.select(eid.alias("request_id"), method.alias("method"), path.alias("path"))
    pg = table(spark, sf_dir, "pages").select(
        (F.col("page_id") + PAGE_REQUEST_BASE).alias("request_id"), F.lit("GET").alias("method"),
        F.regexp_extract("url", r"^[a-z]+://[^/]+(/[^#]*)", 1).alias("path"))
    return ev.unionByName(pg)


def kv_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alternating key/value arrays with a repeated key; odd length when ``event_id % 3 = 0``."""
    e = _events(spark, sf_dir)
    base = F.array(F.lit("a"), F.col("user_id").cast("string"), F.lit("b"), F.col("event_type"),
                   F.lit("a"), F.col("event_id").cast("string"))
    arr = F.when(F.col("event_id") % 3 == 0, F.concat(base, F.array(F.lit("c")))).otherwise(base)
    return e.select("event_id", arr.alias("arr"))


def payload_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status records as JSON text; broken when ``seq % 29 = 0``, blank when ``seq % 31 = 0``."""
    h = history(spark, sf_dir)
    js = F.concat(F.lit('{"tenant_id":"'), F.col("tenant_id"), F.lit('","notification_id":"'),
                  F.col("notification_id"), F.lit('","status":"'), F.col("status"), F.lit('","attempt":'),
                  F.col("attempt").cast("string"), F.lit(',"error":"'), F.col("error"), F.lit('"}'))
    s = F.col("seq")
    text = (F.when(s % 31 == 0, F.lit(""))
             .when(s % 29 == 0, F.substring(js, F.lit(1), F.floor(F.length(js) / 2).cast("int")))
             .otherwise(js))
    return h.select("seq", "status_ts", text.alias("payload"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit-file lines ``{"ts":..,"record":..}`` wrapping ``payload_lines``."""
    p = payload_lines(spark, sf_dir)
    line = F.when(F.col("payload") == "", F.lit("")).otherwise(
        F.concat(F.lit('{"ts":'), F.unix_seconds(F.col("status_ts").cast("timestamp")).cast("string"),
                 F.lit(',"record":'), F.col("payload"), F.lit("}")))
    return p.select("seq", line.alias("value"))


def gapped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status records with missing fields, each field by its own modulus of ``seq``."""
    gaps = {"tenant_id": 3, "user_id": 5, "channel": 7, "content": 11, "correlation_id": 13, "error": 2, "attempt": 17, "status": 19}
    return history(spark, sf_dir).select("seq", *[F.when(F.col("seq") % n != 0, F.col(c)).alias(c) for c, n in gaps.items()])


def storage_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP requests to the storage service covering every route of it, and paths it does not know."""
    e = _events(spark, sf_dir)
    eid = F.col("event_id")
    d = eid % 10
    ten = F.concat(F.lit("tenant-"), (F.col("user_id") % 5).cast("string"))
    note = F.concat(F.lit("/v1/internal/notifications/n-"), F.expr("event_id div 4").cast("string"))
    tenant = F.concat(F.lit("/v1/internal/tenants/"), ten)
    lim = F.element_at(F.array(*[F.lit(x) for x in LIMIT_TEXTS]), (F.expr("event_id div 10") % 4 + 1).cast("int"))
    path = (F.when(d == 0, F.lit("/health")).when(d == 1, F.lit("/v1/internal/idempotency/claim"))
             .when(d == 2, F.lit("/v1/internal/idempotency/release")).when(d == 3, F.lit("/v1/internal/store"))
             .when(d == 4, F.concat(note, F.lit("?tenant_id="), ten)).when(d == 5, note)
             .when(d == 6, F.concat(tenant, F.lit("/deliveries?limit="), lim)).when(d == 7, F.concat(tenant, F.lit("/deliveries")))
             .when(d == 8, F.lit("/v1/notifications")).otherwise(tenant))
    method = F.when(d.isin(1, 2, 3) & (eid % 30 < 20), F.lit("POST")).otherwise(F.lit("GET"))
    return e.select(eid.alias("request_id"), method.alias("method"), path.alias("path"))
