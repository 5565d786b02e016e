"""Record shaping: JSON payloads, status records, audit lines, log rows, field maps.

(P01, P02 stages, P05, P06, P07, S03, S06, S09.)  JSON is parsed with
``from_json`` against an explicit schema (standard JSON, top-level keys
only) and written with ``to_json``; no hand-written scanner, no UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sluice.functions import backoff_ms, int_or
from sluice.operators import dispatch as dsp
from sluice.operators.admission import FAILED_CHECKS
from sluice.operators.ordering import entries_before

# Fixed field set of a status record, in the order the dispatcher writes it.
STATUS_FIELDS = ["tenant_id", "notification_id", "user_id", "channel", "content",
                 "correlation_id", "status", "attempt", "error"]

# Every value is read as text first (a JSON number becomes its digits), so
# integers go through ``int_or`` (numeric prefix, else default) like ``stoi``.
RECORD_SCHEMA = StructType([StructField(f, StringType()) for f in STATUS_FIELDS]
                           + [StructField("_corrupt_record", StringType())])
AUDIT_SCHEMA = StructType([StructField("ts", StringType()),
                           StructField("record", StructType(
                               [StructField(f, StringType()) for f in STATUS_FIELDS])),
                           StructField("_corrupt_record", StringType())])
JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}

# Per-stage defaults of the closed field set.
STAGE_DEFAULTS = {
    "ingress": {"user_id": "unknown-user", "channel": "default"},
    "dispatch": {"tenant_id": "unknown", "user_id": "unknown", "channel": "default", "content": "",
                 "correlation_id": ""},
    "storage": {"user_id": "unknown", "channel": "default", "content": "", "correlation_id": "",
                "error": "", "attempt": "0"},
    "read": {"user_id": "unknown", "channel": "default", "content": "", "correlation_id": "",
             "error": "", "attempt": "0", "status": "unknown"},
}


def normalise(df: DataFrame, stage: str) -> DataFrame:
    """Apply the defaults of one stage (missing -> default; empty stays empty)."""
    defaults = STAGE_DEFAULTS[stage]
    cols = {c: F.coalesce(F.col(c), F.lit(v).cast(df.schema[c].dataType))
            for c, v in defaults.items() if c in df.columns}
    return df.withColumns(cols)


def parse_payload(df: DataFrame, text_col: str = "payload") -> DataFrame:
    """JSON text -> typed columns; ``valid`` flags lines that parsed.

    Blank lines are dropped.  ``attempt`` becomes a bigint via ``int_or``
    (``"3abc"`` -> 3, unreadable -> 0).  Split with ``valid`` to get the
    good and the quarantined rows.
    """
    t = F.col(text_col)
    nonblank = df.filter(F.length(F.trim(t)) > 0)
    parsed = nonblank.withColumn("_p", F.from_json(t, RECORD_SCHEMA, JSON_OPTIONS))
    valid = F.col("_p").isNotNull() & F.col("_p._corrupt_record").isNull()
    out = parsed.withColumn("valid", valid)
    fields = {f: F.when(F.col("valid"), F.col(f"_p.{f}")) for f in STATUS_FIELDS if f != "attempt"}
    fields["attempt"] = F.when(F.col("valid"), int_or(F.col("_p.attempt"), 0))
    return out.withColumns(fields).drop("_p")


def status_record(df: DataFrame, notification_id: str = "message_id") -> Column:
    """A status row -> the JSON body the dispatcher stores."""
    return F.to_json(F.struct(
        F.col("tenant_id").alias("tenant_id"),
        F.col(notification_id).cast("string").alias("notification_id"),
        F.col("user_id").alias("user_id"),
        F.col("channel").alias("channel"),
        F.col("content").alias("content"),
        F.col("correlation_id").alias("correlation_id"),
        F.col("status").alias("status"),
        F.col("attempt").cast("int").alias("attempt"),
        F.col("error").alias("error")))


def audit_details(df: DataFrame) -> Column:
    """``channel=..,attempt=..,error=..,correlation_id=..`` audit text."""
    return F.concat(F.lit("channel="), F.col("channel"), F.lit(",attempt="), F.col("attempt").cast("string"),
                    F.lit(",error="), F.col("error"), F.lit(",correlation_id="), F.col("correlation_id"))


def audit_line(df: DataFrame, ts_col: str = "status_ts", record: Column | None = None) -> Column:
    """``{"ts":<epoch_s>,"record":{...}}`` — one line of the audit file."""
    rec = record if record is not None else F.struct(*[F.col(f) for f in STATUS_FIELDS])
    return F.to_json(F.struct(F.unix_seconds(F.col(ts_col).cast("timestamp")).alias("ts"),
                              rec.alias("record")))


def audit_parse(lines: DataFrame, need_id: bool = True, text_col: str = "value") -> DataFrame:
    """Audit lines -> ``ts`` + the record's columns.

    Blank lines are skipped; lines that do not parse go nowhere (use
    :func:`audit_quarantine`).  State reads (``need_id``) drop lines without
    tenant or notification id; history reads need only the tenant.
    """
    t = F.col(text_col)
    p = (lines.filter(F.length(F.trim(t)) > 0)
              .select(F.from_json(t, AUDIT_SCHEMA, JSON_OPTIONS).alias("a"))
              .filter(F.col("a").isNotNull() & F.col("a._corrupt_record").isNull()))
    out = p.select(int_or(F.col("a.ts"), 0).alias("ts"), "a.record.*")
    out = out.withColumn("attempt", int_or(F.col("attempt"), 0))
    keep = F.col("tenant_id").isNotNull()
    if need_id:
        keep = keep & F.col("notification_id").isNotNull()
    return out.filter(keep)


def audit_quarantine(lines: DataFrame, text_col: str = "value") -> DataFrame:
    """Non-blank audit lines that are not valid JSON records."""
    t = F.col(text_col)
    return (lines.filter(F.length(F.trim(t)) > 0)
                 .withColumn("a", F.from_json(t, AUDIT_SCHEMA, JSON_OPTIONS))
                 .filter(F.col("a").isNull() | F.col("a._corrupt_record").isNotNull())
                 .drop("a"))


def audit_scan(spark, path: str, need_id: bool = True) -> DataFrame:
    """S03 on files: read the JSON-lines audit folder; a missing folder is empty."""
    from pyspark.errors import AnalysisException
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.createDataFrame([], "value string")
    return audit_parse(lines, need_id)


def audit_split(spark, path: str, out_path: str, need_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """S03 on files in one pass: the lines below ``path`` are read and parsed once, and written as records and as quarantine.

    Returns the two tables (records with the file they came from; raw lines
    with theirs).  A line is quarantined when it is not a JSON record or
    lacks the ids that :func:`audit_parse` asks for; blank lines are skipped.
    """
    t = F.col("value")
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.col("_metadata.file_path").alias("file"))
    parsed = lines.filter(F.length(F.trim(t)) > 0).withColumn("a", F.from_json(t, AUDIT_SCHEMA, JSON_OPTIONS))
    good = F.col("a").isNotNull() & F.col("a._corrupt_record").isNull() & F.col("a.record.tenant_id").isNotNull()
    if need_id:
        good = good & F.col("a.record.notification_id").isNotNull()
    good = F.coalesce(good, F.lit(False))
    record = [F.when(good, F.col(f"a.record.{f}")).alias(f) for f in STATUS_FIELDS if f != "attempt"]
    out = parsed.select("file", F.when(good, int_or(F.col("a.ts"), 0)).alias("ts"), *record,
                        F.when(good, int_or(F.col("a.record.attempt"), 0)).alias("attempt"),
                        F.when(~good, t).alias("line"), F.when(good, F.lit("records")).otherwise(F.lit("quarantine")).alias("kind"))
    out.write.mode("overwrite").partitionBy("kind").parquet(out_path)
    table = spark.read.schema(StructType(out.schema.fields)).parquet(out_path)
    return table.filter("kind = 'records'").drop("kind", "line"), table.filter("kind = 'quarantine'").select("file", "line")


def audit_append(df: DataFrame, path: str, ts_col: str = "status_ts") -> None:
    """S06 on files: append audit lines (one text file per task)."""
    df.select(audit_line(df, ts_col).alias("value")).write.mode("append").text(path)


def pairs_to_map(arr, keep_odd: bool = False) -> Column:
    """Alternating key/value array -> map, the last value of a key wins.

    The dispatcher drops an odd trailing key (``keep_odd=False``); the
    replay tool keeps it with ``''``.  Needs ``spark.sql.mapKeyDedupPolicy
    = LAST_WIN`` (set by the session helper).
    """
    a = F.col(arr) if isinstance(arr, str) else arr
    if keep_odd:
        a = F.when(F.size(a) % 2 == 1, F.concat(a, F.array(F.lit("")))).otherwise(a)
    n = F.floor(F.size(a) / 2).cast("int")
    entries = F.transform(F.sequence(F.lit(0), n - 1),
                          lambda i: F.struct(F.get(a, i * 2).alias("key"), F.get(a, i * 2 + 1).alias("value")))
    empty = F.create_map().cast("map<string,string>")
    return F.when(n >= 1, F.map_from_entries(entries)).otherwise(empty)


# Fixed values of the gateway's log lines.
LOG_SERVICE = "gateway"
MAIN_STREAM = "notifications_stream"
RETRY_STREAM = "notifications_retry_stream"


def event_log(decisions: DataFrame, main_backlog: int = 0, main_start_len: int = 0,
              ts_col: str = "arrival_ts", retry_entries: DataFrame | None = None, retry_start_len: int = 0) -> DataFrame:
    """One JSON log row per logged admission decision.

    Content (400) and auth (401) refusals are not logged, like the
    reference.  Empty fields are omitted (``to_json`` drops nulls).  The
    main-stream length in a backpressure line is the latched length; the
    retry stream's is the number of ``retry_entries`` before the request,
    counted for the refused requests only.
    """
    r = F.col("reason")
    logged = decisions.filter(r.isin("ok", "duplicate_idempotency_key", "rate_limited",
                                     "daily_quota_exceeded", "stream_backpressure",
                                     "retry_stream_backpressure", "redis_publish_failed", *FAILED_CHECKS.values()))
    event = F.when(r.isin("ok", "duplicate_idempotency_key"), F.lit("notification_accepted")) \
             .otherwise(F.lit("notification_rejected"))
    corr = (F.when(r.isin("ok", "redis_publish_failed", FAILED_CHECKS["claim"]), F.col("correlation_id"))
             .when(r == "duplicate_idempotency_key", F.col("canonical_id")))
    main_len = max(main_backlog, main_start_len)
    retry_detail = F.lit(f"stream={RETRY_STREAM}")
    if retry_entries is not None:
        refused = logged.filter(r == "retry_stream_backpressure").select("message_id", ts_col)
        logged = logged.join(entries_before(refused, retry_entries, ts_col, "entry_ts"), "message_id", "left")
        retry_detail = F.concat(retry_detail, F.lit(",length="), (F.col("n_before") + retry_start_len).cast("string"))
    detail = (F.when(r == "daily_quota_exceeded",
                     F.concat(F.lit("quota_count="), F.col("quota_count").cast("string")))
               .when(r == "stream_backpressure", F.lit(f"stream={MAIN_STREAM},length={main_len}"))
               .when(r == "retry_stream_backpressure", retry_detail))
    line = F.to_json(F.struct(
        F.unix_seconds(F.col(ts_col).cast("timestamp")).alias("ts"),
        F.lit(LOG_SERVICE).alias("service"),
        event.alias("event"),
        r.alias("outcome"),
        F.col("tenant_id").alias("tenant_id"),
        F.nullif(corr, F.lit("")).alias("correlation_id"),
        F.nullif(detail, F.lit("")).alias("detail")))
    return logged.select("message_id", line.alias("log_line"))


# Fixed values of the dispatcher's log lines: service name, outcome per status.
DISPATCH_SERVICE = "notification-dispatcher"
DISPATCH_OUTCOMES = {dsp.STATUS_DELIVERED: "delivered", dsp.STATUS_DLQ: "dlq_routed", dsp.STATUS_RETRY: "retry_scheduled"}


def dispatch_log(consumed: DataFrame, max_retries: int = dsp.MAX_RETRIES, base_ms: int = dsp.BASE_BACKOFF_MS,
                 max_ms: int = dsp.MAX_BACKOFF_MS) -> DataFrame:
    """S09 (dispatcher): one JSON log row per message whose last step worked, with the time in ISO form to the millisecond.

    A failed message carries its reason (a scheduled retry with its backoff) and the count after the increment.
    """
    o = dsp.outcome(consumed, max_retries)
    ack = F.coalesce(F.col("ack_ok"), F.lit(True)) if "ack_ok" in consumed.columns else F.lit(True)
    rc = F.coalesce(F.col("retry_count"), F.lit(0)).cast("int")
    retry, delivered = F.col("outcome") == dsp.STATUS_RETRY, F.col("outcome") == dsp.STATUS_DELIVERED
    backoff = F.concat(F.coalesce("failure_reason", F.lit(dsp.RETRY_DEFAULT_TEXT)), F.lit(",backoff_ms="), backoff_ms(rc, base_ms, max_ms).cast("string"))
    reason = F.when(retry, backoff).when(~delivered, F.coalesce("failure_reason", F.lit(dsp.DLQ_DEFAULT_TEXT)))
    named = F.create_map(*[F.lit(x) for pair in DISPATCH_OUTCOMES.items() for x in pair])
    blank = lambda c: F.nullif(F.col(c).cast("string"), F.lit(""))
    line = F.to_json(F.struct(
        F.date_format(F.timestamp_millis("seen_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("ts"),
        F.lit(DISPATCH_SERVICE).alias("service"),
        F.lit("notification_dispatch").alias("event"),
        F.element_at(named, F.col("outcome")).alias("outcome"),
        blank("tenant_id").alias("tenant_id"),
        blank("message_id").alias("notification_id"),
        blank("correlation_id").alias("correlation_id"),
        reason.alias("reason"),
        F.when(delivered, rc).otherwise(rc + 1).alias("retry_count")))
    return o.filter(ack).select("message_id", line.alias("log_line"))
