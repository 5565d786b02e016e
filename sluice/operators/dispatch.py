"""Per-message delivery state machine as projections.

A consumed row carries boolean outcome switches of its side effects
(``received_ok``, ``delivered_ok``, ``push_ok``) plus ``simulate_fail``.
Everything here is a narrow transformation: no shuffle at all.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import backoff_ms

# Fixed values of the dispatcher (status names, failure texts, defaults).
STATUS_RECEIVED = "received"
STATUS_DELIVERED = "delivered"
STATUS_RETRY = "retry_scheduled"
STATUS_DLQ = "dlq"
FAIL_RECEIVED = "storage_persist_failed_received"
FAIL_SIMULATED = "simulated_failure"
FAIL_DELIVERED = "storage_persist_failed_delivered"
FAIL_PUSH = "gateway_delivery_failed"
RETRY_DEFAULT_TEXT = "delivery_failed"
DLQ_DEFAULT_TEXT = "max_retries_exhausted"
MAX_RETRIES = 3
BASE_BACKOFF_MS = 250
MAX_BACKOFF_MS = 10_000
MAX_WAIT_MS = 5_000


def _flag(df: DataFrame, name: str, default: bool) -> Column:
    return F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)


def failure_reason(df: DataFrame) -> DataFrame:
    """why a consumed row failed (null = it did not).

    Precedence: received write failed > simulated failure > delivered write
    failed > push failed; the last two are only tried when nothing failed
    before them.
    """
    sim = _flag(df, "simulate_fail", False)
    rec = _flag(df, "received_ok", True)
    dlv = _flag(df, "delivered_ok", True)
    push = _flag(df, "push_ok", True)
    reason = (F.when(~rec, F.lit(FAIL_RECEIVED))
               .when(sim, F.lit(FAIL_SIMULATED))
               .when(~dlv, F.lit(FAIL_DELIVERED))
               .when(~push, F.lit(FAIL_PUSH)))
    return df.withColumn("failure_reason", reason)


def outcome(df: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Outcome of one pass: delivered / retry_scheduled / dlq.

    A failed row whose ``retry_count + 1`` exceeds ``max_retries`` goes to
    the dead letters.  Adds ``failure_reason`` and ``outcome``.
    """
    df = failure_reason(df)
    rc = F.coalesce(F.col("retry_count"), F.lit(0))
    return df.withColumn(
        "outcome",
        F.when(F.col("failure_reason").isNull(), F.lit(STATUS_DELIVERED))
         .when(rc + 1 > max_retries, F.lit(STATUS_DLQ))
         .otherwise(F.lit(STATUS_RETRY)))


def status_expand(df: DataFrame, max_retries: int = MAX_RETRIES, newest_only: bool = False) -> DataFrame:
    """One consumed message -> its status rows, in write order.

    ``received`` is attempted for every row (present unless that write
    failed); ``delivered`` is written when nothing failed before it and its
    write succeeded (so a push failure still leaves it); a failed row then
    gets ``retry_scheduled`` or ``dlq`` with ``attempt = retry_count + 1``.
    ``newest_only`` keeps the last of a message's rows.
    """
    df = outcome(df, max_retries)
    rc = F.coalesce(F.col("retry_count"), F.lit(0)).cast("int")
    rec_ok = _flag(df, "received_ok", True)
    sim = _flag(df, "simulate_fail", False)
    dlv_ok = _flag(df, "delivered_ok", True)
    fail_text = F.coalesce(
        F.col("failure_reason"),
        F.when(F.col("outcome") == STATUS_DLQ, F.lit(DLQ_DEFAULT_TEXT)).otherwise(F.lit(RETRY_DEFAULT_TEXT)))
    entries = F.array(
        F.struct(F.lit(1).alias("step"), F.lit(STATUS_RECEIVED).alias("status"),
                 rc.alias("attempt"), F.lit("").alias("error"), rec_ok.alias("keep")),
        F.struct(F.lit(2).alias("step"), F.lit(STATUS_DELIVERED).alias("status"),
                 rc.alias("attempt"), F.lit("").alias("error"),
                 (rec_ok & ~sim & dlv_ok).alias("keep")),
        F.struct(F.lit(3).alias("step"), F.col("outcome").alias("status"),
                 (rc + 1).alias("attempt"), fail_text.alias("error"),
                 (F.col("outcome") != STATUS_DELIVERED).alias("keep")),
    )
    kept = F.filter(entries, lambda e: e["keep"])
    if newest_only:
        kept = F.slice(kept, -1, 1)
    base = [c for c in df.columns if c not in ("failure_reason", "outcome")]
    return (df.select(*base, F.explode(kept).alias("e"))
              .select(*base, F.col("e.step").alias("step"), F.col("e.status").alias("status"),
                      F.col("e.attempt").alias("attempt"), F.col("e.error").alias("error")))


def retry_schedule(df: DataFrame, base_ms: int = BASE_BACKOFF_MS, max_ms: int = MAX_BACKOFF_MS,
                   now_ms: str = "seen_ms", max_retries: int = MAX_RETRIES) -> DataFrame:
    """Next-attempt plan for rows that go back to the retry stream.

    ``backoff = max(1, min(max, base * 2^clamp(retry_count, 0, 20)))`` with
    the count before the increment; ``next_attempt_at_ms = now + backoff``.
    ``now`` is the time the row was handled (``seen_ms``) so reruns agree.
    """
    df = outcome(df, max_retries).filter(F.col("outcome") == STATUS_RETRY)
    rc = F.coalesce(F.col("retry_count"), F.lit(0))
    b = backoff_ms(rc, base_ms, max_ms)
    return (df.withColumn("retry_backoff_ms", b)
              .withColumn("next_attempt_at_ms", F.col(now_ms) + F.col("retry_backoff_ms"))
              .withColumn("previous_stream_id", F.col("message_id"))
              .withColumn("retry_count", (rc + 1).cast("int"))
              .withColumn("source_stream", F.lit("retry"))
              .withColumn("retry_reason", F.coalesce(F.col("failure_reason"), F.lit(RETRY_DEFAULT_TEXT)))
              .drop("outcome", "failure_reason"))


def dlq_rows(df: DataFrame, max_retries: int = MAX_RETRIES) -> DataFrame:
    """Exhausted rows with the dead-letter fields added.

    ``retry_count`` stays as read; ``final_retry_count`` is one more.
    """
    df = outcome(df, max_retries).filter(F.col("outcome") == STATUS_DLQ)
    rc = F.coalesce(F.col("retry_count"), F.lit(0))
    return (df.withColumn("failure_reason", F.coalesce(F.col("failure_reason"), F.lit(DLQ_DEFAULT_TEXT)))
              .withColumn("original_stream_id", F.col("message_id"))
              .withColumn("final_retry_count", (rc + 1).cast("int"))
              .withColumn("source_stream", F.lit("dlq"))
              .drop("outcome"))


def due_retries(df: DataFrame, t_ms: int, max_wait_ms: int = MAX_WAIT_MS) -> DataFrame:
    """rows ready at epoch-ms ``t``.

    The dispatcher waits at most ``max_wait_ms`` for a retry row and then
    handles it anyway, so it is due at ``min(next_attempt_at, seen + wait)``.
    A missing time counts as 0 (due now); main-stream rows are always due.
    """
    nxt = F.coalesce(F.col("next_attempt_at_ms"), F.lit(0))
    due_at = F.least(nxt, F.col("seen_ms") + F.lit(max_wait_ms))
    is_retry = F.col("source_stream") == "retry"
    return df.withColumn("due_at_ms", F.when(is_retry, due_at).otherwise(F.lit(0).cast("bigint"))) \
             .filter(~is_retry | (F.col("due_at_ms") <= F.lit(t_ms)))


class DispatchFrames(NamedTuple):
    outcomes: DataFrame
    status_rows: DataFrame
    retries: DataFrame
    dead_letters: DataFrame
