"""One dispatcher pass over consumed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.functions import backoff_ms
from sluice.operators import dispatch as dsp

OUTCOME_COLUMNS = ["message_id", "tenant_id", "correlation_id", "source_stream", "retry_count",
                   "outcome", "failure_reason", "attempt", "next_attempt_at_ms", "retry_backoff_ms"]


def dispatch_step(consumed: DataFrame, max_retries: int = dsp.MAX_RETRIES,
                  base_ms: int = dsp.BASE_BACKOFF_MS, max_ms: int = dsp.MAX_BACKOFF_MS
                  ) -> dsp.DispatchFrames:
    """Outcome per row plus the three outputs a pass writes.

    ``outcomes`` has one row per consumed row (``attempt`` is the attempt
    number of the final status written); ``status_rows`` are the P08 status
    records, ``retries`` the P09 rows for the retry stream, ``dead_letters``
    the S08 rows.  All four are narrow projections of the same input.
    """
    o = dsp.outcome(consumed, max_retries)
    rc = F.coalesce(F.col("retry_count"), F.lit(0))
    failed = F.col("outcome") != dsp.STATUS_DELIVERED
    b = backoff_ms(rc, base_ms, max_ms)
    o = o.withColumns({
        "attempt": F.when(failed, rc + 1).otherwise(rc).cast("int"),
        "retry_backoff_ms": F.when(F.col("outcome") == dsp.STATUS_RETRY, b),
        "next_attempt_at_ms": F.when(F.col("outcome") == dsp.STATUS_RETRY, F.col("seen_ms") + b),
    }).select(*OUTCOME_COLUMNS)
    return dsp.DispatchFrames(
        outcomes=o,
        status_rows=dsp.status_expand(consumed, max_retries),
        retries=dsp.retry_schedule(consumed, base_ms, max_ms, max_retries=max_retries),
        dead_letters=dsp.dlq_rows(consumed, max_retries),
    )
