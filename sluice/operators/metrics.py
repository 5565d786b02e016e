"""Counters, lag, usage and service objectives.

All are conditional aggregates (partial aggregation before the shuffle);
totals come from ``rollup``.  Percentiles are exact but never collect a
group's values: they are read off a per-value histogram.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators import dispatch as dsp
from sluice.operators.admission import FAILED_CHECKS
from sluice.operators.ordering import position_and_previous


def _n(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def admission_counters(decisions: DataFrame) -> DataFrame:
    """Requests / accepted / duplicates / rejected / rate-limited / backpressure.

    ``rejected`` counts every 429 and 503 of the submit path; 400 and 401 are not counted, and duplicates are neither accepted
    nor rejected.  One row per tenant plus the total (``is_total``).
    """
    r = F.col("reason")
    return (decisions.rollup("tenant_id").agg(
        F.count(F.lit(1)).alias("requests"),
        _n(r == "ok").alias("accepted"),
        _n(r == "duplicate_idempotency_key").alias("duplicates"),
        _n(r.isin("rate_limited", "daily_quota_exceeded", "stream_backpressure", "retry_stream_backpressure",
                  "redis_publish_failed", *FAILED_CHECKS.values())).alias("rejected"),
        _n(r == "rate_limited").alias("rate_limited"),
        _n(r.isin("stream_backpressure", "retry_stream_backpressure")).alias("backpressure_rejected"),
        (F.grouping("tenant_id") == 1).alias("is_total")))


def dispatch_counters(consumed: DataFrame, max_retries: int = dsp.MAX_RETRIES) -> DataFrame:
    """Consumed / delivered / retry-scheduled / dead-lettered / failures.

    An outcome counts once its last step worked: the ack of a delivered row,
    the re-publish and ack of the others (``ack_ok``); a row whose last step
    failed is a processing error and stays pending.
    """
    o = dsp.outcome(consumed, max_retries)
    ack = F.coalesce(F.col("ack_ok"), F.lit(True)) if "ack_ok" in consumed.columns else F.lit(True)
    rec = F.coalesce(F.col("received_ok"), F.lit(True))
    sim = F.coalesce(F.col("simulate_fail"), F.lit(False))
    dlv = F.coalesce(F.col("delivered_ok"), F.lit(True))
    push = F.coalesce(F.col("push_ok"), F.lit(True))
    return o.rollup("tenant_id").agg(
        F.count(F.lit(1)).alias("consumed"),
        _n((F.col("outcome") == dsp.STATUS_DELIVERED) & ack).alias("delivered"),
        _n((F.col("outcome") == dsp.STATUS_RETRY) & ack).alias("retry_scheduled"),
        _n((F.col("outcome") == dsp.STATUS_DLQ) & ack).alias("dead_lettered"),
        _n(~ack).alias("processing_errors"),
        (_n(~rec) + _n(rec & ~sim & ~dlv)).alias("storage_write_failures"),
        _n(rec & ~sim & dlv & ~push).alias("gateway_delivery_failures"),
        (F.grouping("tenant_id") == 1).alias("is_total"))


def processing_duration(consumed: DataFrame, ms_col: str = "duration_ms") -> DataFrame:
    """Sum and count of whole-ms durations and their mean, per tenant and total."""
    return (consumed.rollup("tenant_id").agg(
                F.sum(F.col(ms_col).cast("bigint")).alias("duration_ms_sum"),
                F.count(F.col(ms_col)).alias("duration_ms_count"),
                (F.grouping("tenant_id") == 1).alias("is_total"))
            .withColumn("duration_ms_mean",
                        F.col("duration_ms_sum") / F.nullif(F.col("duration_ms_count"), F.lit(0))))


def stream_length(entries: DataFrame, stream_col: str = "source_stream") -> DataFrame:
    """Entries per stream (acks do not shrink a stream)."""
    return entries.groupBy(stream_col).agg(F.count(F.lit(1)).alias("length"))


STREAM_NAMES = 1_000  # positions up to here enter the plan as literals


def consumer_lag(entries: DataFrame, positions: DataFrame, pending: DataFrame,
                 stream_col: str = "source_stream") -> DataFrame:
    """Per stream lag (entries after the group's last delivered id), else
    pending, else 0; ``rollup`` adds the total.

    Positions are one row per stream; up to ``STREAM_NAMES`` of them are
    literals, so entries and pending ids are counted in one pass and one
    aggregate, and nothing is joined.  With more, positions are joined.
    A stream without a position has no lag, so its pending entries count.
    """
    known = positions.select(stream_col, "last_delivered").limit(STREAM_NAMES + 1).collect()
    seen = entries.select(stream_col, "message_id", F.lit(0).alias("pending"))
    waits = pending.select(stream_col, F.lit(None).cast("bigint").alias("message_id"), F.lit(1).alias("pending"))
    named = positions.select(stream_col, F.lit(None).cast("bigint").alias("message_id"), F.lit(0).alias("pending"))
    rows = seen.unionByName(waits).unionByName(named)
    if 0 < len(known) <= STREAM_NAMES:
        last = F.create_map(*[F.lit(x) for r in known for x in (r[0], r["last_delivered"] if r["last_delivered"] is not None else -2 ** 63)])
        rows = rows.filter(F.col(stream_col).isin([r[0] for r in known])).withColumn("last", F.nullif(F.element_at(last, F.col(stream_col)), F.lit(-2 ** 63)))
    else:
        rows = rows.join(positions.select(stream_col, F.col("last_delivered").alias("last")), stream_col)
    behind = F.when(F.col("last").isNull(), F.col("pending")).otherwise(F.coalesce((F.col("message_id") > F.col("last")).cast("int"), F.lit(0)))
    return rows.rollup(stream_col).agg(
        F.sum(behind).cast("bigint").alias("consumer_lag"),
        F.sum("pending").cast("bigint").alias("pending"),
        (F.grouping(stream_col) == 1).alias("is_total"))


def tenant_minute_usage(requests: DataFrame, limit_per_minute: int, eligible: str = "eligible",
                        ts_col: str = "arrival_ts") -> DataFrame:
    """Per tenant and UTC minute: seen, allowed (first ``limit``), limited."""
    seen = F.count(F.lit(1))
    allowed = F.least(seen, F.lit(limit_per_minute)) if limit_per_minute > 0 else seen
    return (requests.filter(F.col(eligible))
                    .groupBy("tenant_id", F.window(ts_col, "1 minute").alias("w"))
                    .agg(seen.alias("seen"), allowed.cast("bigint").alias("allowed"))
                    .select("tenant_id", F.col("w.start").alias("minute_start"), "seen", "allowed",
                            (F.col("seen") - F.col("allowed")).alias("limited")))


def tenant_daily_usage(rate_ranked: DataFrame, daily_quota: int) -> DataFrame:
    """Per tenant and UTC day over rate-passed rows: quota counter (it is
    bumped even when over) and how many were over the quota."""
    passed = rate_ranked.filter(F.col("rate_ok"))
    n = F.count(F.lit(1))
    over = F.greatest(n - F.lit(daily_quota), F.lit(0)) if daily_quota > 0 else F.lit(0)
    return (passed.groupBy("tenant_id", F.to_date("arrival_ts").alias("day"))
                  .agg(n.alias("quota_count"), over.cast("bigint").alias("over_quota")))


def duplicate_audit(entries: DataFrame, keys: Sequence[str] = ("tenant_id", "idem_key")) -> DataFrame:
    """Keys that appear other than exactly once."""
    return (entries.filter(F.col(keys[-1]).isNotNull())
                   .groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
                   .filter(F.col("n") != 1))


def exact_percentiles(df: DataFrame, group: Sequence[str], value: str,
                      probs: Sequence[float]) -> DataFrame:
    """Linear-interpolated percentiles (``percentile_cont``) per group.

    Values are first counted per (group, value); a running count over that
    histogram locates the order statistics.  Work per group is bounded by
    its number of distinct values, not by its rows.
    """
    group = list(group)
    hist = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("c"))
    hist = (hist.withColumn("cum", F.sum("c").over(
                Window.partitionBy(*group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
                .withColumn("n", F.sum("c").over(Window.partitionBy(*group))))
    aggs = [F.max("n").alias("n")]
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(p)
        aggs.append(F.min(F.when(F.col("cum") > F.floor(pos), F.col(value))).alias(f"lo{i}"))
        aggs.append(F.min(F.when(F.col("cum") > F.ceil(pos), F.col(value))).alias(f"hi{i}"))
    out = hist.groupBy(*group).agg(*aggs)
    cols = []
    for i, p in enumerate(probs):
        pos = (F.col("n") - 1) * F.lit(p)
        frac = pos - F.floor(pos)
        lo, hi = F.col(f"lo{i}").cast("double"), F.col(f"hi{i}").cast("double")
        cols.append((lo + (hi - lo) * frac).alias(f"p{int(round(p * 100))}"))
    return out.select(*group, *cols)


def slo_report(consumed: DataFrame, ms_col: str = "duration_ms", target: float = 0.99,
               max_retries: int = dsp.MAX_RETRIES, pending: DataFrame | None = None) -> DataFrame:
    """A10: per tenant p50/p90/p95/p99 latency, delivery success rate and
    pass/fail against the success objective (> 99 %); with ``pending`` (J06)
    also the largest backlog of any one stream (``max_lag``)."""
    o = dsp.outcome(consumed, max_retries)
    pct = exact_percentiles(o, ["tenant_id"], ms_col, [0.5, 0.9, 0.95, 0.99])
    rate = o.groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("messages"),
        F.avg(F.when(F.col("outcome") == dsp.STATUS_DELIVERED, 1.0).otherwise(0.0)).alias("success_rate"),
        F.max(F.col(ms_col)).alias("max_duration_ms"))
    out = rate.join(pct, "tenant_id").withColumn("slo_pass", F.col("success_rate") > F.lit(target))
    if pending is None:
        return out
    lag = (pending.groupBy("tenant_id", "source_stream").agg(F.count(F.lit(1)).alias("n"))
                  .groupBy("tenant_id").agg(F.max("n").alias("max_lag")))
    return out.join(lag, "tenant_id", "left").withColumn("max_lag", F.coalesce("max_lag", F.lit(0).cast("bigint")))


SKETCH_ERROR = 0.01


def latency_sketches(rows: DataFrame, keys: Sequence[str] = ("tenant_id",), value: str = "duration_ms",
                     ts_col: str = "arrival_ts", error: float = SKETCH_ERROR) -> DataFrame:
    """A10 at scale: a quantile sketch per (keys, hour), one row per non-empty bin.

    Bin i holds the values in (g**(i-1), g**i] with g = (1 + error) / (1 - error), bin null those of zero or less.  Sketches merge by
    adding counts, so stored ones answer for any span; a value has at most some 2,000 bins, whatever the rows.
    """
    g = (1 + error) / (1 - error)
    i = F.when(F.col(value) > 0, F.ceil(F.log(F.col(value).cast("double")) / F.log(F.lit(g)))).cast("int")
    hour = F.date_trunc("hour", F.col(ts_col)).cast("timestamp_ntz")
    return rows.filter(F.col(value).isNotNull()).groupBy(*keys, hour.alias("hour"), i.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], keys: Sequence[str] = ("tenant_id",), error: float = SKETCH_ERROR) -> DataFrame:
    """Quantiles of merged sketches: each within ``error`` (relative) of the value of rank floor(p * (n - 1))."""
    keys = list(keys)
    g = (1 + error) / (1 - error)
    merged = sketches.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys)
    run = merged.withColumns({"upto": F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first())), "total": F.sum("n").over(w)})
    middle = F.when(F.col("bin").isNull(), F.lit(0.0)).otherwise(2 * F.pow(F.lit(g), F.col("bin")) / (g + 1))
    at = lambda p: F.min(F.when(F.col("upto") > F.floor(F.lit(p) * (F.col("total") - 1)), middle)).alias(f"p{int(round(p * 100))}")
    return run.groupBy(*keys).agg(F.max("total").alias("messages"), *[at(p) for p in probs])


def correlation_trace(history: DataFrame, key: str = "correlation_id") -> DataFrame:
    """The story of one business id: records, attempts, first and last status.

    Bounded aggregates only, so a client that reuses one correlation id for
    millions of requests does not build a giant list; the ordered steps
    themselves are W08.
    """
    order = F.struct(F.col("status_ts"), F.col("seq"))
    return history.groupBy(key).agg(
        F.count(F.lit(1)).alias("records"),
        F.max("attempt").alias("max_attempt"),
        F.min_by("status", order).alias("first_status"),
        F.max_by("status", order).alias("last_status"),
        F.min("status_ts").alias("first_ts"),
        F.max("status_ts").alias("last_ts"),
        _n(F.col("status") == "dlq").alias("dead_letters"))


def retry_chain_step(history: DataFrame, key: str = "correlation_id") -> DataFrame:
    """Position, gap and previous status of each record inside its correlation chain.

    A correlation id comes from the client and may be reused without bound,
    so the chain is never sorted in one task (see ``position_and_previous``).
    """
    h = history.select(key, "seq", "status", "status_ts")
    p = position_and_previous(h, [key], "status_ts", "seq", ["status", "status_ts"])
    return p.select(
        key, "seq", "status", "status_ts", "step",
        F.col("prev_status").alias("prev_status"),
        (F.unix_micros(F.col("status_ts").cast("timestamp"))
         - F.unix_micros(F.col("prev_status_ts").cast("timestamp"))).alias("gap_us"))
