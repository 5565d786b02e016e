"""Streaming jobs.  Each gives the same answer as its batch operator.

Inputs carry ``event_ts`` (``timestamp``) and ``ts_us`` (epoch micros) next
to the batch columns.  What a job must remember lives in tables of the
shared folder under the number of the batch that wrote them, so a batch that
runs again after a failure replaces its own tables and nothing else.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import dispatch as dsp
from sluice.operators import fanout
from sluice.operators.ordering import add_time_buckets
from sluice.operators.state import newest_per_key
from sluice.plans.dispatch import dispatch_step
from sluice.session import data_files, delete_folder, list_folder, setting
from sluice.streaming import claims


def with_event_time(df: DataFrame, ts_col: str = "arrival_ts") -> DataFrame:
    return df.withColumns({"event_ts": F.col(ts_col).cast("timestamp"),
                           "ts_us": F.unix_micros(F.col(ts_col).cast("timestamp"))})


def _newest_batch(spark, path: str, before: int) -> int | None:
    """Number of the newest ``batch_id=`` folder in ``path`` below ``before``; older ones are removed."""
    found = sorted(k for n in list_folder(spark, path) if n.startswith("batch_id=") for k in [int(n[9:])] if k < before)
    for k in found[:-1]:
        delete_folder(spark, os.path.join(path, f"batch_id={k}"))
    return found[-1] if found else None


def together(*writes: Callable[[], None]) -> None:
    """Run the independent writes of one batch at the same time and wait for all; a failure is raised.

    Small writes mostly wait for the driver to plan them, so one after the other they leave the executors idle.
    """
    with ThreadPoolExecutor(len(writes)) as pool:
        for done in [pool.submit(inheritable_thread_target(w)) for w in writes]:
            done.result()


def _expire_days(spark, state_path: str, in_use: list[int], keep_days: int) -> None:
    """Remove the state of days more than ``keep_days`` behind the newest one, but for days in use."""
    held = [int(n[11:]) for n in list_folder(spark, state_path) if n.startswith("bucket_day=") and n[11:].lstrip("-").isdigit()]
    for d in held:
        if d < max(held) - keep_days and d not in in_use:
            delete_folder(spark, os.path.join(state_path, f"bucket_day={d}"))


def rate_quota_sink(out_path: str, state_path: str, limit_per_minute: int, daily_quota: int,
                    keys=("tenant_id",), keep_days: int = 2):
    """T01 as a ``foreachBatch`` function: W01 + W02 across micro-batches.

    Each micro-batch is ranked with the same distributed two-phase plan as
    the batch job, so a hot tenant is never handled by one task.  Counts of
    earlier batches live in ``state_path/bucket_day=<d>/batch_id=<k>``: after
    batch k, the day's rows seen per (tenant, minute) and rows passed per
    tenant.  A batch reads the newest earlier table of its own days only and
    writes that day's new one, so its cost does not depend on how many batches
    came before; a re-run batch replaces its tables.  Older tables of a day
    are removed, keeping the one a re-run would read.  A day's state expires
    once it is more than ``keep_days`` behind the newest day of earlier batches
    and the batch at hand has no row of it; like the service's counters, which
    live for two days, counts of a day begin anew after that.
    """
    from sluice.operators.admission import rate_and_quota

    keys = list(keys)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = add_time_buckets(batch.select(*keys, "message_id", "arrival_ts"), "arrival_ts") \
            .withColumn("eligible", F.lit(True)).persist()
        try:
            days = [r["bucket_day"] for r in rows.select("bucket_day").distinct().collect()]  # days of one batch
            _expire_days(spark, state_path, days, keep_days)
            folders = {d: os.path.join(state_path, f"bucket_day={d}") for d in days}
            newest = {d: _newest_batch(spark, path, batch_id) for d, path in folders.items()}
            held = [os.path.join(folders[d], f"batch_id={k}") for d, k in newest.items() if k is not None]
            prior = spark.read.parquet(*held) if held else None
            by_minute = by_day = None
            if prior is not None:
                by_minute = prior.filter("kind = 'minute'").select(*keys, "bucket_min", F.col("n").alias("seen"))
                by_day = prior.filter("kind = 'day'").select(*keys, F.col("day").alias("bucket_day"), F.col("n").alias("passed"))
            ranked = rate_and_quota(rows, limit_per_minute, daily_quota, "eligible", keys, by_minute, by_day).persist()
            verdicts = ranked.select("message_id", *keys, "rank_in_minute", "rate_ok", "quota_count", "quota_ok")
            seen = (ranked.groupBy(*keys, F.col("bucket_day").alias("day"), "bucket_min").agg(F.count(F.lit(1)).alias("n"))
                          .withColumn("kind", F.lit("minute")))
            passed = (ranked.filter("rate_ok").groupBy(*keys, F.col("bucket_day").alias("day")).agg(F.count(F.lit(1)).alias("n"))
                            .withColumns({"kind": F.lit("day"), "bucket_min": F.lit(None).cast("bigint")}))
            now = seen.unionByName(passed)
            if prior is not None:
                now = now.unionByName(prior)
            now = now.groupBy(*keys, "day", "bucket_min", "kind").agg(F.sum("n").alias("n"))
            state = (now.withColumns({"bucket_day": F.col("day"), "batch_id": F.lit(batch_id)})
                        .repartition("bucket_day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                        .partitionBy("bucket_day", "batch_id"))
            together(partial(_overwrite_batch, verdicts, out_path, batch_id), partial(state.parquet, state_path))
            ranked.unpersist()
        finally:
            rows.unpersist()

    return run


def dedup_sink(out_path: str, claims_path: str, prior: Callable[[], DataFrame] | None = None,
               buckets: int = claims.BUCKETS, compact_every: int = claims.COMPACT_EVERY):
    """T02 as a ``foreachBatch`` function: J04 against a lasting claim table.

    Every request of the batch gets its verdict: the first of a key within
    the batch, by (ts, id), claims it unless the key is on file (``prior``,
    or a claim of an earlier batch), which never expires; rows without a key
    pass.  The claims on file enter the table once; it is bucketed by key, so
    a batch reads only the buckets of its own keys, and folded every
    ``compact_every`` batches (:mod:`sluice.streaming.claims`).
    """
    from sluice.operators.admission import idempotency_claim

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # the table's many small folders are listed by a task per core, not by a task each
        with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", spark.sparkContext.defaultParallelism):
            take(spark, batch, batch_id)

    def take(spark, batch: DataFrame, batch_id: int) -> None:
        if prior is not None and not list_folder(spark, claims_path):
            claims.seed(prior(), claims_path, buckets)
        rows = batch.withColumn("eligible", F.lit(True)).persist()
        try:
            wanted = [r["b"] for r in rows.filter("idem_key is not null").select(claims.bucket_of("idem_key", buckets).alias("b"))
                      .distinct().collect()]  # at most one row per bucket
            # one task per core: a batch is small next to the session's shuffle partitions, each of which would be a task and a file
            decided = idempotency_claim(rows, claims.held(spark, claims_path, sorted(wanted), batch_id)) \
                .coalesce(spark.sparkContext.defaultParallelism).persist()
            verdicts = decided.select("message_id", "tenant_id", "idem_key", "claimed", "duplicate", "canonical_id")
            claimed = decided.filter("claimed").select(
                "tenant_id", F.col("idem_key").alias("idempotency_key"), F.col("correlation_id").alias("notification_id"),
                F.col("arrival_ts").cast("timestamp_ntz").alias("created_ts"))
            together(partial(_overwrite_batch, verdicts, out_path, batch_id), partial(claims.add, claimed, claims_path, batch_id, buckets))
            decided.unpersist()
        finally:
            rows.unpersist()
        if batch_id % compact_every == compact_every - 1:
            claims.compact(spark, claims_path, batch_id, buckets)  # this batch's own folders stay for a re-run

    return run


PENDING_SCHEMA = "message_id long, tenant_id string, attempt int, now_ms long, failed boolean, persistent boolean, clock_ms long"


def retry_sink(out_path: str, pending_path: str, max_retries: int = dsp.MAX_RETRIES,
               base_ms: int = dsp.BASE_BACKOFF_MS, max_ms: int = dsp.MAX_BACKOFF_MS):
    """T03 as a ``foreachBatch`` function: wait the backoff, try again, dead-letter after ``max_retries``.

    Time is the newest ``seen_ms`` of any batch so far.  A message is tried
    when it is read, whenever that is (rows out of order are not late);
    attempts that fall due by that time follow at once, and one that is not
    due yet waits in ``pending_path/batch_id=<k>``, the whole set of waiting
    messages after batch k.  A simulated failure persists across attempts; a
    failed side effect (store or push) fails only the attempt it happened in.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        side_ok = (F.coalesce(F.col("received_ok"), F.lit(True)) & F.coalesce(F.col("delivered_ok"), F.lit(True))
                   & F.coalesce(F.col("push_ok"), F.lit(True)))
        persistent = F.coalesce(F.col("simulate_fail"), F.lit(False))
        new = batch.select("message_id", "tenant_id", F.coalesce("retry_count", F.lit(0)).cast("int").alias("attempt"),
                           F.col("seen_ms").alias("now_ms"), (persistent | ~side_ok).alias("failed"), persistent.alias("persistent"))
        step(spark, new, batch_id)

    def step(spark, new: DataFrame | None, batch_id: int, drain: bool = False) -> None:
        newest = _newest_batch(spark, pending_path, batch_id)
        waiting = (spark.read.schema(PENDING_SCHEMA).parquet(os.path.join(pending_path, f"batch_id={newest}"))
                   if newest is not None else spark.createDataFrame([], PENDING_SCHEMA))
        times = waiting.agg(F.max("clock_ms").alias("t"))
        if new is not None:
            times = times.unionByName(new.agg(F.max("now_ms").alias("t")))
        clock = times.agg(F.max("t")).first()[0] or 0  # one row
        until = F.lit(2 ** 62 if drain else clock).cast("bigint")
        rows = waiting.filter("message_id is not null").drop("clock_ms")
        if new is not None:
            rows = rows.unionByName(new.withColumn("fresh", F.lit(True)), allowMissingColumns=True)
        else:
            rows = rows.withColumn("fresh", F.lit(False))
        due = F.coalesce("fresh", F.lit(False)) | (F.col("now_ms") <= until)
        # Attempts that can follow: one struct per attempt with its time and whether it fails.
        wait_of = lambda a: F.greatest(F.lit(1), F.least(F.lit(max_ms), F.lit(base_ms) * F.pow(F.lit(2.0), F.greatest(F.lit(0), F.least(a, F.lit(20)))))).cast("bigint")
        last = F.greatest("attempt", F.when(F.col("failed"), F.when(F.col("persistent"), F.lit(max_retries)).otherwise(
            F.least(F.col("attempt") + 1, F.greatest("attempt", F.lit(max_retries))))).otherwise(F.col("attempt")))
        tries = F.transform(F.sequence("attempt", last), lambda a: F.struct(
            a.alias("attempt"),
            (F.col("now_ms") + F.when(a > F.col("attempt"), F.aggregate(
                F.sequence(F.col("attempt"), F.greatest(a - 1, F.col("attempt"))), F.lit(0).cast("bigint"), lambda t, k: t + wait_of(k))).otherwise(F.lit(0))).alias("at_ms"),
            F.when(a == F.col("attempt"), F.col("failed")).otherwise(F.col("persistent")).alias("failed")))
        work = rows.withColumns({"due": due, "tries": tries})
        done = work.filter("due").withColumn("t", F.explode(F.filter("tries", lambda t: (t["attempt"] == F.col("attempt")) | (t["at_ms"] <= until))))
        over = F.col("t.attempt") + 1 > max_retries
        status = F.when(~F.col("t.failed"), F.lit(dsp.STATUS_DELIVERED)).when(over, F.lit(dsp.STATUS_DLQ)).otherwise(F.lit(dsp.STATUS_RETRY))
        _overwrite_batch(done.select("message_id", "tenant_id", F.when(F.col("t.failed"), F.col("t.attempt") + 1).otherwise(F.col("t.attempt")).alias("attempt"),
                                     status.alias("status"), F.col("t.at_ms").alias("at_ms")), out_path, batch_id)
        ahead = F.filter("tries", lambda t: (t["attempt"] > F.col("attempt")) & (t["at_ms"] > until))
        later = work.filter("due").withColumn("t", F.try_element_at(ahead, F.lit(1))).filter("t is not null").select(
            "message_id", "tenant_id", F.col("t.attempt").alias("attempt"), F.col("t.at_ms").alias("now_ms"), F.col("t.failed").alias("failed"), "persistent")
        still = work.filter("not due").select("message_id", "tenant_id", "attempt", "now_ms", "failed", "persistent")
        mark = spark.range(1).select(F.lit(None).cast("bigint").alias("message_id"), F.lit(None).cast("string").alias("tenant_id"), F.lit(0).alias("attempt"),
                                     F.lit(0).cast("bigint").alias("now_ms"), F.lit(False).alias("failed"), F.lit(False).alias("persistent"))
        _overwrite_batch(later.unionByName(still).unionByName(mark).withColumn("clock_ms", F.lit(clock).cast("bigint")), pending_path, batch_id)

    def drain(spark, batch_id: int) -> None:
        """After the stream has ended: the attempts that still wait take place in their turn."""
        step(spark, None, batch_id, drain=True)

    run.drain = drain
    return run


def fan_out_sink(out_path: str, sessions: Callable[[], DataFrame], in_blocks: bool = False):
    """T08 as a ``foreachBatch`` function: ``sessions()`` is read anew for every micro-batch.

    ``in_blocks`` writes the joined blocks of J01 instead of their pairs, which :func:`fanout.pairs` makes on reading.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        joined = fanout.blocks(batch, sessions().select(*fanout.KEYS, "session_id")) if in_blocks else fanout.fan_out(batch, sessions())
        _overwrite_batch(joined, out_path, batch_id)

    return run


def usage_sink(counts_path: str, clock_path: str, lateness_ms: int = 120_000):
    """T09 as a ``foreachBatch`` function: one-minute request counts per tenant.

    A row more than ``lateness_ms`` older than the newest row of earlier
    batches is late.  Late rows are counted beside the others and enter the
    totals, so none is lost; :func:`read_usage` sums the batches' counts.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest_batch(spark, clock_path, batch_id)
        held = None if newest is None else spark.read.parquet(os.path.join(clock_path, f"batch_id={newest}")).first()["clock_us"]
        late = F.lit(False) if held is None else F.col("ts_us") < F.lit(held - lateness_ms * 1000)
        counts = (batch.withColumn("late", late).groupBy("tenant_id", F.window("event_ts", "1 minute").alias("w"))
                       .agg(F.count(F.lit(1)).alias("seen"), F.count_if("late").alias("late"))
                       .select("tenant_id", F.col("w.start").cast("timestamp_ntz").alias("minute_start"), "seen", "late"))
        _overwrite_batch(counts, counts_path, batch_id)
        clock = batch.agg(F.max("ts_us").alias("clock_us"))
        if held is not None:
            clock = clock.select(F.greatest(F.coalesce("clock_us", F.lit(held)), F.lit(held)).alias("clock_us"))
        _overwrite_batch(clock, clock_path, batch_id)

    return run


def read_usage(spark, counts_path: str) -> DataFrame:
    """Totals of the windows, late rows included."""
    return (spark.read.parquet(counts_path).groupBy("tenant_id", "minute_start")
                 .agg(F.sum("seen").cast("bigint").alias("seen"), F.sum("late").cast("bigint").alias("late")))


def _overwrite_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch's rows to ``path/batch_id=<id>``; a re-run replaces them."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def storage_error(spark, e: Exception) -> bool:
    """Whether a write failed in the storage layer (an I/O error somewhere in the chain of causes)."""
    from py4j.java_gateway import is_instance_of
    t = getattr(e, "java_exception", None) or getattr(e, "_origin", None)
    while t is not None:
        if is_instance_of(spark.sparkContext._gateway, t, "java.io.IOException"):
            return True
        t = t.getCause()
    return False


def status_fan_write(paths: dict, max_retries: int = dsp.MAX_RETRIES, fallback: dict | None = None,
                     snapshot_path: str | None = None, compact_every: int = 20):
    """S05 / T04 / T05 / T10 as one ``foreachBatch`` function.

    Per micro-batch, over one persisted batch: the dispatcher pass (C02);
    status rows appended to ``history``; the newest status per (tenant,
    message) appended to the ``state`` log (:func:`read_state` merges);
    audit lines, and rows of the ``audit_table`` if there is one; dead
    letters and retries appended; per-batch counters appended to ``metrics``.
    Every write goes to the batch's own ``batch_id`` folder, so a re-run batch
    leaves the same tables.  ``fallback`` maps a table to a second path used
    when storage refuses the first (S07); every table says in ``sink`` which
    took the row.  With ``snapshot_path`` the state log is folded every
    ``compact_every`` batches.
    """
    from sluice.operators import records, metrics as mt

    def write(name: str, df: DataFrame, batch_id: int) -> None:
        try:
            _overwrite_batch(df.withColumn("sink", F.lit("primary")), paths[name], batch_id)
        except Exception as e:
            if not fallback or name not in fallback or not storage_error(df.sparkSession, e):
                raise
            _overwrite_batch(df.withColumn("sink", F.lit("fallback")), fallback[name], batch_id)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            frames = dispatch_step(batch, max_retries)
            status = frames.status_rows.withColumn("batch_id", F.lit(batch_id))
            newest = dsp.status_expand(batch, max_retries, newest_only=True).withColumn("batch_id", F.lit(batch_id))
            record = F.struct(F.col("tenant_id"), F.col("message_id").cast("string").alias("notification_id"),
                              "user_id", "channel", "content", "correlation_id", "status", "attempt", "error")
            tables = {"history": status, "audit": status.select(records.audit_line(status, "arrival_ts", record).alias("value"))}
            if "audit_table" in paths:
                named = status.withColumn("notification_id", F.col("message_id").cast("string"))
                tables["audit_table"] = named.select(
                    "tenant_id", F.col("arrival_ts").alias("event_time"), F.col("status").alias("event_type"), "notification_id",
                    records.audit_details(named).alias("details"))
            tables |= {"dlq": frames.dead_letters, "retry": frames.retries,
                       "metrics": mt.dispatch_counters(batch).filter("is_total").drop("tenant_id", "is_total").withColumn("batch_id", F.lit(batch_id))}
            together(*[partial(write, name, df, batch_id) for name, df in tables.items()],
                     partial(append_state_delta, newest, paths["state"], batch_id))
            if snapshot_path and batch_id % compact_every == compact_every - 1:
                compact_state(batch.sparkSession, paths["state"], snapshot_path)
        finally:
            batch.unpersist()

    return run


STATE_KEYS = ("tenant_id", "message_id")


def append_state_delta(status: DataFrame, state_path: str, batch_id: int) -> None:
    """Upsert as a log: the batch's newest row per (tenant, message) under its ``batch_id``.

    Overwriting the batch's own folder makes a re-run idempotent; the
    current state is read with :func:`read_state`, and :func:`compact_state`
    folds the deltas into a snapshot now and then.
    """
    latest = newest_per_key(status, list(STATE_KEYS), ["step"], 1)
    _overwrite_batch(latest, state_path, batch_id)


def _numbers(spark, path: str, prefix: str) -> list[int]:
    return sorted(int(n[len(prefix):]) for n in list_folder(spark, path) if n.startswith(prefix))


def read_state(spark, state_path: str, snapshot_path: str | None = None) -> DataFrame:
    """Latest state: newest row per key over the snapshots and the deltas after them.

    ``row_number() = 1`` per key is planned as ``WindowGroupLimit``: each map
    task keeps one row per key before the shuffle.
    """
    return _newest_state(spark, state_path, snapshot_path, _numbers(spark, snapshot_path, "upto=") if snapshot_path else [])


def _newest_state(spark, state_path: str, snapshot_path: str | None, snapshots: list[int], after: int | None = None) -> DataFrame:
    """Newest row per key over some snapshots and the deltas after ``after`` (by default after the newest of them)."""
    after = max(snapshots, default=None) if after is None else after
    newer = [k for k in _numbers(spark, state_path, "batch_id=") if after is None or k > after]
    tables = [spark.read.option("basePath", state_path).parquet(*[os.path.join(state_path, f"batch_id={k}") for k in newer])] if newer else []
    if snapshots:
        tables.append(spark.read.parquet(*[os.path.join(snapshot_path, f"upto={k}") for k in snapshots]))
    both = tables[0] if len(tables) == 1 else tables[0].unionByName(tables[1])
    return newest_per_key(both, list(STATE_KEYS), ["batch_id", "step"], 1)


def compact_state(spark, state_path: str, snapshot_path: str) -> None:
    """Fold the state log: write ``snapshot_path/upto=<k>``, then remove the deltas up to k and the snapshots folded with them.

    A snapshot holds the batches after the one before it.  Only snapshots of
    at most twice the batches that are folded with them are written anew, so
    a row is written again about once for every doubling of the log.  The
    newest delta stays for a re-run of its batch; it is at or below k, so
    it is not read.  Snapshots keep ``batch_id``, so the order is unchanged.
    """
    batches = _numbers(spark, state_path, "batch_id=")
    upto = _numbers(spark, snapshot_path, "upto=")
    if not batches or upto and batches[-1] <= upto[-1]:
        return
    keep = list(upto)
    while keep and keep[-1] - (keep[-2] if len(keep) > 1 else -1) <= 2 * (batches[-1] - keep[-1]):
        keep.pop()
    folded = upto[len(keep):]
    _newest_state(spark, state_path, snapshot_path, folded, upto[-1] if upto else None).write.mode("overwrite").parquet(
        os.path.join(snapshot_path, f"upto={batches[-1]}"))
    for k in batches[:-1]:
        delete_folder(spark, os.path.join(state_path, f"batch_id={k}"))
    for k in folded:
        delete_folder(spark, os.path.join(snapshot_path, f"upto={k}"))


def lag_sink(in_path: str, out_path: str, taken_path: str):
    """T10 per batch as a ``foreachBatch`` function: rows taken, and the lag after the batch.

    The batch has a column ``file`` (``_metadata.file_path``).  Lag is latest
    minus committed: the rows of the files that are in the stream's folder and
    that neither this batch nor an earlier one has taken, counted from the
    files' footers.  The files of a batch are kept under its own number, so a
    batch that runs again reports the same.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        own = batch.groupBy("file").agg(F.count(F.lit(1)).alias("n")).persist()
        try:
            _overwrite_batch(own, taken_path, batch_id)
            present = spark.createDataFrame([(f,) for f in data_files(spark, in_path)], "file string")
            name = F.regexp_extract("file", "[^/]+/[^/]+$", 0)  # folder and file: schemes are written in more than one way
            taken = spark.read.schema("file string, n long").parquet(*[os.path.join(taken_path, f"batch_id={k}") for k in _numbers(spark, taken_path, "batch_id=") if k <= batch_id])
            waiting = [r["file"] for r in present.join(taken.select(name.alias("name")), name == F.col("name"), "left_anti").collect()]  # names of files
            lag = spark.read.parquet(*waiting).count() if waiting else 0
            _overwrite_batch(own.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("consumed")).select(
                F.lit(batch_id).cast("long").alias("batch_id"), "consumed", F.lit(lag).cast("long").alias("lag")), out_path, batch_id)
        finally:
            own.unpersist()

    return run


def observe_dispatch(stream: DataFrame, name: str = "dispatch_metrics",
                     max_retries: int = dsp.MAX_RETRIES) -> DataFrame:
    """T10 (live form): attach the dispatcher counters to every micro-batch.

    ``observe`` computes them inside the batch's own job; a
    :class:`MetricsCollector` listener receives them in each progress event.
    """
    o = dsp.outcome(stream, max_retries)
    rec = F.coalesce(F.col("received_ok"), F.lit(True))
    sim = F.coalesce(F.col("simulate_fail"), F.lit(False))
    dlv = F.coalesce(F.col("delivered_ok"), F.lit(True))
    push = F.coalesce(F.col("push_ok"), F.lit(True))
    ack = F.coalesce(F.col("ack_ok"), F.lit(True)) if "ack_ok" in stream.columns else F.lit(True)
    return o.observe(
        name,
        F.count(F.lit(1)).alias("consumed"),
        F.count_if((F.col("outcome") == dsp.STATUS_DELIVERED) & ack).alias("delivered"),
        F.count_if((F.col("outcome") == dsp.STATUS_RETRY) & ack).alias("retry_scheduled"),
        F.count_if((F.col("outcome") == dsp.STATUS_DLQ) & ack).alias("dead_lettered"),
        F.count_if(~ack).alias("processing_errors"),
        (F.count_if(~rec) + F.count_if(rec & ~sim & ~dlv)).alias("storage_write_failures"),
        F.count_if(rec & ~sim & dlv & ~push).alias("gateway_delivery_failures"),
    ).drop("failure_reason", "outcome")


def metrics_collector(name: str = "dispatch_metrics"):
    """A ``StreamingQueryListener`` that keeps the observed counters of every batch."""
    from pyspark.sql.streaming import StreamingQueryListener

    class MetricsCollector(StreamingQueryListener):
        def __init__(self):
            self.batches: list[dict] = []

        def onQueryStarted(self, event):
            pass

        def onQueryProgress(self, event):
            row = event.progress.observedMetrics.get(name)
            if row is not None:
                self.batches.append({"batch_id": event.progress.batchId, **row.asDict()})

        def onQueryIdle(self, event):
            pass

        def onQueryTerminated(self, event):
            pass

        def totals(self) -> dict:
            last = {b["batch_id"]: b for b in self.batches}  # a re-run batch reports once
            keys = [k for k in (self.batches[0] if self.batches else {}) if k != "batch_id"]
            return {k: sum(b[k] for b in last.values()) for k in keys}

    return MetricsCollector()
