"""T09 with a watermark: one-minute windows in the state store, each emitted once when it closes.

Two queries in a row.  The first splits arriving rows by a clock of its own:
a row whose window lies behind the clock is late and counted at once in a
table; the others go on.  The second keeps open windows in the state store
and appends a window's count when the watermark passes its end.  Its
watermark never is ahead of the first query's clock, so it drops nothing.
"""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import list_folder, rename_folder, setting
from sluice.streaming.harness import read_files_stream
from sluice.streaming.jobs import _newest_batch, _numbers, _overwrite_batch, together

LATENESS_MS = 120_000
WINDOW_US = 60_000_000
ROUTED = "tenant_id string, event_ts timestamp, marker boolean"
COUNTED = "tenant_id string, minute_start timestamp_ntz, seen long"


def publish_once(df: DataFrame, path: str, batch_id: int) -> None:
    """Make ``path/batch_id=<id>`` appear by one rename; a batch that runs again leaves what is there.

    A query that reads ``path`` as a stream thus never sees two attempts of one batch.
    """
    spark = df.sparkSession
    name = f"batch_id={batch_id}"
    if name not in list_folder(spark, path):
        df.write.mode("overwrite").parquet(os.path.join(f"{path}-attempts", name))
        rename_folder(spark, os.path.join(f"{path}-attempts", name), os.path.join(path, name))


def route_sink(base: str, lateness_ms: int = LATENESS_MS):
    """The first query as a ``foreachBatch`` function: late rows are counted in ``late``, the others go to ``on_time``.

    A row is late when its window ended at or before the newest time of earlier batches less ``lateness_ms``.
    """
    on_time, late_path, clock_path = (os.path.join(base, n) for n in ("on_time", "late", "clock"))

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest_batch(spark, clock_path, batch_id)
        held = None if newest is None else spark.read.parquet(os.path.join(clock_path, f"batch_id={newest}")).first()["clock_us"]
        minute = F.floor(F.col("ts_us") / WINDOW_US)
        late = F.lit(False) if held is None else (minute + 1) * WINDOW_US <= F.lit(held - lateness_ms * 1000)
        counted = batch.filter(late).groupBy("tenant_id", F.timestamp_micros(minute * WINDOW_US).cast("timestamp_ntz").alias("minute_start"))
        others = batch.filter(~late).select("tenant_id", "event_ts", F.lit(False).alias("marker"))
        clock = batch.agg(F.max("ts_us").alias("clock_us"))
        if held is not None:
            clock = clock.select(F.greatest(F.coalesce("clock_us", F.lit(held)), F.lit(held)).alias("clock_us"))
        together(partial(_overwrite_batch, counted.agg(F.count(F.lit(1)).alias("seen")), late_path, batch_id),
                 partial(publish_once, others, on_time, batch_id), partial(_overwrite_batch, clock, clock_path, batch_id))

    return run


def start_windows(spark: SparkSession, base: str, lateness_ms: int = LATENESS_MS):
    """The second query: closed windows of the rows in ``on_time``, appended to ``closed``."""
    rows = read_files_stream(spark, os.path.join(base, "on_time"), spark.createDataFrame([], ROUTED).schema)
    counts = (rows.withWatermark("event_ts", f"{lateness_ms} milliseconds").groupBy(F.window("event_ts", "1 minute").alias("w"), "tenant_id")
                  .agg(F.count_if(~F.col("marker")).alias("seen"))
                  .select("tenant_id", F.col("w.start").cast("timestamp_ntz").alias("minute_start"), "seen"))
    writer = (counts.writeStream.format("parquet").outputMode("append").option("path", os.path.join(base, "closed"))
              .option("checkpointLocation", os.path.join(base, "checkpoint-windows")).trigger(availableNow=True))
    # State in one partition per core, if the session does not say fewer: every state partition is written at every batch,
    # however few rows it got, and their number stays for the query's life.
    partitions = "spark.sql.shuffle.partitions"
    with setting(spark, partitions, min(int(spark.conf.get(partitions)), spark.sparkContext.defaultParallelism)):
        return writer.start()


def close_all(spark: SparkSession, base: str, lateness_ms: int = LATENESS_MS) -> None:
    """After the stream has ended: a marker row beyond the last window, and one beyond it, close what is open."""
    newest = max(_numbers(spark, os.path.join(base, "clock"), "batch_id="), default=None)
    if newest is None:
        return
    clock = spark.read.parquet(os.path.join(base, "clock", f"batch_id={newest}")).first()["clock_us"]
    if clock is None:
        return
    for step in (1, 2):
        at = clock + step * (lateness_ms * 1000 + 2 * WINDOW_US)
        marker = spark.range(1).select(F.lit(None).cast("string").alias("tenant_id"), F.timestamp_micros(F.lit(at)).alias("event_ts"), F.lit(True).alias("marker"))
        publish_once(marker, os.path.join(base, "on_time"), newest + step)
        start_windows(spark, base, lateness_ms).awaitTermination()


def closed(spark: SparkSession, base: str) -> DataFrame:
    """Windows emitted so far, each once."""
    return spark.read.schema(COUNTED).parquet(os.path.join(base, "closed")).filter("seen > 0")


def totals(spark: SparkSession, base: str) -> DataFrame:
    """Closed windows with the late rows merged in."""
    late = spark.read.schema(COUNTED).parquet(os.path.join(base, "late")).select("tenant_id", "minute_start", "seen")
    return closed(spark, base).unionByName(late).groupBy("tenant_id", "minute_start").agg(F.sum("seen").cast("long").alias("seen"))
