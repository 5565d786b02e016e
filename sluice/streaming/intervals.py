"""J03 on streams: messages met with session intervals, both arriving.

One input carries both sides (column ``side``: ``message`` or ``session``).  What
either side must still be met with lives in a table of the shared folder:
sessions until their interval lies behind the watermark, messages until no
session can begin before them any more.  The watermark is the smaller one of
the two sides' newest times, less the lateness allowed; it never goes back.
"""

from __future__ import annotations

import os
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.functions import epoch_micros
from sluice.operators import fanout
from sluice.streaming.jobs import _newest_batch, _numbers, _overwrite_batch, together

MESSAGE, SESSION = "message", "session"
SIDES = ("side string, message_id long, session_id long, tenant_id string, channel string, "
         "arrival_ts timestamp_ntz, sub_start timestamp_ntz, sub_end timestamp_ntz")
HELD = SIDES + ", message_clock_us long, session_clock_us long"
_COLUMNS = [c.split()[0] for c in SIDES.split(", ")]


def both_sides(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """One input of both sides; ``at`` is a row's own time (arrival, or start of the interval)."""
    m = messages.select(F.lit(MESSAGE).alias("side"), "message_id", "tenant_id", "channel", "arrival_ts", F.col("arrival_ts").alias("at"))
    s = sessions.select(F.lit(SESSION).alias("side"), F.col("session_id").cast("long").alias("session_id"), "tenant_id", "channel", "sub_start", "sub_end",
                        F.col("sub_start").alias("at"))
    both = m.unionByName(s, allowMissingColumns=True)
    return both.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split() for x in SIDES.split(", "))], "at")


def as_of_sink(out_path: str, state_path: str, late_path: str, lateness_ms: int = 600_000, in_blocks: bool = False):
    """J03 as a ``foreachBatch`` function over :func:`both_sides`.

    A batch joins its messages with the sessions held and its own sessions with
    the messages held and new, each by J03's equi-join on time nodes, so
    a pair is made once, in the batch in which its second row arrives.  Rows
    older than the watermark are late: they meet what is still held, and are
    written to ``late_path`` for a repair by the batch job.  A batch that runs
    again reads the state of the batch before it and leaves the same tables.
    ``in_blocks`` writes the joined blocks instead of their pairs, which
    :func:`fanout.as_of_pairs` makes on reading.
    """
    made = _blocks if in_blocks else _pairs

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest = _newest_batch(spark, state_path, batch_id)
        held = (spark.read.schema(HELD).parquet(os.path.join(state_path, f"batch_id={newest}"))
                if newest is not None else spark.createDataFrame([], HELD))
        new = batch.select(*_COLUMNS).persist()
        try:
            before = held.agg(F.max("message_clock_us").alias("m"), F.max("session_clock_us").alias("s")).first()  # one row
            now = new.agg(F.max(epoch_micros("arrival_ts")).alias("m"), F.max(epoch_micros("sub_start")).alias("s")).first()
            clock = {k: max((v for v in (before[k], now[k]) if v is not None), default=None) for k in ("m", "s")}
            mark = lambda c: None if None in (c["m"], c["s"]) else min(c["m"], c["s"]) - lateness_ms * 1000
            was, upto = mark(before), mark(clock)
            rows = held.filter("side is not null").select(*_COLUMNS)
            met = made(new, rows.filter(F.col("side") == SESSION)).unionByName(made(rows.unionByName(new), new.filter(F.col("side") == SESSION)))
            own_time = F.coalesce(epoch_micros("arrival_ts"), epoch_micros("sub_start"))
            late = F.lit(False) if was is None else own_time < F.lit(was)
            needed = F.lit(True) if upto is None else F.when(F.col("side") == MESSAGE, epoch_micros("arrival_ts") >= upto).otherwise(
                F.col("sub_end").isNull() | (epoch_micros("sub_end") > upto))
            clocks = spark.range(1).select(F.lit(clock["m"]).cast("long").alias("message_clock_us"), F.lit(clock["s"]).cast("long").alias("session_clock_us"))
            state = rows.unionByName(new).filter(needed).unionByName(clocks, allowMissingColumns=True)
            together(*[partial(_overwrite_batch, df, path, batch_id) for df, path in ((met, out_path), (new.filter(late), late_path), (state, state_path))])
        finally:
            new.unpersist()

    return run


def _both(messages: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (messages.filter(F.col("side") == MESSAGE).select("message_id", *fanout.KEYS, "arrival_ts"),
            sessions.select("session_id", *fanout.KEYS, "sub_start", "sub_end"))


def _pairs(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return fanout.fan_out_as_of(*_both(messages, sessions)).select("message_id", "session_id", "arrival_ts")


def _blocks(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    return fanout.as_of_blocks(*_both(messages, sessions))


def held_rows(spark: SparkSession, state_path: str) -> DataFrame:
    """The rows that the newest batch left in the state."""
    newest = _numbers(spark, state_path, "batch_id=")[-1]
    return spark.read.schema(HELD).parquet(os.path.join(state_path, f"batch_id={newest}")).filter("side is not null").select(*_COLUMNS)
