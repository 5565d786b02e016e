"""Order-dependent helpers that never sort a whole hot group in one task.

Rank of a row inside a large group ``(keys, day)`` is computed in phases:
rows are ranked only inside their (keys, second); windows over the
per-second count table (at most 60 rows per minute, 86,400 per day) give
each second's offset in its minute and each minute's offset in its day; one
join brings the offsets back.  The global n-th row of an ordered set is
found day -> minute -> second -> millisecond -> row, each step a small job that returns one row.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import epoch_day, epoch_micros, epoch_minute, epoch_second


def add_time_buckets(df: DataFrame, ts_col: str) -> DataFrame:
    """Epoch-aligned UTC second, minute and day indexes of ``ts_col``."""
    return df.withColumns({
        "bucket_sec": epoch_second(ts_col),
        "bucket_min": epoch_minute(ts_col),
        "bucket_day": epoch_day(ts_col),
    })


def running_before(df: DataFrame, group: Sequence[str], order: str, value: str,
                   out: str) -> DataFrame:
    """``out`` = sum of ``value`` over earlier ``order`` rows of the same group."""
    w = (Window.partitionBy(*group).orderBy(order)
         .rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint"))


def minute_and_day_rank(df: DataFrame, keys: Sequence[str], ts_col: str, id_col: str,
                        eligible: str, minute_cap: int = 0,
                        prior_minute: DataFrame | None = None,
                        prior_day: DataFrame | None = None) -> DataFrame:
    """Rank of every eligible row inside its (keys, minute) and (keys, day).

    Adds ``rank_in_minute`` and ``rank_in_day`` (bigint, null for rows that
    are not eligible).  With ``minute_cap > 0`` only the first ``minute_cap``
    rows of each minute count towards the day rank (rows past the cap are
    the rate-limited ones and never reach the daily counter), and the day
    rank of a capped row is left null.

    ``prior_minute`` (keys, ``bucket_min``, ``seen``) and ``prior_day``
    (keys, ``bucket_day``, ``passed``) carry counts of rows handled earlier
    (previous micro-batches); they shift the ranks of this frame.

    ``df`` must carry the columns of :func:`add_time_buckets`.
    """
    keys = list(keys)
    # Rank inside the second.  Ineligible rows sort last, so eligible rows are
    # numbered among themselves.  The per-second counts below are a second
    # branch of the plan that reads the input again (its columns differ, so
    # the exchange is not shared): give this a narrow or stored input, as C01
    # does.
    w = Window.partitionBy(*keys, "bucket_sec").orderBy(
        (~F.col(eligible)), F.col(ts_col), F.col(id_col))
    ranked = df.withColumn("rank_in_sec", F.row_number().over(w))
    # Phase 1: per-second counts; a window over each (keys, minute) gives the
    # second's offset in its minute and the minute's total (<= 60 rows each).
    # Eligible rows are numbered 1..n first, so the largest number is the
    # count; reading it from the window keeps this branch on the same shuffle.
    sec = ranked.filter(F.col(eligible)).groupBy(*keys, "bucket_day", "bucket_min", "bucket_sec").agg(
        F.max("rank_in_sec").cast("bigint").alias("n_sec"))
    w_min = Window.partitionBy(*keys, "bucket_min").orderBy("bucket_sec")
    sec = sec.withColumns({
        "sec_off": F.coalesce(F.sum("n_sec").over(w_min.rowsBetween(Window.unboundedPreceding, -1)),
                              F.lit(0)).cast("bigint"),
        "n_min": F.sum("n_sec").over(Window.partitionBy(*keys, "bucket_min")),
        "first_sec": F.row_number().over(w_min) == 1,
    })
    if prior_minute is not None:
        sec = sec.join(prior_minute.select(*keys, "bucket_min", F.col("seen").alias("seen_before")),
                       keys + ["bucket_min"], "left")
    else:
        sec = sec.withColumn("seen_before", F.lit(0))
    sec = sec.withColumn("seen_before", F.coalesce(F.col("seen_before"), F.lit(0)).cast("bigint"))
    # Phase 2: minutes inside their day.  Each minute's (capped) count enters
    # the running sum once, at its first second; a minute's offset is the sum
    # up to it minus its own count (<= 86,400 rows per (keys, day)).
    counted = (F.least(F.col("n_min"), F.greatest(F.lit(minute_cap) - F.col("seen_before"), F.lit(0)))
               if minute_cap > 0 else F.col("n_min"))
    sec = sec.withColumn("n_counted", counted)
    w_day = (Window.partitionBy(*keys, "bucket_day").orderBy("bucket_min", "bucket_sec")
             .rowsBetween(Window.unboundedPreceding, 0))
    upto = F.sum(F.when(F.col("first_sec"), F.col("n_counted")).otherwise(F.lit(0))).over(w_day)
    sec = sec.withColumn("min_off", (upto - F.col("n_counted")).cast("bigint"))
    if prior_day is not None:
        sec = (sec.join(prior_day.select(*keys, "bucket_day", F.col("passed").alias("passed_before")),
                        keys + ["bucket_day"], "left")
                  .withColumn("min_off", F.col("min_off") + F.coalesce(F.col("passed_before"), F.lit(0))))
    # Phase 3: offsets back onto the rows (same (keys, second) partitioning).
    offsets = sec.select(*[F.col(k).alias(f"off_{k}") for k in keys],
                         F.col("bucket_sec").alias("off_sec"), "sec_off", "min_off", "seen_before")
    cond = [F.col(k) == F.col(f"off_{k}") for k in keys] + \
           [F.col("bucket_sec") == F.col("off_sec"), F.col(eligible)]
    joined = ranked.join(offsets, cond, "left").drop(*[f"off_{k}" for k in keys], "off_sec")
    local = (F.col("sec_off") + F.col("rank_in_sec")).cast("bigint")
    in_min = F.col("seen_before") + local
    in_day = F.col("min_off") + local
    if minute_cap > 0:
        in_day = F.when(in_min <= minute_cap, in_day)
    return (joined.withColumn("rank_in_minute", F.when(F.col(eligible), in_min))
                  .withColumn("rank_in_day", F.when(F.col(eligible), in_day.cast("bigint")))
                  .drop("rank_in_sec", "sec_off", "min_off", "seen_before"))


def nth_in_order(df: DataFrame, n: int, ts_col: str, id_col: str):
    """``(ts, id)`` of the ``n``-th row of ``df`` by (ts, id), or None if it has fewer rows.

    Small jobs, each returning one row to the driver: the day that holds the
    n-th row, then the minute, the second and the millisecond inside it (a
    running sum over a count table of at most 1,440, 60 and 1,000 rows), and
    last the row inside that millisecond.  The later jobs filter on a literal
    time range, which reaches the parquet scan as a pushed filter.
    """
    if n <= 0:
        return None
    rows = df.select(F.col(ts_col).alias("t"), F.col(id_col).alias("i"))
    before = 0
    for micros in (86_400_000_000, 60_000_000, 1_000_000, 1_000):
        bucket = F.floor(epoch_micros("t") / micros).cast("bigint")
        counts = rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("c"))
        upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # over the count table
        counts = counts.withColumn("cum", F.lit(before) + F.sum("c").over(upto))
        hit = counts.filter(F.col("cum") >= n).orderBy("b").select("b", (F.col("cum") - F.col("c")).alias("before")).first()
        if hit is None:
            return None
        before = hit["before"]
        start = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=hit["b"] * micros)
        rows = rows.filter((F.col("t") >= ts_literal(start)) & (F.col("t") < ts_literal(start + dt.timedelta(microseconds=micros))))
    row = rows.orderBy("t", "i").offset(n - before - 1).limit(1).first()
    return (row["t"], row["i"])


def ts_literal(value: dt.datetime):
    """Exact NTZ literal of a wall-clock datetime (no local-time conversion)."""
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def position_and_previous(df: DataFrame, group: Sequence[str], ts_col: str, id_col: str,
                          carry: Sequence[str]) -> DataFrame:
    """1-based ``step`` of each row in its group by (ts, id), and ``prev_<c>`` of the row before.

    Nothing sorts a whole group: rows are ordered only inside their (group,
    second).  The last row of a second stands for it: its number there is
    the second's count.  Running sums and ``lag`` over those rows inside the
    day (at most 86,400), and over the last of each day inside the group,
    give every second's offset and the row before it; one join brings them
    back.  Null times come first, null group values are values.

    Rows and seconds come from one shuffle if ``df`` has no columns but the
    ones named here; keys travel as structs, so that null keys meet by plain
    equality and the join keeps the rows where they are.
    """
    group, carry = list(group), list(carry)
    rest = [c for c in df.columns if c not in group]
    rows = df.select(F.struct(*group, epoch_second(ts_col).alias("_s")).alias("_at"), *rest)
    w_in = Window.partitionBy("_at").orderBy(ts_col, id_col)
    rows = rows.withColumns({"_rn": F.row_number().over(w_in), "_more": F.lead(F.lit(1)).over(w_in),
                             **{f"_lag_{c}": F.lag(c).over(w_in) for c in carry}})
    secs = rows.filter(F.col("_more").isNull()).select(
        F.struct(*[F.col(f"_at.{g}").alias(g) for g in group], epoch_day(ts_col).alias("_d")).alias("_on"),
        F.col("_at._s").alias("_s"), F.col("_rn").cast("bigint").alias("_n"), F.struct(*carry).alias("_last"))
    w_secs = Window.partitionBy("_on").orderBy("_s")
    secs = secs.withColumns({
        "_off": F.coalesce(F.sum("_n").over(w_secs.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_before": F.lag("_last").over(w_secs), "_more": F.lead(F.lit(1)).over(w_secs)})
    w_days = Window.partitionBy(*[f"_on.{g}" for g in group]).orderBy("_on._d")
    days = secs.filter(F.col("_more").isNull()).select(
        F.col("_on").alias("_day"),
        F.coalesce(F.sum(F.col("_off") + F.col("_n")).over(w_days.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_day_off"),
        F.lag("_last").over(w_days).alias("_day_before"))
    offsets = secs.join(days, F.col("_on") == F.col("_day")).select(
        F.struct(*[F.col(f"_on.{g}").alias(g) for g in group], "_s").alias("_sec"), (F.col("_off") + F.col("_day_off")).alias("_off"),
        F.coalesce("_before", "_day_before").alias("_before"))
    out = rows.join(offsets, F.col("_at") == F.col("_sec"))
    return out.select(
        *[F.col(f"_at.{g}").alias(g) for g in group], *rest, (F.col("_off") + F.col("_rn")).cast("bigint").alias("step"),
        *[F.when(F.col("_rn") == 1, F.col(f"_before.{c}")).otherwise(F.col(f"_lag_{c}")).alias(f"prev_{c}") for c in carry])


def entries_before(rows: DataFrame, entries: DataFrame, ts_col: str, entry_col: str, id_col: str = "message_id") -> DataFrame:
    """(id, ``n_before``): how many entries lie strictly before each row's time.

    Counts per second are summed up within the hour, and per hour within the year; the entries of earlier years are a literal for
    each year (a small job counts them).  Only within one second are rows and entries ordered, and no window spans all rows.
    """
    year_of = lambda hour: F.floor(hour / 8766).cast("bigint")
    hour_of = F.floor(epoch_micros(entry_col) / 3_600_000_000).cast("bigint")
    years = entries.groupBy(year_of(hour_of).alias("year")).agg(F.count(F.lit(1)).alias("n")).filter("year is not null").collect()
    marked = (rows.select(epoch_micros(ts_col).alias("us"), F.col(id_col).alias("id"), F.lit(0).alias("entry"))
                  .unionByName(entries.select(epoch_micros(entry_col).alias("us"), F.lit(None).cast("bigint").alias("id"), F.lit(1).alias("entry"))))
    marked = marked.withColumns({"sec": F.floor(F.col("us") / 1_000_000).cast("bigint"), "hour": F.floor(F.col("us") / 3_600_000_000).cast("bigint")})
    seconds = marked.groupBy("hour", "sec").agg(F.sum("entry").alias("n"))
    hours = running_before(seconds.groupBy("hour").agg(F.sum("n").alias("n")).withColumn("year", year_of(F.col("hour"))), ["year"], "hour", "n", "in_year")
    earlier = sum((F.when(F.col("year") > r["year"], r["n"]).otherwise(0) for r in years), F.lit(0))
    hours = hours.withColumn("hours_before", F.col("in_year") + earlier)
    base = running_before(seconds, ["hour"], "sec", "n", "secs_before").join(hours.select("hour", "hours_before"), "hour")
    within = Window.partitionBy("sec").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    inside = marked.withColumn("inside", F.coalesce(F.sum("entry").over(within), F.lit(0))).filter("entry = 0")
    return inside.join(base.select("sec", "secs_before", "hours_before"), "sec").select(
        F.col("id").alias(id_col), (F.col("hours_before") + F.col("secs_before") + F.col("inside")).cast("bigint").alias("n_before"))
