"""Subscription fan-out (J01-J03) and open-session counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import epoch_micros
from sluice.session import materialize

KEYS = ("tenant_id", "channel")


# Rows of either side in one stored block, and in one block that a task joins; pairs that one task makes on average.
BLOCK_ROWS = 512
JOIN_ROWS = 2048
PAIRS_PER_TASK = 4_000_000
MAX_TASKS = 10_000


def _per_key(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _dealt(rows: DataFrame, keys: Sequence[str], name: str, number: str) -> DataFrame:
    """Rows of one side in arrays ``name`` of about ``BLOCK_ROWS`` at most; a key with more rows has more arrays, told apart by ``number``."""
    columns = [c for c in rows.columns if c not in keys]
    return (rows.join(_per_key(rows, keys), list(keys)).groupBy(*keys, _block(columns, "n", BLOCK_ROWS).alias(number))
                .agg(F.collect_list(F.struct(*columns)).alias(name)))


def _block(columns: Sequence[str], rows_of_key: str, rows: int) -> Column:
    """Number of a row's block among its key's blocks of about ``rows`` rows at most."""
    return F.pmod(F.xxhash64(*columns), _n_blocks(rows_of_key, rows))


def _n_blocks(rows_of_key: str, rows: int) -> Column:
    return F.ceil(F.col(rows_of_key) / rows).cast("bigint")


def _over_cores(sessions: DataFrame) -> DataFrame:
    """Sessions in a task per core: few bytes of them are listed in many rows."""
    return sessions.repartition(sessions.sparkSession.sparkContext.defaultParallelism, "session_id")


def _tasks(n_pairs: int) -> int:
    return min(MAX_TASKS, max(1, -(-n_pairs // PAIRS_PER_TASK)))


def blocks(messages: DataFrame, sessions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The join on ``keys`` in blocks: each row stands for every pair of its ``messages`` and ``sessions``.

    A block of full size holds a quarter of a million pairs, so blocks are dealt or
    stored at a small part of the pairs' size; :func:`pairs` makes the pairs.
    """
    return _dealt(messages, keys, "messages", "m").join(_dealt(sessions, keys, "sessions", "s"), list(keys))


def pairs(joined: DataFrame, keys: Sequence[str] = KEYS, n_pairs: int | None = None) -> DataFrame:
    """The pairs of :func:`blocks`: the keys, then the columns of both sides.

    Blocks are dealt to tasks by their number of pairs, not by their bytes,
    which say little about the work; ``n_pairs`` is counted where not given.
    The ``coalesce`` merges nothing: it parts the generated code of the two
    explodes, which as one would hold all pairs of a block before it passes
    the first on.
    """
    if n_pairs is None:
        n_pairs = joined.agg(F.sum(F.size("messages").cast("bigint") * F.size("sessions"))).first()[0] or 0
    tasks = _tasks(n_pairs)
    one = joined.repartition(tasks, *keys, "m", "s").select(*keys, F.inline("messages"), "sessions").coalesce(tasks)
    return one.select(*[c for c in one.columns if c != "sessions"], F.inline("sessions"))


def _joined(messages: DataFrame, sessions: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The join on ``keys``: the keys, then the columns of both sides.

    Both sides of a key are cut into blocks of about ``JOIN_ROWS`` rows; each
    row is listed under the blocks of the other side, and tasks join the rows
    of some pairs of blocks, chosen by their number of pairs.  So a hot key is
    spread over tasks on either side, no task holds more than one block of
    sessions besides what Spark sorts (and spills), and rows without a partner
    go before anything is dealt.  The keys' row counts are kept under ``name``.
    """
    both = materialize(_per_key(messages, keys).join(_per_key(sessions, keys).withColumnRenamed("n", "k"), list(keys)), name)
    tasks = _tasks(int(both.agg(F.sum(F.col("n").cast("decimal(20,0)") * F.col("k"))).first()[0] or 0))
    at = ("message_block", "session_block", *keys)

    def dealt(rows: DataFrame, own: str, n: str, other: str, k: str) -> DataFrame:
        columns = [c for c in rows.columns if c not in keys]
        return (rows.join(both, list(keys))
                    .select(*rows.columns, _block(columns, n, JOIN_ROWS).alias(own), F.explode(F.sequence(F.lit(0), _n_blocks(k, JOIN_ROWS) - 1)).alias(other))
                    .repartition(tasks, *at))

    m, s = dealt(messages, at[0], "n", at[1], "k"), dealt(sessions, at[1], "k", at[0], "n")
    return m.join(s, list(at)).select(*keys, *[c for x in (messages, sessions) for c in x.columns if c not in keys])


def fan_out(messages: DataFrame, sessions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Every message x every session subscribed to its (tenant, channel).

    The session side is projected to keys and id.  No hint: adaptive
    execution broadcasts a side when its measured size allows.  Rows are
    joined in blocks, so a hot (tenant, channel) is spread over tasks on
    either side.  The output is all pairs by definition; J02 counts without
    making them, and J03 is the form for delivery.
    """
    return _joined(messages, _over_cores(sessions.select(*keys, "session_id")), keys, "fan-out-counts")


def fan_out_counts(messages: DataFrame, sessions: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Clients reached per message, 0 included.

    Sessions are counted per key first (one row per (tenant, channel)), so
    the join never multiplies rows.
    """
    per_key = sessions.groupBy(*keys).agg(F.count(F.lit(1)).alias("clients"))
    return (messages.join(per_key, list(keys), "left")
                    .withColumn("clients", F.coalesce(F.col("clients"), F.lit(0)).cast("bigint")))


# Sizes of the time nodes a session is listed under, in base buckets (hour, day, 30 days).
NODE_SIZES = (720, 24, 1)


def cover(lo: Column, hi: Column, sizes: Sequence[int] = NODE_SIZES) -> Column:
    """Array of (size, index) nodes that cover ``[lo, hi)`` exactly once, largest first.

    Whole large nodes cover the middle; the two ends go to the next size.
    An interval of any length has at most a few dozen nodes besides its
    30-day ones.
    """
    size = sizes[0]
    first, last = F.ceil(lo / size).cast("bigint"), F.floor(hi / size).cast("bigint")
    whole = first < last
    mid = F.when(whole, F.transform(F.sequence(first, last - 1), lambda i: F.struct(F.lit(size).alias("size"), i.alias("node")))) \
        .otherwise(F.array().cast("array<struct<size:int,node:bigint>>"))
    if len(sizes) == 1:
        return mid
    left = cover(lo, F.when(whole, first * size).otherwise(hi), sizes[1:])
    right = cover(F.when(whole, last * size).otherwise(hi), hi, sizes[1:])
    return F.concat(left, mid, right)


def _at_nodes(messages: DataFrame, sessions: DataFrame, ts_col: str, keys: Sequence[str], bucket_seconds: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of J03 under their time nodes (``size``, ``node``); sessions only where there are messages."""
    b = bucket_seconds * 1_000_000
    bucket = F.floor(epoch_micros(ts_col) / b)
    span = messages.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi")).first()
    start_b = F.greatest(F.floor(epoch_micros("sub_start") / b).cast("bigint"), F.lit(span["lo"]))
    end_b = F.least(F.coalesce(F.floor((epoch_micros("sub_end") - 1) / b).cast("bigint"), F.lit(span["hi"])), F.lit(span["hi"])) + 1
    live = (F.col("sub_end").isNull() | (F.col("sub_end") > F.col("sub_start"))) & (start_b < end_b)
    s = (sessions.filter(live).select(*keys, "session_id", "sub_start", "sub_end", F.explode(cover(start_b, end_b)).alias("at"))
                 .select(*keys, "session_id", "sub_start", "sub_end", "at.size", "at.node"))
    m = messages.withColumn("at", F.explode(F.array(*[
        F.struct(F.lit(n).alias("size"), F.floor(epoch_micros(ts_col) / (b * n)).cast("bigint").alias("node")) for n in NODE_SIZES])))
    return m.withColumns({"size": F.col("at.size"), "node": F.col("at.node")}).drop("at"), s


NODE = ("size", "node")


def as_of_blocks(messages: DataFrame, sessions: DataFrame, ts_col: str = "arrival_ts",
                 keys: Sequence[str] = KEYS, bucket_seconds: int = 3600) -> DataFrame:
    """J03's equi join on (keys, node) in blocks; :func:`as_of_pairs` tests the exact range."""
    return blocks(*_at_nodes(messages, sessions, ts_col, keys, bucket_seconds), (*keys, *NODE))


def _live_at(ts_col: str) -> Column:
    return (F.col("sub_start") <= F.col(ts_col)) & (F.col("sub_end").isNull() | (F.col(ts_col) < F.col("sub_end")))


def as_of_pairs(joined: DataFrame, ts_col: str = "arrival_ts", keys: Sequence[str] = KEYS, n_pairs: int | None = None) -> DataFrame:
    """J03's rows from :func:`as_of_blocks`."""
    return pairs(joined, (*keys, *NODE), n_pairs).filter(_live_at(ts_col)).drop(*NODE)


def fan_out_as_of(messages: DataFrame, sessions: DataFrame, ts_col: str = "arrival_ts",
                  keys: Sequence[str] = KEYS, bucket_seconds: int = 3600) -> DataFrame:
    """Sessions live at delivery time, ``sub_start <= ts < sub_end``; null ``sub_end`` = still open.

    A range join as an equi join: each session is listed under the time
    nodes (hours, days, 30 days) that cover it exactly once, a message under
    its one node of each size; they join on (keys, node) in blocks, and the
    exact range test runs on the matches, so no match is duplicated.  An open
    session reaches to the last message.
    """
    m, s = _at_nodes(messages, _over_cores(sessions), ts_col, keys, bucket_seconds)
    return _joined(m, s, (*keys, *NODE), "fan-out-as-of-counts").filter(_live_at(ts_col)).drop(*NODE)


def active_sessions(sessions: DataFrame, opened: str = "sub_start", closed: str = "sub_end") -> DataFrame:
    """Sessions open at each instant at which one opens or closes.

    A session counts at instant ``t`` when ``opened <= t < closed`` (null
    ``closed`` = still open).  Changes are summed per instant, then per hour;
    a running sum over the hours (bounded by the time span) gives each
    hour's start, and one within the hour each instant's count.
    """
    changes = sessions.select(F.explode(F.array(
        F.struct(F.col(opened).alias("change_ts"), F.lit(1).alias("d")),
        F.struct(F.col(closed).alias("change_ts"), F.lit(-1).alias("d")))).alias("x")) \
        .select("x.*").filter(F.col("change_ts").isNotNull())
    instants = changes.groupBy("change_ts").agg(F.sum("d").alias("delta")) \
        .withColumn("hour", F.floor(epoch_micros("change_ts") / 3_600_000_000).cast("bigint"))
    hours = instants.groupBy("hour").agg(F.sum("delta").alias("in_hour"))
    before = Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = hours.select("hour", F.coalesce(F.sum("in_hour").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("hour").orderBy("change_ts").rowsBetween(Window.unboundedPreceding, 0)
    return instants.join(hours, "hour").select(
        "change_ts", (F.col("before") + F.sum("delta").over(within)).cast("bigint").alias("active"))


def active_at(sessions: DataFrame, t: str, opened: str = "sub_start", closed: str = "sub_end") -> DataFrame:
    """A06 point form: one row, sessions open at instant ``t``."""
    tt = F.lit(t).cast("timestamp_ntz")
    return sessions.agg(F.count_if((F.col(opened) <= tt)
                                   & (F.col(closed).isNull() | (F.col(closed) > tt))).alias("active"))
