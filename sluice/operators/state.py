"""Latest-state, newest-N and clustered reads over status history.

Top-1 / top-N per key is always ``row_number() <= n`` over a keyed window:
Spark plans it as ``WindowGroupLimit`` and keeps at most ``n`` rows per key
*before* the shuffle, so a hot tenant or notification never ships all of its
rows to one task.  A global newest-N is ``orderBy().limit()``, planned as
``TakeOrderedAndProject`` (per-partition top-N, then a merge of N rows each).
"""

from __future__ import annotations

import datetime as dt
import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.session import delete_folder, list_folder, rename_folder

# Fixed values of the read API (newest-N history reads).
HISTORY_LIMIT_DEFAULT = 50
HISTORY_LIMIT_MIN = 1
HISTORY_LIMIT_MAX = 500

DELIVERY_COLUMNS = ["tenant_id", "notification_id", "user_id", "channel", "status",
                    "attempt", "correlation_id", "status_ts"]


def _desc(cols: Sequence[str]) -> list[Column]:
    return [F.col(c).desc() for c in cols]


def newest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                   n: int = 1, rank_col: str | None = None) -> DataFrame:
    """The ``n`` newest rows of every key, by ``order`` descending.

    ``order`` must make rows unique within a key (e.g. ``(ts, seq)``).
    """
    w = Window.partitionBy(*keys).orderBy(*_desc(order))
    rn = F.row_number().over(w)
    out = df.withColumn("__rn", rn).filter(F.col("__rn") <= n)
    if rank_col:
        return out.withColumn(rank_col, F.col("__rn").cast("bigint")).drop("__rn")
    return out.drop("__rn")


def latest_state(history: DataFrame, tenant_id: str | None = None,
                 notification_id: str | None = None,
                 keys: Sequence[str] = ("tenant_id", "notification_id"),
                 order: Sequence[str] = ("status_ts", "seq")) -> DataFrame:
    """Newest record per (tenant, notification); optional point lookup.

    A point lookup filters first, so the predicate reaches the parquet scan;
    no match gives an empty frame (= not found).
    """
    if tenant_id is not None:
        history = history.filter(F.col("tenant_id") == tenant_id)
    if notification_id is not None:
        history = history.filter(F.col("notification_id") == notification_id)
    return newest_per_key(history, keys, order, 1)


def history_limit(n) -> int:
    """Clamp a requested history size to [1, 500]; unreadable -> 50."""
    try:
        v = int(str(n).strip()) if n is not None else HISTORY_LIMIT_DEFAULT
    except ValueError:
        v = HISTORY_LIMIT_DEFAULT
    return max(HISTORY_LIMIT_MIN, min(HISTORY_LIMIT_MAX, v))


def delivery_history(history: DataFrame, n=HISTORY_LIMIT_DEFAULT, tenant_id: str | None = None,
                     order: Sequence[str] = ("status_ts", "seq")) -> DataFrame:
    """Newest ``n`` status rows of one tenant, or of every tenant.

    Not one row per notification: every status row counts.  Content and
    error are not part of the projection.
    """
    n = history_limit(n)
    cols = DELIVERY_COLUMNS + [c for c in order if c not in DELIVERY_COLUMNS]
    h = history.select(*cols)
    if tenant_id is not None:
        return h.filter(F.col("tenant_id") == tenant_id).orderBy(*_desc(order)).limit(n)
    return newest_per_key(h, ["tenant_id"], order, n)


def pk_collapse(history: DataFrame, pk: Sequence[str], ts_col: str = "status_ts",
                grain: str = "millisecond", seq_col: str = "seq") -> DataFrame:
    """Table as seen after primary-key overwrite, last write wins.

    The timestamp part of the key is truncated to ``grain`` (the store keeps
    milliseconds); among rows with the same key the highest ``seq`` survives.
    """
    keyed = history.withColumn("pk_ts", F.date_trunc(grain, F.col(ts_col)).cast("timestamp_ntz"))
    return newest_per_key(keyed, list(pk) + ["pk_ts"], [seq_col], 1)


def dlq_newest(dead_letters: DataFrame, n: int = 50,
               order: Sequence[str] = ("arrival_ts", "message_id")) -> DataFrame:
    """Newest ``n`` dead letters, newest first (``TakeOrderedAndProject``)."""
    return dead_letters.orderBy(*_desc(order)).limit(max(0, int(n)))


def latest_entry(stream: DataFrame, per: Sequence[str] = ("source_stream",),
                 order: Sequence[str] = ("arrival_ts", "message_id")) -> DataFrame:
    """Newest entry of each stream (``per=()`` -> newest of the whole stream)."""
    if not per:
        return stream.orderBy(*_desc(order)).limit(1)
    return newest_per_key(stream, per, order, 1)


def clustered_history(history: DataFrame, tenant_id: str, notification_id: str,
                      order: Sequence[str] = ("status_ts", "seq")) -> DataFrame:
    """Full history of one (tenant, notification), newest first."""
    return (history.filter((F.col("tenant_id") == tenant_id)
                           & (F.col("notification_id") == notification_id))
                   .orderBy(*_desc(order)))


def bucket_of(tenant_id, notification_id, buckets: int):
    """The bucket of one (tenant, notification) in a clustered table."""
    return F.pmod(F.xxhash64(tenant_id, notification_id), F.lit(buckets)).cast("int")


def write_clustered(history: DataFrame, path: str, partitions: int | None = None, buckets: int = 0) -> None:
    """Writer side of L03: cluster by tenant, newest first within a file,
    so row-group min/max statistics prune point reads.  With ``buckets`` every
    day is also split by hash of (tenant, notification), so a point
    read opens one bucket's files only (:func:`point_rows`)."""
    df = history.withColumn("status_date", F.to_date("status_ts"))
    if buckets > 0:
        df = df.withColumn("bucket", bucket_of(F.col("tenant_id"), F.col("notification_id"), buckets))
        (df.repartition("bucket").sortWithinPartitions("status_date", "tenant_id", "notification_id", F.col("status_ts").desc())
           .write.mode("append").partitionBy("status_date", "bucket").parquet(path))
        return
    by = ["tenant_id", "notification_id"]  # ranges, so a busy tenant spans several files
    df = df.repartitionByRange(partitions, *by) if partitions else df.repartitionByRange(*by)
    (df.sortWithinPartitions("tenant_id", "notification_id", F.col("status_ts").desc())
       .write.mode("append").partitionBy("status_date").parquet(path))


def point_rows(spark, path: str, tenant_id: str, notification_id: str, buckets: int) -> DataFrame:
    """L03 / W05 on the clustered table: rows of one (tenant, notification).

    The bucket is a literal, so other buckets' files are pruned by their
    folder, and row groups by the two pushed equality filters.
    """
    bucket = spark.range(1).select(bucket_of(F.lit(tenant_id), F.lit(notification_id), buckets).alias("b")).first()["b"]
    return spark.read.parquet(path).filter((F.col("bucket") == bucket) & (F.col("tenant_id") == tenant_id)
                                           & (F.col("notification_id") == notification_id)).drop("bucket", "status_date")


def purge(spark, path: str, as_of: str, ttl_seconds: int, ts_col: str = "status_ts", date_col: str = "status_date") -> dict[str, list[str]]:
    """T11 as a job on a table partitioned by day: whole expired days are dropped by listing; only the day on the boundary is rewritten.

    The rewritten day is complete beside the table before it is swapped in by
    rename; a run that ends in between is finished by the next one, and a
    second run changes nothing.  Rows without a time stay (reads skip them).
    Returns which days were dropped and which rewritten.
    """
    done: dict[str, list[str]] = {"dropped": [], "rewritten": []}
    if ttl_seconds <= 0:
        return done
    fresh, old = os.path.join(path, "_purge_new"), os.path.join(path, "_purge_old")
    for day in list_folder(spark, old):  # a swap that was cut short
        if day not in list_folder(spark, path):
            rename_folder(spark, os.path.join(fresh if day in list_folder(spark, fresh) else old, day), os.path.join(path, day))
    for leftover in (fresh, old):
        delete_folder(spark, leftover)
    limit = dt.datetime.fromisoformat(as_of) - dt.timedelta(seconds=ttl_seconds)
    boundary = limit.date().isoformat()
    for day in [d for d in list_folder(spark, path) if re.fullmatch(date_col + r"=\d{4}-\d\d-\d\d", d)]:
        name = day.split("=")[1]
        if name < boundary:
            delete_folder(spark, os.path.join(path, day))
            done["dropped"].append(name)
        elif name == boundary:
            rows = spark.read.parquet(os.path.join(path, day))
            expired = F.col(ts_col) <= F.lit(limit)
            if rows.filter(expired).isEmpty():
                continue
            writer = rows.filter(~expired).write.mode("overwrite")
            (writer.partitionBy("bucket") if "bucket" in rows.columns else writer).parquet(os.path.join(fresh, day))
            rename_folder(spark, os.path.join(path, day), os.path.join(old, day))
            rename_folder(spark, os.path.join(fresh, day), os.path.join(path, day))
            delete_folder(spark, old)
            done["rewritten"].append(name)
    delete_folder(spark, fresh)
    return done


def retention(records: DataFrame, as_of: str, ttl_seconds: int,
              ts_col: str = "status_ts") -> DataFrame:
    """Rows still alive at ``as_of``; ``ttl_seconds <= 0`` keeps everything."""
    if ttl_seconds <= 0:
        return records
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(secs=F.lit(ttl_seconds))
    return records.filter(F.col(ts_col) > limit)
