"""The claim table of T02/J04: bucketed by hash of (tenant, key), compacted.

``path/bucket=<b>/batch_id=<k>`` holds the claims that batch k made in bucket
b; ``path/bucket=<b>/upto=<k>`` replaces all of the bucket's folders up to k.
A batch reads only the buckets that its own keys fall in.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import delete_folder, list_folder, rename_folder

CLAIM_SCHEMA = "tenant_id string, idempotency_key string, notification_id string, created_ts timestamp_ntz"
BUCKETS = 64
COMPACT_EVERY = 16


def bucket_of(key: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64("tenant_id", key), F.lit(buckets)).cast("int")


def dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """A bucket's rows in one task, so that it is one file; the buckets in as many tasks as there are cores."""
    return rows.repartition(min(buckets, rows.sparkSession.sparkContext.defaultParallelism), "bucket")


def seed(claims: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write the claims on file as what came before the first batch; the whole table appears by one rename."""
    spark = claims.sparkSession
    if list_folder(spark, path):
        return
    rows = claims.select("tenant_id", "idempotency_key", "notification_id", "created_ts").withColumns(
        {"bucket": bucket_of("idempotency_key", buckets), "batch_id": F.lit(-1)})
    dealt(rows, buckets).write.mode("overwrite").partitionBy("bucket", "batch_id").parquet(f"{path}-seed")
    rename_folder(spark, f"{path}-seed", path)


def folders(spark: SparkSession, path: str, wanted: list[int], before: int) -> list[str]:
    """The folders of some buckets that hold the claims of all batches before ``before``."""
    out = []
    for b in wanted:
        base = os.path.join(path, f"bucket={b}")
        names = list_folder(spark, base)
        upto = max((int(n[5:]) for n in names if n.startswith("upto=") and int(n[5:]) < before), default=None)
        out += [os.path.join(base, f"upto={upto}")] if upto is not None else []
        out += [os.path.join(base, n) for n in names if n.startswith("batch_id=") and (upto is None or int(n[9:]) > upto) and int(n[9:]) < before]
    return out


def held(spark: SparkSession, path: str, wanted: list[int], before: int) -> DataFrame:
    found = folders(spark, path, wanted, before)
    return spark.read.schema(CLAIM_SCHEMA).parquet(*found) if found else spark.createDataFrame([], CLAIM_SCHEMA)


def add(claims: DataFrame, path: str, batch_id: int, buckets: int = BUCKETS) -> None:
    """The claims of one batch; a batch that runs again replaces its own folders."""
    rows = claims.withColumns({"bucket": bucket_of("idempotency_key", buckets), "batch_id": F.lit(batch_id)})
    (dealt(rows, buckets).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch_id").parquet(path))


def compact(spark: SparkSession, path: str, before: int, buckets: int = BUCKETS) -> None:
    """Fold every bucket's folders of batches before ``before`` into one, all in one job; folders go only after their successor is in place."""
    old = {b: found for b in range(buckets) if len(found := folders(spark, path, [b], before)) > 1}
    if not old:
        return
    fold = os.path.join(path, "_fold")
    rows = spark.read.schema(CLAIM_SCHEMA).parquet(*[f for found in old.values() for f in found])
    dealt(rows.withColumn("bucket", bucket_of("idempotency_key", buckets)), buckets).write.mode("overwrite").partitionBy("bucket").parquet(fold)
    for b, found in old.items():
        upto = max(int(f.rsplit("=", 1)[1]) for f in found)
        if rename_folder(spark, os.path.join(fold, f"bucket={b}"), os.path.join(path, f"bucket={b}", f"upto={upto}")):
            for f in found:
                delete_folder(spark, f)
