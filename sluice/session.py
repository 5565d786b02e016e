"""Session construction and cluster-shared locations."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on.  UTC makes minute/day buckets epoch aligned
# (the reference buckets by t/60 and t/86400); LAST_WIN gives "last value
# wins" for duplicated map keys (P05); AQE re-plans joins at run time and
# splits skewed partitions (hot tenant / hot idempotency key).
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str = "local[8]", shuffle_partitions: int = 8,
                app_name: str = "sluice", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(SESSION_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    apply_runtime_conf(spark)
    return spark


RUNTIME_KEYS = ("spark.sql.session.timeZone", "spark.sql.mapKeyDedupPolicy",
                "spark.sql.streaming.stateStore.providerClass", "spark.sql.adaptive.enabled",
                "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.adaptive.skewJoin.enabled")


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the SQL confs the operators need on a session built elsewhere.

    Time zone (epoch-aligned buckets), map-key policy (P05), the RocksDB
    state store (``transformWithState`` needs it) and AQE.
    """
    for k in RUNTIME_KEYS:
        spark.conf.set(k, SESSION_CONF[k])


@contextmanager
def setting(spark: SparkSession, key: str, value):
    """A runtime setting that holds inside the block."""
    said = spark.conf.get(key)
    spark.conf.set(key, str(value))
    try:
        yield
    finally:
        spark.conf.set(key, said)


def checkpoint_dir(spark: SparkSession, sub: str = "") -> str:
    """Shared folder for checkpoints and intermediate tables.

    ``spark.checkpoint.dir`` names a folder every executor can reach.  Where
    it is unset a fresh temp folder is taken on a local master only (tests);
    on any other master that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="sluice-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(base, sub) if sub else base


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it back.

    Used where a later step needs a global answer (a cut) over an earlier
    result: the earlier result is computed once, survives executor loss,
    and the re-read gets column pruning and filter pushdown.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark, "tables"), f"{name}-{uuid.uuid4().hex}")
    df.write.mode("overwrite").parquet(path)
    delete_on_exit(spark, path)
    return spark.read.parquet(path)


def delete_on_exit(spark: SparkSession, path: str) -> None:
    """Have the file system remove an intermediate folder when the application ends."""
    p, fs = _path(spark, path)
    fs.deleteOnExit(p)


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it does not exist."""
    p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete_folder(spark: SparkSession, path: str) -> None:
    p, fs = _path(spark, path)
    fs.delete(p, True)


def rename_folder(spark: SparkSession, old: str, new: str) -> bool:
    """Move a folder to a new name (parents are made); False where it does not exist."""
    p, fs = _path(spark, old)
    q, _ = _path(spark, new)
    if not fs.exists(p):
        return False
    fs.mkdirs(q.getParent())
    if not fs.rename(p, q):
        raise OSError(f"{old} could not be renamed")
    return True


def write_file(spark: SparkSession, path: str) -> None:
    """An empty plain file."""
    p, fs = _path(spark, path)
    fs.create(p).close()


def data_files(spark: SparkSession, path: str) -> list[str]:
    """Paths of the data files anywhere below a folder."""
    p, fs = _path(spark, path)
    out, found = [], fs.listFiles(p, True)
    while found.hasNext():
        f = found.next().getPath()
        if not f.getName().startswith(("_", ".")):
            out.append(f.toString())
    return sorted(out)


def set_modified(spark: SparkSession, path: str, millis: int) -> None:
    """Give every data file below a folder a time of change (file streams take the oldest first)."""
    for f in data_files(spark, path):
        p, fs = _path(spark, f)
        fs.setTimes(p, millis, -1)
