"""Feeding a table to a stream slice by slice, and running a query to the end.

A view is written once, by many tasks, into a folder per slice under the
shared checkpoint folder.  A slice then enters the stream's input folder by
one rename, and the query runs from its checkpoint until it has taken
everything; so every slice also resumes the query from its checkpoint.  There
are at most ``MAX_SLICES``, however many rows: beyond that slices grow, and
``maxFilesPerTrigger`` cuts them into batches.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sluice.session import checkpoint_dir, rename_folder, set_modified
from sluice.sources.streams import stream_read

ROWS_PER_SLICE = 25_000
MIN_SLICES = 4
MAX_SLICES = 32


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder."""
    return checkpoint_dir(spark, os.path.join("streams", f"{name}-{uuid.uuid4().hex[:12]}"))


def stage_slices(df: DataFrame, ts_col: str, out_dir: str, order: str = "time",
                 rows_per_slice: int = ROWS_PER_SLICE, files_per_slice: int = 8) -> int:
    """Write ``df`` as ``out_dir/slice=k``, about ``rows_per_slice`` rows each; returns how many.

    ``order="time"``: consecutive time ranges.  ``order="mixed"``: every
    slice holds rows of all times (late and early ones).
    """
    t = F.unix_micros(F.col(ts_col).cast("timestamp"))
    size = df.agg(F.count(F.lit(1)).alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")).first()
    if not size["n"]:
        return 0
    n = min(MAX_SLICES, max(MIN_SLICES, -(-size["n"] // rows_per_slice)))
    if order == "time":
        k = F.floor((t - F.lit(size["lo"])) / F.lit((size["hi"] - size["lo"] + 1) / n))
    else:
        k = F.pmod(F.xxhash64(t), F.lit(n))
    sliced = df.withColumn("slice", F.least(k, F.lit(n - 1)).cast("int"))
    (sliced.repartition("slice", F.pmod(F.xxhash64(t), F.lit(files_per_slice)))
           .write.partitionBy("slice").parquet(out_dir))
    return n


def run_slices(spark: SparkSession, name: str, df: DataFrame, ts_col: str,
               start: Callable[[DataFrame, str], StreamingQuery], order: str = "time") -> str:
    """Feed ``df`` to the query that ``start(stream, base)`` starts, slice by slice; returns ``base``."""
    base = scratch(spark, name)
    staged, inp = os.path.join(base, "staged"), os.path.join(base, "in")
    for k in range(stage_slices(df, ts_col, staged, order)):
        if rename_folder(spark, os.path.join(staged, f"slice={k}"), os.path.join(inp, f"part={k:06d}")):
            wait(start(read_files_stream(spark, inp, df.schema), base))
    return base


def run_backlog(spark: SparkSession, name: str, df: DataFrame, ts_col: str,
                start: Callable[[DataFrame, str], StreamingQuery]) -> str:
    """All slices wait in the stream, one file each, oldest first; the query takes them one per batch.  Returns ``base``."""
    base = scratch(spark, name)
    staged, inp = os.path.join(base, "staged"), os.path.join(base, "in")
    n, now = stage_slices(df, ts_col, staged, files_per_slice=1), int(time.time() * 1000)
    for k in range(n):
        folder = os.path.join(inp, f"part={k:06d}")
        if rename_folder(spark, os.path.join(staged, f"slice={k}"), folder):
            set_modified(spark, folder, now - 1000 * (n - k))
    wait(start(read_files_stream(spark, inp, df.schema, 1), base))
    return base


def read_files_stream(spark: SparkSession, in_dir: str, schema, max_files: int = 1000) -> DataFrame:
    """S01 over the files below ``in_dir``, oldest first."""
    return stream_read(spark, in_dir, schema, max_files, options={"recursiveFileLookup": "true"})


def run_to_end(writer, timeout_s: float | None = None) -> StreamingQuery:
    """Start a ``DataStreamWriter`` with ``availableNow`` and wait for it to finish."""
    return wait(writer.trigger(availableNow=True).start(), timeout_s)


def wait(q: StreamingQuery, timeout_s: float | None = None) -> StreamingQuery:
    """Wait for a started query to finish; a failure is raised, and so is running out of time."""
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError(f"the query had not taken all its input after {timeout_s} s")
    if q.exception() is not None:
        raise q.exception()
    return q
