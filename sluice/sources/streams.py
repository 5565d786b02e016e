"""Stream sources and sinks (S01, S02, S04, S07) and the audit file.

Streams are append-only folders of Parquet (or a Kafka topic in
production); a consumer group is a Structured Streaming checkpoint.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sluice.session import list_folder


def union_streams(main: DataFrame, retry: DataFrame, stream_col: str = "source_stream") -> DataFrame:
    """Main and retry entries as one input, each row tagged with its stream."""
    return (main.withColumn(stream_col, F.lit("main"))
                .unionByName(retry.withColumn(stream_col, F.lit("retry")), allowMissingColumns=True))


def stream_read(spark: SparkSession, path: str, schema: StructType, max_files_per_trigger: int = 10,
                fmt: str = "parquet", options: dict | None = None) -> DataFrame:
    """Read an append-only stream as typed rows.

    Without a checkpoint a Kafka consumer starts at the current end
    (``latest``) and a folder of files at its oldest file; with a checkpoint
    either resumes after the last committed batch.
    ``max_files_per_trigger`` (``maxOffsetsPerTrigger`` for Kafka) caps a
    micro-batch the way the dispatcher caps a read at 10 entries.
    """
    if fmt == "kafka":
        # The Kafka source has a fixed schema: records are JSON in ``value``,
        # ``path`` is the topic.  Needs the Kafka connector on the classpath.
        reader = (spark.readStream.format("kafka").option("subscribe", path)
                  .option("startingOffsets", "latest").option("maxOffsetsPerTrigger", max_files_per_trigger))
        for k, v in (options or {}).items():
            reader = reader.option(k, v)
        raw = reader.load()
        return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")
    reader = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", max_files_per_trigger)
    for k, v in (options or {}).items():
        reader = reader.option(k, v)
    return reader.load(path)


def stream_append(df: DataFrame, path: str, checkpoint: str | None = None, trigger: dict | None = None):
    """Append rows to a named stream (batch write or streaming query)."""
    if df.isStreaming:
        w = df.writeStream.format("parquet").outputMode("append").option("path", path)
        if checkpoint:
            w = w.option("checkpointLocation", checkpoint)
        return w.trigger(**(trigger or {"availableNow": True})).start()
    df.write.mode("append").parquet(path)
    return None


def start_at_latest(stream: DataFrame, checkpoint: str) -> bool:
    """Have a query that is new begin after what the folder holds now; returns whether it was new.

    The files present are recorded in the new checkpoint as taken, without
    being read; a query that has a checkpoint resumes after its last batch
    and is left alone.  For queries with a ``foreachBatch`` sink on this stream.
    """
    if list_folder(stream.sparkSession, os.path.join(checkpoint, "offsets")):
        return False
    (stream.writeStream.foreachBatch(lambda batch, batch_id: None).option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start().awaitTermination())
    return True
