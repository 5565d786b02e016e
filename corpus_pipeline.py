"""The training-corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  A stage's result is written as
Parquet and read again, so a lost executor repeats at most one stage.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.llm import decontaminate, line_dedup, minhash, packing, toxicity
from sluice.llm.common import read, stored
from sluice.registry import register


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the learned lexicon does not reject."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat an earlier one; documents with nothing left go."""
    return line_dedup.dedup(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.dedup(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of token ids."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents),
          ("decontaminate", drop_contaminated), ("packing", pack)]

ORACLE_SQL = None  # the learned lexicon and the tokenizer are beyond SQL


@register("pipeline")
def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the last one's rows."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
