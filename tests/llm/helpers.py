"""Rows with awkward cases, and plain versions of what the operators compute."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG_TEXT = " ".join(f"w{i % 997}x{i}" for i in range(60_000))


def docs_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(doc_id, text) or (doc_id, text, lang) rows as documents."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS)


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingle_set(text: str | None, k: int = 5) -> set[tuple[str, ...]]:
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def clashing(df: DataFrame) -> DataFrame:
    """Columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    for name in ("shard", "score", "key", "band", "rep", "first", "_gone", "_text", "h1", "component", "digest", "item_id", "rank", "chunk", "_s", "row", "judged", "t", "tree", "word"):
        df = df.withColumn(name, F.lit("mine"))
    return df
