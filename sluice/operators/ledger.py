"""Stream-ledger joins: release, pending, reconcile, replay, lineage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators.state import dlq_newest

CLAIM_KEYS = ("tenant_id", "idempotency_key", "notification_id")


def idempotency_release(claims: DataFrame, releases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove a claim only when tenant, key *and* id all match.

    Returns ``(remaining_claims, release_results)``; each release request
    gets ``released`` = whether it matched a claim.
    """
    keys = list(CLAIM_KEYS)
    remaining = claims.join(releases.select(*keys).distinct(), keys, "left_anti")
    hit = claims.select(*keys).distinct().withColumn("released", F.lit(True))
    results = (releases.join(hit, keys, "left")
                       .withColumn("released", F.coalesce(F.col("released"), F.lit(False))))
    return remaining, results


def pending_entries(reads: DataFrame, acks: DataFrame,
                    keys: Sequence[str] = ("source_stream", "message_id")) -> DataFrame:
    """Entries read but never acknowledged."""
    return reads.join(acks.select(*keys), list(keys), "left_anti")


def stream_state_reconcile(stream: DataFrame, persisted: DataFrame,
                           keys: Sequence[str] = ("tenant_id", "message_id")) -> DataFrame:
    """Compare stream entries with persisted state.

    ``ok`` / ``missing_state`` (entry, no state) / ``orphan_state`` (state,
    no entry) / ``content_mismatch``.
    """
    digest = F.sha2(F.col("content"), 256)  # contents stay where they are; 256 bits go through the shuffle
    s = stream.select(*keys, digest.alias("stream_digest"), F.lit(True).alias("in_stream"))
    p = persisted.select(*keys, digest.alias("state_digest"), F.lit(True).alias("in_state"))
    j = s.join(p, list(keys), "full")
    verdict = (F.when(F.col("in_state").isNull(), F.lit("missing_state"))
                .when(F.col("in_stream").isNull(), F.lit("orphan_state"))
                .when(~F.col("stream_digest").eqNullSafe(F.col("state_digest")), F.lit("content_mismatch"))
                .otherwise(F.lit("ok")))
    return j.withColumn("verdict", verdict).drop("in_stream", "in_state")


def dlq_replay(dead_letters: DataFrame, n: int = 50, delete_after: bool = False
               ) -> tuple[DataFrame, DataFrame]:
    """Newest ``n`` dead letters back to the retry stream, fields kept.

    ``retry_count`` is kept as it was (a replayed row that fails again goes
    straight back to the dead letters).  Returns ``(replayed, remaining)``;
    ``remaining`` drops the replayed ids only when ``delete_after``.
    """
    picked = dlq_newest(dead_letters, n)
    replayed = (picked.withColumn("replayed_from", F.col("message_id"))
                      .withColumn("source_stream", F.lit("retry")))
    if not delete_after:
        return replayed, dead_letters
    remaining = dead_letters.join(picked.select("message_id"), "message_id", "left_anti")
    return replayed, remaining


def retry_lineage(entries: DataFrame, link: str = "previous_stream_id") -> DataFrame:
    """Each entry joined to the entry it came from; ``parent_missing`` where that is not in the table."""
    parent = entries.select(F.col("message_id").alias(link),
                            F.col("arrival_ts").alias("parent_ts"),
                            F.col("retry_count").alias("parent_retry_count"),
                            F.col("source_stream").alias("parent_stream"))
    return (entries.filter(F.col(link).isNotNull()).join(parent, link, "left")
                   .withColumn("parent_missing", F.col("parent_ts").isNull()))
