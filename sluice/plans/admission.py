"""Full admission decision per request, one row out per row in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.operators import admission as adm
from sluice.session import materialize

DECISION_COLUMNS = ["message_id", "tenant_id", "correlation_id", "decision", "reason",
                    "http_status", "quota_count", "canonical_id"]
# What the steps after a materialization read.  The request payload and the
# raw header/body fields are not stored twice (at scale they are most of the bytes).
CARRIED = ["message_id", "arrival_ts", "tenant_id", "correlation_id", "idem_key", "content_ok", "auth_reason",
           "eligible", "publish_ok", "rate_ok", "quota_ok", "quota_count", "rank_in_minute", "rank_in_day"]


def _carry(df: DataFrame, keep_columns: bool, extra: tuple = ()) -> DataFrame:
    if keep_columns:
        return df.drop("bucket_sec", "bucket_min", "bucket_day")
    return df.select(*[c for c in df.columns if c in CARRIED or c in extra])


def admission_decisions(requests: DataFrame, claims: DataFrame | None = None,
                        retry_entries: DataFrame | None = None,
                        limit_per_minute: int = 0, daily_quota: int = 0,
                        main_backlog: int = 0, retry_backlog: int = 0,
                        require_auth: bool = False,
                        main_start_len: int = 0, retry_start_len: int = 0,
                        keep_columns: bool = False, publish: str | None = None,
                        checks: dict[str, str] | None = None) -> DataFrame:
    """Decide every request: F01 -> F02 -> W01 -> W02 -> W07 main -> W07 retry -> W03/J04 -> publish.

    ``publish`` names a column that says whether the publish itself works;
    a failed one is a 503, releases its claim and does not lengthen the stream.

    ``checks`` names columns that say whether a check could be made: ``quota``, ``main_backlog``, ``retry_backlog``, ``claim``.
    A row that gets as far as a check that fails is a 503 there: it uses up no quota count (where that check is the quota's), lengthens no
    stream and claims no key; the checks before it count as ever.  A check that is off, or a claim without a key, is not made.

    Output: ``decision`` (accepted / duplicate / rejected), ``reason``,
    ``http_status``, ``quota_count`` (rank in the tenant's day when the quota
    is on and the row reached it), ``canonical_id`` (own id when accepted,
    the id on file when a duplicate).
    """
    checks = checks or {}
    made = lambda step, on: F.coalesce(F.col(checks[step]), F.lit(True)) if step in checks and on else F.lit(True)
    flags = tuple(checks.values())
    df = adm.normalise_request(requests)
    df = adm.content_required(df)
    df = adm.resolve_tenant(df, require_auth)
    df = df.withColumn("eligible", F.col("content_ok") & F.col("auth_reason").isNull())
    if limit_per_minute > 0 or daily_quota > 0:
        # The rank reads its input twice (rows, and per-second counts): give
        # it the narrow request table, so the payload is read from the source
        # only once.
        df = materialize(_carry(df, keep_columns, flags), "admission-requests")
        if daily_quota > 0 and "quota" in checks:
            df = materialize(_carry(adm.rate_and_quota(df, limit_per_minute, 0, eligible="eligible"), keep_columns, flags), "admission-rated")
            df = adm.quota_where_checked(df, daily_quota, checks["quota"])
        else:
            df = adm.rate_and_quota(df, limit_per_minute, daily_quota, eligible="eligible")
        # The claim step reads the ranked rows twice (rows and per-key
        # winners): rank once and store the result in the shared folder.
        df = materialize(_carry(df, keep_columns, flags), "admission-ranked")
    else:
        df = df.withColumns({"rate_ok": F.col("eligible"), "quota_ok": F.col("eligible"),
                             "quota_count": F.lit(None).cast("bigint")})
    df = df.withColumn("survivor", F.col("quota_ok"))
    unmade = (F.when(F.col("rate_ok") & ~made("quota", daily_quota > 0), F.lit("quota"))
               .when(~F.col("survivor"), F.lit(None).cast("string"))
               .when(~made("main_backlog", main_backlog > 0), F.lit("main_backlog"))
               .when(~made("retry_backlog", retry_backlog > 0), F.lit("retry_backlog"))
               .when(F.col("idem_key").isNotNull() & ~made("claim", True), F.lit("claim")))
    df = df.withColumn("unmade", unmade).withColumn("reaches", F.col("survivor") & F.col("unmade").isNull())
    df = adm.idempotency_claim(df, claims, eligible="reaches", publishes=publish)
    df = df.withColumn("publishable", F.col("reaches") & ~F.col("publish_failed") & (F.col("idem_key").isNull() | F.col("claimed")))
    if main_backlog > 0 or retry_backlog > 0:
        # The cut is global over arrival order: compute the per-row verdicts
        # once, store them in the shared folder, and cut the stored table.
        df = materialize(_carry(df, keep_columns, ("survivor", "unmade", "claimed", "duplicate", "canonical_id",
                                                   "winner_id", "winner_corr", "publishable", "publish_failed")),
                         "admission-claimed")
    df = adm.backlog_gate(df, "survivor", "publishable", main_backlog, retry_backlog,
                          retry_entries, main_start_len, retry_start_len)
    failed = lambda step: F.coalesce(F.col("unmade") == step, F.lit(False))
    reason = (F.when(~F.col("content_ok"), F.lit(adm.REASON_CONTENT))
               .when(F.col("auth_reason").isNotNull(), F.col("auth_reason"))
               .when(~F.col("rate_ok"), F.lit(adm.REASON_RATE))
               .when(failed("quota"), F.lit(adm.FAILED_CHECKS["quota"]))
               .when(~F.col("quota_ok"), F.lit(adm.REASON_QUOTA))
               .when(failed("main_backlog"), F.lit(adm.FAILED_CHECKS["main_backlog"]))
               .when(F.col("gate_reason") == adm.REASON_MAIN_BACKLOG, F.col("gate_reason"))
               .when(failed("retry_backlog"), F.lit(adm.FAILED_CHECKS["retry_backlog"]))
               .when(F.col("gate_reason").isNotNull(), F.col("gate_reason"))
               .when(failed("claim"), F.lit(adm.FAILED_CHECKS["claim"]))
               .when(F.col("publish_failed"), F.lit(adm.REASON_PUBLISH))
               .when(F.col("duplicate"), F.lit(adm.REASON_DUPLICATE))
               .otherwise(F.lit(adm.REASON_OK)))
    df = df.withColumn("reason", reason)
    decision = (F.when(F.col("reason") == adm.REASON_OK, F.lit("accepted"))
                 .when(F.col("reason") == adm.REASON_DUPLICATE, F.lit("duplicate"))
                 .otherwise(F.lit("rejected")))
    status = (F.when(F.col("reason").isin(adm.REASON_OK, adm.REASON_DUPLICATE), F.lit(202))
               .when(F.col("reason") == adm.REASON_CONTENT, F.lit(400))
               .when(F.col("reason").isin(adm.REASON_PUBLISH, *adm.FAILED_CHECKS.values()), F.lit(503))
               .when(F.col("auth_reason").isNotNull(), F.lit(401))
               .otherwise(F.lit(429)))
    df = df.withColumns({
        "decision": decision,
        "http_status": status,
        "canonical_id": F.when(F.col("reason") == adm.REASON_OK, F.col("correlation_id"))
                         .when(F.col("reason") == adm.REASON_DUPLICATE, F.col("canonical_id")),
    })
    return df if keep_columns else df.select(*DECISION_COLUMNS)
