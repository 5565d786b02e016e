"""Admission rules over an ordered request table.

Every rule adds columns and never drops rows, so the composite job (C01)
keeps one row out per row in.  Order of the checks is part of the
semantics: a later counter only sees the survivors of the earlier checks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.functions import blank_to_null
from sluice.operators.ordering import add_time_buckets, minute_and_day_rank, nth_in_order, ts_literal

# Fixed values of the ingress service (defaults and response codes).
DEFAULT_USER = "unknown-user"
DEFAULT_CHANNEL = "default"
REASON_CONTENT = "content_required"
REASON_TOKEN_INVALID = "invalid_bearer_token"
REASON_TOKEN_REQUIRED = "bearer_token_required"
REASON_TENANT_MISSING = "tenant_missing"
REASON_RATE = "rate_limited"
REASON_QUOTA = "daily_quota_exceeded"
REASON_MAIN_BACKLOG = "stream_backpressure"
REASON_RETRY_BACKLOG = "retry_stream_backpressure"
REASON_DUPLICATE = "duplicate_idempotency_key"
REASON_PUBLISH = "redis_publish_failed"
REASON_OK = "ok"
# A check that could not be made (503), by the step it belongs to.
FAILED_CHECKS = {"quota": "quota_check_failed", "main_backlog": "backpressure_check_failed",
                 "retry_backlog": "retry_backpressure_check_failed", "claim": "idempotency_claim_failed"}

ORDER = ("arrival_ts", "message_id")


def normalise_request(df: DataFrame) -> DataFrame:
    """P02-P04 at ingress: user/channel defaults, correlation id, idempotency key.

    The correlation id is the header, else the body field, else
    ``corr-<epoch_s>-<message_id>`` (the message id stands in for the
    process counter so reruns agree); an empty string counts as missing.
    """
    generated = F.concat(F.lit("corr-"), F.unix_seconds(F.col("arrival_ts").cast("timestamp")).cast("string"),
                         F.lit("-"), F.col("message_id").cast("string"))
    # The ``Idempotency-Key`` header when given, else the body field.
    key = blank_to_null("idempotency_key")
    if "idempotency_header" in df.columns:
        key = F.coalesce(blank_to_null("idempotency_header"), key)
    return df.withColumns({
        "user_id": F.coalesce(F.col("user_field"), F.lit(DEFAULT_USER)),
        "channel": F.coalesce(F.col("channel_field"), F.lit(DEFAULT_CHANNEL)),
        "correlation_id": F.coalesce(blank_to_null("header_corr"), blank_to_null("body_corr"), generated),
        "idem_key": key,
    })


def content_required(df: DataFrame) -> DataFrame:
    """``content_ok`` is false when content is missing or empty."""
    return df.withColumn("content_ok", F.coalesce(F.length("content"), F.lit(0)) > 0)


def resolve_tenant(df: DataFrame, require_auth: bool = False,
                   token_status: str = "token_status", token_tenant: str = "token_tenant",
                   body_tenant: str = "tenant_id") -> DataFrame:
    """tenant from a valid token, else (auth optional) from the body.

    ``token_status`` is ``valid`` / ``invalid`` / null (no token).  Adds the
    resolved ``tenant_id`` and ``auth_reason`` (null when resolved).  A valid
    token's tenant wins over the body; the two are not compared here.
    """
    cols = set(df.columns)
    status = F.col(token_status) if token_status in cols else F.lit(None).cast("string")
    tok_tenant = F.col(token_tenant) if token_tenant in cols else F.lit(None).cast("string")
    valid = (status == "valid") & tok_tenant.isNotNull()
    reason = (F.when(valid, F.lit(None).cast("string"))
               .when(status == "invalid", F.lit(REASON_TOKEN_INVALID))
               .when(F.lit(require_auth), F.lit(REASON_TOKEN_REQUIRED))
               .when(F.col(body_tenant).isNotNull(), F.lit(None).cast("string"))
               .otherwise(F.lit(REASON_TENANT_MISSING)))
    tenant = F.when(valid, tok_tenant).when(reason.isNull(), F.col(body_tenant))
    return df.withColumn("auth_reason", reason).withColumn("tenant_id", tenant)


def rate_and_quota(df: DataFrame, limit_per_minute: int, daily_quota: int,
                   eligible: str = "eligible", keys: Sequence[str] = ("tenant_id",),
                   prior_minute: DataFrame | None = None, prior_day: DataFrame | None = None) -> DataFrame:
    """W01 + W02 in one pass.

    W01: in each (tenant, UTC minute) the first ``limit`` eligible rows pass
    (``rate_ok``); ``limit <= 0`` = off.  W02: the daily counter is bumped by
    every rate-passed row, so ``quota_count`` = rank among rate-passed rows of
    the (tenant, UTC day); ``quota_ok`` = ``quota_count <= quota``;
    ``quota <= 0`` = off.  ``prior_minute`` / ``prior_day`` carry the counts
    of earlier micro-batches (see :func:`minute_and_day_rank`).
    """
    df = add_time_buckets(df, "arrival_ts")
    df = minute_and_day_rank(df, keys, "arrival_ts", "message_id", eligible,
                             minute_cap=max(limit_per_minute, 0),
                             prior_minute=prior_minute, prior_day=prior_day)
    rate_ok = F.col(eligible) & (F.lit(limit_per_minute <= 0)
                                 | (F.col("rank_in_minute") <= limit_per_minute))
    quota_ok = F.col("rate_ok") & (F.lit(daily_quota <= 0) | (F.col("rank_in_day") <= daily_quota))
    return (df.withColumn("rate_ok", rate_ok)
              .withColumn("quota_ok", quota_ok)
              .withColumn("quota_count", F.when(F.col("rate_ok") & F.lit(daily_quota > 0),
                                                F.col("rank_in_day"))))


def quota_where_checked(df: DataFrame, daily_quota: int, checked: str, keys: Sequence[str] = ("tenant_id",)) -> DataFrame:
    """W02 where the counter cannot always be asked: only rate-passed rows with ``checked`` use it up.

    Replaces ``quota_ok`` and ``quota_count``; a row whose check failed has neither.  Give it a stored frame with
    ``rate_ok``: the rank reads its input twice.
    """
    asked = F.col("rate_ok") & F.coalesce(F.col(checked), F.lit(True))
    kept = df.drop("quota_ok", "quota_count", "rank_in_minute", "rank_in_day").withColumn("asked", asked)
    ranked = minute_and_day_rank(add_time_buckets(kept, "arrival_ts"), keys, "arrival_ts", "message_id", "asked")
    return (ranked.withColumn("quota_ok", F.col("asked") & (F.col("rank_in_day") <= daily_quota))
                  .withColumn("quota_count", F.when(F.col("asked"), F.col("rank_in_day")))
                  .drop("asked", "rank_in_minute"))


def first_claim(df: DataFrame, eligible: str = "eligible",
                keys: Sequence[str] = ("tenant_id", "idem_key")) -> DataFrame:
    """First eligible row per (tenant, key) by (ts, id) wins.

    Adds ``winner_id`` / ``winner_corr`` (the winner's message and
    correlation id) to every eligible keyed row.  Winners are found with
    ``row_number() = 1`` (a ``WindowGroupLimit`` that keeps one row per key
    per map task before the shuffle), then joined back; rows without a key
    join on a spread column so they never pile into the null-key partition.
    """
    keys = list(keys)
    keyed = F.col(eligible) & F.col(keys[-1]).isNotNull()
    winners = _winners(df, keyed, keys).drop("winner_ts").withColumn("spread", F.lit(0).cast("bigint"))
    return _join_on_key(df, winners, keys, keyed)


def _winners(df: DataFrame, keyed: Column, keys: list[str]) -> DataFrame:
    """First keyed row per key by (ts, id): its message and correlation id."""
    w = Window.partitionBy(*keys).orderBy(*ORDER)
    return (df.filter(keyed)
              .withColumn("rn", F.row_number().over(w)).filter(F.col("rn") == 1)
              .select(*keys, F.col("message_id").alias("winner_id"),
                      F.col("correlation_id").alias("winner_corr"), F.col("arrival_ts").alias("winner_ts")))


def _join_on_key(df: DataFrame, info: DataFrame, keys: list[str], keyed: Column) -> DataFrame:
    spread = F.when(keyed, F.lit(0)).otherwise(F.col("message_id")).cast("bigint")
    return df.withColumn("spread", spread).join(info, keys + ["spread"], "left").drop("spread")


def idempotency_claim(df: DataFrame, claims: DataFrame | None, eligible: str = "eligible",
                      keys: Sequence[str] = ("tenant_id", "idem_key"), publishes: str | None = None) -> DataFrame:
    """Insert-if-absent against existing claims plus first-wins in the batch.

    Adds ``claimed`` (this row takes the key), ``duplicate`` and
    ``canonical_id``: a duplicate gets the id already on file (a prior
    claim's id, else the in-batch winner's correlation id), or its own id
    when that is blank.  Existing claims beat in-batch ones.  Rows without a
    key are never deduplicated (``claimed`` null, ``duplicate`` false).

    ``publishes`` names a flag: a request that takes its key but fails to
    publish releases it again (``publish_failed``), so the first row that
    publishes wins; later rows of the key are duplicates whether they could
    publish or not.
    """
    keys = list(keys)
    keyed = F.col(eligible) & F.col(keys[-1]).isNotNull()
    can = F.coalesce(F.col(publishes), F.lit(True)) if publishes else F.lit(True)
    if publishes:  # a row for every key in the batch, without a winner where none of its rows publishes
        first = F.min(F.when(can, F.struct("arrival_ts", "message_id", "correlation_id"))).alias("w")
        winners = df.filter(keyed).groupBy(*keys).agg(first).select(
            *keys, F.col("w.message_id").alias("winner_id"), F.col("w.correlation_id").alias("winner_corr"), F.col("w.arrival_ts").alias("winner_ts"))
    else:
        winners = _winners(df, keyed, keys)
    if claims is not None:
        prior = claims.select(F.col("tenant_id").alias(keys[0]),
                              F.col("idempotency_key").alias(keys[1]),
                              F.col("notification_id").alias("prior_id"),
                              F.lit(True).alias("has_prior"))
        info = winners.join(prior, keys, "left")  # a key that nothing in the batch uses is not needed
    else:
        info = winners.withColumns({"prior_id": F.lit(None).cast("string"),
                                    "has_prior": F.lit(None).cast("boolean")})
    info = info.withColumn("spread", F.lit(0).cast("bigint"))
    out = _join_on_key(df, info, keys, keyed)
    has_prior = F.coalesce(F.col("has_prior"), F.lit(False))
    claimed = F.when(keyed, ~has_prior & F.coalesce(F.col("message_id") == F.col("winner_id"), F.lit(False)))
    before = F.col("winner_id").isNull() | (F.struct(*ORDER) < F.struct("winner_ts", "winner_id"))
    failed = F.col(eligible) & ~can & (~keyed | (~has_prior & before))
    stored = F.when(has_prior, F.col("prior_id")).otherwise(F.col("winner_corr"))
    canonical = F.when(failed, F.lit(None).cast("string")).when(claimed, F.col("correlation_id")).when(
        keyed, F.coalesce(blank_to_null(stored), F.col("correlation_id")))
    return (out.withColumn("claimed", claimed)
               .withColumn("publish_failed", failed)
               .withColumn("duplicate", F.coalesce(~F.col("claimed"), F.lit(False)) & ~F.col("publish_failed"))
               .withColumn("canonical_id", canonical)
               .drop("prior_id", "has_prior", "winner_ts"))


def backlog_gate(df: DataFrame, survivor: str, publishable: str,
                 main_limit: int, retry_limit: int = 0,
                 retry_entries: DataFrame | None = None,
                 main_start_len: int = 0, retry_start_len: int = 0) -> DataFrame:
    """Refuse ingress once a stream's length reaches its limit.

    Stream lengths never fall, so "closed" is a suffix of arrival order and
    one cut decides.  Main cut = the N-th publishable row (N = limit -
    starting length): it still passes, every later survivor is refused.
    Retry cut = time of the R-th retry entry: survivors strictly later are
    refused.  The earlier cut names the reason (main is checked first; once
    retry closes nothing publishes, so main never fills).  Limit <= 0 = off;
    N or R <= 0 with the limit on = closed from the first row.

    Adds ``gate_reason`` (null = passes).  Each cut is found by small jobs
    that return one row (:func:`nth_in_order`); the per-row test is then a
    comparison with literals.
    """
    ts, tid = F.col("arrival_ts"), F.col("message_id")
    main_on, retry_on = main_limit > 0, retry_limit > 0
    n_main, n_retry = main_limit - main_start_len, retry_limit - retry_start_len

    main_cut = (nth_in_order(df.filter(F.col(publishable)), n_main, "arrival_ts", "message_id")
                if main_on and n_main > 0 else None)
    if main_cut is not None:
        cut_ts, cut_id = ts_literal(main_cut[0]), F.lit(main_cut[1])
        after_main = (ts > cut_ts) | ((ts == cut_ts) & (tid > cut_id))
    else:
        after_main = F.lit(main_on and n_main <= 0)

    retry_cut = None
    if retry_on and n_retry > 0:
        if retry_entries is None:
            raise ValueError("retry_limit needs retry_entries")
        retry_cut = nth_in_order(retry_entries, n_retry, "entry_ts", "message_id")
    if retry_cut is not None:
        after_retry = ts > ts_literal(retry_cut[0])
    else:
        after_retry = F.lit(retry_on and n_retry <= 0)

    # Is the main cut real?  Only if its row itself got past the retry gate.
    if main_on and n_main <= 0:
        main_valid = True
    elif main_cut is None:
        main_valid = False
    elif not retry_on:
        main_valid = True
    elif n_retry <= 0:
        main_valid = False
    elif retry_cut is None:
        main_valid = True
    else:
        main_valid = main_cut[0] <= retry_cut[0]

    reason = (F.when(~F.col(survivor), F.lit(None).cast("string"))
               .when(F.lit(main_valid) & after_main, F.lit(REASON_MAIN_BACKLOG))
               .when(after_retry, F.lit(REASON_RETRY_BACKLOG)))
    return df.withColumn("gate_reason", reason)
