"""Validation over tables of tokens, records, session frames and requests.

(F03 token audit, F04 tenant scope, F05 required fields, F06 subscription
frames, F09 request routing.)  All checks are built-in column expressions;
HMAC-SHA256 is two nested ``sha2`` calls over key blocks prepared once on
the driver from the secret (a parameter, not data).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.functions import b64url_decode, clamp, int_or, query_param
from sluice.operators.state import HISTORY_LIMIT_DEFAULT, HISTORY_LIMIT_MAX, HISTORY_LIMIT_MIN, newest_per_key

# Fixed values of the token rules (texts of the refusals, in rule order).
ERR_FORMAT = "invalid JWT format"
ERR_ALG = "unsupported JWT alg"
ERR_SIGNATURE = "invalid JWT signature"
ERR_PAYLOAD = "invalid JWT payload"
ERR_NO_EXP = "missing exp claim"
ERR_EXPIRED = "token expired"
ERR_NOT_YET = "token not yet valid"
ERR_FUTURE_IAT = "token issued in the future"
ERR_NO_TENANT = "tenant claim missing in JWT"
BEARER = "Bearer "
DEFAULT_SKEW_SECONDS = 60
HMAC_BLOCK = 64

CLAIM_FIELDS = ("exp", "nbf", "iat", "tenant_id", "tid")


def hmac_sha256(secret: str, message: Column) -> Column:
    """HMAC-SHA256 of a string column (RFC 2104) as binary."""
    key = secret.encode("utf-8")
    if len(key) > HMAC_BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(HMAC_BLOCK, b"\0")
    ipad = bytearray(b ^ 0x36 for b in key)
    opad = bytearray(b ^ 0x5C for b in key)
    inner = F.unhex(F.sha2(F.concat(F.lit(ipad), F.encode(message, "UTF-8")), 256))
    return F.unhex(F.sha2(F.concat(F.lit(opad), inner), 256))


def b64url_encode(b: Column) -> Column:
    """Binary -> unpadded base64url text."""
    s = F.base64(b)
    for old, new in (("\r", ""), ("\n", ""), ("=", ""), ("+", "-"), ("/", "_")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return s


def _segment_ok(seg: Column) -> Column:
    return seg.rlike(r"^[A-Za-z0-9_\-\s]*=*$")


def _decode(seg: Column) -> Column:
    clean = F.regexp_replace(F.regexp_replace(seg, r"\s", ""), "=+$", "")
    return F.when(_segment_ok(seg), b64url_decode(clean))


def token_audit(df: DataFrame, secret: str, skew_seconds: int = DEFAULT_SKEW_SECONDS,
                now="checked_at_s", auth_col: str = "authorization") -> DataFrame:
    """verdict of every bearer token; the first failing rule wins.

    Adds ``token_status`` (``valid`` / ``invalid`` / null = no token),
    ``token_error`` and ``token_tenant`` (``tenant_id`` claim, else ``tid``).
    Rules: format -> alg HS256 -> signature -> payload -> exp present ->
    not expired (``now > exp + skew``) -> nbf -> iat -> tenant claim.  An
    empty secret makes every signature invalid.  ``now`` is an epoch-second
    column name or int.
    """
    now_c = F.col(now) if isinstance(now, str) else F.lit(int(now))
    auth = F.col(auth_col)
    # Each step names its result and the next step reads only those names,
    # with few references each, so a filter on the verdict that Catalyst
    # pushes down (inlining the definitions) stays small.
    df = df.withColumn("_tok", F.when(auth.startswith(BEARER), F.expr(f"substr({auth_col}, {len(BEARER) + 1})")))
    # Split at the first two dots; the signature is everything after the second.
    df = df.withColumn("_parts", F.split(F.col("_tok"), r"\.", 3))
    parts = F.col("_parts")
    df = df.withColumns({
        "_h": F.get(parts, 0),
        "_p": F.get(parts, 1),
        "_s": F.get(parts, 2),
    })
    df = df.withColumn("_bad_format", F.coalesce(F.length("_h"), F.lit(0)) * F.coalesce(F.length("_p"), F.lit(0))
                       * F.coalesce(F.length("_s"), F.lit(0)) == 0)
    alg = F.get_json_object(F.decode(_decode(F.col("_h")), "UTF-8"), "$.alg")
    df = df.withColumns({"_alg_ok": F.coalesce(alg == "HS256", F.lit(False)),
                         "_payload": _decode(F.col("_p"))})
    if secret:
        expected = hmac_sha256(secret, F.concat(F.col("_h"), F.lit("."), F.col("_p")))
        df = df.withColumn("_sig_ok", F.coalesce(_decode(F.col("_s")) == expected, F.lit(False)))
    else:
        df = df.withColumn("_sig_ok", F.lit(False))
    # One parse of the claims for all five top-level fields (values as text).
    df = df.select("*", F.json_tuple(F.decode(F.col("_payload"), "UTF-8"), *CLAIM_FIELDS)
                   .alias(*[f"_c_{c}" for c in CLAIM_FIELDS]))
    df = df.withColumns({f"_{name}": int_or(F.col(f"_c_{name}"), None) for name in ("exp", "nbf", "iat")}
                        | {"_tenant": F.coalesce(F.col("_c_tenant_id"), F.col("_c_tid"))})
    exp, nbf, iat = F.col("_exp"), F.col("_nbf"), F.col("_iat")
    error = (F.when(F.col("_tok").isNull(), F.lit(None).cast("string"))
              .when(F.col("_bad_format"), F.lit(ERR_FORMAT))
              .when(~F.col("_alg_ok"), F.lit(ERR_ALG))
              .when(~F.col("_sig_ok"), F.lit(ERR_SIGNATURE))
              .when(F.col("_payload").isNull(), F.lit(ERR_PAYLOAD))
              .when(exp.isNull(), F.lit(ERR_NO_EXP))
              .when(now_c > exp + skew_seconds, F.lit(ERR_EXPIRED))
              .when(now_c + skew_seconds < nbf, F.lit(ERR_NOT_YET))
              .when(now_c + skew_seconds < iat, F.lit(ERR_FUTURE_IAT))
              .when(F.col("_tenant").isNull(), F.lit(ERR_NO_TENANT))
              .otherwise(F.lit("")))
    df = df.withColumn("_err", error)
    status = F.when(F.col("_err") == "", F.lit("valid")).when(F.col("_err").isNotNull(), F.lit("invalid"))
    return (df.withColumn("token_status", status)
              .withColumn("token_error", F.nullif(F.col("_err"), F.lit("")))
              .withColumn("token_tenant", F.when(F.col("token_status") == "valid", F.col("_tenant")))
              .drop("_tok", "_parts", "_h", "_p", "_s", "_bad_format", "_alg_ok", "_payload", "_sig_ok",
                    "_exp", "_nbf", "_iat", "_tenant", "_err", *[f"_c_{c}" for c in CLAIM_FIELDS]))


def tenant_scope(df: DataFrame, asked_col: str = "asked_tenant", require_auth: bool = False) -> DataFrame:
    """read access of a request to the tenant it asks for.

    ``scope`` = ``allowed`` / ``unauthorized`` (invalid token, or no token
    while auth is required: 401) / ``forbidden`` (valid token of another
    tenant: 403).  Needs the columns of :func:`token_audit`.
    """
    st = F.col("token_status")
    scope = (F.when(st == "invalid", F.lit("unauthorized"))
              .when(F.lit(require_auth) & st.isNull(), F.lit("unauthorized"))
              .when((st == "valid") & F.col("token_tenant").isNotNull()
                    & (F.col("token_tenant") != F.col(asked_col)), F.lit("forbidden"))
              .otherwise(F.lit("allowed")))
    http = F.when(scope == "unauthorized", 401).when(scope == "forbidden", 403).otherwise(200)
    return df.withColumn("scope", scope).withColumn("scope_status", http)


# Fixed values of the storage service's record validation.
STORE_REQUIRED = "tenant_id, status and notification_id are required"
CLAIM_REQUIRED = "tenant_id, idempotency_key and notification_id are required"


def required_fields(df: DataFrame, kind_col: str = "kind") -> DataFrame:
    """``store`` needs tenant, status and id *present*; ``claim`` and
    ``release`` need tenant, key and id present *and non-empty*.  Rejects
    stay in the output with ``reject_reason`` (HTTP 400)."""
    def nonempty(c):
        return F.col(c).isNotNull() & (F.col(c) != "")

    store_ok = F.col("tenant_id").isNotNull() & F.col("status").isNotNull() & F.col("notification_id").isNotNull()
    claim_ok = nonempty("tenant_id") & nonempty("idempotency_key") & nonempty("notification_id")
    kind = F.col(kind_col)
    reason = (F.when((kind == "store") & ~store_ok, F.lit(STORE_REQUIRED))
               .when(kind.isin("claim", "release") & ~claim_ok, F.lit(CLAIM_REQUIRED)))
    return df.withColumn("reject_reason", reason).withColumn("valid", F.col("reject_reason").isNull())


def subscription_frames(frames: DataFrame, session_col: str = "session_id", order_col: str = "seq") -> DataFrame:
    """verdict per frame of a session log: accept / ignore / close / after_close.

    Only ``subscribe`` frames with non-empty tenant and channel count.  A
    session with an auth tenant that asks for another tenant is closed;
    anything after the close is ``after_close``.  Sessions without a token
    may subscribe to any tenant.  The first close per session is an
    aggregate joined back, so a long session never sorts in one task.
    """
    def nonempty(c):
        return F.col(c).isNotNull() & (F.col(c) != "")

    counts = (F.col("type") == "subscribe") & nonempty("tenant_id") & nonempty("channel")
    mismatch = nonempty("auth_tenant") & (F.col("auth_tenant") != F.col("tenant_id"))
    v = frames.withColumn("verdict0", F.when(~counts, F.lit("ignore"))
                                       .when(mismatch, F.lit("close")).otherwise(F.lit("accept")))
    closes = (v.filter(F.col("verdict0") == "close").groupBy(session_col)
               .agg(F.min(order_col).alias("closed_at")))
    j = v.join(closes, session_col, "left")
    verdict = F.when(F.col("closed_at").isNotNull() & (F.col(order_col) > F.col("closed_at")),
                     F.lit("after_close")).otherwise(F.col("verdict0"))
    return j.withColumn("verdict", verdict).drop("verdict0", "closed_at")


def current_subscriptions(verdicts: DataFrame, session_col: str = "session_id",
                          order_col: str = "seq") -> DataFrame:
    """Last accepted subscription of each session (each accept replaces the last)."""
    acc = verdicts.filter(F.col("verdict") == "accept")
    return newest_per_key(acc, [session_col], [order_col], 1)


# Fixed values of the routes (method, path, name, nominal status) of both services that answer reads.
GATEWAY_ROUTES = [("GET", "/health", "health", 200), ("GET", "/metrics", "metrics", 200),
                  ("GET", "/ws", "websocket", 101), ("POST", "/v1/internal/deliver", "internal_deliver", 200),
                  ("POST", "/v1/notifications", "submit", 202)]
STORAGE_ROUTES = [("GET", "/health", "health", 200), ("POST", "/v1/internal/idempotency/claim", "claim", 200),
                  ("POST", "/v1/internal/idempotency/release", "release", 200), ("POST", "/v1/internal/store", "store", 200)]
GATEWAY_PREFIXES = ("/v1/notifications/", "/v1/tenants/")
STORAGE_PREFIXES = ("/v1/internal/notifications/", "/v1/internal/tenants/")
DELIVERIES_SUFFIX = "/deliveries"


def route_requests(df: DataFrame, method_col: str = "method", path_col: str = "path", service: str = "gateway") -> DataFrame:
    """classify an access log of the gateway or of the storage service into routes with ids, tenant and limit.

    Adds ``route``, ``http_status`` (nominal: 404 unknown, 400 missing
    ``tenant_id``), ``resource_id``, ``tenant_id`` and ``limit`` (history
    size: numeric prefix, clamped to [1, 500], unreadable or missing -> 50).
    """
    m, p = F.col(method_col), F.col(path_col)
    bare = F.substring_index(p, "?", 1)
    exact, (note_prefix, tenant_prefix) = {"gateway": (GATEWAY_ROUTES, GATEWAY_PREFIXES), "storage": (STORAGE_ROUTES, STORAGE_PREFIXES)}[service]
    np_len, tp_len, ds_len = len(note_prefix), len(tenant_prefix), len(DELIVERIES_SUFFIX)
    is_note = (m == "GET") & bare.startswith(note_prefix) & (F.length(bare) > np_len)
    tenant_part = F.substring(bare, tp_len + 1, 1 << 30)
    is_deliv = ((m == "GET") & bare.startswith(tenant_prefix) & (F.length(bare) > tp_len)
                & (F.length(tenant_part) > ds_len) & tenant_part.endswith(DELIVERIES_SUFFIX))
    found = F.when(F.lit(False), F.struct(F.lit("").alias("route"), F.lit(0).alias("status")))
    for meth, path, name, code in exact:
        found = found.when((m == meth) & (bare == path), F.struct(F.lit(name).alias("route"), F.lit(code).alias("status")))
    found = (found.when(is_note, F.struct(F.lit("notification_state").alias("route"), F.lit(200).alias("status")))
                  .when(is_deliv, F.struct(F.lit("tenant_deliveries").alias("route"), F.lit(200).alias("status")))
                  .otherwise(F.struct(F.lit("not_found").alias("route"), F.lit(404).alias("status"))))
    # Each step names its result once; the next reads the names, so no condition or pattern is evaluated twice.
    df = df.withColumn("_found", found)
    route = F.col("_found.route")
    at_note, at_deliveries = route == "notification_state", route == "tenant_deliveries"
    df = df.withColumns({"_query_tenant": F.when(at_note, query_param(p, "tenant_id")),
                         "_limit": F.when(at_deliveries, int_or(query_param(p, "limit"), HISTORY_LIMIT_DEFAULT))})
    no_tenant = at_note & (F.coalesce(F.col("_query_tenant"), F.lit("")) == "")
    asked = F.col("_limit")
    asked = F.when((asked < -(1 << 31)) | (asked > (1 << 31) - 1), F.lit(HISTORY_LIMIT_DEFAULT)).otherwise(asked)
    tenant = (F.when(at_note, F.col("_query_tenant"))
               .when(at_deliveries, F.substring(tenant_part, F.lit(1), F.length(tenant_part) - ds_len)))
    return (df.withColumns({"route": route, "http_status": F.when(no_tenant, F.lit(400)).otherwise(F.col("_found.status")).cast("int"),
                            "resource_id": F.when(at_note, F.substring(bare, np_len + 1, 1 << 30)), "tenant_id": tenant,
                            "limit": F.when(at_deliveries, clamp(asked, HISTORY_LIMIT_MIN, HISTORY_LIMIT_MAX).cast("int"))})
              .drop("_found", "_query_tenant", "_limit"))
