"""URL filters as a temporal list join, in DataFrame operations only.

A list is a log of dated entries (list_name, verdict, kind, pattern, action, since): from ``since`` on the pattern is on the
list ("add") or off it ("remove").  Entries become validity intervals, and every capture (page_id, url, fetch_time) meets the
intervals that are active at its fetch time.  ``kind`` is "domain" (the host or any parent domain) or "prefix" (host and
leading path segments, as many as ``prefix_segments``).  The most specific active entry (longest pattern) decides; at equal
length "allow" beats "block", then the later list name and pattern.

The as-of join is an equality join on (kind, pattern, time node) with the interval test inside it, so a capture meets only the
intervals of its own keys and time; hot hosts are split by adaptive skew handling.  Nodes are buckets of 30 days and, where the
fetch times span more than 32 of them, runs of 32, 1,024 and so on: an interval is listed under the few nodes that cover it once,
a capture asks at its node of each size, so an open entry and a capture dated far away cost a few rows, not one per bucket.  Intervals of a hot pattern are found in
two steps, within a bucket of time and between buckets, so no task sorts all entries of one pattern.

Null url, a url without scheme and host, or a host of more than 253 characters has no key: verdict "none".  Null fetch_time:
"none".  Entries with a null pattern, action or since are ignored; of entries at one instant "remove" wins.  Repeated captures
(same page_id, url and fetch_time) give one row.  Empty lists leave every capture "none".  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.operators.fanout import cover

BUCKET_SECONDS = 30 * 86_400
FAN = 32
PREFIX_SEGMENTS = 2
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"
ENTRY = ("struct<size:int,allow:boolean,list_name:string,pattern:string,kind:string,verdict:string,"
         "since:timestamp,until:timestamp>")
KEY = ["list_name", "verdict", "kind", "pattern"]


def host(url: Column) -> Column:
    """Host in lower case; null where there is none."""
    found = F.lower(F.regexp_extract(url, HOST, 1))
    return F.when(F.length(found).between(1, 253), found)


def keys(url: Column, prefix_segments: int = PREFIX_SEGMENTS) -> Column:
    """Array of (kind, pattern) that a url can match."""
    labels = F.split(host(url), r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(
        F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")))
    segments = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda s: s != "")
    some = F.least(F.size(segments), F.lit(prefix_segments))
    prefixes = F.transform(F.when(some > 0, F.sequence(F.lit(1), some)).otherwise(F.array().cast("array<int>")), lambda n: F.struct(
        F.lit("prefix").alias("kind"), F.concat(host(url), F.lit("/"), F.array_join(F.slice(segments, F.lit(1), n), "/")).alias("pattern")))
    return F.when(host(url).isNotNull(), F.concat(parents, prefixes))


def bucket(time: Column) -> Column:
    return F.floor(F.unix_timestamp(time) / BUCKET_SECONDS)


def intervals(entries: DataFrame) -> DataFrame:
    """(list_name, verdict, kind, pattern, since, until): the entry is active from since to before until (null: for good)."""
    log = entries.where(F.col("pattern").isNotNull() & F.col("action").isin("add", "remove") & F.col("since").isNotNull()) \
        .groupBy(*KEY, "since").agg(F.max("action").alias("action")).withColumn("bucket", bucket(F.col("since")))
    within = Window.partitionBy(*KEY, "bucket").orderBy("since")
    between = Window.partitionBy(*KEY).orderBy("bucket")  # one row per bucket of time
    later = log.groupBy(*KEY, "bucket").agg(F.min("since").alias("first")) \
        .select(*KEY, "bucket", F.lead("first").over(between).alias("after"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"n.{c}")) for c in [*KEY, "bucket"]]
    log = log.withColumn("until", F.lead("since").over(within))
    return log.alias("l").join(later.alias("n"), same).where("l.action = 'add'") \
        .select(*[f"l.{c}" for c in KEY], "l.since", F.coalesce("l.until", "n.after").alias("until"))


def node_sizes(buckets: int) -> list[int]:
    """Sizes of the time nodes for a span of so many buckets, largest first: powers of ``FAN`` below it."""
    sizes = [1]
    while sizes[0] * FAN < buckets:
        sizes.insert(0, sizes[0] * FAN)
    return sizes


def listed(spans: DataFrame, lo: int, hi: int) -> DataFrame:
    """The intervals that touch buckets lo to hi, each under the time nodes (size, node) that cover it there."""
    from_ = F.greatest(F.lit(lo), bucket(F.col("since")))
    to = F.least(F.lit(hi), F.coalesce(bucket(F.col("until")), F.lit(hi)))
    return spans.where(from_ <= to).select(*KEY, "since", "until", F.explode(cover(from_, to + 1, node_sizes(hi - lo + 1))).alias("at")) \
        .select(*KEY, "since", "until", "at.size", "at.node")


def evaluate(captures: DataFrame, entries: DataFrame, prefix_segments: int = PREFIX_SEGMENTS) -> DataFrame:
    """One row per capture: verdict, the entry that decides with its interval, and the number of active entries."""
    seen = captures.select("page_id", "url", "fetch_time")
    span = seen.agg(F.min(bucket(F.col("fetch_time"))).alias("lo"), F.max(bucket(F.col("fetch_time"))).alias("hi")).first()
    lo, hi = (span[c] or 0 for c in ("lo", "hi"))
    nodes = F.array(*[F.struct(F.lit(n).alias("size"), F.floor(bucket(F.col("fetch_time")) / n).alias("node")) for n in node_sizes(hi - lo + 1)])
    asked = seen.where("fetch_time is not null").select("*", F.explode(keys(F.col("url"), prefix_segments)).alias("k")) \
        .select("page_id", "url", "fetch_time", "k.kind", "k.pattern", F.explode(nodes).alias("at")) \
        .select("page_id", "url", "fetch_time", "kind", "pattern", "at.size", "at.node")
    hits = asked.join(listed(intervals(entries), lo, hi), ["kind", "pattern", "size", "node"]).where(
        "fetch_time >= since and (until is null or fetch_time < until)")
    entry = F.struct(F.length("pattern").alias("size"), (F.col("verdict") == "allow").alias("allow"), "list_name", "pattern",
                     "kind", "verdict", "since", "until")
    rows = seen.select("page_id", "url", "fetch_time", F.lit(None).cast(ENTRY).alias("entry")).unionByName(
        hits.select("page_id", "url", "fetch_time", entry.cast(ENTRY).alias("entry")))
    return rows.groupBy("page_id", "url", "fetch_time").agg(F.max("entry").alias("e"), F.count("entry").alias("n_active")).select(
        "page_id", "url", "fetch_time", F.coalesce("e.verdict", F.lit("none")).alias("verdict"), "e.list_name", "e.kind", "e.pattern",
        F.col("e.since").alias("active_since"), F.col("e.until").alias("active_until"), "n_active")
