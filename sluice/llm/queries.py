"""The queries opN_<name>: each applies its operator with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm import bpe, decontaminate, fingerprint, language, line_dedup, merkle, minhash, packing, pii, spelling, toxicity, url_filter, warc
from sluice.llm.common import new_folder, read
from sluice.registry import register
from sluice.session import delete_on_exit


@register("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


@register("op10_toxicity")
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_hits")


@register("op3_warc")
def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    delete_on_exit(spark, folder)
    manifest = warc.write(read(spark, sf_dir, "pages"), folder)
    return warc.read_back(manifest, folder).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SPAM_WORDS = "casino|bets|pills|spam|ads-|adult"


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a time of capture derived from page_id, as the table has none."""
    minutes = F.coalesce(F.col("page_id") * 7919 % 525_600, F.lit(0))
    return pages.select("page_id", "url", F.timestamp_seconds(F.lit(1_704_067_200) + minutes * 60).alias("fetch_time"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Dated entries derived from the hosts seen: spam words for good, others on and off a watch list, some sections allowed."""
    hosts = pages.select(url_filter.host(F.col("url")).alias("host")).where("host is not null").distinct() \
        .withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))
    entry = lambda name, verdict, kind, pattern, action, day: F.struct(
        F.lit(name).alias("list_name"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), F.expr(pattern).alias("pattern"),
        F.lit(action).alias("action"), F.expr(f"timestamp_seconds(1704067200 + 86400 * ({day}))").alias("since"))
    spam, watched, allowed = f"host rlike '{SPAM_WORDS}'", "h % 3 = 0", "h % 5 = 1"
    rules = [(spam, entry("spam", "block", "domain", "regexp_replace(host, '^(www|m|blog)[.]', '')", "add", "0")),
             (watched, entry("watch", "block", "domain", "host", "add", "h % 200")),
             (watched, entry("watch", "block", "domain", "host", "remove", "h % 200 + 30 + h % 60")),
             (watched + " and h % 2 = 0", entry("watch", "block", "domain", "host", "add", "300")),
             (allowed, entry("sections", "allow", "prefix", "concat(host, '/en')", "add", "31 + h % 100"))]
    return hosts.select(F.explode(F.array(*[F.when(F.expr(when), e) for when, e in rules])).alias("e")).where("e is not null").select("e.*")


@register("op4_url_filter")
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return url_filter.evaluate(derived_captures(pages), derived_entries(pages)).select(
        "page_id", "url", text("fetch_time"), "verdict", "list_name", "kind", "pattern", text("active_since"), text("active_until"), "n_active")


@register("op8_fingerprint")
def op8_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare_next(read(spark, sf_dir, "documents"))


@register("op6_language")
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs)
    return language.predict(docs, model).select(
        "doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@register("op5_pii")
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.detect(docs, pii.learn(docs))


@register("op1_line_dedup")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = line_dedup.judge(read(spark, sf_dir, "documents")).drop("h1", "h2")
    return judged.select(*[F.col(c).cast("long").alias(c) if t == "int" else c for c, t in judged.dtypes])


@register("op2_minhash")
def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents"), percent=85)


@register("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@register("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(read(spark, sf_dir, "documents")))


@register("op12_bpe")
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.decode(bpe.encode(read(spark, sf_dir, "documents"))).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("data", 256).alias("decoded_sha256"))


@register("op13_merkle")
def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return merkle.verify(read(spark, sf_dir, "documents"), tampered)
