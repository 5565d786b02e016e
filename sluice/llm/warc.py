"""Deterministic sharded WARC writer and reader.

Records are dealt to shards by ranges of page_id: equal-width bins of the ids are weighed (records and payload bytes) and
consecutive bins joined up to ``shard_bytes``, so the same input gives the same shards on any cluster.  Each task sorts its
shard by page_id and writes gzip members, one per record, to files that roll when ``file_bytes`` compressed bytes are reached.
Headers, digests and record ids are made anew from the rows.  A file gets a temporary name with a fresh suffix per attempt, in a
folder of its own; the attempt that Spark accepts reports it in the manifest (a Parquet table), and only files of the manifest are
renamed to their final names and read.  Files of lost or repeated attempts are never seen and go with the temporary folder once
all names are final (a folder takes the archives of one write).

Equal payloads of at least ``min_revisit`` bytes: the row with the largest page_id is a response, the others are revisits of
it.  The groups are found on digests alone; payloads move once, to their shard.

Null html is an empty payload, null url an empty target.  Rows with null page_id sort first and are always responses.
Repeated page_ids with equal payload: the first in (url) order is the response.  An empty table writes no file.  Other
columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Ranges, ship, stored
from sluice.session import delete_folder

MIN_REVISIT = 1000
SHARD_BYTES = 64 << 20
FILE_BYTES = 16 << 20
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
TEMPORARY = "_temporary"
MANIFEST = "temporary string, final string, records long, bytes long, sha256 string"
MANIFEST_NAMES = ["temporary", "final", "records", "bytes", "sha256"]
COMMITTED = "file string, records long, bytes long, sha256 string"
RECORDS = ("page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, "
           "payload_digest string, file string, offset long")
RECORD_NAMES = ["page_id", "target_uri", "record_type", "refers_to", "payload_bytes", "payload_digest", "file", "offset"]


def record_id(page_id: int | None, url: str, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{url}|{digest}')}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record: an HTTP response with the payload, or a revisit with the HTTP headers only."""
    digest = hashlib.sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    sha = lambda d: "sha1:" + base64.b32encode(d).decode()
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: {record_id(page_id, url, digest.hexdigest())}", f"WARC-Date: {DATE}",
             f"WARC-Target-URI: {url}", "Content-Type: application/http; msgtype=response",
             f"WARC-Payload-Digest: {sha(digest.digest())}", f"WARC-Block-Digest: {sha(hashlib.sha1(block).digest())}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes) -> bytes:
    """A gzip member without time or name, so equal records give equal bytes."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=6, mtime=0, filename="") as f:
        f.write(raw)
    return out.getvalue()


def clean_url(url: str | None) -> str:
    """A header cannot hold line breaks."""
    return (url or "").replace("\r", "%0D").replace("\n", "%0A")


def open_folder(base: str):
    """(file system, path) of a folder named as Spark names it."""
    from pyarrow import fs
    if "://" not in base and not base.startswith("file:"):
        return fs.LocalFileSystem(), base
    return fs.FileSystem.from_uri(base if "://" in base else "file://" + base.removeprefix("file:"))


class Roller:
    """Writes the records of one task to files that roll by shard and by compressed size."""

    def __init__(self, folder: str, file_bytes: int):
        self.system, self.base = open_folder(folder)
        self.file_bytes = file_bytes
        self.attempt = uuid.uuid4().hex
        self.done: list[tuple] = []
        self.shard = self.part = -1
        self.out = None

    def add(self, shard: int, packed: bytes) -> None:
        if self.out is None or shard != self.shard or self.size >= self.file_bytes:
            self.close()
            self.part = self.part + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.temporary = f"{TEMPORARY}/{shard:06d}-{self.part:05d}-{self.attempt}"
            self.system.create_dir(f"{self.base}/{TEMPORARY}", recursive=True)
            self.out = self.system.open_output_stream(f"{self.base}/{self.temporary}", compression=None)
        self.out.write(packed)
        self.sha.update(packed)
        self.size += len(packed)
        self.records += 1

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.temporary, f"shard-{self.shard:06d}-{self.part:05d}.warc.gz", self.records, self.size, self.sha.hexdigest()))
            self.out = None


def write(pages: DataFrame, folder: str, min_revisit: int = MIN_REVISIT, shard_bytes: int = SHARD_BYTES,
          file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as WARC files in ``folder``; returns the committed manifest."""
    spark = pages.sparkSession
    ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    narrow = stored(rows.select("page_id", F.octet_length("payload").alias("payload_bytes"), F.sha1("payload").alias("digest")), "digests")
    ranges = Ranges(narrow.withColumnRenamed("digest", "spread"), "page_id", F.col("payload_bytes") + 500, shard_bytes, F.xxhash64("spread"))
    large = narrow.where((F.col("payload_bytes") >= min_revisit) & F.col("page_id").isNotNull())
    groups = large.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1")
    notes = large.join(groups.drop("n"), "digest").select("page_id", "digest", "refers_to").distinct()
    # A note says that a page's payload has others like it; it comes to the page's shard, just before the page.
    # Pages of one page_id are spread by their digest, and notes go with them.
    both = rows.select("page_id", "url", "payload", F.lit(None).cast("string").alias("digest"), F.lit(None).cast("long").alias("refers_to"), F.sha1("payload").alias("spread")) \
        .unionByName(notes.select("page_id", F.lit("").alias("url"), F.lit(None).cast("binary").alias("payload"), "digest", "refers_to", F.col("digest").alias("spread")))
    dealt = ranges.with_shard(both).select("shard", "page_id", "url", "payload", "digest", "refers_to") \
        .repartitionById(ranges.n_shards, F.col("shard")) \
        .sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), F.col("digest").desc_nulls_last(), "url")

    def roll(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Roller(folder, file_bytes)
        page, notes_of, answered = None, {}, set()
        for batch in batches:
            for i in range(batch.num_rows):
                shard, page_id, url, payload, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if page_id != page or page_id is None:
                    page, notes_of, answered = page_id, {}, set()
                if digest is not None:
                    notes_of[digest] = refers_to
                    continue
                own = hashlib.sha1(payload).hexdigest() if notes_of else ""
                to = notes_of.get(own)
                if to == page_id and own not in answered:  # this row is the response of its group
                    answered.add(own)
                    to = None
                files.add(shard, member(record(page_id, clean_url(url), payload, to)))
        files.close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in files.done], kind) for i, kind in enumerate(
            (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()))], MANIFEST_NAMES)

    return commit(stored(dealt.mapInArrow(roll, MANIFEST), "manifest"), folder)


def commit(manifest: DataFrame, folder: str) -> DataFrame:
    """Give the files of the manifest their final names and remove the other files written; done twice it changes nothing."""
    from pyarrow import fs

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        for b in batches:
            for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if system.get_file_info(f"{base}/{old}").type != fs.FileType.NotFound:
                    system.move(f"{base}/{old}", f"{base}/{new}")
            yield pa.RecordBatch.from_arrays(b.columns[1:], ["file", "records", "bytes", "sha256"])

    committed = stored(manifest.mapInArrow(rename, COMMITTED), "committed")
    delete_folder(manifest.sparkSession, f"{folder}/{TEMPORARY}")
    return committed


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    return headers, rest[:int(headers["content-length"])]


def members(stream) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream, one at a time."""
    offset, pending = 0, b""
    while pending or (pending := stream.read(1 << 20)):
        one, out, used = zlib.decompressobj(31), [], 0
        while not one.eof:
            pending = pending or stream.read(1 << 20)
            if not pending:
                raise ValueError(f"the member at {offset} is cut off")
            out.append(one.decompress(pending))
            used += len(pending) - len(one.unused_data)
            pending = one.unused_data
        yield offset, b"".join(out)
        offset += used


def read_back(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per record of the manifest's files; block and payload digests are checked."""
    ship(manifest.sparkSession)
    n_files = manifest.count()

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = open_folder(folder)
        plain = lambda text: base64.b32decode(text.removeprefix("sha1:")).hex()
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for offset, raw in members(stream):
                        h, block = parse(raw)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
                        digest = plain(h["warc-payload-digest"])
                        if plain(h["warc-block-digest"]) != hashlib.sha1(block).hexdigest() or h["warc-type"] == "response" and (
                                len(payload) != size or digest != hashlib.sha1(payload).hexdigest()):
                            raise ValueError(f"{name} at {offset}: a digest or length is wrong")
                        number = lambda key: int(h[key]) if key in h else None
                        rows.append((number("x-page-id"), h["warc-target-uri"], h["warc-type"], number("x-refers-to-page-id"), size, digest, name, offset))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(
                    (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], RECORD_NAMES)

    return manifest.select("file").repartition(max(1, min(n_files, 10_000))).mapInArrow(records, RECORDS)
