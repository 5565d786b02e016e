import gzip
import hashlib

from pyspark.sql import functions as F

from sluice.llm import warc
from sluice.llm.common import new_folder
from tests.llm.helpers import clashing

PAGES = "page_id long, url string, html string"


def archived(spark, pages, **options):
    folder = new_folder(spark, "test-warc")
    manifest = warc.write(pages, folder, **options)
    return folder, manifest, warc.read_back(manifest, folder)


def brute(rows):
    newest = {}
    for page_id, _, html in rows:
        p = (html or "").encode()
        if page_id is not None and len(p) >= 1000:
            newest[p] = max(newest.get(p, page_id), page_id)
    out = []
    for page_id, _, html in rows:
        p = (html or "").encode()
        to = newest.get(p) if page_id is not None else None
        again = to is not None and to != page_id
        out.append((page_id, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", to if again else None))
    return sorted(out, key=str)


def test_round_trip_and_revisits(spark):
    big = "é" * 700
    rows = [(i, f"http://h{i % 3}/{i}", big if i % 3 == 0 else f"{big}{i}" if i % 3 == 1 else "small") for i in range(200)]
    rows += [(500, None, None), (None, "http://x/", big), (501, "http://a\r\nb/", ""), (502, "http://z/", "\r\n\r\nWARC/1.1\r\n" * 200)]
    _, _, back = archived(spark, clashing(spark.createDataFrame(rows, PAGES)), shard_bytes=20_000, file_bytes=4_000)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()), key=str)
    assert got == brute(rows)


def test_files_are_the_same_whatever_the_partitions(spark):
    rows = [(i, f"http://h/{i}", f"{i} " * 400) for i in range(120)]
    one = archived(spark, spark.createDataFrame(rows, PAGES).repartition(1), shard_bytes=30_000, file_bytes=2_000)[1]
    two = archived(spark, spark.createDataFrame(rows[::-1], PAGES).repartition(7), shard_bytes=30_000, file_bytes=2_000)[1]
    first = sorted((r.file, r.records, r.bytes, r.sha256) for r in one.collect())
    assert first == sorted((r.file, r.records, r.bytes, r.sha256) for r in two.collect())
    assert len({f.split("-")[1] for f, *_ in first}) > 1 and len(first) > len({f.split("-")[1] for f, *_ in first})


def test_files_are_sorted_gzip_members_under_final_names(spark):
    import os
    rows = [(i, f"http://h/{i}", "x" * 2000) for i in (5, 3, 9)]
    folder, manifest, back = archived(spark, spark.createDataFrame(rows, PAGES))
    names = sorted(os.listdir(folder))
    assert [n for n in names if not n.startswith(".")] == [r.file for r in manifest.collect()]
    text = gzip.open(os.path.join(folder, manifest.first().file)).read().decode()
    assert [line for line in text.splitlines() if line.startswith("X-Page-ID")] == ["X-Page-ID: 3", "X-Page-ID: 5", "X-Page-ID: 9"]
    assert text.count("WARC-Type: revisit") == 2 and text.count("x" * 2000) == 1
    assert back.where(F.col("record_type") == "response").first().page_id == 9


def test_commit_twice_changes_nothing(spark):
    folder, manifest, _ = archived(spark, spark.createDataFrame([(1, "u", "x")], PAGES))
    again = manifest.select(F.lit("_temporary/gone").alias("temporary"), F.col("file").alias("final"), "records", "bytes", "sha256")
    assert warc.commit(again, folder).collect() == manifest.collect()


def test_files_of_lost_attempts_go(spark):
    """A file that no accepted attempt reports is neither read nor kept."""
    import os
    folder = new_folder(spark, "test-warc")
    os.makedirs(os.path.join(folder, warc.TEMPORARY))
    lost = os.path.join(folder, warc.TEMPORARY, "000000-00000-lost")
    open(lost, "wb").write(b"cut off")
    manifest = warc.write(spark.createDataFrame([(1, "u", "x"), (2, "v", "y")], PAGES), folder)
    assert not os.path.exists(lost) and sorted(r.page_id for r in warc.read_back(manifest, folder).collect()) == [1, 2]
    assert [n for n in os.listdir(folder) if not n.startswith(".")] == [r.file for r in manifest.collect()]


def test_repeated_page(spark):
    rows = [(7, "http://b/", "y" * 1500), (7, "http://a/", "y" * 1500), (3, "http://c/", "y" * 1500)]
    got = sorted((r.page_id, r.target_uri, r.record_type, r.refers_to) for r in archived(spark, spark.createDataFrame(rows, PAGES))[2].collect())
    assert got == [(3, "http://c/", "revisit", 7), (7, "http://a/", "response", None), (7, "http://b/", "revisit", 7)]


def test_empty_table(spark):
    _, manifest, back = archived(spark, spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and back.count() == 0


def test_a_third_without_an_id_and_a_far_one(spark):
    """They are spread over shards, and revisits of a page_id with several payloads are still told apart."""
    big = "é" * 700
    rows = [(None, f"http://n/{i}", f"{big}{i}") for i in range(60)] + [(i, f"http://h/{i}", big if i % 4 == 0 else f"{big}{i}") for i in range(120)] + [(1 << 50, "http://far/", big)]
    rows += [(7, f"http://hot/{i}", f"{big}hot{i % 20}") for i in range(60)]
    _, manifest, back = archived(spark, spark.createDataFrame(rows, PAGES), shard_bytes=20_000)
    shards = {r.file.split("-")[1]: r.records for r in manifest.collect()}
    assert len(shards) > 8 and max(shards.values()) < 50
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in back.collect()), key=str)
    want = brute(rows)
    assert [g[:3] for g in got] == [w[:3] for w in want] and [g for g in got if g[0] != 7] == [w for w in want if w[0] != 7]
    hot = [g for g in got if g[0] == 7]
    assert sum(g[3] == "response" for g in hot) == len({g[2] for g in hot})
