import datetime as dt
import random

from sluice.llm import url_filter
from tests.llm.helpers import clashing

ENTRIES = "list_name string, verdict string, kind string, pattern string, action string, since timestamp"
CAPTURES = "page_id long, url string, fetch_time timestamp"
DAY0 = dt.datetime(2024, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def brute(captures, entries):
    out = set()
    for page_id, url, t in captures:
        found = []
        if url and t and "://" in url:
            rest = url.split("://", 1)[1].split("?")[0].split("#")[0]
            host, *path = rest.split("/")
            host, path = host.split("@")[-1].split(":")[0].lower(), [p for p in path if p]
            labels = host.split(".")
            keys = {("domain", ".".join(labels[i:])) for i in range(len(labels))} | {("prefix", host + "/" + "/".join(path[:n])) for n in (1, 2) if len(path) >= n}
            for name, verdict, kind, pattern in {e[:4] for e in entries}:
                log = sorted((since, action) for *k, action, since in entries if tuple(k) == (name, verdict, kind, pattern) and since <= t)
                if (kind, pattern) in keys and log and log[-1][1] == "add":
                    found.append((len(pattern), verdict == "allow", name, pattern, verdict))
        best = max(found) if found else None
        out.add((page_id, url, t, best[4] if best else "none", best[2] if best else None, best[3] if best else None, len(found)))
    return out


def answer(df):
    return {(r.page_id, r.url, r.fetch_time, r.verdict, r.list_name, r.pattern, r.n_active) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(4)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.org", "x.d.org"]
    entries = [("l%d" % rnd.randint(0, 2), v, k, p, rnd.choice(["add", "add", "remove"]), day(rnd.randint(0, 300)))
               for _ in range(150) for k, p in [rnd.choice([("domain", rnd.choice(hosts)), ("prefix", rnd.choice(hosts) + rnd.choice(["/x", "/x/y"]))])]
               for v in [rnd.choice(["allow", "block"])]]
    captures = [(i, rnd.choice(["http://", "https://u@"]) + rnd.choice(hosts).upper() + rnd.choice(["", "/", "/x", "/x/y/z", "/q?x=/x", ":80/x#f"]),
                 day(rnd.randint(0, 330)) + dt.timedelta(seconds=rnd.randint(0, 1))) for i in range(400)]
    got = url_filter.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES))
    assert answer(got) == brute(captures, entries)


def test_interval_ends(spark):
    entries = [("l", "block", "domain", "a.com", "add", day(1)), ("l", "block", "domain", "a.com", "remove", day(100)), ("l", "block", "domain", "a.com", "remove", day(1))]
    captures = [(i, "http://a.com/", t) for i, t in enumerate([day(0), day(1), day(99), day(100)])]
    assert {r.verdict for r in url_filter.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)).collect()} == {"none"}
    got = url_filter.evaluate(spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries[:2], ENTRIES)).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["none", "block", "block", "none"]
    assert got[1].active_since == day(1) and got[1].active_until == day(100)


def test_far_times(spark):
    """Fetch times from 1900 to 9999 give the same answers, and an open entry is listed under few nodes."""
    rnd = random.Random(5)
    far = [dt.datetime(1900, 1, 1), dt.datetime(1969, 12, 31, 23, 59, 59), dt.datetime(2031, 5, 1), dt.datetime(9999, 12, 30)]
    entries = [("l%d" % i, "block", "domain", rnd.choice(["a.com", "b.a.com"]), rnd.choice(["add", "remove"]), rnd.choice(far + [day(i)])) for i in range(60)]
    entries += [("open", "allow", "domain", "a.com", "add", far[0]), ("late", "block", "domain", "a.com", "add", far[3])]
    captures = [(i, "http://b.a.com/", rnd.choice(far + [day(rnd.randint(0, 80))]) + dt.timedelta(seconds=rnd.randint(0, 1))) for i in range(80)]
    captures, entries = spark.createDataFrame(captures, CAPTURES), spark.createDataFrame(entries, ENTRIES)
    assert answer(url_filter.evaluate(captures, entries)) == brute([tuple(r) for r in captures.collect()], [tuple(r) for r in entries.collect()])
    lo, hi = -852, 97_800
    assert url_filter.node_sizes(hi - lo + 1) == [32_768, 1024, 32, 1] and url_filter.node_sizes(13) == [1]
    spans = url_filter.intervals(entries)
    assert url_filter.listed(spans, lo, hi).count() < 200 * spans.count()
    covered = url_filter.listed(spans, lo, hi).groupBy(*url_filter.KEY, "since", "until").agg({"size": "sum"}).collect()
    wanted = spans.select("since", "until", url_filter.bucket(spans["since"]).alias("a"), url_filter.bucket(spans["until"]).alias("b")).collect()
    assert sorted(r["sum(size)"] for r in covered) == sorted((hi if r.b is None else r.b) - max(lo, r.a) + 1 for r in wanted if r.a <= hi)


def test_awkward_rows(spark):
    entries = [("l", "block", "domain", "a.com", "add", day(0)), ("l", "block", "domain", None, "add", day(0)), ("l", None, "domain", "b.com", "add", day(0)),
               ("l", "block", "domain", "c.com", None, day(0)), ("l", "block", "domain", "d.com", "add", None)]
    captures = [(1, None, day(1)), (2, "", day(1)), (3, "http://a.com", None), (4, "not a url", day(1)), (5, "http://" + "x" * 300 + ".a.com/", day(1)),
                (None, "http://a.com", day(1)), (6, "http://a.com", day(1)), (6, "http://a.com", day(1)), (7, "http://c.com", day(2)), (8, "http://a.com/" + "p/" * 50_000, day(1))]
    got = url_filter.evaluate(clashing(spark.createDataFrame(captures, CAPTURES)), spark.createDataFrame(entries, ENTRIES)).collect()
    assert sorted((str(r.page_id), r.verdict) for r in got) == sorted([(str(i), "none") for i in (1, 2, 3, 4, 5, 7)] + [("None", "block"), ("6", "block"), ("8", "block")])


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], ENTRIES), spark.createDataFrame([(1, "http://a.com", day(0))], CAPTURES)
    assert [r.verdict for r in url_filter.evaluate(some, none).collect()] == ["none"]
    assert url_filter.evaluate(spark.createDataFrame([], CAPTURES), none).count() == 0


def test_no_python_in_the_plan(spark):
    df = url_filter.evaluate(spark.createDataFrame([(1, "http://a.com", day(0))], CAPTURES), spark.createDataFrame([], ENTRIES))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))
