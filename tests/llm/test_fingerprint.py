import hashlib
import random

from sluice.llm import fingerprint as fp
from tests.llm.helpers import LONG_TEXT, clashing, docs_of


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_spans_and_extensions():
    rnd = random.Random(6)
    for _ in range(200):
        x = "".join(rnd.choice("abé😀") for _ in range(rnd.randint(0, 30)))
        y = rnd.choice([x, x[3:], "".join(rnd.choice("abé😀") for _ in range(rnd.randint(0, 30)))])
        a, b = fp.Prefixes(x), fp.Prefixes(y)
        i, j = rnd.randint(0, len(x)), rnd.randint(0, len(y))
        assert fp.extension(a, i, b, j) == common(x[i:], y[j:])
        assert fp.extension_left(a, i, b, j, 99) == common(x[:i][::-1], y[:j][::-1])
        n = min(len(x) - i, len(y) - j)
        assert fp.equal(a, i, b, j, n) == (x[i:i + n] == y[j:j + n])
        assert (str(a.fingerprint()) == str(b.fingerprint())) == (x == y)


def test_stored_fingerprints_bound_the_likeness():
    """Two strings, without their texts, give the share that whole steps cover; the exact share lies within the bounds."""
    rnd = random.Random(8)
    for _ in range(300):
        x = "".join(rnd.choice("ab😀") for _ in range(rnd.choice([0, 1, 5, 64, 65, 700, 5000])))
        cut, k = rnd.randint(0, len(x)), rnd.randint(0, 40)
        y = rnd.choice([x, x[:cut], x[cut:], x[:cut] + "z" * k + x[cut:], x[:cut] + x[cut + k:], x[:cut] + "z" * (len(x) - cut)])
        a, b = (fp.Prefixes(t) for t in (x, y))
        low, high = fp.bounds(*(fp.Fingerprint.parse(str(t.fingerprint())) for t in (a, b)))
        exact = fp.likeness(a, b)
        assert low <= exact <= high and high - low < 1 / 16
        assert low == stepped(x, y) and (low == exact or max(len(x), len(y)) > 64)
        assert len(str(a.fingerprint())) < 800


def stepped(x, y):
    """Brute force: common prefix and suffix in whole steps."""
    if x == y:
        return 1.0
    step = 1
    while max(len(x), len(y)) // step > 64:
        step *= 2
    covered = common(x, y) // step * step + common(x[::-1], y[::-1]) // step * step
    return min(len(x), len(y), covered) / max(len(x), len(y))


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (d, text) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        changed = text[:len(text) - len(text) // 2] + following[:len(text) // 2]

        def like(a, b):
            if not a and not b:
                return 1.0
            head = common(a, b)
            tail = common(a[::-1][:min(len(a), len(b)) - head], b[::-1][:min(len(a), len(b)) - head])
            return (head + tail) / max(len(a), len(b))
        out.append((d, len(text), hashlib.sha256(changed.encode()).hexdigest(), *(
            round(share(text, other), 9) for share in (like, stepped) for other in (changed, following))))
    return sorted(out, key=str)


def answer(df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, *(round(x, 9) for x in (r.exact_edited, r.exact_next, r.near_edited, r.near_next))) for r in df.collect()), key=str)


def test_against_brute_force_over_ranges(spark):
    rnd = random.Random(9)
    rows = [(i * 7 - 300, "".join(rnd.choice("ab ") for _ in range(rnd.randint(0, 60)))) for i in range(300)]
    rows += [(5000, "same"), (5001, "same"), (5002, LONG_TEXT)]
    rnd.shuffle(rows)
    assert answer(fp.compare_next(docs_of(spark, rows).repartition(4), range_bytes=3_000)) == brute(rows)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "x"), (None, "null id"), (4, "ab"), (4, "aa"), (9, "😀é")]
    assert answer(fp.compare_next(clashing(docs_of(spark, rows)))) == brute(rows)
    assert answer(fp.compare_next(docs_of(spark, [(1, "abcd")]))) == brute([(1, "abcd")])
    assert fp.compare_next(docs_of(spark, [])).count() == 0


def test_a_third_without_an_id_and_a_far_one(spark):
    """Many rows of one doc_id fill several ranges: every row follows another of them, and the ring is closed."""
    rnd = random.Random(12)
    rows = [(None, f"null {i} " + "".join(rnd.choice("ab ") for _ in range(40))) for i in range(150)] + [(i, f"doc {i}" * 5) for i in range(300)] + [(1 << 55, "far")]
    got = fp.compare_next(docs_of(spark, rows).repartition(5), range_bytes=4_000).collect()
    assert len(got) == len(rows)
    texts = sorted({t for _, t in rows})
    by_edit = {}
    for d, text in rows:
        for other in texts:
            changed = text[:len(text) - len(text) // 2] + other[:len(text) // 2]
            by_edit.setdefault((d, len(text), hashlib.sha256(changed.encode()).hexdigest()), []).append((text, other))
    for r in got:
        assert (r.doc_id, r.n_chars, r.edited_sha256) in by_edit
    want = brute(rows)
    named = [r for r in answer_rows(got) if r[0] is not None]
    assert named == [w for w in want if w[0] is not None]


def answer_rows(rows):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, *(round(x, 9) for x in (r.exact_edited, r.exact_next, r.near_edited, r.near_next))) for r in rows), key=str)


def test_only_the_first_row_of_a_range_is_sent(spark):
    """Hundreds of rows share the doc_id that a range begins with; one of them goes to the range before."""
    rows = [(i, f"a{i}" * 30) for i in range(40)] + [(40, f"hot {i} " * 6) for i in range(200)]
    got = fp.compare_next(docs_of(spark, rows), range_bytes=3_000)
    assert got.count() == len(rows)
