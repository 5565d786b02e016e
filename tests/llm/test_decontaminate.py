import random

import numpy as np
import pyarrow as pa

from sluice.llm import decontaminate as dc
from tests.llm.helpers import LONG_TEXT, clashing, docs_of, shingle_set

ITEMS = "item_id long, text string"


def text_of(rnd, n):
    return " ".join(rnd.choice("abcdefghij") + rnd.choice("klmnop") * rnd.randint(1, 3) for _ in range(n))


def test_planted_passages(spark):
    rnd = random.Random(7)
    items = [(i, text_of(rnd, rnd.randint(10, 90))) for i in range(40)]
    rows, planted = [], set()
    for d in range(160):
        body = text_of(rnd, rnd.randint(0, 400)).split()
        if d % 4 == 0:
            item, text = items[(d // 4) % 40]
            passage = text.upper().split() if d % 8 else text.split()
            at = rnd.randint(0, len(body))
            body[at:at] = passage
            planted.add((d, item))
        rows.append((d, "\n ".join(body)))
    docs, benchmark = docs_of(spark, rows), spark.createDataFrame(items, ITEMS)
    got = {(r.doc_id, r.item_id): r.similarity for r in dc.find(docs, benchmark, item_block=15).collect()}
    share = {(d, i): len(shingle_set(t) & shingle_set(x)) / len(shingle_set(x)) for d, t in rows for i, x in items}
    assert got.keys() == planted == {k for k, v in share.items() if v >= 0.8}
    assert all(v == 1.0 for v in got.values())
    kept = {r.doc_id for r in dc.decontaminate(docs, benchmark, item_block=15).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in planted}


def test_edited_passage(spark):
    rnd = random.Random(3)
    item = [f"{c}{i}" for i in range(60) for c in rnd.choice("abc")]
    changed = list(item)
    changed[30] = "other"
    docs = docs_of(spark, [(1, " ".join(["x"] * 50 + changed + ["y"] * 50)), (2, " ".join(item[:30]))])
    got = dc.find(docs, spark.createDataFrame([(5, " ".join(item))], ITEMS)).collect()
    assert [(r.doc_id, r.item_id) for r in got] == [(1, 5)] and 0.8 <= got[0].similarity < 1


def test_all_fingerprints_within_the_radius_are_found():
    rnd = np.random.default_rng(1)
    index = dc.Index([(k, rnd.integers(0, 2 ** 63, 40, dtype=np.uint64)) for k in range(30)])
    prints, *_ = index.sizes[32]
    found, want = [], set()
    for k, p in enumerate(np.repeat(prints, 20)):
        bits = rnd.choice(64, rnd.integers(0, 16), replace=False)
        found.append(p ^ np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64)) if len(bits) else p)
        want |= {(k, w) for w, q in enumerate(prints) if int(found[-1] ^ q).bit_count() <= dc.RADIUS}
    which, window, distance = index.near(32, np.array(found, dtype=np.uint64))
    assert set(zip(which.tolist(), window.tolist())) == want and (distance <= dc.RADIUS).all()


def test_awkward_rows(spark):
    passage = "one two three four five six seven eight nine ten"
    items = spark.createDataFrame([(1, passage), (1, passage), (2, None), (3, ""), (4, "too short"), (None, passage + " eleven")], ITEMS)
    docs = clashing(docs_of(spark, [(1, None), (2, ""), (3, "too short"), (4, passage), (4, passage), (None, "x " + passage + " y"), (None, "clean"), (5, LONG_TEXT)]))
    got = {(r.doc_id, r.item_id) for r in dc.find(docs, items).collect()}
    assert {(4, 1), (None, 1)} <= got and {d for d, _ in got} == {4, None}
    out = dc.decontaminate(docs, items)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id) for r in out.collect())) == ["1", "2", "3", "5", "None"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], ITEMS)
    assert dc.find(docs_of(spark, [(1, "a b c d e f g h")]), none).count() == 0
    assert dc.decontaminate(docs_of(spark, [(1, "a b c d e f g h")]), none).count() == 1
    assert dc.find(docs_of(spark, []), none).count() == 0


def test_edited_copies_near_the_threshold_against_brute_force():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(6))
    for n, edits in ((50, (23, 25, 27)), (48, (22, 24, 25)), (50, (23, 24, 25, 26)), (50, (24, 26)), (80, (20, 40, 60)), (200, range(90, 124)), (12, (0,))):
        items = [[word() for _ in range(n)] for _ in range(60)]
        index = dc.index_of([(i, " ".join(w)) for i, w in enumerate(items)])
        texts, want = [], set()
        for i, item in enumerate(items):
            copy = [word() if at in edits else w for at, w in enumerate(item)]
            texts.append(" ".join([word() for _ in range(rnd.randint(0, 90))] + copy + [word() for _ in range(rnd.randint(0, 90))]))
            one, two = shingle_set(" ".join(item)), shingle_set(" ".join(copy))
            want |= {(i, i)} if len(one & two) >= 0.8 * len(one) else set()
        assert len(want) == 60 and index.matches(dc.Words(pa.array(texts))).keys() == want


def test_similarity_does_not_depend_on_blocks(spark):
    """Weights are counted over the whole benchmark: common shingles weigh the same in every block."""
    rnd = random.Random(21)
    shared = text_of(rnd, 12)
    items = [(i, (shared + " " if i % 3 else "") + text_of(rnd, rnd.randint(10, 40))) for i in range(60)] + [(60, None), (61, "too short"), (3, "a copy of an id")]
    rows = []
    for d in range(60):
        words = items[d % 60][1].split()
        for _ in range(rnd.randint(0, 2)):
            words[rnd.randrange(len(words))] = "edit"
        rows.append((d, text_of(rnd, 30) + " " + " ".join(words) + " " + text_of(rnd, 30)))
    docs, benchmark = docs_of(spark, rows), spark.createDataFrame(items, ITEMS)
    found = [sorted(tuple(r) for r in dc.find(docs, benchmark, item_block=n).collect()) for n in (5, 25, 10_000)]
    assert found[0] == found[1] == found[2] and any(r[2] < 1 for r in found[0]) and len(found[0]) > 30
    kept = [sorted(r.doc_id for r in dc.decontaminate(docs, benchmark, item_block=n).collect()) for n in (5, 10_000)]
    assert kept[0] == kept[1] == sorted({d for d, _ in rows} - {r[0] for r in found[0]})
