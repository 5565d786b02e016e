import random

import numpy as np

from sluice.llm import minhash
from tests.llm.helpers import LONG_TEXT, clashing, docs_of, shingle_set


def brute(rows, percent):
    sets = {d: shingle_set(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def varied(rnd, words, share):
    return [rnd.choice("pqrstuv") * 3 if rnd.random() < share else w for w in words]


def test_against_brute_force(spark):
    rnd = random.Random(11)
    rows, n = [], 0
    for _ in range(12):
        words = [f"{rnd.choice('abcdefgh')}{rnd.randint(0, 50)}" for _ in range(rnd.randint(30, 300))]
        for _ in range(rnd.randint(1, 12)):
            words = words if rnd.random() < 0.5 else varied(rnd, words, rnd.choice([0.0, 0.005, 0.01, 0.03]))
            rows.append((n, " ".join(words)))
            n += 1
    rnd.shuffle(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs_of(spark, rows), 85).collect()}
    assert got == brute(rows, 85)


def test_chain_whose_ends_are_unlike(spark):
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(12):  # each step changes other words; only neighbours are similar
        words = list(words)
        words[i * 15] = f"n{i}"
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows), 85).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 85).items()}


def test_pairs_across_components_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rnd = random.Random(2)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(varied(rnd, base, 0.02))) for i in range(60)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs_of(spark, rows), 80).collect()}
    assert got == {d: c for d, (_, c) in brute(rows, 80).items()}


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one two"), (5, "ONE\ttwo"), (6, "two one"), (7, LONG_TEXT), (8, LONG_TEXT), (None, "one two"), (9, "one two"), (9, "one two")]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows)).collect()), key=str)
    big = len(shingle_set(LONG_TEXT))
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 6, True), (7, big, 7, True),
                          (8, big, 7, False), (None, 1, None, True), (9, 1, 4, False), (9, 1, 4, False)], key=str)


def test_dedup_keeps_columns_and_one_of_each(spark):
    docs = clashing(docs_of(spark, [(1, "a b c"), (2, "a b c"), (3, None), (4, "x y"), (4, "x y"), (None, "a b c")]))
    out = minhash.dedup(docs)
    assert out.columns == docs.columns
    assert sorted((r.doc_id for r in out.collect()), key=str) == [1, 3, 4, None]


def test_empty_table(spark):
    assert minhash.near_duplicates(docs_of(spark, [])).count() == 0
    assert minhash.dedup(docs_of(spark, [])).count() == 0


def test_signatures_estimate_similarity():
    rnd = np.random.default_rng(1)
    x = rnd.integers(0, 2 ** 63, 1000, dtype=np.uint64)
    for share in (0.5, 0.8, 0.95):
        y = np.concatenate((x[:int(2000 * share / (1 + share))], rnd.integers(0, 2 ** 63, 1000 - int(2000 * share / (1 + share)), dtype=np.uint64)))
        a, b = (np.frombuffer(minhash.signature(s), "<u2") for s in (x, y))
        assert abs((a == b).mean() - share) < 0.12


A, B, C = ("alpha " + " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40)), " ".join(f"c{i}" for i in range(40)))


def test_rows_of_one_doc_id_are_judged_each_by_its_text(spark):
    """B has no copy anywhere and stays, however the rows are dealt."""
    rows = [(3, A), (5, A), (5, B)]
    for n in range(1, 6):
        docs = docs_of(spark, rows if n % 2 else rows[::-1]).repartition(n)
        assert sorted((r.doc_id, r.text) for r in minhash.dedup(docs).collect()) == [(3, A), (5, B)]
        got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect())
        assert got == [(3, 37, 3, True), (5, 36, 5, True), (5, 37, 3, False)]


def test_classes_that_share_their_least_doc_id(spark):
    """Both classes are represented, each by its own signature and text."""
    near_b, near_c = B.replace("b20", "zz"), C.replace("c39", "zz")
    rows = [(1, B), (1, C), (2, near_b), (3, near_c), (3, B), (4, near_c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs_of(spark, rows), 70).collect())
    assert got == [(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (4, 1, False)]
    kept = sorted((r.doc_id, r.text) for r in minhash.dedup(docs_of(spark, rows), 70).collect())
    assert kept == [(1, B), (1, C)]


def test_equal_rows_and_null_texts_of_one_doc_id(spark):
    rows = [(7, B), (7, B), (8, None), (8, ""), (8, "x y"), (9, "X y"), (None, B), (None, B)]
    assert sorted(((r.doc_id, r.text or "") for r in minhash.dedup(docs_of(spark, rows)).collect()), key=str) == sorted(
        [(7, B), (8, ""), (8, "x y"), (None, B), (None, B)], key=str)


def test_only_members_outside_the_largest_component_are_multiplied(spark, monkeypatch):
    """A bucket of 20,000 near copies and one odd member: each near copy is in one block, the odd one in all."""
    from pyspark.sql import functions as F
    name = lambda c: F.struct(c.cast("long").alias("doc_id"), F.lit(b"t").alias("t"))
    members = spark.range(20_001).select(F.lit(1).alias("key"), name(F.col("id")).alias("rep"), name(F.when(F.col("id") == 77, 77).otherwise(0)).alias("component"),
                                         name(F.lit(0)).alias("main"), F.lit(1).cast("long").alias("few"), F.lit(5).cast("long").alias("many"))
    got = minhash.blocks(members)
    assert got.count() == 20_000 + 5
    sizes = [r["count"] for r in got.groupBy("s.x", "s.y").count().collect()]
    assert len(sizes) == 5 and max(sizes) < 4_500


def test_all_pairs_outside_the_largest_component_meet_once(spark):
    from pyspark.sql import functions as F
    name = lambda c: F.struct(c.cast("long").alias("doc_id"), F.lit(b"t").alias("t"))
    members = spark.range(60).select(F.lit(1).alias("key"), F.col("id"), name(F.col("id")).alias("rep"), name(F.when(F.col("id") < 30, F.col("id") + 1).otherwise(0)).alias("component"),
                                     name(F.lit(0)).alias("main"), F.lit(3).cast("long").alias("few"), F.lit(2).cast("long").alias("many"))
    met = {}
    by_block = {}
    for r in minhash.blocks(members).select("id", "chunk", "s.*").collect():
        by_block.setdefault((r.x, r.y, r.inner), []).append((r.id, r.chunk))
    assert len({k[:2] for k in by_block}) == len(by_block)
    for (x, y, inner), rows in by_block.items():
        assert {c for _, c in rows} <= {x, y}
        for i, c in rows:
            for j, d in rows:
                if c == x and (d != x or (inner and j > i)):
                    pair = frozenset((i, j))
                    met[pair] = met.get(pair, 0) + 1
    assert met == {frozenset((i, j)): 1 for i in range(30) for j in range(60) if i < j or j >= 30}
