"""Near-duplicate documents by min-max hashing.

A document's set holds its distinct 5-word shingles (A-Z in lower case; fewer words make one shingle, none an empty set that is
linked with nothing).  Each of ``PERMUTATIONS`` permutations gives two values of the signature, the smallest and the largest
element, so there are half as many hash evaluations as values; the share of equal values is an unbiased estimate of the
similarity.  ``ROWS`` values make a band: documents that agree in a band share a bucket and are candidates.  With 32 bands of 6
values a pair at similarity 0.85 shares none with probability 3e-7.

A row is named by its doc_id and the digest of its text, so rows that share a doc_id are judged each by its own text.  Equal sets are
collapsed first; the least (doc_id, digest) of a class stands for it.  Candidates are confirmed on full sets, in two steps that join all that is linked without
making all pairs of a group: (1) every document with the smallest member of its buckets, one candidate each; (2) buckets
that still hold several components, in blocks of at most ``BLOCK`` members and ``BLOCK_SHINGLES`` shingles on a side: the members
outside a bucket's largest component meet each other and the rest, which is not multiplied for them.  Pairs across components
that the signatures do not rule out (``SIGMAS`` standard errors) are checked in place, and only links leave the task.  Pairs within one
component need no check, as they cannot change it.

Null text is empty text.  A row with null doc_id is linked with nothing.  Rows of one doc_id with unlike texts keep their own classes, all
with that doc_id or a smaller one as component_id.  Empty tables give empty results.  ``dedup`` keeps all columns of its input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Words, mix, row_slices, shingles, ship, signed, stored

PERMUTATIONS = 96
ROWS = 6
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 80
BLOCK = 4096
BLOCK_SHINGLES = 2_000_000
SIGMAS = 6.0
_U = np.uint64
_SEEDS = mix(np.arange(1, 2 * PERMUTATIONS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)).reshape(2, PERMUTATIONS)
_XOR, _FACTOR = _SEEDS[0][:, None], (_SEEDS[1] | _U(1))[:, None]
SIGNED = "doc_id long, t binary, n_shingles long, d1 long, d2 long, signature binary"
NAME = "struct<doc_id:long,t:binary>"
_NAME = pa.struct([("doc_id", pa.int64()), ("t", pa.binary())])
SET = ["d1", "d2", "n_shingles"]


def signature(elements: np.ndarray) -> bytes:
    """16 bits of the smallest and of the largest element under each permutation; first all smallest, then all largest."""
    low = np.full(PERMUTATIONS, np.iinfo(_U).max, dtype=_U)
    high = np.zeros(PERMUTATIONS, dtype=_U)
    for at in range(0, len(elements), 2048):
        v = (elements[None, at:at + 2048] ^ _XOR) * _FACTOR
        np.minimum(low, v.min(axis=1), out=low)
        np.maximum(high, v.max(axis=1), out=high)
    return (mix(np.concatenate((low, high))) >> _U(48)).astype("<u2").tobytes()


def named_texts(docs: DataFrame) -> DataFrame:
    """doc_id, text and the digest t of the text of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("t"))


def signatures(docs: DataFrame) -> DataFrame:
    """Size, 128-bit digest and signature of every row's set; the signature of an empty set is null."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch.column(1)):
                words = Words(batch.column(1).slice(a, b - a))
                n, d1, d2, sigs = [], [], [], []
                for i in range(b - a):
                    s = np.unique(shingles(words.row(i)))
                    n.append(len(s))
                    d1.append(mix(s).sum(dtype=_U))
                    d2.append(mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=_U))
                    sigs.append(signature(s) if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(2).slice(a, b - a), pa.array(n, pa.int64()), pa.array(signed(np.array(d1, _U))), pa.array(signed(np.array(d2, _U))),
                     pa.array(sigs, pa.binary())], [c.split()[0] for c in SIGNED.split(", ")])

    return named_texts(docs).mapInArrow(run, SIGNED)


def buckets(reps: DataFrame) -> DataFrame:
    """(key, band, rep, n) for every band of every representative."""
    width = 2 * ROWS
    band = lambda b: F.struct(b.alias("band"), F.xxhash64(b, F.substring("signature", b * width + 1, F.lit(width))).alias("key"))
    return reps.select("rep", "n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("b")) \
        .select("b.key", "b.band", "rep", "n")


def similar(n_common: int, n_a: int, n_b: int, percent: int) -> bool:
    return 100 * n_common >= percent * (n_a + n_b - n_common)


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; ``texts`` has (rep, text), one row per representative."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for lo, hi in row_slices(batch.column(2), 1 << 20):
                one, two = (Words(batch.column(c).slice(lo, hi - lo)) for c in (2, 3))
                for i in range(hi - lo):
                    x, y = np.unique(shingles(one.row(i))), np.unique(shingles(two.row(i)))
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if similar(both, len(x), len(y), percent):
                        keep.append(lo + i)
            take = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take)], ["a", "b"])

    return pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b") \
        .join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a") \
        .select("a", "b", "text_a", "text_b").mapInArrow(run, f"a {NAME}, b {NAME}")


def components(edges: DataFrame) -> DataFrame:
    """(rep, component) of all nodes with an edge, by alternating large-star and small-star steps; every step is stored."""
    now = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("rep"), F.col("v").alias("component")).unionByName(
                now.select(F.col("v").alias("rep"), F.col("v").alias("component")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = stored(small.where("u <> v").distinct(), "edges")


def blocks(members: DataFrame) -> DataFrame:
    """The members of mixed buckets dealt to blocks (key, x, y) of two chunks.

    ``members`` has key, rep, component and, of its bucket, main (the largest component), few (chunks of the members outside it) and
    many (chunks of its own).  Chunk x < few always lies outside the largest component; ``inner`` marks the one block of a chunk
    x in which the pairs inside x are looked at too.
    """
    place = lambda of: F.pmod(F.xxhash64("rep"), of)
    block = lambda x, y, inner: F.struct(x.alias("x"), y.alias("y"), inner.alias("inner"))
    few, many, zero = F.col("few"), F.col("many"), F.lit(0).cast("long")
    outside = F.col("component") != F.col("main")
    chunk = F.when(outside, place(few)).otherwise(few + place(many))
    beside = F.transform(F.filter(F.sequence(zero, few - 1), lambda g: g != F.col("chunk")), lambda g: block(F.least("chunk", g), F.greatest("chunk", g), F.lit(False)))
    across_ = F.transform(F.sequence(zero, many - 1), lambda c: block(F.col("chunk"), few + c, c == 0))
    from_main = F.transform(F.sequence(zero, few - 1), lambda g: block(g, F.col("chunk"), F.col("chunk") == few))
    return members.withColumn("chunk", chunk).withColumn("s", F.explode(F.when(outside, F.concat(beside, across_)).otherwise(from_main)))


def across(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components that share a bucket, enough of them to join all components that are linked.

    A task holds one block at a time.  Within a block the members of chunk x meet the members of other components whose
    signature does not rule the similarity out, the likeliest first, each pair only in the first band that it has in common; a
    pair whose components a link has joined meanwhile needs no check.
    """
    t = percent / 100
    floor = t - SIGMAS * math.sqrt(t * (1 - t) / (2 * PERMUTATIONS))
    dealt = blocks(members).select("key", "s.x", "s.y", "s.inner", "band", "chunk", "rep", "n", "component", "signature", "text")
    dealt = dealt.repartition(F.col("key"), F.col("x"), F.col("y")).sortWithinPartitions("key", "x", "y")

    def links_of(block: list[tuple]) -> list[tuple[dict, dict]]:
        _, x, _, inner, band, *_ = block[0]
        names = [(r[8]["doc_id"], r[8]["t"]) for r in block]
        label = {c: k for k, c in enumerate(sorted(set(names)))}
        if len(label) == 1:
            return []
        component = np.array([label[c] for c in names])
        chunk, n = (np.array([r[k] for r in block]) for k in (5, 7))
        sig = np.frombuffer(b"".join(r[9] for r in block), "<u2").reshape(len(block), 2 * PERMUTATIONS)
        parent = list(range(len(label)))
        sets: dict[int, np.ndarray] = {}
        place = np.arange(len(block))

        def root(c: int) -> int:
            while parent[c] != c:
                c = parent[c]
            return c

        def set_of(k: int) -> np.ndarray:
            if k not in sets:
                sets[k] = np.unique(shingles(Words(pa.array([block[k][10]], pa.string())).row(0)))
            return sets[k]

        out = []
        for i in np.flatnonzero(chunk == x):
            j = np.flatnonzero((component != component[i]) & ((chunk != x) | (inner & (place > i))))
            j = j[100 * np.minimum(n[j], n[i]) >= percent * np.maximum(n[j], n[i])]
            if not len(j):
                continue
            equal = sig[j] == sig[i]
            share = equal.mean(axis=1)
            ok = (share >= floor) & (np.argmax(equal.reshape(len(j), BANDS, ROWS).all(axis=2), axis=1) == band)
            for k in j[ok][np.argsort(-share[ok], kind="stable")].tolist():
                one, two = root(int(component[i])), root(int(component[k]))
                if one == two:
                    continue
                a, b = set_of(int(i)), set_of(k)
                if similar(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b), percent):
                    parent[max(one, two)] = min(one, two)
                    out.append((block[i][6], block[k][6]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        found: list[tuple[int, int]] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if block and row[:3] != block[0][:3]:
                    found += links_of(block)
                    block = []
                block.append(row)
        if block:
            found += links_of(block)
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], _NAME) for k in (0, 1)], ["a", "b"])

    return dealt.mapInArrow(run, f"a {NAME}, b {NAME}")


def judged(docs: DataFrame, percent: int) -> DataFrame:
    """Per row: doc_id, t, n_shingles and component, the name of the row that stands for all rows linked with it (null: linked with nothing)."""
    every = stored(signatures(docs), "signatures")
    own = F.struct("doc_id", "t")
    named = every.where("n_shingles > 0 and doc_id is not null")
    classes = stored(named.groupBy(*SET).agg(F.min(own).alias("rep")), "classes")
    reps = stored(named.join(classes, SET).where(own == F.col("rep"))
                  .select("rep", F.col("n_shingles").alias("n"), "signature").dropDuplicates(["rep"]), "representatives")
    banded = buckets(reps)
    hubs = banded.groupBy("key").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("size")).where("size > 1").drop("size")
    star = stored(banded.join(hubs, "key"), "stars")
    asked = star.select("rep").distinct()
    texts = stored(named_texts(docs).select(own.alias("rep"), "text").join(asked, "rep").dropDuplicates(["rep"]), "candidate_texts")
    first = star.where("rep <> hub").groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")).select("a", "b")
    edges = stored(confirm(first, texts, percent), "links")
    known = stored(components(edges), "components")

    def component_of(ids: DataFrame) -> DataFrame:
        return ids.join(known, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    member = component_of(star.drop("hub"))
    parts = member.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"))
    chunks = lambda c, n: F.greatest(F.lit(1), F.ceil(c / BLOCK), F.ceil(n / BLOCK_SHINGLES)).cast("long")
    main = F.max(F.struct("c", "component", "n"))
    mixed = parts.groupBy("key").agg(main.alias("main"), F.sum("c").alias("c"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("components")) \
        .where("components > 1").select("key", chunks(F.col("c") - F.col("main.c"), F.col("n") - F.col("main.n")).alias("few"),
                                        chunks(F.col("main.c"), F.col("main.n")).alias("many"), F.col("main.component").alias("main"))
    inside = member.join(mixed, "key").join(reps.select("rep", "signature"), "rep").join(texts, "rep")
    more = stored(across(inside, percent), "links")
    edges = edges.unionByName(more)
    known = stored(components(edges), "components")
    linked = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component")).alias("component")
    return every.select("doc_id", "t", *SET).join(component_of(classes).select(*SET, "component"), SET, "left").select("doc_id", "t", "n_shingles", linked)


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest doc_id reachable) and kept (whether it is that document)."""
    component = F.coalesce("component.doc_id", "doc_id")
    return judged(docs, percent).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each class; of rows that share doc_id and text one stays, rows with null doc_id all stay."""
    gone = judged(docs.select("doc_id", "text"), percent).where(F.struct("doc_id", "t") != F.col("component")).select("doc_id", "t").distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("t"))
    named = rows.where("doc_id is not null").join(gone, ["doc_id", "t"], "left_anti").dropDuplicates(["doc_id", "t"])
    return named.unionByName(rows.where("doc_id is null")).select("row.*")
