"""Benchmark decontamination by SimHash windows.

Every benchmark item of ``MIN_WORDS`` words or more gives two windows, its first and its last W words, where W is the largest power of two
within 0.8 of its length.  A window's fingerprint is the 64-bit SimHash of its word pairs.  Documents are read in windows of the
same sizes, a sixteenth of a window apart, whose fingerprints come from prefix sums.  The fingerprint has four blocks of 16
bits; two fingerprints within ``RADIUS`` = 11 bits differ in at most 2 bits of some block, and the index lists every block
value within 2 bits, so no fingerprint within the radius is missed.  Edits can move both windows beyond the radius, so the rarest
shingles of every item are looked up as well, as many as weigh more than 1 - ``THRESHOLD`` of the item: a place without any of
them is below the threshold.  What is found is verified: the item's place in the document
follows from the window, and the weighted share of the item's distinct 5-word shingles found in the item-sized window there
(widened by the step) must be at least ``THRESHOLD``.  A shingle's weight is the log of items over items that have it, plus one, counted
over the whole benchmark, so a similarity does not depend on how items are dealt.

Items are handled in blocks of about ``ITEM_BLOCK``, so a task never holds more than a block's index (about 5 KB an item) at a time.  A block
carries its items and the counts of their shingles.

Null text and short texts match nothing; null items and items with fewer words than ``MIN_WORDS`` match nothing.  Repeated items are
reported each; of rows that share a doc_id the best match is reported.  Empty tables give empty results.  Only doc_id, text and
item_id are read; ``decontaminate`` keeps all columns.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Words, mix, row_slices, shingles, ship, signed, stored

MIN_WORDS = 8
THRESHOLD = 0.8
RADIUS = 11
BLOCKS = 4
ITEM_BLOCK = 20_000
SEGMENT = 4096  # words whose bit counts are held together
MATCHES = "doc_id long, item_id long, similarity double, start_word long, n_words long, distance int"
_U = np.uint64


def pairs(words: np.ndarray) -> np.ndarray:
    """Hashes of all word pairs."""
    return mix(words[:-1] * _U(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words[:0]


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """Row i: how often each of 64 bits is set in the first i hashes."""
    bits = np.unpackbits(np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8), axis=1)
    out = np.zeros((len(hashes) + 1, 64), dtype=np.int16 if len(hashes) < 32_000 else np.int32)
    np.cumsum(bits, axis=0, out=out[1:])
    return out


def simhashes(counts: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of n hashes from each start on, from bit counts."""
    more = (counts[starts + n] - counts[starts]) * 2 > n
    return np.packbits(more, axis=1).view(_U).ravel()


def size_of(n_words: int) -> int:
    """Window of an item: the largest power of two within 0.8 of its words, 8 at least."""
    return 1 << max(3, int(0.8 * n_words).bit_length() - 1)


class Index:
    """Fingerprints of the windows of some items, by window size and block.

    ``counted`` is what the weights rest on: shingles in order, how many items of the whole benchmark have each, and the number of items;
    without it these items are the whole benchmark.
    """

    def __init__(self, items: list[tuple[int, np.ndarray]], radius: int = RADIUS, counted: tuple[np.ndarray, np.ndarray, int] | None = None):
        self.items = [(i, w) for i, w in items if len(w) >= MIN_WORDS]
        self.radius = radius
        self.lengths = np.array([len(w) for _, w in self.items], dtype=np.int64)
        per_block = radius // BLOCKS
        flips = np.array([sum(1 << b for b in some) for n in range(per_block + 1) for some in combinations(range(16), n)], dtype=np.uint16)
        self.shingles = [np.unique(shingles(w)) for _, w in self.items]
        if counted is None:
            counted = (*(np.unique(np.concatenate(self.shingles), return_counts=True) if self.items else (np.zeros(0, _U), np.zeros(0))), len(self.items))
        every, n_items, total = counted
        self.known, weight = every, 1 + np.log(max(1, total) / np.maximum(n_items, 1))
        self.weights = [weight[np.searchsorted(every, s)] for s in self.shingles]
        self.least = np.array([w.sum() / w.max() for w in self.weights])  # a share of the weight needs that share of so many shingles
        windows: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # size -> (fingerprint, item, where it lies)
        for k, (_, w) in enumerate(self.items):
            size = size_of(len(w))
            counts = bit_counts(pairs(w))
            for at in sorted({0, len(w) - size}):
                windows[size].append((int(simhashes(counts, np.array([at]), size - 1)[0]), k, at))
        self.rare: dict[float, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        self.steps = np.array([max(1, size_of(n) // 16) for n in self.lengths], dtype=np.int64)
        self.sizes = {}
        for size, rows in windows.items():
            prints = np.array([r[0] for r in rows], dtype=_U)
            tables = []
            for block in range(BLOCKS):
                values = (prints >> _U(16 * block)).astype(np.uint16)[:, None] ^ flips
                flat = values.ravel()
                order = np.argsort(flat, kind="stable")
                first = np.searchsorted(flat[order], np.arange(65537))
                tables.append((first, (order // len(flips)).astype(np.int32)))
            self.sizes[size] = (prints, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), tables)

    def rarest(self, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(keys, first, item, place): shingles of which every place with at least ``threshold`` of an item holds one; those of key i
        are the items and places from first[i] to first[i + 1]."""
        if threshold not in self.rare:
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for k, (_, w) in enumerate(self.items):
                order = np.argsort(-self.weights[k], kind="stable")
                weight = np.cumsum(self.weights[k][order])
                n = 1 + np.searchsorted(weight, (1 - threshold + 1e-9) * weight[-1], "right")
                every = shingles(w)
                at = np.flatnonzero(np.isin(every, self.shingles[k][order[:n]]))
                found.append((every[at], np.full(len(at), k), at))
            key, item, place = (np.concatenate(c) for c in zip(*found))
            order = np.argsort(key, kind="stable")
            keys, first = np.unique(key[order], return_index=True)
            self.rare[threshold] = keys, np.append(first, len(key)), item[order], place[order]
        return self.rare[threshold]

    def near(self, size: int, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``found``, window, distance) of all pairs within the radius; a pair may come from several blocks."""
        prints, _, _, tables = self.sizes[size]
        out = []
        for block, (first, window) in enumerate(tables):
            value = (found >> _U(16 * block)).astype(np.uint16).astype(np.int64)
            many = first[value + 1] - first[value]
            which = np.repeat(np.arange(len(found)), many)
            slot = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + first[value][which]
            w = window[slot]
            distance = np.bitwise_count(found[which] ^ prints[w])
            ok = distance <= self.radius
            out.append((which[ok], w[ok], distance[ok]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def matches(self, words: Words, threshold: float = THRESHOLD) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item) -> (similarity, first word, distance) of the item's best place in that row's text."""
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        total = len(words.hash)
        if total < MIN_WORDS or not self.sizes:
            return best
        row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
        end_of = words.first[1:][row]  # where the text that holds a word ends
        own, two = shingles(words.hash), pairs(words.hash)
        inside = np.arange(total) - words.first[row]
        place = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        hit = np.concatenate(([0], np.cumsum(self.known[place] == own)))  # how many shingles of any item lie before each place

        def distance_at(text: int, start: int, j: int) -> int:
            """Distance of the item's first window from the text's window at ``start``, or as near to it as the text has one."""
            size = min(size_of(len(self.items[j][1])), int(words.first[text + 1] - words.first[text]))
            start = min(max(start, int(words.first[text])), int(words.first[text + 1]) - size)
            one, other = (int(simhashes(bit_counts(pairs(w)), np.array([0]), size - 1)[0]) for w in (words.hash[start:start + size], self.items[j][1][:size]))
            return (one ^ other).bit_count()

        def verify(text: np.ndarray, k: np.ndarray, start: np.ndarray, distance: np.ndarray) -> None:
            """Keep the best of the items ``k`` that may begin at the places ``start``; a distance of -1 is measured if needed."""
            first, last = words.first[text], words.first[text + 1] - 4
            begin = np.clip(start - self.steps[k], first, np.maximum(first, last))
            end = np.clip(start + self.lengths[k] - 4 + self.steps[k], begin, np.maximum(begin, last))
            some = np.flatnonzero(hit[end] - hit[begin] >= np.maximum(1, threshold * self.least[k] - 1e-6))
            for r, b, e, j, d, s in sorted(set(zip(*(c[some].tolist() for c in (text, begin, end, k, distance, start))))):
                share = np.isin(self.shingles[j], own[b:e])
                similarity = float(self.weights[j][share].sum() / self.weights[j].sum())
                have = best.get((r, j))
                if similarity < threshold or (have is not None and similarity < have[0]):
                    continue
                d = distance_at(r, s, j) if d < 0 else d
                b -= int(words.first[r])
                if have is None or (-similarity, d, b) < (-have[0], have[2], have[1]):
                    best[r, j] = (similarity, b, d)

        for lo in range(0, total, SEGMENT):
            counts = bit_counts(two[lo:lo + SEGMENT + max(self.sizes)])
            ends = words.first[np.searchsorted(words.first, lo, "right"):np.searchsorted(words.first, lo + SEGMENT + max(self.sizes), "right")]
            for size, (_, item, at, _) in self.sizes.items():
                mark = inside[lo:lo + SEGMENT] % max(1, size // 16) == 0
                last = ends - size - lo
                mark[last[(last >= 0) & (last < len(mark))]] = True
                starts = np.flatnonzero(mark) + lo
                starts = starts[starts + size <= end_of[starts]]  # windows lie within one text; its last window is among them
                which, window, distance = self.near(size, simhashes(counts, starts - lo, size - 1))
                if len(which):
                    verify(row[starts[which]], item[window], starts[which] - at[window], distance.astype(np.int64))
        keys, first, item, place = self.rarest(threshold)
        slot = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        where = np.flatnonzero((keys[slot] == own) & (np.arange(len(own)) + 5 <= end_of[:len(own)]))
        slot = slot[where]
        many = first[slot + 1] - first[slot]
        where = np.repeat(where, many)
        which = np.arange(len(where)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[slot], many)
        verify(row[where], item[which], where - place[which], np.full(len(where), -1))
        return best


Block = tuple[list[tuple[int | None, str]], np.ndarray, np.ndarray, int]


def item_blocks(benchmark: DataFrame, item_block: int = ITEM_BLOCK) -> Iterator[Block]:
    """Items in blocks of about ``item_block``, each with the counts of its shingles over the whole benchmark; there is always a block."""
    ship(benchmark.sparkSession)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column(1))
            rows = [np.unique(shingles(words.row(i))) if len(words.row(i)) >= MIN_WORDS else np.zeros(0, _U) for i in range(batch.num_rows)]
            block = np.repeat(batch.column(2).to_numpy(), [len(r) for r in rows])
            yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(signed(np.concatenate(rows)))], ["block", "shingle"])

    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n_blocks = max(1, -(-given.count() // item_block))
    items = stored(given.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))), "items")
    by_block = stored(items.mapInArrow(split, "block long, shingle long").groupBy("block", "shingle").agg(F.count(F.lit(1)).alias("n")), "item_shingles")
    whole = by_block.groupBy("shingle").agg(F.sum("n").alias("n"))
    counts = stored(by_block.select("block", "shingle").join(whole, "shingle"), "shingle_counts")
    n_words = F.size(F.filter(F.split("text", "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))
    total = items.where(n_words >= MIN_WORDS).count()
    for k in range(n_blocks):  # a block of items and of their shingles at a time
        rows = items.where(F.col("block") == k).select("item_id", "text").collect()
        table = counts.where(F.col("block") == k).select("shingle", "n").toArrow()
        keys = table.column("shingle").to_numpy().astype(np.int64).view(_U)
        order = np.argsort(keys)
        yield (sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1])),
               keys[order], table.column("n").to_numpy()[order], total)


def index_of(items: list[tuple[int | None, str]], *counted) -> Index:
    """The index of some items; ``counted`` as in a block, else these items are the whole benchmark."""
    words = Words(pa.array([t for _, t in items], pa.string()))
    return Index([(i, words.row(k)) for k, (i, _) in enumerate(items)], counted=counted or None)


def find(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_block: int = ITEM_BLOCK) -> DataFrame:
    """(doc_id, item_id) of all documents that hold an item, with the best similarity and its place."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))

    def scan(block: Block) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = index_of(*block)
            for batch in batches:
                out = []
                for a, b in row_slices(batch.column(1)):
                    for (i, j), (similarity, at, distance) in index.matches(Words(batch.column(1).slice(a, b - a)), threshold).items():
                        out.append((batch.column(0)[a + i].as_py(), index.items[j][0], similarity, at, len(index.items[j][1]), distance))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(
                    (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32()))], [c.split()[0] for c in MATCHES.split(", ")])

        return texts.mapInArrow(run, MATCHES)

    found = None
    for block in item_blocks(benchmark, item_block):
        one = scan(block)
        found = one if found is None else found.unionByName(one)
    order = F.struct("similarity", (-F.col("distance")).alias("d"), (-F.col("start_word")).alias("s"), "n_words")
    return found.groupBy("doc_id", "item_id").agg(F.max(order).alias("m")).select(
        "doc_id", "item_id", "m.similarity", (-F.col("m.s")).alias("start_word"), "m.n_words", (-F.col("m.d")).alias("distance"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``docs`` without the rows that hold an item; rows are judged where they lie, without a shuffle."""
    ship(docs.sparkSession)

    def holds(block: Block):
        made: list[Index] = []

        @F.pandas_udf("boolean")
        def run(texts: pd.Series) -> pd.Series:
            if not made:
                made.append(index_of(*block))
            column = pa.array(texts, pa.string(), from_pandas=True)
            out = np.zeros(len(texts), dtype=bool)
            for a, b in row_slices(column):
                for i, _ in made[0].matches(Words(column.slice(a, b - a)), threshold):
                    out[a + i] = True
            return pd.Series(out)

        return run(F.col("text").cast("string"))

    for block in item_blocks(benchmark, item_block):
        docs = docs.where(~holds(block))
    return docs
