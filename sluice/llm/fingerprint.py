"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds, for every length, the sum of (code point + 1) * base**position modulo a prime; two primes are
used.  With it any two spans are compared in constant time, and the longest common extension of two positions is found by
binary search.  A text's fingerprint is its length, the value of its whole prefix array, and the values of prefixes and suffixes
whose lengths are multiples of a step: the power of two that gives at most 64 of each.  A coarser step's places are among a
finer one's, so any two stored fingerprints can be compared without their texts: binary search over the places that both have
gives the longest common prefix and suffix, down to one step.  Their likeness is the share of the longer text that these two
(which do not overlap) cover for certain; ``bounds`` also gives the most they can cover.  The exact share, from the whole prefix
arrays, is less than a sixteenth above it, and equal up to 64 code points.

``compare_next`` meets every document with the next one by doc_id.  Documents move once, to a range of doc_id; each range
also gets the first document of the range after it, and only that one.

Null text is empty text; two empty texts are alike (1.0).  A null doc_id comes first.  Documents with equal doc_id are ordered
by text; where they fill several ranges, by ranges of a hash of the text and by text inside each.  A single document follows itself.  An empty table gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Ranges, ship

RANGE_BYTES = 16 << 20
PRIMES = (2_147_483_647, 2_147_483_629)
BASES = (1_000_003_471, 1_594_320_089)
INVERSE = pow(BASES[0], -1, PRIMES[0])
MARKS = 64
COMPARED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double, exact_edited double, exact_next double")
_POWERS: dict[int, np.ndarray] = {}


def powers(k: int, n: int) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo the k-th prime; for k = -1 those of the first base's inverse."""
    have = _POWERS.get(k)
    if have is None or len(have) < n:
        have = np.ones(1 << max(12, (n - 1).bit_length()), dtype=np.uint64)
        done, (step, p) = 1, (BASES[k], PRIMES[k]) if k >= 0 else (INVERSE, PRIMES[0])
        while done < len(have):
            have[done:2 * done] = have[:done] * np.uint64(step) % np.uint64(p)
            done, step = 2 * done, step * step % p
        _POWERS[k] = have
    return have[:n]


def step_of(n: int) -> int:
    """The least power of two of which at most MARKS multiples lie within n."""
    step = 1
    while n // step > MARKS:
        step *= 2
    return step


@dataclass(frozen=True, eq=False)
class Fingerprint:
    """Length, hash of the whole text, hashes of its prefixes and suffixes at multiples of ``step_of(n)``."""
    n: int
    whole: str
    heads: np.ndarray
    tails: np.ndarray

    def __str__(self) -> str:
        return "-".join([f"{self.n:x}", self.whole, *(base64.b64encode(m.tobytes()).decode() for m in (self.heads, self.tails))])

    @staticmethod
    def parse(text: str) -> Fingerprint:
        n, whole, *marks = text.split("-")
        return Fingerprint(int(n, 16), whole, *(np.frombuffer(base64.b64decode(m), "<u4") for m in marks))


def bounds(a: Fingerprint, b: Fingerprint) -> tuple[float, float]:
    """Least and greatest share of the longer text that the longest common prefix and suffix can cover."""
    if (a.n, a.whole) == (b.n, b.whole):
        return 1.0, 1.0
    own, other = step_of(a.n), step_of(b.n)
    step = max(own, other)
    sizes = []
    for x, y in ((a.heads, b.heads), (a.tails, b.tails)):
        x, y = x[step // own - 1::step // own], y[step // other - 1::step // other]
        lo, hi = 0, min(len(x), len(y))
        while lo < hi:  # spans that agree at one place agree at all before it
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if x[mid - 1] == y[mid - 1] else (lo, mid - 1)
        sizes.append(lo * step)
    shorter, longer = sorted((a.n, b.n))
    return min(shorter, sum(sizes)) / longer, min(shorter, sum(sizes) + 2 * (step - 1)) / longer


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
        self.n = len(codes)
        self.sums = np.zeros((2, self.n + 1), dtype=np.uint64)
        for k, p in enumerate(PRIMES):  # each term is below 2**31, so sums of 2**33 of them fit
            self.sums[k, 1:] = np.cumsum(codes * powers(k, self.n) % np.uint64(p)) % np.uint64(p)

    def fingerprint(self) -> Fingerprint:
        step = step_of(self.n)
        lengths = np.arange(step, self.n + 1, step)
        heads, p = self.sums[0], np.uint64(PRIMES[0])
        tails = (heads[-1] + p - heads[self.n - lengths]) % p * powers(-1, self.n + 1)[self.n - lengths] % p
        return Fingerprint(self.n, f"{int(heads[-1]):08x}{int(self.sums[1, -1]):08x}", heads[lengths].astype("<u4"), tails.astype("<u4"))

    def span(self, k: int, i: int, n: int, shift: int) -> int:
        """Hash of [i, i + n) as if it began at ``shift`` more."""
        p = PRIMES[k]
        return (int(self.sums[k, i + n]) - int(self.sums[k, i])) % p * int(powers(k, shift + 1)[shift]) % p


def equal(a: Prefixes, i: int, b: Prefixes, j: int, n: int) -> bool:
    """Whether a[i:i + n] and b[j:j + n] have equal hashes."""
    return all(a.span(k, i, n, j) == b.span(k, j, n, i) for k in (0, 1))


def extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """Length of the longest common extension to the right of a[i:] and b[j:]."""
    lo, hi = 0, min(a.n - i, b.n - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(a, i + lo, b, j + lo, mid - lo) else (lo, mid - 1)
    return lo


def extension_left(a: Prefixes, i: int, b: Prefixes, j: int, most: int) -> int:
    """Length, at most ``most``, of the longest common extension to the left of a[:i] and b[:j]."""
    lo, hi = 0, min(i, j, most)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if equal(a, i - mid, b, j - mid, mid - lo) else (lo, mid - 1)
    return lo


def likeness(a: Prefixes, b: Prefixes) -> float:
    """The exact share of the longer text that the longest common prefix and suffix cover."""
    if a.n == b.n == 0:
        return 1.0
    head = extension(a, 0, b, 0)
    tail = extension_left(a, a.n, b, b.n, min(a.n, b.n) - head)
    return (head + tail) / max(a.n, b.n)


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    k = len(text) // 2
    return text[:len(text) - k] + following[:k]


def compare_next(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Per document: fingerprints of it and of its edited text, their likeness and that to the next document's, and the exact shares."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = Ranges(rows, "doc_id", F.octet_length("text") + 200, range_bytes, F.xxhash64("text"))
    dealt = ranges.with_shard(rows)
    order = F.struct(F.col("doc_id").isNotNull(), "doc_id")
    first = dealt.groupBy("shard").agg(F.min(order).alias("first"))
    heads = sorted((r["shard"], r["first"]["doc_id"]) for r in first.collect())  # one row per range
    if not heads:
        return docs.sparkSession.createDataFrame([], COMPARED)
    follow = docs.sparkSession.createDataFrame(
        [(*heads[(k + 1) % len(heads)], shard) for k, (shard, _) in enumerate(heads)], "shard int, head long, target int")
    after = dealt.join(F.broadcast(follow), "shard").where(F.col("doc_id").eqNullSafe(F.col("head"))) \
        .groupBy(F.col("target").alias("shard"), F.lit(True).alias("after"), "doc_id").agg(F.min("text").alias("text"))  # one row per range
    both = dealt.select("shard", F.lit(False).alias("after"), "doc_id", "text").unionByName(after)
    sorted_rows = both.repartitionById(ranges.n_shards, F.col("shard")) \
        .sortWithinPartitions("shard", "after", F.col("doc_id").asc_nulls_first(), "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (doc_id, text, prefixes, fingerprint) that waits for the document after it
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                _, is_after, doc_id, text = (c[i].as_py() for c in batch.columns)
                if held is None and is_after:
                    continue
                own = Prefixes(text)
                mark = own.fingerprint()
                if held is not None:
                    before_id, before, prefixes, before_mark = held
                    changed = edited(before, text)
                    there = Prefixes(changed)
                    there_mark = there.fingerprint()
                    out.append((before_id, len(before), hashlib.sha256(changed.encode()).hexdigest(), str(before_mark), str(there_mark),
                                bounds(before_mark, there_mark)[0], bounds(before_mark, mark)[0], likeness(prefixes, there), likeness(prefixes, own)))
                held = None if is_after else (doc_id, text, own, mark)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4))],
                [c.split()[0] for c in COMPARED.split(", ")])

    return sorted_rows.mapInArrow(compare, COMPARED)
