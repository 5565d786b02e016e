"""Packing by non-negative least squares.

Every document becomes token ids with an end id and is cut into full windows of ``size`` ids and one shorter rest.  A full
window is a sequence of its own.  The rests are packed by their lengths alone: shallow combinations of two or three lengths
that fill a window exactly are enumerated, their repeat counts solved against the histogram of lengths by non-negative least
squares and rounded, and what is left is packed greedily.  The histogram has at most ``size`` rows whatever the input, so the
plan is made on the driver; documents and ids never leave the executors.

Pieces of one length take the plan's slots by rank.  A hot length is split: ranks are counted within (length, chunk) and
chunks are laid end to end.

The text of an added token (such as ``<|endoftext|>``) is that token.  Null text is empty text (one piece, the end id).  Repeated rows are packed each on its own.  Null doc_id is kept.
An empty table gives an empty result.  Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.common import ship, stored

SIZE = 2048
END_ID = 1
LONGEST_RUN = 2000  # a longer run without white space goes to the library that merges it in n log n
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"
_ENCODERS: dict[str, object] = {}


def encoder(path: str | None = None):
    """text -> list of ids, those of the JSON file's tokenizer without added special tokens.

    The rank file holds the same vocabulary and its library is faster, so texts go there, but for those that hold an added token's text
    or a run too long for its merges: the tokenizer itself encodes these.
    """
    import public_tokenizers as tokens
    key = path or "byte_bpe_50k"
    if key not in _ENCODERS:
        import re

        import tiktoken
        from tokenizers import Tokenizer
        whole = Tokenizer.from_file(path or tokens.path("byte_bpe_50k.json"))
        encode = lambda text: whole.encode(text, add_special_tokens=False).ids
        if not path:
            with open(tokens.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("byte_bpe_50k", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
            added = [re.escape(t.content) for t in whole.get_added_tokens_decoder().values()]
            odd = re.compile("|".join([*added, r"\S{%d}" % LONGEST_RUN, r"\s{%d}" % LONGEST_RUN]))
            slow = encode
            encode = lambda text: slow(text) if odd.search(text) else fast.encode_ordinary(text)
        _ENCODERS[key] = encode
    return _ENCODERS[key]


def pieces(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Windows of ``size`` ids and the rest of every document, with the checksum of each."""
    ship(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = array("I", encode(text.as_py() or ""))
                ids.append(end_id)
                raw = ids.tobytes()
                for start in range(0, len(ids), size):
                    n = min(size, len(ids) - start)
                    for column, value in zip(out, (doc_id, start, n, zlib.crc32(raw[4 * start:4 * (start + n)]), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out],
                                             ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def solve(histogram: dict[int, int], size: int = SIZE, triples_each: int = 6, rounds: int = 400) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths and how often each repeats; together they use every length exactly as often as it occurs."""
    left = {n: c for n, c in histogram.items() if c > 0}
    plan: list[tuple[tuple[int, ...], int]] = []
    if left.get(size):
        plan.append(((size,), left.pop(size)))
    lengths = sorted(left)
    have = set(lengths)
    combos = {(a, size - a) for a in lengths if a <= size - a and size - a in have}
    common = sorted(lengths, key=lambda n: (-left[n], n))
    for a in lengths:
        found = 0
        for b in common:
            c = size - a - b
            if c in have and found < triples_each:
                combos.add(tuple(sorted((a, b, c))))
                found += 1
    if combos:
        combos = sorted(combos)
        where = {n: i for i, n in enumerate(lengths)}
        rows = np.array([where[n] for combo in combos for n in combo])
        cols = np.array([k for k, combo in enumerate(combos) for _ in combo])
        target = np.array([left[n] for n in lengths], dtype=float)
        wanted = np.bincount(cols, target[rows], len(combos))
        x = np.full(len(combos), target.sum() / (3.0 * len(combos)))
        for _ in range(rounds):  # multiplicative updates keep x >= 0 and lower the squared error
            now = np.bincount(rows, x[cols], len(lengths))
            x *= wanted / np.maximum(np.bincount(cols, now[rows], len(combos)), 1e-12)
        for k in np.argsort(-x, kind="stable"):
            combo = combos[k]
            times = min([int(round(x[k])), *(left[n] // combo.count(n) for n in combo)])
            if times > 0:
                plan.append((combo, times))
                for n in combo:
                    left[n] -= times
    rest = np.zeros(size + 1, dtype=np.int64)
    for n, c in left.items():
        rest[n] = c
    while rest.any():  # the longest first, then always the longest that still fits; each pattern uses up a length
        gap, pattern = size, []
        spare = rest.copy()
        while (fits := np.flatnonzero(spare[:gap + 1])).size:
            n = int(fits[-1])
            pattern.append(n)
            spare[n] -= 1
            gap -= n
        times = min(int(rest[n]) // pattern.count(n) for n in pattern)
        plan.append((tuple(pattern), times))
        for n in pattern:
            rest[n] -= times
    return plan


def slots(plan: list[tuple[tuple[int, ...], int]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset), sorted: ranks from the first on go to the sequences from that on."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for combo, times in plan:
        offset = 0
        for n in combo:
            out.append((n, used.get(n, 0), sequence, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        sequence += times
    out.sort()
    return np.array(out, dtype=np.int64).reshape(-1, 4)


def pack(docs: DataFrame, size: int = SIZE, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and place there."""
    cut = stored(pieces(docs, size, end_id, path), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `size` rows
    table = slots(solve(histogram, size))
    chunks = 256 + sum(histogram.values()) // 10_000_000
    cut = cut.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(chunks)))
    earlier = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "chunk").orderBy("doc_id", "start", "ids_crc32")
    ranked = cut.join(base, ["length", "chunk"]).withColumn("rank", F.col("base") + F.row_number().over(within) - 1)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = table[:, 0].astype(np.float64) * 2.0 ** 40 + table[:, 1]  # exact: below 2**53
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (2, 5))
            at = np.searchsorted(order, length * 2.0 ** 40 + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])],
                [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(place, PACKED)
