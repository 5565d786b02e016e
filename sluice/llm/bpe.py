"""Byte-level BPE encoding and decoding by monoid tree reduction.

The elements of the monoid are spans of bytes with their token ids; joining two neighbours gives the ids of the joined span.
A span of at most ``LEAF`` bytes is merged as it is; a longer one is cut in two, both parts are encoded and joined.  A join re-encodes a window at
the boundary: at first nothing, then the last tokens on the left and the first on the right, and twice as many on a side that
does not hold.  A side holds when the two tokens that meet there *stay*: the bytes of both, encoded alone, give these two tokens.

Why the tokens outside a window are then final: BPE merges the pair of lowest rank, leftmost first.  Suppose all neighbours of
a token sequence stay, and look at the first merge that crosses a boundary between two of them.  Up to then all merges lay
within single tokens, and within those two they came in the same order as if the two were encoded alone; so the crossing merge
would have happened there too, and the two do not stay.  Hence no merge crosses, and the sequence is the encoding of its bytes.

A text is cut in halves as well, down to blocks of about ``BLOCK`` code points.  Texts are cut before white space that follows
something else: every match of the pattern that ends in anything but white space ends there, whatever follows, so the tokens
on both sides are final and the join is a concatenation.  Every match of the pattern is encoded separately; one that is a token
as a whole is that token.  Ids of matches seen before are remembered, at most ``HELD`` of them at a time.

Decoding goes up the same kind of tree: the bytes of blocks of ids are concatenated pairwise.

Null text is empty text (no ids).  Repeated rows, and rows with equal or null doc_id, are answered each on its own.  An empty table
gives an empty result.  Only doc_id and text are read.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import row_slices, ship

BLOCK = 1 << 16
LEAF = 24
SHORT = 64  # up to here a list of neighbours is quicker than a heap
HELD = 400_000
LONGEST_HELD = 64
ENCODED = "doc_id long, n_tokens long, ids binary"
DECODED = "doc_id long, n_tokens long, ids binary, data binary"
_MADE: dict[tuple, "Vocabulary"] = {}


class Matches(dict):
    """Packed ids of matches, made when asked for."""

    def __init__(self, vocabulary: "Vocabulary"):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, match: str) -> bytes:
        packed = array("I", self.vocabulary.encode_match(match.encode())).tobytes()
        if len(match) <= LONGEST_HELD:
            if len(self) >= HELD:
                self.clear()
            self[match] = packed
        return packed


class Vocabulary:
    """Tokens by rank and the pattern that splits a text before the merges."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex
        self.ranks = ranks
        self.none = 1 + max(ranks.values())
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.cut_after = regex.compile(r"(?<=\S)\s").search
        self.cut_before = regex.compile(r"(?r)(?<=\S)\s").search
        self.kept: dict[tuple[int, int], bool] = {}
        self.matches = Matches(self)

    def merge(self, data: bytes) -> list[int]:
        """Plain BPE of a span: the pair of lowest rank is merged, the leftmost of equal ones, until none is a token."""
        n, ranks = len(data), self.ranks
        if n <= SHORT:
            none, rank_of = self.none, ranks.get
            parts = [data[i:i + 1] for i in range(n)]
            pairs = [rank_of(data[i:i + 2], none) for i in range(n - 1)]
            while pairs and (lowest := min(pairs)) < none:
                i = pairs.index(lowest)
                parts[i:i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
                if i < len(pairs):
                    pairs[i] = rank_of(parts[i] + parts[i + 1], none)
            return [ranks[p] for p in parts]
        end = list(range(1, n + 1))  # where the token that starts here ends; 0: swallowed
        start = list(range(-1, n))  # where the token that ends here starts
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(data[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            mid = end[i]
            if not mid or mid >= to or end[mid] != to:
                continue
            end[i], end[mid], start[to] = to, 0, i
            if i and (r := ranks.get(data[start[i]:to])) is not None:
                heapq.heappush(heap, (r, start[i], to))
            if to < n and (r := ranks.get(data[i:end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        out, at = [], 0
        while at < n:
            out.append(ranks[data[at:end[at]]])
            at = end[at]
        return out

    def stay(self, a: int, b: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        key = (a, b)
        known = self.kept.get(key)
        if known is None:
            if len(self.kept) >= HELD:
                self.kept.clear()
            known = self.kept[key] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, a: list[int], b: list[int]) -> list[int]:
        """The ids of a's bytes followed by b's bytes, where a and b are the ids of each."""
        if not a or not b or self.stay(a[-1], b[0]):
            return a + b
        left = right = 1
        while True:
            window = self.merge(b"".join([self.tokens[t] for t in a[-left:] + b[:right]]))
            holds_left = left >= len(a) or self.stay(a[-left - 1], window[0])
            holds_right = right >= len(b) or self.stay(window[-1], b[right])
            if holds_left and holds_right:
                return a[:max(0, len(a) - left)] + window + b[right:]
            left, right = left if holds_left else 2 * left, right if holds_right else 2 * right

    def encode_span(self, data: bytes) -> list[int]:
        """Ids of a span up the tree; the left part has a power of two of bytes, so runs of equal parts are cut alike."""
        if len(data) <= LEAF:
            return self.merge(data)
        cut = 1 << ((len(data) - 1).bit_length() - 1)
        return self.join(self.encode_span(data[:cut]), self.encode_span(data[cut:]))

    def encode_match(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.encode_span(data)

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        middle = len(text) // 2
        cut = None
        if len(text) > BLOCK:
            cut = self.cut_after(text, middle) or self.cut_before(text, 0, middle)
        if cut is None:
            return b"".join(map(self.matches.__getitem__, self.find(text)))
        return self.encode(text[:cut.start()]) + self.encode(text[cut.start():])

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) > BLOCK:
            return self.decode(ids[:len(ids) // 2]) + self.decode(ids[len(ids) // 2:])
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


def vocabulary(path: str | None = None, pattern: str | None = None) -> Vocabulary:
    """The vocabulary of a rank file; without a path the public one of 50,256 tokens with its pattern."""
    import public_tokenizers
    key = (path or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN)
    if key not in _MADE:
        with open(key[0], "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _MADE[key] = Vocabulary(ranks, key[1])
    return _MADE[key]


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian unsigned 32-bit integers) of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path, pattern)
        for batch in batches:
            for lo, hi in row_slices(batch.column(1)):
                ids = [v.encode(text or "") for text in batch.column(1).slice(lo, hi - lo).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(i) // 4 for i in ids], pa.int64()),
                                                  pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, ENCODED)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """The rows of ``encode`` with ``data``, the bytes that their ids stand for; null ids are no ids."""
    ship(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for lo, hi in row_slices(batch.column(2)):
                part = batch.slice(lo, hi - lo)
                data = [v.decode(np.frombuffer(ids or b"", "<u4")) for ids in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(data, pa.binary())], ["doc_id", "n_tokens", "ids", "data"])

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, DECODED)
