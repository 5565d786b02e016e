"""Line dedup by a deletion-neighbourhood join.

A line is what stands between line feeds; its words are compared with A-Z in lower case.  A line repeats an earlier one if the
words are equal, or if both have at least ``min_words`` words and one word inserted, left out or replaced makes them equal
(word edit distance 1).  Every line that repeats an earlier line (by doc_id, then line number) goes; the earliest one stays.

The neighbourhood of a line holds the line itself and all lines with one word left out, as hashed keys: one group key for
"word p of n left out" (members differ in that word only) and one for the words that remain (members gain a word against the
member that is whole).  All members of the first are neighbours of each other and all of the second of the whole one, so the
smallest member says all that matters and no pairs within a group are made; a hot group is pre-aggregated.

Most lines have no neighbour.  An exact sieve finds those first: within one edit the first or the second half stays
equal, so only lines that share a half (for their own length or one more) with another line give out variants, and only those
of the other half.  Equal lines are collapsed before anything else.  Candidates are verified on the words themselves.

Lines without words are never repeats.  Null text has no lines.  Of lines at one place (rows that share a doc_id, or have none) no
one is earlier; rows are told apart by a hash of doc_id and text.  A null doc_id sorts first.  Empty tables give empty results.  Other columns are kept by ``dedup``; n_chars is made anew if it is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import Words, mix, row_slices, ship, signed, stored

MIN_WORDS = 8
_U = np.uint64
_MULTIPLIERS = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
_TABLES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
LINES = "doc_id long, row long, line_no int, n_words int, h1 long, h2 long"
HALVES = ", half0 long, half1 long, half2 long, half3 long"
REPLACED, GAINED, WHOLE = 0, 1, 2  # what a key says: one word differs, one word more than the whole line, the whole line
VARIANTS = "k1 long, k2 long, kind int, doc_id long, row long, line_no int"


def _tables(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a multiplier and of its inverse modulo 2**64."""
    have = _TABLES.get(which)
    if have is None or len(have[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        out = []
        for base in (_MULTIPLIERS[which], pow(_MULTIPLIERS[which], -1, 1 << 64)):
            t = np.ones(size, dtype=_U)
            done, step = 1, base
            while done < size:
                t[done:2 * done] = t[:done] * _U(step)
                done, step = 2 * done, step * step % (1 << 64)
            out.append(t)
        have = _TABLES[which] = (out[0], out[1])
    return have


class Spans:
    """Hashes of spans of a sequence of word hashes, from prefix sums."""

    def __init__(self, words: np.ndarray, which: int):
        up, self.down = _tables(which, len(words) + 2)
        self.sums = np.zeros(len(words) + 1, dtype=_U)
        np.cumsum(words * up[:len(words)], out=self.sums[1:])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return (self.sums[hi] - self.sums[lo]) * self.down[lo]

    def without(self, lo: np.ndarray, hi: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hash of [lo, hi) without the word at ``at``."""
        return (self.sums[at] - self.sums[lo]) * self.down[lo] + (self.sums[hi] - self.sums[at + 1]) * self.down[lo + 1]


def _half_keys(spans: Spans, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    """First and second half, of the line's own length and as the shorter one of a pair."""
    out = []
    for more in (0, 1):
        n = hi - lo + more
        first, second = n // 2, n - n // 2
        for side, part in ((1, spans.hash(lo, lo + first)), (2, spans.hash(hi - second, hi))):
            out.append(mix(part + n.astype(_U) * _U(0xA24BAED4963EE407) + _U(side)))
    return out


class LineTable:
    """The lines with words of some texts, by arrays: row, line number, first and last word, 128-bit hash."""

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        words = Words(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        row = np.repeat(np.arange(len(texts)), np.diff(words.first))
        feeds = np.flatnonzero(data == 10)
        line = np.searchsorted(feeds, words.starts) - np.searchsorted(feeds, offsets[:-1] - offsets[0])[row]
        new = np.ones(len(row), dtype=bool)
        new[1:] = (line[1:] != line[:-1]) | (row[1:] != row[:-1])
        self.lo = np.flatnonzero(new)
        self.hi = np.append(self.lo[1:], len(row)) if len(row) else self.lo
        self.row, self.line = row[self.lo], line[self.lo].astype(np.int32)
        self.spans = Spans(words.hash, 0)
        salt = (self.hi - self.lo).astype(_U) * _U(0xD6E8FEB86659FD93)
        self.h1 = signed(mix(self.spans.hash(self.lo, self.hi) + salt))
        self.h2 = signed(mix(Spans(words.hash, 1).hash(self.lo, self.hi) + salt))


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text); ``row`` tells rows of one doc_id apart, unless their texts are equal too."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.select("doc_id", F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("row"), "text")


def lines(docs: DataFrame, halves: bool = False) -> DataFrame:
    """All lines with words: their place, number of words and 128-bit hash, and on request the keys of their halves."""
    ship(docs.sparkSession)
    schema = LINES + HALVES * halves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_slices(batch.column(2)):
                t = LineTable(batch.column(2).slice(a, b - a))
                keys = [pa.array(signed(k)) for k in _half_keys(t.spans, t.lo, t.hi)] if halves else []
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(pa.array(a + t.row)) for c in (0, 1)), pa.array(t.line), pa.array((t.hi - t.lo).astype(np.int32)), pa.array(t.h1), pa.array(t.h2),
                     *keys], [c.split()[0] for c in schema.split(", ")])

    return rows_of(docs).mapInArrow(run, schema)


def variants(active: DataFrame) -> DataFrame:
    """Keys of the neighbourhood of the active lines (doc_id, row, line_no, shared, line); bit i of shared: half i is shared."""
    ship(active.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = batch.column(3).to_numpy(zero_copy_only=False)
            for a, b in row_slices(batch.column(4), 1 << 18):
                words = Words(batch.column(4).slice(a, b - a))
                lo, hi = words.first[:-1], words.first[1:]
                n, bits = hi - lo, shared[a:b]
                middle = n // 2
                # the first half is shared: a word of the second is left out, and the other way round
                from_, to = np.where(bits & 1, np.where(bits & 2, 0, middle), 0), np.where(bits & 1, n, np.where(bits & 2, middle, 0))
                many = to - from_
                row = np.repeat(np.arange(b - a), many)
                at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + from_[row]
                whole = np.flatnonzero(bits & 12)
                keys = []
                for which in (0, 1):
                    spans = Spans(words.hash, which)
                    rest = spans.without(lo[row], hi[row], lo[row] + at)
                    salt = _U(0xA24BAED4963EE407)
                    replaced = mix(mix(rest + n[row].astype(_U) * salt) + at.astype(_U) + _U(1))
                    gained = mix(rest + (n[row] - 1).astype(_U) * salt + _U(7))
                    keys.append(np.concatenate((replaced, gained, mix(spans.hash(lo[whole], hi[whole]) + n[whole].astype(_U) * salt + _U(7)))))
                rows = np.concatenate((row, row, whole))
                kind = np.repeat(np.array([REPLACED, GAINED, WHOLE], dtype=np.int32), (len(row), len(row), len(whole)))
                take = pa.array(a + rows)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys[0])), pa.array(signed(keys[1])), pa.array(kind),
                                                  *(batch.column(c).take(take) for c in range(3))], ["k1", "k2", "kind", "doc_id", "row", "line_no"])

    return active.select("doc_id", "row", "line_no", "shared", "line").mapInArrow(run, VARIANTS)


def within_one_edit(a: str, b: str) -> bool:
    """Whether the word edit distance of two lines is at most 1."""
    x, y = _words(a), _words(b)
    if len(x) > len(y):
        x, y = y, x
    if len(y) - len(x) > 1:
        return False
    i = 0
    while i < len(x) and x[i] == y[i]:
        i += 1
    return x[i:] == y[i + 1:] or x[i + 1:] == y[i + 1:]


_SEPARATORS = str.maketrans("\t\n\x0b\x0c\r", "     ")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _words(line: str) -> list[str]:
    return [w for w in line.translate(_LOWER).translate(_SEPARATORS).split(" ") if w]


def place(of: str = "") -> Column:
    """Where a line stands, or the line ``of`` (see ``own``)."""
    return F.struct(F.col(f"{of}doc_id").alias("doc_id"), F.col(f"{of}line_no").alias("line_no"))


def own() -> Column:
    """The place and the row, which no two lines share; ordered by place."""
    return F.struct("doc_id", "line_no", "row")


def near(docs: DataFrame, distinct: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(first, keeper) of the distinct lines (first, n_words, half0..3) that an earlier line is within one edit of."""
    halves = distinct.where(F.col("n_words") >= min_words).select(
        "first", F.posexplode(F.array("half0", "half1", "half2", "half3")).alias("i", "half"))
    shared = halves.groupBy("half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("half")
    mine = halves.join(shared, "half").groupBy("first").agg(F.bit_or(F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), F.col("i") + 1)).alias("shared"))
    by_row = mine.groupBy(F.col("first.row").alias("row"), F.coalesce("first.doc_id", F.lit(0)).alias("_id")) \
        .agg(F.collect_list(F.struct("first.line_no", "shared")).alias("asked"))  # at most the row's own lines

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py().split("\n")
                for one in (o for o in batch.column(3)[i].as_py() if o["line_no"] < len(text)):
                    for column, value in zip(out, (batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), one["line_no"], one["shared"], text[one["line_no"]])):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()))],
                                             ["doc_id", "row", "line_no", "shared", "line"])

    texts = rows_of(docs).where("text is not null").withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    asked = texts.join(by_row, ["row", "_id"]).dropDuplicates(["row", "_id"]).select("doc_id", "row", "text", "asked")  # equal rows ask once
    active = stored(asked.mapInArrow(pick, "doc_id long, row long, line_no int, shared int, line string"), "active_lines")
    keys = variants(active).withColumn("own", own()).drop("doc_id", "row", "line_no")
    least = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("own")))
    groups = keys.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), least(REPLACED).alias("replaced"), least(GAINED).alias("gained"),
                                          least(WHOLE).alias("whole")).where("n > 1").drop("n")
    other = F.when(F.col("kind") == REPLACED, F.col("replaced")).when(F.col("kind") == GAINED, F.col("whole")).otherwise(F.col("gained"))
    found = keys.join(groups, ["k1", "k2"]).select("own", other.alias("other")).where(place("other.") < place("own.")) \
        .groupBy("own").agg(F.min("other").alias("other"))

    @F.pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_edit(x, y) for x, y in zip(a, b)], dtype=bool)

    line = active.select(own().alias("p"), "line")
    return found.join(line.select(F.col("p").alias("own"), F.col("line").alias("a")), "own") \
        .join(line.select(F.col("p").alias("other"), F.col("line").alias("b")), "other") \
        .where(verified("a", "b")).select(F.col("own").alias("first"), F.col("other").alias("keeper"))


def judged(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """As ``judge``, with the row that holds the line."""
    distinct = stored(lines(docs, halves=True).groupBy("h1", "h2").agg(
        F.min(own()).alias("first"), F.count(F.lit(1)).alias("copies"),
        *[F.max(c).alias(c) for c in ("n_words", "half0", "half1", "half2", "half3")]), "distinct_lines")
    keepers = near(docs, distinct, min_words)
    # Only classes with more than one line, or with a keeper, have something to say; all other lines stay.
    known = distinct.select("h1", "h2", "first", "copies").join(keepers, "first", "left").where("copies > 1 or keeper is not null").drop("copies")
    exact = F.coalesce((place() != place("first.")) & F.col("first").isNotNull(), F.lit(False))
    keeper = F.when(F.col("keeper").isNotNull(), F.col("keeper")).when(exact, F.col("first"))
    return lines(docs).join(known, ["h1", "h2"], "left").select(
        "doc_id", "row", "line_no", "n_words", "h1", "h2", keeper.isNull().alias("kept"),
        F.when(exact, F.lit("exact")).when(F.col("keeper").isNotNull(), F.lit("near")).alias("reason"),
        keeper["doc_id"].alias("keeper_doc_id"), keeper["line_no"].alias("keeper_line_no"))


def judge(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Every line with words: kept, reason (exact, near) and the place of the line that it repeats."""
    return judged(docs, min_words).drop("row")


def dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` without repeated lines; documents of which no line with words is left go."""
    gone = judged(docs, min_words).where("not kept").groupBy(F.col("row").alias("_row"), F.coalesce("doc_id", F.lit(0)).alias("_id")) \
        .agg(F.collect_set(F.struct("line_no", "h1", "h2")).alias("_gone"))  # at most the row's own lines

    @F.pandas_udf("string")
    def rest(texts: pd.Series, gone: pd.Series) -> pd.Series:
        out = list(texts)
        some = [i for i, g in enumerate(gone) if g is not None and out[i] is not None]
        for a, b in row_slices(pa.array([out[i] for i in some], pa.string())):
            t = LineTable(pa.array([out[i] for i in some[a:b]], pa.string()))
            first = np.searchsorted(t.row, np.arange(b - a + 1))
            for k, i in enumerate(some[a:b]):
                listed = {(g["line_no"], g["h1"], g["h2"]) for g in gone.iloc[i]}
                here = range(first[k], first[k + 1])
                drop = {int(t.line[x]) for x in here if (int(t.line[x]), int(t.h1[x]), int(t.h2[x])) in listed}
                out[i] = "\n".join(v for n, v in enumerate(out[i].split("\n")) if n not in drop) if len(drop) < len(here) else None
        return pd.Series(out)

    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = docs.select(F.struct(*columns).alias("d"))  # in a struct no name of the caller's clashes
    doc_id = F.col("d.doc_id").cast("long")
    row = F.xxhash64(doc_id, doc_id.isNull(), F.col("d.text").cast("string"))  # as in rows_of
    joined = whole.join(gone, (row == F.col("_row")) & (F.coalesce(doc_id, F.lit(0)) == F.col("_id")), "left") \
        .withColumn("_text", rest(F.col("d.text").cast("string"), F.col("_gone"))).where("_gone is null or _text is not null")
    made = {"text": F.col("_text"), "n_chars": F.when(F.col("_gone").isNull(), F.col("d.n_chars")).otherwise(F.length("_text"))} \
        if "n_chars" in docs.columns else {"text": F.col("_text")}
    return joined.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(f"d.`{c}`") for c in docs.columns])
