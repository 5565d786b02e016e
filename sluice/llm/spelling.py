"""Spelling variants by finite-state composition.

Words are the maximal runs of letters of the texts (A-Z in lower case), some with one letter left out (``vocabulary``).  Two words are
near if one code point inserted, deleted or replaced turns one into the other.  The near pairs are the strings that the
composition *vocabulary acceptor - one-edit transducer - vocabulary acceptor* accepts.

The composition is partitioned by initial state.  A state of the acceptor is reached by a beginning of words, one of the reversed
acceptor by an ending; a partition is the set of words that reach one pair of such states, and what is composed there is the
minimised acceptor of the middles that remain.  Let m be the length of the shorter word of a pair: the edit lies either behind
the first half of m or before the rest, so the pair meets in the partition of its common beginning or of its common ending.
Partitions of more than ``GROUP`` words descend further: their middles are halved in the same way until at most ``GROUP`` words share a
state or the middles have one or two code points (their number is then bounded by the alphabet squared).  So no task
ever holds the vocabulary, no pair is lost, and a beginning that a third of all words share is split like any other.

Within a partition the composition is walked lazily.  Before the edit both sides are in the same state; after it they are in a
pair of states that both must leave by equal letters.  Every state knows how many words it accepts, so a walk counts ranks
instead of building strings.  An inserted letter is taken at the last place where it can stand, so a pair is accepted once.

Null text has no words; a null doc_id is written as empty text before the colon.  Repeated rows count each.  Empty tables give
empty results.  Only doc_id and text are read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.common import ship, stored

MIN_LENGTH = 5
MIN_COUNT = 3
SLIP = 97
GROUP = 2048
HELD = 200_000
PAIRS = "word string, n long, near string, near_n long"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, slip: int = SLIP) -> DataFrame:
    """(word, n): words of at least ``min_length`` code points with at least ``min_count`` occurrences over all rows.

    A run loses a code point where ``slip`` divides the crc32 of ``<doc_id>:<run>``, the one at crc32 modulo its length.
    """
    ship(docs.sparkSession)
    runs = re.compile("[a-zÀ-ÿ]{%d,}" % min_length).findall  # shorter runs cannot make a word

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def counted() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_py()
                if not raw:
                    continue
                start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
                for run, n in Counter(runs(raw.lower().decode())).items():  # bytes.lower: A-Z alone
                    h = zlib.crc32(run.encode(), start)
                    if h % slip == 0:
                        run = run[:h % len(run)] + run[h % len(run) + 1:]
                        if len(run) < min_length:
                            continue
                    held[run] += n
                if len(held) > HELD:  # partial counts; Spark sums them
                    yield counted()
        if held:
            yield counted()

    return docs.select(F.col("doc_id").cast("string"), F.col("text").cast("string").cast("binary")).mapInArrow(count, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


class Acceptor:
    """The minimal acyclic acceptor of sorted distinct words.

    ``states[s]`` is (final, {letter: (next state, words before it)}); ``many[s]`` is the number of words accepted from s on.
    """

    def __init__(self, words: list[str]):
        self.states: list[tuple[bool, dict[str, tuple[int, int]]]] = []
        self.many: list[int] = []
        known: dict[tuple, int] = {}
        path: list[tuple[list[bool], dict[str, int]]] = [([False], {})]  # the states of the last word, still open
        last = ""

        def close() -> int:
            final, edges = path.pop()
            key = (final[0], *edges.items())
            if key not in known:
                known[key] = len(self.states)
                before, numbered = int(final[0]), {}
                for letter, to in edges.items():
                    numbered[letter] = (to, before)
                    before += self.many[to]
                self.states.append((final[0], numbered))
                self.many.append(before)
            return known[key]

        for word in words:
            same = 0
            while same < len(last) and same < len(word) and last[same] == word[same]:
                same += 1
            while len(path) > same + 1:
                state = close()
                path[-1][1][last[len(path) - 1]] = state
            path += [([False], {}) for _ in word[same:]]
            path[-1][0][0] = True
            last = word
        while len(path) > 1:
            state = close()
            path[-1][1][last[len(path) - 1]] = state
        self.start = close()

    def common(self, p: int, q: int, i: int, j: int, but: str = "") -> Iterator[tuple[int, int]]:
        """Ranks of the strings accepted from both states; with ``but`` given, of those that do not begin with that letter."""
        states, waiting = self.states, [(p, q, i, j, but)]
        while waiting:
            p, q, i, j, but = waiting.pop()
            (final_p, from_p), (final_q, from_q) = states[p], states[q]
            if final_p and final_q:
                yield i, j
            for letter in from_p if len(from_p) <= len(from_q) else from_q:
                if letter != but and letter in from_p and letter in from_q:
                    (x, a), (y, b) = from_p[letter], from_q[letter]
                    waiting.append((x, y, i + a, j + b, ""))

    def one_edit_pairs(self) -> Iterator[tuple[int, int]]:
        """Ranks of all pairs of words that the composition with the one-edit transducer accepts, each pair once."""
        waiting = [(self.start, 0)]
        while waiting:
            p, i = waiting.pop()
            edges = list(self.states[p][1].items())
            for k, (letter, (x, a)) in enumerate(edges):
                yield from self.common(p, x, i, i + a, letter)  # the letter is inserted here
                for _, (y, b) in edges[k + 1:]:  # or replaced by another one
                    yield from self.common(x, y, i + a, i + b)
                waiting.append((x, i + a))


def partitioned(rows: DataFrame) -> DataFrame:
    """Rows (word, n, m, a, b) with the key of their partition: the beginning of a and the ending of b code points."""
    return rows.withColumn("key", F.xxhash64("m", "a", "b", F.expr("left(word, a)"), F.expr("right(word, b)")))


def halved(rows: DataFrame) -> DataFrame:
    """Both descents of every row: by the first half of the middle, and by the rest of it."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    rest = F.col("m") - F.col("a") - F.col("b") - half
    step = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    both = F.array(step(F.col("a") + half, F.col("b")), step(F.col("a"), F.col("b") + rest))
    return rows.select("word", "n", "m", F.explode(both).alias("s")).select("word", "n", "m", "s.a", "s.b")


def near_pairs(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n, near, near_n): every pair of near words of ``words`` (word, n; distinct words), both ways round."""
    ship(words.sparkSession)
    own = F.char_length("word")
    whole = words.select("word", "n", F.explode(F.array(own, own - 1)).alias("m"), F.lit(0).alias("a"), F.lit(0).alias("b")).where("m > 0")
    open_rows = halved(whole)
    ready = []
    while True:
        rows = stored(partitioned(open_rows), "initial_states")
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")  # alone in its state: no pair
        sized = stored(rows.join(sizes, "key"), "partitions")
        splittable = (F.col("size") > group) & (F.col("m") - F.col("a") - F.col("b") > 1)
        ready.append(sized.where(~splittable).drop("size"))
        if sized.where(splittable).isEmpty():
            break
        open_rows = halved(sized.where(splittable))
    members = ready[0]
    for more in ready[1:]:
        members = members.unionByName(more)
    dealt = members.select("key", "m", "a", "b", "word", "n").repartition("key") \
        .sortWithinPartitions("key", "m", "a", "b", F.expr("left(word, a)"), F.expr("right(word, b)"))

    def links_of(rows: list[tuple[str, int]], m: int, a: int, b: int) -> Iterator[tuple[str, int, str, int]]:
        if len(rows) == 1:
            return
        by_middle = sorted((word[a:len(word) - b], word, n) for word, n in rows)
        for i, j in Acceptor([r[0] for r in by_middle]).one_edit_pairs():
            (_, u, n_u), (_, v, n_v) = by_middle[i], by_middle[j]
            if len(u) == m or len(v) == m:  # two longer words meet in a partition of their own length
                yield u, n_u, v, n_v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, rows, found = None, [], []

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int64()) * 2)],
                                             ["word", "n", "near", "near_n"])
            found.clear()
            return out

        for batch in batches:
            for m, a, b, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                this = (m, a, b, word[:a], word[len(word) - b:])
                if this != state:
                    if rows:
                        for link in links_of(rows, *state[:3]):
                            found.append(link)
                            if len(found) >= 10_000:
                                yield flush()
                    state, rows = this, []
                rows.append((word, n))
        if rows:
            found += links_of(rows, *state[:3])
        if found:
            yield flush()

    once = dealt.select("m", "a", "b", "word", "n").mapInArrow(run, PAIRS)
    ordered = once.select(*[F.when(F.col("word") < F.col("near"), F.col(x)).otherwise(F.col(y)).alias(x)
                            for x, y in (("word", "near"), ("n", "near_n"), ("near", "word"), ("near_n", "n"))])
    pairs = stored(ordered.distinct(), "near_words")  # a pair may share both its beginning and its ending
    return pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root) of all words that have a form, by pointer doubling: a chain at least doubles its count at every step, so it has at
    most 63 links and six rounds reach its end."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jump = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(now.join(jump, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if moved.where("moved").isEmpty():
            return now
        now = moved.select("word", "root")


def variants(words: DataFrame, ratio: int = 2, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every row of ``words`` (word, n): the form is the near word with the largest n, the smallest
    of equal ones, if that n is at least ``ratio`` times the word's."""
    words = stored(words, "vocabulary")
    pairs = near_pairs(words, group)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("form"))).alias("best"))
    takes: Column = -F.col("best.n") >= F.lit(ratio) * F.col("n")
    judged = stored(words.join(best, "word", "left").select(
        "word", F.when(takes, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(takes, -F.col("best.n")).cast("long").alias("form_n")), "judged")
    roots = follow(judged.where("form is not null"))
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
