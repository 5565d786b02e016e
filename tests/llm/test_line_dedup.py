import random

from sluice.llm import line_dedup
from tests.llm.helpers import LONG_TEXT, clashing, docs_of, words


def edits(a, b):
    """Word edit distance by the textbook table."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def brute(rows, min_words):
    lines = sorted((d if d is not None else -1, n, words(t)) for d, text in rows if text is not None
                   for n, t in enumerate(text.split("\n")) if words(t))
    first = {}
    for d, n, w in lines:
        first.setdefault(tuple(w), (d, n))
    out = {}
    for d, n, w in lines:
        near = [p for v, p in first.items() if p < first[tuple(w)] and len(w) >= min_words and len(v) >= min_words and edits(w, v) <= 1]
        keeper = min(near) if near else first[tuple(w)] if first[tuple(w)] != (d, n) else None
        out[d, n] = keeper
    return out


def judged(df):
    return {(r.doc_id, r.line_no): None if r.kept else (r.keeper_doc_id, r.keeper_line_no) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    base = [[rnd.choice("abcdefgh") * 2 for _ in range(rnd.randint(3, 14))] for _ in range(12)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(rnd.randint(0, 6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                at = rnd.randrange(len(w))
                kind = rnd.choice("ird")
                if kind == "i":
                    w.insert(at, rnd.choice("xyz"))
                elif kind == "r":
                    w[at] = rnd.choice("XyZ")
                elif len(w) > 1:
                    w.pop(at)
            lines.append(rnd.choice([" ", "\t "]).join(w))
        rows.append((d, rnd.choice(["\n", "\n\n"]).join(lines)))
    assert judged(line_dedup.judge(docs_of(spark, rows).repartition(5), 6)) == brute(rows, 6)


def test_a_hot_group_of_near_copies(spark):
    line = " ".join(f"w{i}" for i in range(20))
    rows = [(i, f"{line} n{i}") for i in range(400)] + [(1000 + i, line) for i in range(300)]
    got = judged(line_dedup.judge(docs_of(spark, rows)))
    assert [k for k, v in got.items() if v is None] == [(0, 0)] and all(v == (0, 0) for v in got.values() if v)


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, "same short\nsame short"), (5, "same short"), (6, LONG_TEXT), (7, LONG_TEXT + " tail"),
            (None, "only here\nsame short"), (8, "stays\n\nsame short\n")]
    docs = clashing(docs_of(spark, rows))
    out = line_dedup.dedup(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    # the null doc_id sorts first, so its line is the earliest
    assert got == {1: (None, None), 2: ("", 0), 3: ("\n \n", 3), 6: (LONG_TEXT, len(LONG_TEXT)),
                   None: ("only here\nsame short", 20), 8: ("stays\n\n", 7)}


def test_empty_table(spark):
    assert line_dedup.dedup(docs_of(spark, [])).count() == 0
    assert line_dedup.judge(docs_of(spark, [])).count() == 0


def test_verification():
    assert line_dedup.within_one_edit("a b c", "A b  c")
    assert line_dedup.within_one_edit("a b c", "a c") and line_dedup.within_one_edit("a c", "a b c")
    assert line_dedup.within_one_edit("a b c", "a x c") and not line_dedup.within_one_edit("a b c", "a c b")
    assert not line_dedup.within_one_edit("a b c d", "a b")


def test_near_lines_under_repeated_and_null_ids(spark):
    line = [f"w{i}" for i in range(12)]
    near = [" ".join([*line[:k], f"n{k}", *line[k + 1:]]) for k in (3, 7)]
    other = [" ".join(f"{c}{i}" for i in range(12)) for c in "xyz"]
    rows = [(1, " ".join(line)), (5, near[0]), (5, other[0]), (5, f"{other[1]}\n{near[1]}"), (6, near[0]), (6, near[0]), (7, other[2]), (7, other[2])]
    got = sorted((r.doc_id, r.line_no, r.reason or "", r.keeper_doc_id) for r in line_dedup.judge(docs_of(spark, rows).repartition(3)).collect() if r.doc_id != 1)
    assert got == [(5, 0, "", None), (5, 0, "", None), (5, 0, "near", 1), (5, 1, "near", 1), (6, 0, "exact", 1), (6, 0, "exact", 1), (7, 0, "", None), (7, 0, "", None)]
    kept = sorted((r.doc_id, r.text) for r in line_dedup.dedup(docs_of(spark, rows)).collect())
    assert kept == [(1, " ".join(line)), (5, other[0]), (5, other[1]), (7, other[2]), (7, other[2])]
    nulls = [(None, f"{' '.join(line)}\n{near[0]}"), (None, f"{other[0]}\n{other[1]}"), (None, None), (None, other[2]), (2, near[1])]
    kept = {(r.doc_id, r.text) for r in line_dedup.dedup(docs_of(spark, nulls)).collect()}
    assert kept == {(None, " ".join(line)), (None, f"{other[0]}\n{other[1]}"), (None, None), (None, other[2])}
