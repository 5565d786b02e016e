from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sluice.llm import merkle
from tests.llm.helpers import LONG_TEXT, clashing, docs_of


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def plain_leaf(doc_id, text, lang):
    n_chars = None if text is None else len(text)
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, "s", lang, n_chars, text)])


def plain_tree(nodes):
    """Levels from the leaves to the one node that remains."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def climb(levels, at):
    """(before, after) of every level from a node up."""
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8:at // 8 * 8 + 8]
        out.append(("".join(run[:at % 8]), "".join(run[at % 8 + 1:])))
        at //= 8
    return out


def plain(rows, tampered=lambda d: False):
    by_lang = {}
    for d, t, lang in rows:
        by_lang.setdefault(lang, []).append((d is not None, d or 0, plain_leaf(d, t, lang), d, t))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([r[2] for r in sorted(by_lang[x], key=lambda r: r[:3])]) for x in langs}
    top = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for no, x in enumerate(langs):
        for at, (_, _, leaf, d, t) in enumerate(sorted(by_lang[x], key=lambda r: r[:3])):
            path = climb(trees[x], at) + climb(top, no)
            node = leaf
            if tampered(d) and t is not None:
                lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
                node = h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (d, "s", x, len(t), lower)])
            for before, after in path:
                node = h(before, node, after)
            out.append((d, leaf, trees[x][-1][0], top[-1][0], h(*[b + a for b, a in path]), node, node == top[-1][0]))
    return sorted(out, key=str)


def rows_of(spark, docs, tampered=None):
    return sorted((tuple(r) for r in merkle.verify(docs, F.lit(False) if tampered is None else tampered).collect()), key=str)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 8}, {"en": 9}, {"en": 65, "de": 1, None: 3}, {f"l{i}": 1 + i % 3 for i in range(11)}])
def test_trees_of_many_sizes(spark, sizes):
    rows = [(100 * k + i, f"Text {i}", lang) for k, (lang, n) in enumerate(sizes.items()) for i in range(n)]
    assert rows_of(spark, docs_of(spark, rows)) == plain(rows)


def test_awkward_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, LONG_TEXT, "en"), (4, "ÄÖ É", "en"), (4, "ÄÖ É", "en"), (4, "Other", "en"), (None, "No id", "en"), (None, "No id", None),
            (-5, "Negative", "en"), (9_999_999_999_999, "Far", "en"), (5, "ABC", "日本"), (6, "ABC", "")] + [(20, "Same", "fr")] * 40
    assert rows_of(spark, clashing(docs_of(spark, rows))) == plain(rows)
    assert merkle.verify(docs_of(spark, []), F.lit(True)).count() == 0


def test_tampering_is_seen(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en") for i in range(30)] + [(30, None, "en"), (31, "É only", "en")]
    got = rows_of(spark, docs_of(spark, rows), F.col("doc_id") % 3 == 0)
    assert got == plain(rows, lambda d: d % 3 == 0)
    assert {r[0] for r in got if not r[-1]} == {i for i in range(30) if i % 2 and i % 3 == 0}


def test_a_third_without_an_id_and_a_far_one(spark):
    rows = [(None, f"n{i}", "en") for i in range(60)] + [(i, f"t{i}", "en") for i in range(120)] + [(1 << 60, "far", "en")]
    assert rows_of(spark, docs_of(spark, rows)) == plain(rows)


def test_some_requests_only(spark):
    """The descent takes only the digits that requests have, and the records are found by digest."""
    rows = [(i, f"t{i}", "en" if i % 4 else "de") for i in range(200)]
    manifest = merkle.build(docs_of(spark, rows))
    wanted = spark.createDataFrame([("+en", 0), ("+en", 77), ("+de", 49), ("+de", 1000), ("+xx", 0)], "tree string, rank long")
    got = {(r.tree, r.rank): r for r in merkle.proofs(manifest, wanted).collect()}
    assert set(got) == {("+en", 0), ("+en", 77), ("+de", 49)}
    every = {(r.tree, r.rank): r for r in merkle.proofs(manifest).collect()}
    assert all(every[k].path == r.path and every[k].leaf == r.leaf for k, r in got.items())
    records = manifest.levels[0].collect()
    assert all(h(*r.children) == r.digest for level in (*manifest.levels, *manifest.top) for r in level.collect()) and len(records) == 7 + 19


def test_same_tree_for_any_order_and_partitioning(spark):
    docs = docs_of(spark, [(i, f"t{i}", "en") for i in range(100)])
    assert rows_of(spark, docs.repartition(7)) == rows_of(spark, docs.coalesce(1).orderBy(F.desc("doc_id")))
