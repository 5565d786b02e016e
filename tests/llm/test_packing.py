import zlib
from array import array
from collections import Counter, defaultdict

import public_tokenizers as tokens
import pytest
from tokenizers import Tokenizer

from sluice.llm import packing
from tests.llm.helpers import LONG_TEXT, clashing, docs_of


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, ids, size=2048):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for d, got in by_doc.items():
        copies = Counter(r.start for r in got)[0]
        assert sum(r.length for r in got) == copies * len(ids[d])
        for r in got:
            part = ids[d][r.start:r.start + r.length]
            assert len(part) == r.length and r.doc_tokens == len(ids[d])
            assert r.ids_crc32 == zlib.crc32(array("I", part).tobytes())
    for got in by_sequence.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= size


def test_ids_are_those_of_the_tokenizer_file(reference):
    encode = packing.encoder()
    for text in ["", " a  b\n\n c", "don't  stop\t\t!", "<|endoftext|> x", "hi <|endoftext|> there", "<|endoftext|>" * 3, "é" * 50, "x" * 5000, " " * 5000 + "y", "\x1c\x1d a \x85b", LONG_TEXT[:20_000], "日本語 ½ Ⅷ"]:
        assert encode(text) + [1] == reference(text)


def test_pack(spark, reference):
    rows = [(i, " ".join(["word"] * (1 + i * 37 % 900))) for i in range(150)] + [(1000 + i, "the same text") for i in range(300)]
    rows += [(2000, None), (2001, ""), (2002, LONG_TEXT), (2002, LONG_TEXT), (2003, "hi <|endoftext|> there")]
    got = packing.pack(clashing(docs_of(spark, rows))).collect()
    check(got, {d: reference(t) for d, t in rows})
    total, used = sum(r.length for r in got), len({r.sequence_id for r in got})
    assert used * 2048 < 1.1 * total + 2048


def test_null_ids_and_empty_table(spark):
    got = packing.pack(docs_of(spark, [(None, "a"), (None, "b")])).collect()
    assert [r.doc_id for r in got] == [None, None] and len({(r.sequence_id, r.offset) for r in got}) == 2
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_plan_uses_every_length_exactly():
    histogram = {1: 5, 2: 9, 1000: 40, 1048: 33, 700: 21, 648: 10, 2047: 3, 2048: 4, 1500: 7}
    used = Counter()
    for combo, times in packing.solve(histogram):
        assert sum(combo) <= 2048 and times > 0
        for n in combo:
            used[n] += times
    assert used == Counter(histogram)


def test_least_squares_finds_the_fitting_combinations():
    plan = packing.solve({1000: 100, 1048: 60, 524: 80})
    assert Counter(dict(plan))[(1000, 1048)] + Counter(dict(plan))[(524, 524, 1000)] >= 95
