import random
from array import array
from hashlib import sha256

import numpy as np
import public_tokenizers as tokens
import pytest
import tiktoken
from pyspark.sql import functions as F

from sluice.llm import bpe
from sluice.llm.queries import op12_bpe
from tests.conftest import SF001
from tests.llm.helpers import LONG_TEXT, clashing, docs_of

ALPHABETS = ["ab", "a", " a\n", "aeinrst", "'sre tdlmv ", "0123 .-_", "é日本 ab", "xX<|endoftext|>", " \t\x1c\x85 a!", "".join(map(chr, range(32, 127)))]


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.vocabulary().ranks
    t = tiktoken.Encoding("reference", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return lambda text: array("I", t.encode_ordinary(text or "")).tobytes()


@pytest.mark.parametrize("leaf,block", [(1, 8), (2, 50), (24, 1 << 16)])
def test_tree_equals_the_library(monkeypatch, reference, leaf, block):
    monkeypatch.setattr(bpe, "LEAF", leaf)
    monkeypatch.setattr(bpe, "BLOCK", block)
    v = bpe.Vocabulary(bpe.vocabulary().ranks, tokens.PATTERN)
    rng = random.Random(leaf)
    for alphabet in ALPHABETS:
        for n in [0, 1, 2, 7, 20, 100, 300] * 12:
            text = "".join(rng.choice(alphabet) for _ in range(n))
            ids = v.encode(text)
            assert ids == reference(text)
            assert v.decode(np.frombuffer(ids, "<u4")) == text.encode()


def test_joins_of_any_two_spans(reference):
    """The join of two encodings is the encoding of the joined bytes, wherever the cut lies."""
    v, rng = bpe.vocabulary(), random.Random(7)
    for alphabet in ["ab", "a", "aeinrst", "0123456789abcdef", "=-"]:
        for _ in range(30):
            data = "".join(rng.choice(alphabet) for _ in range(rng.randint(2, 90))).encode()
            for cut in range(1, len(data)):
                assert v.join(v.merge(data[:cut]), v.merge(data[cut:])) == v.merge(data)


def test_both_ways_of_merging(monkeypatch):
    v, rng = bpe.vocabulary(), random.Random(3)
    for _ in range(300):
        data = bytes(rng.randrange(256) for _ in range(rng.randint(1, 60))) if rng.random() < 0.5 else b"the aeronautical " * rng.randint(1, 3)
        short = v.merge(data)
        monkeypatch.setattr(bpe, "SHORT", 0)
        assert v.merge(data) == short
        monkeypatch.undo()


def test_long_runs(reference):
    v = bpe.vocabulary()
    for text in ["a" * 30_001, "ab" * 10_000, " " * 20_000 + "x", "=-" * 5_000, "word " * 40_000 + "z" * 70_000]:
        ids = v.encode(text)
        assert v.decode(np.frombuffer(ids, "<u4")) == text.encode()
        if len(text) < 25_000:
            assert ids == reference(text)


def test_remembered_matches_are_bounded(monkeypatch, reference):
    monkeypatch.setattr(bpe, "HELD", 10)
    v = bpe.Vocabulary(bpe.vocabulary().ranks, tokens.PATTERN)
    assert v.encode(LONG_TEXT) == reference(LONG_TEXT)
    assert len(v.matches) <= 10 and len(v.kept) <= 10


def test_awkward_rows(spark, reference):
    rows = [(1, None), (2, ""), (3, LONG_TEXT), (3, LONG_TEXT), (None, "a b"), (None, None), (4, "<|endoftext|> 'S 're"), (5, " \n\t "), (5, "other")]
    got = bpe.decode(bpe.encode(clashing(docs_of(spark, rows)))).collect()
    assert sorted((str(r.doc_id), bytes(r.ids), bytes(r.data)) for r in got) == sorted((str(d), reference(t), (t or "").encode()) for d, t in rows)
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.decode(bpe.encode(docs_of(spark, []))).count() == 0


def test_null_ids_decode_to_nothing(spark):
    assert bytes(bpe.decode(spark.createDataFrame([(1, 0, None)], bpe.ENCODED)).first().data) == b""


def test_query_equals_the_library(spark, reference):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()}
    got = op12_bpe(spark, SF001).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = reference(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, sha256(ids).hexdigest(), sha256(docs[r.doc_id].encode()).hexdigest())


def test_ids_survive_storage_and_row_order(spark):
    encoded = bpe.encode(docs_of(spark, [(i, f"row {i} text") for i in range(50)])).orderBy(F.desc("doc_id"))
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded).collect()} == {i: f"row {i} text" for i in range(50)}
