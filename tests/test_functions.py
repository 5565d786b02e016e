"""Scalar rules and edge values."""

import base64
import hashlib
import hmac as py_hmac

from pyspark.sql import functions as F

from sluice.functions import b64url_decode, backoff_ms, bool_word, int_or, iso_ms, query_param, trim_ws
from sluice.operators.records import pairs_to_map
from sluice.operators.state import history_limit
from sluice.operators.validation import b64url_encode, hmac_sha256


def _one(spark, col, data, schema="x string"):
    return [r[0] for r in spark.createDataFrame(data, schema).select(col).collect()]


def test_int_or_numeric_prefix(spark):
    got = _one(spark, int_or("x", 0), [("3abc",), ("  42",), ("abc",), ("",), (None,), ("-7",),
                                       ("99999999999999999999",)])
    assert got == [3, 42, 0, 0, 0, -7, 0]


def test_bool_word(spark):
    got = _one(spark, bool_word("x", False), [("TRUE",), (" yes",), ("1",), ("no",), ("maybe",), (None,)])
    assert got == [True, True, True, False, False, False]


def test_trim_whitespace(spark):
    assert _one(spark, trim_ws("x"), [("\t a b \n",)]) == ["a b"]


def test_backoff_doubles_and_clamps(spark):
    got = _one(spark, backoff_ms("x", 250, 10_000), [(0,), (1,), (5,), (6,), (-3,), (40,)], "x int")
    assert got == [250, 500, 8000, 10000, 250, 10000]


def test_iso_ms_truncates(spark):
    got = spark.sql("select timestamp_ntz'2024-01-01 00:00:07.179975' as t").select(iso_ms("t")).first()[0]
    assert got == "2024-01-01T00:00:07.179Z"


def test_query_param_first_match(spark):
    got = _one(spark, query_param("x", "limit"),
               [("/a?limit=7&limit=9",), ("/a?x=1",), ("/a?limit=",), ("/a",), ("/a?b=1?limit=3",)])
    assert got == ["7", None, "", None, None]
    assert _one(spark, query_param("x", "k"), [("/p?k=v&z=1",)]) == ["v"]


def test_history_limit_clamps():
    assert [history_limit(v) for v in ("7", "0", "9999", "abc", None, "-4")] == [7, 1, 500, 50, 50, 1]


def test_hmac_matches_python(spark):
    msgs = ["", "a.b", "héllo.wörld", "x" * 300]
    for secret in ["change-me", "k" * 100]:
        got = spark.createDataFrame([(m,) for m in msgs], "m string") \
                   .select(b64url_encode(hmac_sha256(secret, F.col("m")))).collect()
        want = [base64.urlsafe_b64encode(py_hmac.new(secret.encode(), m.encode(), hashlib.sha256).digest())
                .decode().rstrip("=") for m in msgs]
        assert [r[0] for r in got] == want


def test_b64url_roundtrip(spark):
    texts = ['{"alg":"HS256"}', "a", "ab", "abc", "é"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(
        F.decode(b64url_decode(b64url_encode(F.encode("t", "UTF-8"))), "UTF-8")).collect()
    assert [r[0] for r in got] == texts
    assert _one(spark, b64url_decode("x"), [("!!!!",)]) == [None]


def test_pairs_to_map_last_wins_and_odd(spark):
    df = spark.createDataFrame([(["a", "1", "b", "2", "a", "3", "c"],), (["k"],), ([],)], "arr array<string>")
    drop = [r[0] for r in df.select(pairs_to_map("arr")).collect()]
    keep = [r[0] for r in df.select(pairs_to_map("arr", keep_odd=True)).collect()]
    assert drop == [{"a": "3", "b": "2"}, {}, {}]
    assert keep == [{"a": "3", "b": "2", "c": ""}, {"k": ""}, {}]
