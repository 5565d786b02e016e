import random

import numpy as np
import pyarrow as pa
import pytest

from sluice.llm import common
from tests.llm.helpers import LONG_TEXT, words


def test_words_agree_with_the_pattern():
    rnd = random.Random(3)
    texts = ["".join(rnd.choice("aAbB \t\n\x0b\x0c\ré. ") for _ in range(rnd.randint(0, 40))) for _ in range(300)] + [None, "", LONG_TEXT]
    seen: dict[str, int] = {}
    w = common.Words(pa.array(texts, pa.string()))
    for i, text in enumerate(texts):
        plain = words(text)
        got = w.row(i).tolist()
        assert len(got) == len(plain)
        for a, b in zip(plain, got):
            assert seen.setdefault(a, b) == b
    assert len(set(seen.values())) == len(seen)


def test_words_of_a_slice():
    a = pa.array(["x y", "aa bb cc", None, "dd"], pa.string())
    w = common.Words(a.slice(1, 3))
    assert [len(w.row(i)) for i in range(3)] == [3, 0, 1]
    assert w.row(0).tolist() == common.Words(pa.array(["AA bb\ncc"])).row(0).tolist()


def test_shingles_of_short_texts():
    w = common.Words(pa.array(["a b", "b a", "", "a b c d e f"]))
    assert len(common.shingles(w.row(0))) == 1
    assert common.shingles(w.row(0))[0] != common.shingles(w.row(1))[0]
    assert len(common.shingles(w.row(2))) == 0
    assert len(common.shingles(w.row(3))) == 2


def test_row_slices_cover_all_rows():
    a = pa.array(["x" * 10] * 7 + [None, "y" * 100], pa.string())
    parts = list(common.row_slices(a, 25))
    assert parts[0][0] == 0 and parts[-1][1] == 9 and all(p[1] == q[0] for p, q in zip(parts, parts[1:]))
    assert list(common.row_slices(pa.array([], pa.string()))) == []


def test_shared_folder_is_needed_off_local_masters(spark):
    class Context:
        master = "spark://somewhere:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError):
        common.shared_dir(Session())


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(common.mix(x))) == len(x)


@pytest.mark.parametrize("case", ["a third null", "one far key", "one hot key", "uniform", "clustered"])
def test_ranges_split_heavy_bins(spark, case):
    """No shard is much heavier than the target, and shards follow the order of the keys."""
    from pyspark.sql import functions as F
    key = {"a third null": "if(id % 3 = 0, null, id)", "one far key": "if(id = 5, 1000000000000000, id)", "one hot key": "if(id % 3 = 0, 77, id)",
           "uniform": "id * 1000", "clustered": "if(id % 2 = 0, 1000000000000 + id, id)"}[case]
    rows = spark.range(6000).selectExpr(f"{key} as k", "id as v").withColumn("text", F.concat(F.lit("t"), "v"))
    ranges = common.Ranges(rows, "k", F.lit(10), 1000, F.xxhash64("text"), bins=64)
    dealt = ranges.with_shard(rows)
    assert dealt.count() == 6000 and dealt.columns == ["k", "v", "text", "shard"]
    shards = sorted((r.shard, r.n, r.lo, r.hi) for r in dealt.groupBy("shard").agg(
        F.count("*").alias("n"), F.min(F.coalesce("k", F.lit(-1))).alias("lo"), F.max(F.coalesce("k", F.lit(-1))).alias("hi")).collect())
    assert max(n for _, n, _, _ in shards) <= 300 and len(shards) == ranges.n_shards >= 20
    assert all(a[3] <= b[2] for a, b in zip(shards, shards[1:]))


def test_equal_rows_and_rows_without_a_tie_stay_together(spark):
    from pyspark.sql import functions as F
    rows = spark.range(500).selectExpr("cast(null as long) as k", "'same' as text")
    assert common.Ranges(rows, "k", F.lit(10), 100, F.xxhash64("text")).with_shard(rows).select("shard").distinct().count() == 1
    assert common.Ranges(rows, "k", F.lit(10), 100).with_shard(rows).count() == 500
    assert common.Ranges(rows.limit(0), "k", F.lit(10), 100, F.xxhash64("text")).with_shard(rows.limit(0)).count() == 0
