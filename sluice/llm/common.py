"""Shared helpers: reading tables, shared scratch tables, and vectorised word hashing over Arrow string columns.

Words are maximal runs of bytes other than space and 0x09-0x0D; A-Z is lower-cased.  A word's hash is a polynomial over
its bytes modulo 2**64, taken from prefix sums over the whole buffer, so no Python code runs per word.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import delete_on_exit

SLICE_BYTES = 1 << 20
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_POWERS: dict[str, np.ndarray] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; Spark's reader opens it, so any file system it knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    A temporary folder is taken only where the setting is absent and the master is local (tests).
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends, and lost executors cost nothing.

    The file system removes the table when the application ends.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    delete_on_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for files that are not tables."""
    return os.path.join(shared_dir(spark), "llm", f"{name}-{uuid.uuid4().hex}")


# Rows and bytes that a Python worker gets at a time; long texts make large batches otherwise.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers once per Spark application; keep batches small where the session does not say."""
    for key, value in BATCHES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    sc = spark.sparkContext
    if getattr(sc, "_llm_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="llm-ship-"), "llm_workers.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(root), os.path.relpath(full, root)))
    sc.addPyFile(path)
    sc._llm_shipped = True


class Ranges:
    """Deals rows to shards by ranges of an integer key, the same on any cluster.

    Equal-width bins of the keys are weighed.  A bin heavier than ``target`` is split again, by the keys inside it, or where it
    holds a single key (or null) by ``tie``, a hash of the row; so neither a far key nor a key that many rows share makes a
    heavy shard (only equal rows stay together).  Consecutive bins are joined up to ``target``.  There are at most ``bins`` + 1 bins and some for
    each ``target`` of weight; their weights are gathered on the driver and the table bin -> shard is broadcast.
    """

    def __init__(self, rows: DataFrame, key: str, weight: Column, target: int, tie: Column | None = None, bins: int = 4096):
        spark = rows.sparkSession
        edge = rows.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        self.key, self.tie, self.lo = key, tie, edge["lo"] or 0
        self.width = ((edge["hi"] or 0) - self.lo) // bins + 1
        self.splits: list[DataFrame] = []
        weights: dict[str, int] = {}
        todo = rows.withColumn("weight", weight).withColumn("bin", self.bin())
        while True:
            heavy = []
            for r in todo.groupBy("bin").agg(F.sum("weight").alias("w"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect():
                by_key = r["lo"] is not None and r["lo"] < r["hi"]
                if r["w"] > target and (by_key or tie is not None and "t" not in r["bin"]):
                    pieces = max(64, min(bins, 2 * -(-r["w"] // target)))
                    heavy.append((r["bin"], r["lo"] if by_key else None, (r["hi"] - r["lo"]) // pieces + 1 if by_key else None, pieces))
                else:
                    weights[r["bin"]] = r["w"]
            if not heavy:
                break
            self.splits.append(spark.createDataFrame(heavy, "bin string, split_lo long, split_width long, pieces long"))
            todo = self.split(todo.join(F.broadcast(self.splits[-1].select("bin")), "bin", "left_semi"), self.splits[-1])
        shards, total = {}, 0
        for path in sorted(weights, key=lambda p: [int(x.removeprefix("t")) for x in p.split("/")]):
            shards[path] = total // target
            total += weights[path]
        renumber = {old: new for new, old in enumerate(sorted(set(shards.values())))}
        self.n_shards = max(1, len(renumber))
        self.table = spark.createDataFrame([(b, renumber[s]) for b, s in shards.items()], "bin string, shard int")

    def bin(self) -> Column:
        return F.coalesce(F.floor((F.col(self.key) - F.lit(self.lo)) / F.lit(self.width)), F.lit(-1)).cast("string")

    def split(self, rows: DataFrame, table: DataFrame) -> DataFrame:
        """Rows of the bins in ``table`` go to the pieces of their bin."""
        by_tie = F.lit(None).cast("string") if self.tie is None else F.concat(
            F.lit("t"), F.floor(F.pmod(self.tie, F.lit(1 << 32)) * F.col("pieces") / F.lit(1 << 32)).cast("string"))
        piece = F.when(F.col("split_lo").isNull(), by_tie).otherwise(F.floor((F.col(self.key) - F.col("split_lo")) / F.col("split_width")).cast("string"))
        to = F.when(F.col("pieces").isNull(), F.col("bin")).otherwise(F.concat("bin", F.lit("/"), piece))
        return rows.join(F.broadcast(table), "bin", "left").withColumn("bin", to).drop("split_lo", "split_width", "pieces")

    def with_shard(self, rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("bin", self.bin())
        for table in self.splits:
            rows = self.split(rows, table)
        return rows.join(F.broadcast(self.table), "bin").drop("bin")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers with good avalanche."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        for key, base in (("up", _BASE), ("down", _BASE_INV)):
            out = np.ones(size, dtype=_U)
            done, step = 1, base
            while done < size:  # doubling: out[done:2*done] = out[:done] * base**done
                m = min(done, size - done)
                out[done:done + m] = out[:m] * _U(step)
                done += m
                step = step * step & _MASK
            _POWERS[key] = out
    return _POWERS["up"][:n], _POWERS["down"][:n]


def row_slices(texts: pa.Array, limit: int = 2 * SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes of text together (one longer row stands alone)."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        n = 0 if n != n or n is None else int(n)
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Hashes of the words of some rows: ``hash[first[i]:first[i + 1]]`` are those of row ``i``."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        space = _SPACE[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.empty(len(data), dtype=bool)
        if len(data):
            before[0] = True
            before[1:] = space[:-1]
        starts = np.flatnonzero(~space & (before | edge[:-1]))
        after = np.empty(len(data), dtype=bool)
        if len(data):
            after[-1] = True
            after[:-1] = space[1:]
        ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        self.starts, self.ends = starts, ends
        self.first = np.searchsorted(starts, offsets)
        self.hash = np.empty(len(starts), dtype=_U)
        at = 0
        while at < len(starts):  # whole words up to a slice of bytes, so that temporary arrays stay small
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE_BYTES, "right")))
            lo, hi = int(starts[at]), int(ends[to - 1])
            part = data[lo:hi]
            up, down = _powers(hi - lo)
            sums = np.zeros(hi - lo + 1, dtype=_U)
            np.cumsum(((_LOWER[part] if lower else part).astype(_U) + _U(1)) * up, out=sums[1:])
            s, e = starts[at:to] - lo, ends[at:to] - lo
            self.hash[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(_U) * _U(0xD6E8FEB86659FD93))
            at = to

    def row(self, i: int) -> np.ndarray:
        return self.hash[self.first[i]:self.first[i + 1]]


_PLACE = [_U(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64)) for k in range(64)]


def shingles(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of all k-word shingles in order; fewer than k words make one shingle, none make none."""
    n = len(words)
    if n == 0:
        return words
    width = min(k, n)
    out = np.zeros(n - width + 1, dtype=_U)
    for j in range(width):
        out += words[j:n - width + 1 + j] * _PLACE[j]
    return mix(out + _U(width))


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return np.ascontiguousarray(x).view(np.int64)
