"""Helpers that several corpus operators share."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WORDS_PER_SHINGLE = 5
_MIX_1, _MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the given folder, by whatever path Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only where the session names none (a local test) a temporary folder of this machine is set.
    The folder holds intermediate tables and may be deleted once the result has been written.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if "QUADRILLE_SCRATCH" not in os.environ:
            os.environ["QUADRILLE_SCRATCH"] = tempfile.mkdtemp(prefix="quadrille-")
        base = os.environ["QUADRILLE_SCRATCH"]
    return f"{base.rstrip('/')}/quadrille-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back: its lineage ends there and survives lost executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_KEPT: dict = {}


def kept_by_worker(kind: str, make=lambda: None):
    """What a worker process keeps for its later tasks of one kind; the first task of another kind drops it, so caches don't add up."""
    if kind not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
            release()
        _KEPT[kind] = make()
    return _KEPT[kind]


def release() -> None:
    """Return free memory to the system, as far as the allocators let one ask for it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (wraps around)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _MIX_1
        x = (x ^ (x >> np.uint64(27))) * _MIX_2
        return x ^ (x >> np.uint64(31))


def bounded_sample(df: DataFrame, by: str, key: str, most: Column) -> DataFrame:
    """Rows of df of a bounded number of keys of every value of column `by`: at most `most` (of that value) each.

    Chosen are the keys whose hash is least; of rows that share value and key one stays, the least. Only values, their
    counts and hashes are ranked, and a threshold on the hash leaves a few times the wanted number before that, so
    one value may hold most of the rows and there may be any number of values. Rows without a value or key are left out.
    """
    rows = df.filter(F.col(by).isNotNull() & F.col(key).isNotNull()).withColumn("__h", F.xxhash64(key))
    shares = rows.groupBy(F.col(by).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    shares = shares.select("__v", most.alias("__most"), (F.lit(float(1 << 64)) * F.least(F.lit(1.0), (4 * most + 200) / F.col("__n")) - F.lit(float(1 << 63))).alias("__below"))
    # Written tables of one row a value: their size is known, so Spark broadcasts them as long as they are small.
    shares = stored(shares, "shares")
    near = rows.select(F.col(by).alias("__w"), "__h").join(shares, F.col("__w") == F.col("__v")).filter(F.col("__h") <= F.col("__below"))
    near = near.groupBy("__v", "__h").agg(F.first("__most").alias("__most"))
    rank = F.row_number().over(Window.partitionBy("__v").orderBy("__h"))
    last = near.withColumn("__r", rank).filter(F.col("__r") <= F.col("__most")).groupBy("__v").agg(F.max("__h").alias("__last"))
    chosen = rows.join(stored(last, "last"), F.col(by) == F.col("__v")).filter(F.col("__h") <= F.col("__last"))
    others = [c for c in df.columns if c != by]
    return chosen.groupBy("__v", "__h").agg(F.min(F.struct(*others)).alias("__row")).select(F.col("__v").alias(by), "__row.*")


class WordHasher:
    """64-bit hashes of words, kept for the words seen last (two generations of bounded size)."""

    def __init__(self, keep: int = 150_000) -> None:
        self.keep, self.new, self.old = keep, {}, {}

    def __call__(self, words: list[str]) -> np.ndarray:
        import xxhash

        new, old, out = self.new, self.old, []
        for w in words:
            h = new.get(w)
            if h is None:
                h = old.get(w)
                if h is None:
                    h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
                new[w] = h
                if len(new) >= self.keep:
                    self.old, self.new = new, {}
                    new, old = self.new, self.old
            out.append(h)
        return np.array(out, dtype=np.uint64)


def shingles(words: np.ndarray, n: int = WORDS_PER_SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of one text, given its word hashes.

    A text of fewer than n words has one shingle of all of them; one without words has none.
    """
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    m = len(words) - n + 1
    with np.errstate(over="ignore"):
        h = np.full(m, np.uint64(n), np.uint64)
        for i in range(n):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + m])
    return np.unique(h)
