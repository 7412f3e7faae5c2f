"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

Equal texts are one node. Every node gets MinHash values of its five-word shingles (words: lower case, parted
by white space), in bands whose number and rows follow from the threshold and the wanted recall; nodes that
share a band hash are candidates of one another. Candidates are gathered into clusters over star edges, so a
bucket of m nodes gives m - 1 rows, not all pairs. Inside a cluster every pair is verified on the whole
shingle sets: clusters are dealt out in tiles of at most two blocks of bounded size, so that no task gets an
unbounded group, and a tile returns link counts and a spanning forest, not pairs. Components of the forests are
the classes.

Result: one row for each row of the input with doc_id, class_id (least doc_id of the class), n_links (other
texts with similarity of at least the threshold) and n_copies (rows with the same text). Nothing is capped.

Defined results: a null text is an empty text; texts without words have no links, but equal ones are copies of
each other; a text of fewer than five words has one shingle of all its words; rows with a null id take part and
are named by the least id of their class (null if there is none); repeated rows count as copies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHasher, kept_by_worker, shingles, stored
from .graph import components
from .tokenization import blocks

THRESHOLD_NUMERATOR, THRESHOLD_DENOMINATOR = 4, 5
RECALL, MOST_HASHES = 0.999, 160
#: Texts and shingles of a block of a cluster, as expected (a hash deals them out).
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 3_000_000


def bands_for(threshold: float, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows whose bands reach the recall at the threshold within the number of hashes."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows)) if threshold < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


class MinHasher:
    """Band hashes of shingle sets."""

    def __init__(self, bands: int, rows: int, seed: int = 20) -> None:
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
        self.c = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        """One hash a band, which the band's number goes into; none for an empty set."""
        if not len(s):
            return np.empty(0, np.int64)
        least = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(s), 512):
                np.minimum(least, (s[at : at + 512, None] * self.a + self.b).min(axis=0), out=least)
            mixed = (least ^ (least >> np.uint64(29))).reshape(self.bands, self.rows) * self.c
            out = mixed.sum(axis=1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(self.bands, dtype=np.uint64)
        return out.view(np.int64)


def signatures(df: DataFrame, threshold: float, doc_id: str, text: str) -> DataFrame:
    """doc_id, t (128-bit hash of the text), n (shingles), bands for every row."""
    bands, rows = bands_for(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_by_worker("shingles")
        words, minhash = WordHasher(), MinHasher(bands, rows)
        for batch in batches:
            for part, texts in blocks(batch, 2):
                sets = [shingles(words(t.lower().split())) for t in texts]
                sigs = [minhash(s) for s in sets]
                ends = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sigs, np.empty(0, np.int64)])))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), lists], names=["doc_id", "t", "n", "bands"])

    named = df.select(F.col(doc_id).cast("long").alias("doc_id"), _key(text).alias("t"), F.col(text).alias("text"))
    return named.mapInArrow(run, "doc_id long, t binary, n long, bands array<long>")


def _key(text: str):
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def verified(sets: list[np.ndarray], first: np.ndarray, across: bool) -> np.ndarray:
    """Symmetric boolean matrix of the linked pairs of a tile.

    across: only pairs of a set in the first block with one outside it. Shingles that a single set has can't be
    shared and are left out; the others are counted by products of 0/1 matrices over slices of the shingles.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    which = np.repeat(np.arange(m), sizes)
    flat = np.concatenate([*sets, np.empty(0, np.uint64)])
    order = np.argsort(flat, kind="stable")
    flat, which = flat[order], which[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])[: len(flat)]
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(flat) else np.empty(0, bool)
    number, which = number[shared], which[shared]
    if len(number):
        number = np.cumsum(np.concatenate([[0], number[1:] != number[:-1]]))
    common = np.zeros((m, m), np.float32)
    width = 4096
    for at in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        lo, hi = np.searchsorted(number, [at, at + width])
        x = np.zeros((m, width), np.float32)
        x[which[lo:hi], number[lo:hi] - at] = 1
        common += x @ x.T
    common = common.astype(np.int64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = (THRESHOLD_DENOMINATOR * common >= THRESHOLD_NUMERATOR * union) & (union > 0)
    np.fill_diagonal(linked, False)
    if across:
        linked &= first[:, None] != first[None, :]
    return linked


def roots(linked: np.ndarray) -> np.ndarray:
    """The least member of each set's component."""
    label = np.arange(len(linked))
    while True:
        now = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _tiles(rows: DataFrame) -> DataFrame:
    """t, links, hub: what each tile found of its texts."""

    def flush(key: tuple, members: list[tuple]) -> Iterator[tuple]:
        unique = sorted({m[0]: m for m in members}.values())
        linked = verified([np.frombuffer(m[2], np.uint64) for m in unique], np.array([m[1] == key[1] for m in unique]), key[1] != key[2])
        root = roots(linked)
        for i in np.flatnonzero(linked.any(axis=1)).tolist():
            yield unique[i][0], int(linked[i].sum()), unique[root[i]][0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.binary())], names=["t", "links", "hub"])

        kept_by_worker("shingles")
        key, members = None, []
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            found: list[tuple] = []
            for root, i, j, t, block, s in zip(*cols, strict=True):
                if (root, i, j) != key:
                    if members:
                        found += flush(key, members)
                    key, members = (root, i, j), []
                members.append((t, block, s))
            yield out(found)
        if members:
            yield out(list(flush(key, members)))

    return rows.mapInArrow(run, "t binary, links long, hub binary")


def join(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of df: doc_id, class_id, n_links, n_copies, t, the hash of its text, and class_t, the least hash of its class."""
    threshold = THRESHOLD_NUMERATOR / THRESHOLD_DENOMINATOR
    rows = stored(signatures(df, threshold, doc_id, text), "signatures")
    texts = rows.groupBy("t").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_copies"), F.max("n").alias("n"), F.first("bands").alias("bands"))
    banded = texts.select("t", F.explode("bands").alias("b"))
    hubs = banded.groupBy("b").agg(F.min("t").alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1").select(F.col("b").alias("hb"), "hub")
    stars = banded.join(hubs, F.col("b") == F.col("hb")).select(F.col("t").alias("u"), F.col("hub").alias("v"))
    clusters = stored(components(stars), "clusters")
    sized = texts.select("t", "least", "n").join(clusters.withColumnRenamed("node", "t"), "t")
    sized = stored(sized, "members")
    per = sized.groupBy(F.col("root").alias("r")).agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("nb"))
    members = sized.join(per, F.col("root") == F.col("r")).select("root", "nb", "least", F.col("t").alias("mt"), F.pmod(F.xxhash64("t"), F.col("nb")).cast("int").alias("block"))
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), _key(text).alias("t"))
    # A merge join at every size: the texts of members are found with one shuffle of the table, whatever fits a broadcast.
    chosen = source.join(members.hint("merge"), (F.col("t") == F.col("mt")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("root", "nb", "block", "t", "text")
    sets = chosen.mapInArrow(_sets, "root binary, nb int, block int, t binary, shingles binary")
    tile = F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other")
    dealt = sets.select("root", "block", "t", "shingles", tile).select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "t", "block", "shingles")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tiles = _tiles(dealt.repartition(parts, "root", "i", "j").sortWithinPartitions("root", "i", "j"))
    links = stored(tiles, "links")
    classes = components(links.select(F.col("t").alias("u"), F.col("hub").alias("v")))
    count = links.groupBy(F.col("t").alias("lt")).agg(F.sum("links").alias("n_links"))
    named = texts.select("t", "least", "n_copies").join(classes, F.col("t") == F.col("node"), "left").join(count, F.col("t") == F.col("lt"), "left")
    grouped = sized.select(F.col("t").alias("gt"), "least").join(classes, F.col("gt") == F.col("node")).groupBy(F.col("root").alias("gr")).agg(F.min("least").alias("class_least"))
    named = named.join(grouped, F.col("root") == F.col("gr"), "left")
    named = named.select(F.col("t").alias("nt"), F.when(F.col("root").isNull(), F.col("least")).otherwise(F.col("class_least")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies", F.coalesce("root", "t").alias("class_t"))
    return rows.select("doc_id", "t").join(named, F.col("t") == F.col("nt")).select("doc_id", "class_id", "n_links", "n_copies", "t", "class_t")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingle sets of texts (last column) as bytes."""
    kept_by_worker("shingles")
    words = WordHasher()
    for batch in batches:
        for part, texts in blocks(batch, 4):
            sets = [shingles(words(t.lower().split())).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), pa.array(sets, pa.binary())], names=["root", "nb", "block", "t", "shingles"])


def kept(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df that stay when each class keeps one document: that of its least id (ids before null), of equal ids the one
    whose text's hash is least; of rows that are alike in both, one."""
    columns = df.columns
    inner = df.toDF(*[f"__c{i}" for i in range(len(columns))])
    of, content = (f"__c{columns.index(c)}" for c in (doc_id, text))
    found = join(inner, of, content)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("t").alias("t"))).alias("r")
    winners = found.groupBy("class_t").agg(least).select(F.col("r.id").alias("__id"), F.col("r.t").alias("__of"))
    rows = inner.withColumn("__t", _key(content))
    rows = rows.join(winners.hint("merge"), F.col(of).cast("long").eqNullSafe(F.col("__id")) & (F.col("__t") == F.col("__of")))
    rows = rows.dropDuplicates(["__id", "__t"]).select(*inner.columns)
    return rows.toDF(*columns)
