"""The write-through overlay of a tile archive: an append-only record table, its log file, and streaming compaction.

A record is (tile_id, seq, blob); the last record of a tile wins. Compaction merges the overlay into a base table,
in one batch or as a stream whose batches are replayed without effect after a failure.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.aggregates import latest
from ..operators.joins import overlay_over_base

RECORD = "tile_id long, seq long, blob binary"


def put(records: DataFrame, path: str) -> None:
    """Append records to the overlay's table."""
    records.select("tile_id", "seq", "blob").write.mode("append").parquet(path)


def current(spark: SparkSession, path: str) -> DataFrame:
    """The last record of every tile of the overlay."""
    return latest(spark.read.schema(RECORD).parquet(path))


def compacted(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Base and overlay as one table, the overlay's tiles first."""
    return overlay_over_base(base, latest(overlay)).select("tile_id", "blob")


def clear(spark: SparkSession, path: str) -> None:
    """Empty the overlay."""
    spark.createDataFrame([], RECORD).write.mode("overwrite").parquet(path)


def _numbers(spark: SparkSession, base_path: str) -> dict[str, list[int]]:
    """The numbers of the complete tables under a base: v=<n> whole ones, d=<n> later records only."""
    at = spark._jvm.org.apache.hadoop.fs.Path(base_path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out: dict[str, list[int]] = {"v": [], "d": []}
    for status in fs.listStatus(at) if fs.exists(at) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in out and number.isdigit() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            out[kind].append(int(number))
    return out


def _records(spark: SparkSession, base_path: str, found: dict[str, list[int]]) -> DataFrame:
    """The last record of every tile: the newest whole table and what came after it. Whole tables without seq are older than any record."""
    newest = max(found["v"], default=-1)
    out = spark.read.schema(RECORD).parquet(*[f"{base_path}/d={n}" for n in found["d"] if n > newest]) if any(n > newest for n in found["d"]) else spark.createDataFrame([], RECORD)
    if newest >= 0:
        whole = spark.read.parquet(f"{base_path}/v={newest}")
        seq = F.col("seq") if "seq" in whole.columns else F.lit(-1)
        out = out.union(whole.select("tile_id", seq.cast("long").alias("seq"), "blob"))
    return latest(out)


def base_tiles(spark: SparkSession, base_path: str) -> DataFrame:
    """The tiles of a base that compact_stream keeps: tile_id, blob."""
    return _records(spark, base_path, _numbers(spark, base_path)).select("tile_id", "blob")


class Owner:
    """A flag file under a base, made only if there is none: one compaction at a time. A crash leaves it; release() takes it away."""

    def __init__(self, spark: SparkSession, base_path: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path(f"{base_path}/_compacting")
        self.fs = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def take(self) -> bool:
        return self.fs.createNewFile(self.path)

    def release(self) -> None:
        self.fs.delete(self.path, False)


def compact(spark: SparkSession, base_path: str) -> bool:
    """Merge a base's tables into one whole table of the next number; False if another compaction owns the base."""
    owner = Owner(spark, base_path)
    if not owner.take():
        return False
    try:
        found = _numbers(spark, base_path)
        number = max(found["v"] + found["d"], default=-1)
        _records(spark, base_path, found).write.mode("overwrite").parquet(f"{base_path}/v={number + 1}")
    finally:
        owner.release()
    return True


def compact_stream(spark: SparkSession, overlay_path: str, base_path: str, checkpoint: str, trigger: dict | None = None, merge_every: int = 8):
    """A query that folds new overlay records into a base, read by base_tiles.

    A batch writes only its own last records, as a table of the next number; the base as a whole is written anew after
    every merge_every such tables. Records keep their seq, so a record that comes late never hides a newer one, and a batch
    that is replayed after a failure, or under a new checkpoint, changes nothing: no table is taken away or assumed to be there.
    A record without a blob hides nothing.
    """

    def fold(batch: DataFrame, _: int) -> None:
        found = _numbers(spark, base_path)
        number = max(found["v"] + found["d"], default=-1) + 1
        latest(batch.filter(F.col("blob").isNotNull()).select("tile_id", "seq", "blob")).write.mode("overwrite").parquet(f"{base_path}/d={number}")
        newest = max(found["v"], default=-1)
        if sum(n > newest for n in found["d"]) + 1 >= merge_every:
            compact(spark, base_path)

    stream = spark.readStream.schema(RECORD).parquet(overlay_path)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def invalidated_tiles(events: DataFrame, tile_of, delay: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """An extension: tiles that a stream of point events touches, counted by event-time windows with a watermark.

    events has ts, lon and lat; tile_of makes the tile id Column from the columns lon and lat.
    """
    marked = events.withWatermark("ts", delay).withColumn("tile_id", tile_of(F.col("lon"), F.col("lat")))
    return marked.groupBy(F.window("ts", window), "tile_id").agg(F.count(F.lit(1)).alias("n"))


# The log file: records of id (8 bytes), length (4), CRC-32 of the blob (4), blob; a torn end is cut off.


def write_log(path: str, records: Iterable[tuple[int, bytes]]) -> None:
    with open(path, "ab") as f:
        for id, blob in records:
            f.write(struct.pack("<QII", id, len(blob), zlib.crc32(blob)) + blob)


def read_log(path: str, repair: bool = True) -> Iterator[tuple[int, int, bytes]]:
    """Whole records with their sequence numbers; the first bad one ends the log, which is then cut there."""
    with open(path, "r+b" if repair else "rb") as f:
        seq = at = 0
        while True:
            head = f.read(16)
            if len(head) < 16:
                break
            id, n, crc = struct.unpack("<QII", head)
            blob = f.read(n)
            if len(blob) < n or zlib.crc32(blob) != crc:
                break
            at = f.tell()
            yield id, seq, blob
            seq += 1
        if repair:
            f.truncate(at)
