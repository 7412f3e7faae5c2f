"""Tile archives as tables, and tables as archives."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.pmtiles import Archive, write


class PmtilesSource(DataSource):
    """spark.read.format("pmtiles"): option path; rows (tile_id, run_length, blob), a run's blob once."""

    @classmethod
    def name(cls) -> str:
        return "pmtiles"

    def schema(self) -> str:
        return "tile_id long, run_length long, blob binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


class _Leaf(InputPartition):
    def __init__(self, entries: list[tuple]) -> None:
        self.entries = entries


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        root = Archive(self.path).root
        leaves = [_Leaf([e]) for e in root if e[1] == 0]
        tiles = [e for e in root if e[1]]
        return leaves + [_Leaf(tiles[i : i + 2048]) for i in range(0, len(tiles), 2048)] or [_Leaf([])]

    def read(self, part: _Leaf) -> Iterator[tuple]:
        a = Archive(self.path)
        for e in part.entries:
            for tile, run, offset, length in a.leaf(e[2], e[3]) if e[1] == 0 else [e]:
                yield tile, run, a.blob(offset, length)


def expanded(archive: DataFrame) -> DataFrame:
    """One row for each addressed tile."""
    return archive.select(F.explode(F.sequence("tile_id", F.col("tile_id") + F.col("run_length") - 1)).alias("tile_id"), "blob")


def export(tiles: DataFrame, path: str, kind: str = "mvt", metadata: dict | None = None) -> dict:
    """Write (tile_id, blob) rows as one archive file.

    Spark sorts the tiles by range; the driver streams one partition after another into the file, which a single
    file asks for, and never holds more than one.
    """
    rows = tiles.select("tile_id", "blob").orderBy("tile_id").toLocalIterator(prefetchPartitions=False)
    return write(path, ((r[0], bytes(r[1])) for r in rows), kind, metadata)
