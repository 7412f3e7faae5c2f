"""GeoTIFF rasters (with overviews) as tables of chunks, and the codecs of their tiles."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import jpeg

#: Fixed values of the format: struct codes of the field types and numpy kinds of the sample formats.
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
SAMPLE = {1: "u", 2: "i", 3: "f"}


@dataclass
class Level:
    """One resolution: size, tile size, sample layout, and where its tiles are."""

    width: int
    height: int
    tile_w: int
    tile_h: int
    samples: int
    bits: int
    sample_format: int
    compression: int
    predictor: int
    offsets: tuple
    counts: tuple
    tables: bytes | None = None
    order: str = "<"
    factor: float = 1.0
    photometric: int = 1

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_w)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_h)

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(f"{self.order}{SAMPLE[self.sample_format]}{max(1, self.bits // 8)}")


@dataclass
class Tiff:
    """Levels (finest first) and place of a raster."""

    levels: list[Level] = field(default_factory=list)
    origin: tuple[float, float] = (0.0, 0.0)
    pixel: tuple[float, float] = (1.0, 1.0)
    nodata: float | None = None
    epsg: int | None = None


def read_header(path: str) -> Tiff:
    """Directories of a TIFF or BigTIFF with tiles; masks are passed over."""
    out = Tiff()
    with open(path, "rb") as f:

        def at(pos: int, n: int) -> bytes:
            f.seek(pos)
            data = f.read(n)
            if len(data) != n:
                raise OSError("the file ends too early")
            return data

        head = at(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(head[:2])
        if order is None:
            raise ValueError("not a TIFF file")
        big = struct.unpack_from(order + "H", head, 2)[0] == 43
        pos = struct.unpack_from(order + ("Q" if big else "I"), head, 8 if big else 4)[0]
        while pos:
            n = struct.unpack(order + ("Q" if big else "H"), at(pos, 8 if big else 2))[0]
            pos += 8 if big else 2
            size = 20 if big else 12
            tags: dict[int, tuple | bytes] = {}
            for k in range(n):
                e = at(pos + k * size, size)
                tag, kind = struct.unpack_from(order + "HH", e)
                count = struct.unpack_from(order + ("Q" if big else "I"), e, 4)[0]
                code = FIELD.get(kind)
                if not code:
                    continue
                width = struct.calcsize(order + code) * count
                inline = e[12:20] if big else e[8:12]
                data = inline[:width] if width <= len(inline) else at(struct.unpack(order + ("Q" if big else "I"), inline)[0], width)
                tags[tag] = data if code == "s" else struct.unpack(order + code * count, data)
            pos = struct.unpack(order + ("Q" if big else "I"), at(pos + n * size, 8 if big else 4))[0]
            one = lambda t, default=None: tags[t][0] if t in tags else default
            if one(254, 0) & 4 or 324 not in tags:
                continue
            out.levels.append(Level(one(256), one(257), one(322), one(323), one(277, 1), one(258, 1), one(339, 1), one(259, 1), one(317, 1), tags[324], tags[325], tags.get(347) if isinstance(tags.get(347), bytes) else bytes(tags.get(347, ())) or None, order, photometric=one(262, 1)))
            if 33550 in tags and 33922 in tags and len(out.levels) == 1:
                px, py = tags[33550][:2]
                i, j, _, x, y, _ = tags[33922][:6]
                out.origin, out.pixel = (x - i * px, y + j * py), (px, py)
            if 42113 in tags and out.nodata is None:
                text = tags[42113].split(b"\0")[0].decode().strip()
                out.nodata = float(text) if text else None
            keys = tags.get(34735, ())
            for k in range(4, len(keys), 4):
                if keys[k] in (2048, 3072) and keys[k + 1] == 0 and keys[k + 3] not in (0, 32767):
                    out.epsg = keys[k + 3]
    if not out.levels:
        raise ValueError("the file has no tiled image")
    out.levels.sort(key=lambda x: -x.width)
    for x in out.levels:
        x.factor = out.levels[0].width / x.width
    return out


def lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes from the high bit on, which widen one code early."""
    out, table, width, bits, held, previous = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        code = held >> (bits - width) & ((1 << width) - 1)
        bits -= width
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, previous = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if previous is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out += entry
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def unpacked(data: bytes, compression: int, size: int) -> bytes:
    """Bytes of a tile, padded with zeros to its size."""
    if compression == 1:
        out = data
    elif compression in (8, 32946):
        try:
            out = zlib.decompress(data)
        except zlib.error:
            out = zlib.decompressobj(-15).decompress(data)
    elif compression == 5:
        out = lzw(data)
    elif compression == 50000:
        out = pa.Codec("zstd").decompress(data, size).to_pybytes()
    else:
        raise ValueError(f"no codec here for compression {compression}")
    return out[:size].ljust(size, b"\0")


def samples(data: bytes | None, level: Level) -> np.ndarray:
    """Samples of a tile, shape (rows, columns, samples); a hole is zeros."""
    shape = (level.tile_h, level.tile_w, level.samples)
    if data is None:
        return np.zeros(shape, level.dtype)
    if level.bits == 1:
        row = -(-level.tile_w * level.samples // 8)
        raw = np.frombuffer(unpacked(data, level.compression, row * level.tile_h), np.uint8).reshape(level.tile_h, row)
        return (np.unpackbits(raw, axis=1)[:, : level.tile_w * level.samples].reshape(shape) * 255).astype(np.uint8)
    if level.compression == 7:
        found = jpeg.decode(data, level.tables, level.photometric == 6)[: level.tile_h, : level.tile_w, : level.samples]
        return np.pad(found, [(0, n - m) for n, m in zip(shape, found.shape, strict=True)])
    width = level.bits // 8
    raw = unpacked(data, level.compression, level.tile_h * level.tile_w * level.samples * width)
    if level.predictor == 3:
        rows = np.frombuffer(raw, np.uint8).reshape(level.tile_h, -1, level.samples if level.samples > 1 else 1)
        flat = np.cumsum(rows, axis=1, dtype=np.uint8).reshape(level.tile_h, width, level.tile_w * level.samples)
        return np.ascontiguousarray(np.moveaxis(flat, 1, 2)).view(f">f{width}").reshape(shape).astype(f"<f{width}")
    out = np.frombuffer(raw, level.dtype).reshape(shape)
    return np.cumsum(out, axis=1, dtype=out.dtype) if level.predictor == 2 else out


def rgba(tile: np.ndarray) -> np.ndarray:
    """Bytes of 1, 2, 3 or more samples as RGBA."""
    n = tile.shape[2]
    grey = tile[..., :1] if n < 3 else None
    colour = np.repeat(grey, 3, axis=2) if grey is not None else tile[..., :3]
    alpha = tile[..., 3:4] if n > 3 else np.full((*tile.shape[:2], 1), 255, tile.dtype)
    return np.concatenate([colour, alpha], axis=2).astype(np.uint8)


class _Run(InputPartition):
    def __init__(self, level: int, first: int, after: int) -> None:
        self.level, self.first, self.after = level, first, after


class GeoTiffSource(DataSource):
    """spark.read.format("geotiff"): options path, level (all), run (tiles a task); rows (level, tile_index, grid_col, grid_row, bytes), bytes null for a hole."""

    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def schema(self) -> str:
        return "level int, tile_index long, grid_col long, grid_row long, bytes binary"

    def reader(self, schema) -> DataSourceReader:
        return _TiffReader(self.options)


class _TiffReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.level, self.run = options["path"], options.get("level"), int(options.get("run", 256))

    def partitions(self) -> list[InputPartition]:
        levels = read_header(self.path).levels
        wanted = range(len(levels)) if self.level is None else [int(self.level)]
        return [_Run(k, i, min(i + self.run, len(levels[k].offsets))) for k in wanted for i in range(0, len(levels[k].offsets), self.run)]

    def read(self, part: _Run) -> Iterator[tuple]:
        level = read_header(self.path).levels[part.level]
        with open(self.path, "rb") as f:
            for i in range(part.first, part.after):
                data = None
                if level.offsets[i] and level.counts[i]:
                    f.seek(level.offsets[i])
                    data = f.read(level.counts[i])
                    if len(data) != level.counts[i]:
                        raise OSError("the file ends too early")
                yield part.level, i, i % level.across, i // level.across, data


def pixels(chunks: DataFrame, tiff: Tiff, level: int = 0, bands: list[int] | None = None) -> DataFrame:
    """Pixels (col, row, b<n>...) of one level's chunks; only the wanted bands (1-based) leave the decoder, padding doesn't."""
    of = tiff.levels[level]
    bands = bands or list(range(1, of.samples + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for col, row, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                tile = samples(data, of)[: of.height - row * of.tile_h, : of.width - col * of.tile_w]
                r, c = np.mgrid[0 : tile.shape[0], 0 : tile.shape[1]]
                yield pa.RecordBatch.from_arrays([pa.array((c + col * of.tile_w).ravel()), pa.array((r + row * of.tile_h).ravel()), *[pa.array(tile[..., n - 1].ravel().astype(np.float64)) for n in bands]], names=["col", "row", *[f"b{n}" for n in bands]])

    schema = "col long, row long, " + ", ".join(f"b{n} double" for n in bands)
    return chunks.filter(chunks.level == level).select("grid_col", "grid_row", "bytes").mapInArrow(run, schema)


def write_tiff(path: str, image: np.ndarray, tile: int, origin: tuple[float, float], pixel: tuple[float, float], overviews: int = 0, epsg: int = 3857, compression: int = 8, predictor: int = 1, nodata: float | None = None) -> None:
    """A tiled GeoTIFF of shape (rows, columns, samples) with halved overviews, for tests and exports."""
    images = [image]
    for _ in range(overviews):
        images.append(images[-1][::2, ::2])
    body, directories = bytearray(b"II" + struct.pack("<HI", 42, 0)), []
    for k, im in enumerate(images):
        h, w, n = im.shape
        offsets, counts = [], []
        for y in range(0, h, tile):
            for x in range(0, w, tile):
                t = np.zeros((tile, tile, n), im.dtype)
                part = im[y : y + tile, x : x + tile]
                t[: part.shape[0], : part.shape[1]] = part
                if predictor == 2:
                    t = np.diff(t, axis=1, prepend=np.zeros((tile, 1, n), im.dtype))
                data = zlib.compress(t.tobytes()) if compression == 8 else t.tobytes()
                offsets.append(len(body))
                counts.append(len(data))
                body += data
        kind = {"u": 1, "i": 2, "f": 3}[im.dtype.kind]
        tags = [(254, 4, [1 if k else 0]), (256, 4, [w]), (257, 4, [h]), (258, 3, [im.dtype.itemsize * 8] * n), (259, 3, [compression]), (277, 3, [n]), (317, 3, [predictor]), (322, 3, [tile]), (323, 3, [tile]), (324, 4, offsets), (325, 4, counts), (339, 3, [kind] * n)]
        if k == 0:
            tags += [(33550, 12, [*pixel, 0.0]), (33922, 12, [0.0, 0.0, 0.0, *origin, 0.0]), (34735, 3, [1, 1, 0, 1, 3072, 0, 1, epsg])]
            if nodata is not None:
                tags.append((42113, 2, f"{nodata}\0".encode()))
        directories.append(sorted(tags))
    last = 4
    for tags in directories:
        packed = []
        for tag, kind, values in tags:
            data = values if kind == 2 else struct.pack(f"<{len(values)}{FIELD[kind]}", *values)
            if len(data) > 4:
                packed.append((tag, kind, len(values), struct.pack("<I", len(body))))
                body += data + b"\0" * (len(data) % 2)
            else:
                packed.append((tag, kind, len(values), data.ljust(4, b"\0")))
        struct.pack_into("<I", body, last, len(body))
        body += struct.pack("<H", len(packed)) + b"".join(struct.pack("<HHI", *p[:3]) + p[3] for p in packed)
        last = len(body)
        body += b"\0\0\0\0"
    with open(path, "wb") as f:
        f.write(body)
