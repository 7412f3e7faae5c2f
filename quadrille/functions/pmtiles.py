"""Single-file tile archives: directories, header, writer and reader."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterable

from .grids import tile_of_id
from .mvt import varint

#: Fixed values of the format: bytes that the root directory may take, and tile types.
ROOM = 16384 - 127
TYPES = {"mvt": 1, "png": 2}


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    shift = value = 0
    while True:
        b = data[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def pack_directory(entries: list[tuple[int, int, int, int]]) -> bytes:
    """Entries (tile id, run length, offset, length): five columns of varints; an offset of 0 follows on the entry before."""
    ids = [e[0] for e in entries]
    columns = [[len(entries)], [b - a for a, b in zip([0, *ids], ids)], [e[1] for e in entries], [e[3] for e in entries]]
    columns.append([0 if i and e[2] == entries[i - 1][2] + entries[i - 1][3] else e[2] + 1 for i, e in enumerate(entries)])
    return gzip.compress(b"".join(varint(v) for c in columns for v in c), mtime=0)


def unpack_directory(data: bytes, most: int = 1 << 28) -> list[tuple[int, int, int, int]]:
    """The entries of a packed directory; one that unpacks to more than `most` bytes is refused."""
    raw = zlib.decompressobj(31).decompress(data, most)
    n, at = _read_varint(raw, 0)
    columns = []
    for _ in range(4):
        column = []
        for _ in range(n):
            v, at = _read_varint(raw, at)
            column.append(v)
        columns.append(column)
    out, tile = [], 0
    for delta, run, length, offset in zip(*columns):
        tile += delta
        out.append((tile, run, out[-1][2] + out[-1][3] if offset == 0 and out else offset - 1, length))
    return out


def root_and_leaves(entries: list[tuple[int, int, int, int]]) -> tuple[bytes, bytes]:
    """A root directory that fits, with leaf directories where there must be some."""
    root = pack_directory(entries)
    size = 4096
    leaves = b""
    while len(root) > ROOM:
        leaves, roots = b"", []
        for i in range(0, len(entries), size):
            leaf = pack_directory(entries[i : i + size])
            roots.append((entries[i][0], 0, len(leaves), len(leaf)))
            leaves += leaf
        root, size = pack_directory(roots), int(size * 1.2) + 1
    return root, leaves


def write(path: str, tiles: Iterable[tuple[int, bytes]], kind: str = "mvt", metadata: dict | None = None, bounds: tuple = (-180.0, -85.0, 180.0, 85.0)) -> dict:
    """Write tiles of strictly ascending ids; equal contents are stored once. The file appears whole or not at all."""
    entries: list[list[int]] = []
    seen: dict[bytes, tuple[int, int]] = {}
    size, addressed, last = 0, 0, -1
    part, data = f"{path}.part", f"{path}.data"
    with open(data, "wb") as f:
        for tile, blob in tiles:
            if tile <= last:
                raise ValueError("tiles must come in ascending order")
            last, addressed = tile, addressed + 1
            packed = gzip.compress(blob, mtime=0) if kind == "mvt" else blob
            key = hashlib.sha256(packed).digest()
            if key not in seen:
                seen[key] = (size, len(packed))
                f.write(packed)
                size += len(packed)
            offset, length = seen[key]
            if entries and entries[-1][2:] == [offset, length] and tile == entries[-1][0] + entries[-1][1]:
                entries[-1][1] += 1
            else:
                entries.append([tile, 1, offset, length])
    root, leaves = root_and_leaves([tuple(e) for e in entries])
    meta = gzip.compress(json.dumps(metadata or {}).encode(), mtime=0)
    zooms = [tile_of_id(entries[0][0])[0], tile_of_id(last)[0]] if entries else [0, 0]
    at = 127
    places = []
    for n in (len(root), len(meta), len(leaves), size):
        places += [at, n]
        at += n
    e7 = [round(v * 1e7) for v in bounds]
    centre = [round((bounds[0] + bounds[2]) / 2 * 1e7), round((bounds[1] + bounds[3]) / 2 * 1e7)]
    head = b"PMTiles" + struct.pack("<B8Q3Q4B2B4iB2i", 3, *places, addressed, len(entries), len(seen), 1, 2, 2 if kind == "mvt" else 1, TYPES[kind], *zooms, *e7, zooms[0], *centre)
    with open(part, "wb") as f:
        f.write(head + root + meta + leaves)
        with open(data, "rb") as d:
            while block := d.read(1 << 20):
                f.write(block)
    os.remove(data)
    os.replace(part, path)
    return {"addressed": addressed, "entries": len(entries), "contents": len(seen), "bytes": at}


class Archive:
    """Reads an archive's header, metadata, entries and single tiles."""

    def __init__(self, path: str) -> None:
        self.path = path
        with open(path, "rb") as f:
            head = f.read(127)
            if head[:7] != b"PMTiles" or head[7] != 3:
                raise ValueError("not a version 3 archive")
            v = struct.unpack("<8Q3Q4B2B4iB2i", head[8:127])
            self.places, self.counts, self.kind = v[:8], v[8:11], {n: k for k, n in TYPES.items()}.get(v[14], "unknown")
            self.compressed, self.zooms = v[13] == 2, v[15:17]
            f.seek(self.places[0])
            self.root = unpack_directory(f.read(self.places[1]))
            f.seek(self.places[2])
            self.metadata = json.loads(gzip.decompress(f.read(self.places[3])))

    def require(self, kind: str) -> None:
        if self.kind != kind:
            raise ValueError(f"the archive holds {self.kind} tiles, not {kind}")

    def leaf(self, offset: int, length: int) -> list[tuple[int, int, int, int]]:
        with open(self.path, "rb") as f:
            f.seek(self.places[4] + offset)
            return unpack_directory(f.read(length))

    def entries(self) -> Iterable[tuple[int, int, int, int]]:
        for e in self.root:
            yield from self.leaf(e[2], e[3]) if e[1] == 0 else [e]

    def blob(self, offset: int, length: int) -> bytes:
        with open(self.path, "rb") as f:
            f.seek(self.places[6] + offset)
            data = f.read(length)
        if len(data) != length:
            raise OSError("the archive ends too early")
        return gzip.decompress(data) if self.compressed else data

    def get(self, tile: int) -> bytes | None:
        """A tile by its id; at most four directories deep."""
        from bisect import bisect_right

        entries = self.root
        for _ in range(4):
            i = bisect_right(entries, tile, key=lambda e: e[0]) - 1
            if i < 0:
                return None
            first, run, offset, length = entries[i]
            if run:
                return self.blob(offset, length) if tile < first + run else None
            entries = self.leaf(offset, length)
        return None
