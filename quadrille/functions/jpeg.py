"""Baseline JPEG images, decoded: sequential Huffman frames of 8 bits, with restart markers, subsampling, and shared tables.

The entropy-coded bits are read one coefficient after another; everything after that (dequantization, the inverse
cosine transform, upsampling, colour) is done for all blocks at once.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: markers.
_SOI, _EOI, _SOS, _DQT, _DHT, _DRI, _SOF0, _SOF1, _APP14 = 0xD8, 0xD9, 0xDA, 0xDB, 0xC4, 0xDD, 0xC0, 0xC1, 0xEE


def _zigzag() -> np.ndarray:
    """Place (row * 8 + column) of each coefficient in the order of the stream: diagonals, up and down in turn."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    return np.array([r * 8 + c for r, c in sorted(cells, key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))])


_ZIGZAG = _zigzag()
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


@dataclass
class _Component:
    id: int
    h: int
    v: int
    table: int
    dc: list | None = None
    ac: list | None = None
    blocks: list = field(default_factory=list)  # (row, column, coefficients) in stream order
    last: int = 0


@dataclass
class _Tables:
    """What markers define and later images may use."""

    quantization: dict[int, np.ndarray] = field(default_factory=dict)
    huffman: dict[tuple[int, int], list] = field(default_factory=dict)
    restart: int = 0


def _lookup(counts: bytes, symbols: bytes) -> list:
    """For each 16 bits: length << 8 | symbol of the code that they begin with; 0 where there is none."""
    out, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            first = code << (16 - length)
            out[first : first + (1 << (16 - length))] = [length << 8 | symbols[at]] * (1 << (16 - length))
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _define(marker: int, body: bytes, tables: _Tables) -> None:
    at = 0
    if marker == _DRI:
        tables.restart = struct.unpack(">H", body[:2])[0]
    while marker in (_DQT, _DHT) and at < len(body):
        kind, number = body[at] >> 4, body[at] & 15
        at += 1
        if marker == _DQT:
            size = 128 if kind else 64
            tables.quantization[number] = np.frombuffer(body[at : at + size], ">u2" if kind else np.uint8).astype(np.float64)
            at += size
        else:
            counts = body[at : at + 16]
            n = sum(counts)
            tables.huffman[kind, number] = _lookup(counts, body[at + 16 : at + 16 + n])
            at += 16 + n


class _Bits:
    """The bits of one stretch between restart markers, stuffed zeros taken out; beyond its end they are zeros."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + b"\0" * 8, np.uint8).astype(np.int64)
        self.words = (raw[:-4] << 32 | raw[1:-3] << 24 | raw[2:-2] << 16 | raw[3:-1] << 8 | raw[4:]).tolist()
        self.at, self.end = 0, len(self.words) - 1

    def block(self, dc: list, ac: list) -> list[tuple[int, int]]:
        """Coefficients of a block as (place in the stream, value); the first is the difference to the block before."""
        words, at, end, out, k = self.words, self.at, self.end, [], 0
        while k < 64:
            word = words[min(at >> 3, end)] << (at & 7)
            found = (ac if k else dc)[word >> 24 & 0xFFFF]
            if not found:
                raise ValueError("bad code in a JPEG image")
            at += found >> 8
            run, size = (found >> 4 & 15, found & 15) if k else (0, found & 255)
            if k and not size:
                if run < 15:
                    break
                k += 16
                continue
            k += run
            if size:
                word = words[min(at >> 3, end)] << (at & 7)
                value = word >> (40 - size) & ((1 << size) - 1)
                at += size
                if value < 1 << (size - 1):
                    value -= (1 << size) - 1
                if k < 64:
                    out.append((k, value))
            k += 1
        self.at = at
        return out


def decode(data: bytes, shared: bytes | None = None, ycc: bool | None = None) -> np.ndarray:
    """Samples of an image, shape (rows, columns, components), three components as red, green and blue.

    shared: a stream of tables only, as TIFF files keep it. ycc: whether three components are luma and chroma; where it isn't
    told an Adobe marker says so, else they are. Progressive, lossless and arithmetic frames are an error.
    """
    tables = _Tables()
    if shared:
        for marker, body, _ in _segments(shared):
            _define(marker, body, tables)
    parts, adobe, size, scan = [], None, None, None
    for marker, body, at in _segments(data):
        _define(marker, body, tables)
        if marker in (_SOF0, _SOF1):
            if body[0] != 8:
                raise ValueError("JPEG samples of more than 8 bits")
            size = struct.unpack(">HH", body[1:5])
            parts = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(body[5])]
        elif 0xC0 < marker <= 0xCF and marker not in (_DHT, 0xC8, 0xCC):
            raise ValueError("only baseline JPEG images can be read")
        elif marker == _APP14 and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == _SOS:
            own = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            chosen = [c for c in parts if c.id in own]
            for c in chosen:
                c.dc, c.ac, c.last = tables.huffman[0, own[c.id] >> 4], tables.huffman[1, own[c.id] & 15], 0
            scan = data[at:]
            _scan(scan, chosen, parts, size, tables.restart)
    if scan is None or size is None:
        raise ValueError("no image in a JPEG stream")
    planes = [_plane(c, parts, size, tables.quantization[c.table]) for c in parts]
    out = np.stack(planes, axis=2)
    if len(parts) == 3 and (ycc if ycc is not None else adobe != 0):
        y, cb, cr = out[..., 0], out[..., 1] - 128.0, out[..., 2] - 128.0
        out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def _segments(data: bytes):
    """Markers with their bodies and where these end; after a scan's header its coded data is passed over."""
    at = 0
    while at + 1 < len(data):
        if data[at] != 0xFF or data[at + 1] in (0, 0xFF) or 0xD0 <= data[at + 1] <= 0xD8:
            at += 1 if data[at] != 0xFF or data[at + 1] == 0xFF else 2
            continue
        marker = data[at + 1]
        if marker == _EOI:
            return
        n = struct.unpack_from(">H", data, at + 2)[0]
        yield marker, data[at + 4 : at + 2 + n], at + 2 + n
        at += 2 + n


def _scan(data: bytes, chosen: list[_Component], parts: list[_Component], size: tuple[int, int], restart: int) -> None:
    """Read the blocks of a scan into its components."""
    most_h, most_v = max(c.h for c in parts), max(c.v for c in parts)
    if len(chosen) == 1:  # not interleaved: only the blocks that the component has
        c = chosen[0]
        across, down = -(-(-(-size[1] * c.h // most_h)) // 8), -(-(-(-size[0] * c.v // most_v)) // 8)
        units = [(c, 1, 1)]
    else:
        across, down = -(-size[1] // (8 * most_h)), -(-size[0] // (8 * most_v))
        units = [(c, c.h, c.v) for c in chosen]
    stretches, at, begin = [], 0, 0
    while at < len(data):  # up to the next marker that isn't a restart
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            at = len(data)
            break
        following = data[at + 1]
        if 0xD0 <= following <= 0xD7:
            stretches.append(data[begin:at])
            begin = at + 2
        elif following not in (0, 0xFF):
            break
        at += 1 if following == 0xFF else 2
    stretches.append(data[begin:at])
    bits, left, number = _Bits(stretches[0]), restart, 0
    for unit in range(across * down):
        if restart and not left:
            number += 1
            bits, left = _Bits(stretches[number] if number < len(stretches) else b""), restart
            for c in chosen:
                c.last = 0
        left -= 1
        for c, h, v in units:
            for k in range(h * v):
                found = bits.block(c.dc, c.ac)
                if found and found[0][0] == 0:
                    c.last += found[0][1]
                    found = found[1:]
                c.blocks.append((unit // across * v + k // h, unit % across * h + k % h, c.last, found))


def _plane(c: _Component, parts: list[_Component], size: tuple[int, int], quantization: np.ndarray) -> np.ndarray:
    """Samples of a component at the size of the image."""
    rows, columns = max(b[0] for b in c.blocks) + 1, max(b[1] for b in c.blocks) + 1
    flat = np.zeros((rows * columns, 64))
    for row, column, first, found in c.blocks:
        of = flat[row * columns + column]
        of[0] = first
        for k, value in found:
            of[k] = value
    square = np.zeros_like(flat)
    square[:, _ZIGZAG] = flat * quantization
    made = _COSINES.T @ square.reshape(-1, 8, 8) @ _COSINES + 128.0
    plane = np.clip(np.floor(made + 0.5), 0, 255).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
    tall, wide = max(p.v for p in parts) // c.v, max(p.h for p in parts) // c.h
    return plane.repeat(tall, axis=0).repeat(wide, axis=1)[: size[0], : size[1]]
