"""PNG files from RGBA rows."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode(rgba: np.ndarray) -> bytes:
    """An 8-bit RGBA image of shape (rows, columns, 4)."""
    h, w = rgba.shape[:2]
    raw = np.concatenate([np.zeros((h, 1), np.uint8), rgba.astype(np.uint8).reshape(h, w * 4)], axis=1).tobytes()
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, 6)) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """An image that encode wrote."""
    at, body, w, h = 8, b"", 0, 0
    while at < len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        if kind == b"IHDR":
            w, h = struct.unpack_from(">II", data, at + 8)
        elif kind == b"IDAT":
            body += data[at + 8 : at + 8 + n]
        at += 12 + n
    return np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + 4 * w)[:, 1:].reshape(h, w, 4)
