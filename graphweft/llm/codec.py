"""Compact byte strings for whole-number columns inside shuffled rows."""

from __future__ import annotations

import struct

import numpy as np

from .token_files import decode_values, encode_values

_HEAD = struct.Struct("<BII")


def pack(values: np.ndarray) -> bytes:
    """Unsigned values, below 2^32 in 1 to 4 bytes each, larger ones in 4 and those for the upper half."""
    values = np.asarray(values, dtype=np.uint64)
    wide = bool(len(values)) and int(values.max()) >> 32 > 0
    control, data = encode_values(values >> np.uint64(32) if wide else values)
    low = values.astype("<u4").tobytes() if wide else b""
    return _HEAD.pack(wide, len(values), len(control)) + low + control + data


def unpack(blob: bytes) -> np.ndarray:
    wide, n, size = _HEAD.unpack_from(blob)
    at = _HEAD.size + 4 * n * wide
    out = decode_values(blob[at : at + size], blob[at + size :], n).astype(np.uint64)
    return (out << np.uint64(32)) | np.frombuffer(blob, "<u4", n, _HEAD.size) if wide else out


def pack_small(values: np.ndarray) -> bytes:
    """Unsigned values that are mostly below 255, in one byte each; the others stand after them."""
    values = np.asarray(values, dtype=np.uint64)
    large = values[values >= 255]
    return struct.pack("<I", len(values)) + np.minimum(values, 255).astype(np.uint8).tobytes() + pack(large)


def unpack_small(blob: bytes) -> np.ndarray:
    (n,) = struct.unpack_from("<I", blob)
    small = np.frombuffer(blob, np.uint8, n, 4)
    out = small.astype(np.uint64)
    large = np.flatnonzero(small == 255)
    if len(large):
        out[large] = unpack(blob[4 + n :])
    return out


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values[:1] * 0))


def unpack_rising(blob: bytes) -> np.ndarray:
    return np.cumsum(unpack(blob), dtype=np.uint64)


def pack_many(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def unpack_many(blob: bytes, n: int) -> list[bytes]:
    sizes, at, out = struct.unpack_from(f"<{n}I", blob), 4 * n, []
    for size in sizes:
        out.append(blob[at : at + size])
        at += size
    return out
