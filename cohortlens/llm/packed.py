"""Compact binary columns: integer arrays as byte planes under zstd (numpy, inside tasks).

Few distinct high bytes cost almost nothing, so ids, positions and sorted
hashes travel through a shuffle in about their information content.
"""

from __future__ import annotations

import numpy as np
import zstandard

_ZERO = np.zeros(1, np.uint64)


def pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit integers, as differences where they ascend."""
    v = values.astype(np.int64).view(np.uint64)
    if ascending:
        v = np.diff(v, prepend=_ZERO)
    planes = np.ascontiguousarray(v.view(np.uint8).reshape(len(v), 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes, ascending: bool = False) -> np.ndarray:
    """The integers of ``pack`` (int64)."""
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    v = np.ascontiguousarray(planes.reshape(8, -1).T).view(np.uint64).ravel()
    if ascending:
        v = np.cumsum(v, dtype=np.uint64)
    return v.view(np.int64)


def spark_xxhash64(values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's ``xxhash64`` of a non-null long column (int64)."""
    u = np.uint64
    p1, p2, p3, p4, p5 = (u(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                         0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))

    def turn(x: np.ndarray, r: int) -> np.ndarray:
        return (x << u(r)) | (x >> u(64 - r))

    k = values.astype(np.int64).view(u)
    h = (turn(k * p2, 31) * p1) ^ (u(seed) + p5 + u(8))
    h = turn(h, 27) * p1 + p4
    h = (h ^ (h >> u(33))) * p2
    h = (h ^ (h >> u(29))) * p3
    return (h ^ (h >> u(32))).view(np.int64)
