"""Integer arrays as compressed bytes, for table cells that hold a block of keys or counts."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(x: np.ndarray) -> bytes:
    """Non-negative integers, stored byte plane by byte plane, so that equal high bytes vanish."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.compress(x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending integers, by their differences."""
    return pack(np.diff(np.ascontiguousarray(x, dtype=np.uint64), prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)
