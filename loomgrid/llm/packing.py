"""Numbers as compressed planes of bytes, as narrow as the largest of them allows."""

from __future__ import annotations

import numpy as np


def pack(x: np.ndarray, level: int = 1) -> bytes:
    """Numbers from 0 to 2**64 - 1: planes of low and high bytes, compressed."""
    import zstandard

    x = np.ascontiguousarray(x).astype("<u8")
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return bytes([width]) + zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes(), level)


def unpack(raw: bytes, dtype: str = "<u8") -> np.ndarray:
    """The numbers again; ``dtype`` is an unsigned type that holds them."""
    import zstandard

    width, size = raw[0], np.dtype(dtype).itemsize
    if width > size:
        raise ValueError(f"numbers of {width} bytes do not fit {dtype}")
    planes = np.frombuffer(zstandard.decompress(raw[1:]), np.uint8).reshape(width, -1)
    wide = np.zeros((planes.shape[1], size), np.uint8)
    wide[:, :width] = planes.T
    return wide.view(dtype).ravel()


def pack_skewed(x: np.ndarray) -> bytes:
    """Numbers most of which are small: one byte each, and what is beyond 254 apart."""
    import zstandard

    small = zstandard.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), 3)
    return len(small).to_bytes(4, "little") + small + pack(x[x >= 255] - 255, 3)


def unpack_skewed(raw: bytes, dtype: str = "<u4") -> np.ndarray:
    import zstandard

    at = 4 + int.from_bytes(raw[:4], "little")
    out = np.frombuffer(zstandard.decompress(raw[4:at]), np.uint8).astype(dtype)
    out[out == 255] += unpack(raw[at:], dtype)
    return out


def pack_rising(x: np.ndarray) -> bytes:
    """Rising numbers as packed differences."""
    x = np.asarray(x, np.uint64)
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw), dtype=np.uint64)


def edges(buckets: int) -> np.ndarray:
    """Lower ends of equal ranges of 64-bit hashes."""
    return np.array([(1 << 64) * j // buckets for j in range(buckets)], np.uint64)


def bounds_of(rising: np.ndarray, buckets: int) -> np.ndarray:
    """Where each range of ``edges`` begins in rising hashes, and the end."""
    return np.append(np.searchsorted(rising, edges(buckets)), len(rising))
