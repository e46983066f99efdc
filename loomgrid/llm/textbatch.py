"""Vectorised scans over Arrow batches of text.

A batch is one contiguous UTF-8 buffer with offsets, so words, n-grams and their 64-bit hashes come
from a few array passes and no per-word Python. Hashes are the same on every machine and in every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is one slice by itself.
SLICE_BYTES = 4 << 20

#: Bytes of a buffer whose words are found and hashed at once; a longer word is one piece by itself.
PIECE_BYTES = 1 << 20
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 64

_MULT = np.uint64(0x9E3779B97F4A7C55)
_STEP = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def tidy() -> None:
    """Give memory that earlier batches of this worker have left behind back to the system."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(offsets):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``limit`` bytes of ``column``; no row is split."""
    for batch in batches:
        if not batch.num_rows:
            continue
        tidy()
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes.astype(np.int64)) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


#: ASCII letters A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table_of(predicate) -> np.ndarray:
    return np.array([bool(predicate(b)) for b in range(256)])


#: Word bytes of ``[^\x20\x09-\x0D]+``.
NON_SPACE = table_of(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: Word bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z were lower-cased.
ALNUM = table_of(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of each maximal run of member bytes inside one text."""
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    inside = member[data]
    flips = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    rising = inside[flips]
    edges = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    glued = edges[inside[edges - 1] & inside[edges]]
    starts = np.concatenate((np.zeros(int(inside[0]), np.int64), flips[rising], glued))
    ends = np.concatenate((flips[~rising], np.full(int(inside[-1]), len(data)), glued))
    if len(glued):
        starts.sort()
        ends.sort()
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))


def pieces(data: np.ndarray, member: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of about ``limit`` bytes of the buffer that cut no run of member bytes."""
    lo = 0
    while lo < len(data):
        hi = lo + limit
        while hi < len(data):
            gap = np.flatnonzero(~member[data[hi : hi + limit]])
            if len(gap):
                hi += int(gap[0])
                break
            hi += limit
        hi = min(hi, len(data))
        yield lo, hi
        lo = hi


def word_hashes(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool = False, seeds: tuple[int, ...] = (0,)):
    """(words of each text, a hash of every word for each seed), in bounded working memory however long a text is."""
    bounds, hashes, held = np.zeros(len(offsets), np.int64), [[] for _ in seeds], 0
    for lo, hi in pieces(data, member):
        part = LOWER[data[lo:hi]] if lower else data[lo:hi]
        first, last = np.searchsorted(offsets, [lo, hi])
        own = np.concatenate(([0], offsets[first:last] - lo, [hi - lo]))
        starts, ends, _ = words(part, own, member)
        bounds[first:last] = held + np.searchsorted(starts, offsets[first:last] - lo)
        held += len(starts)
        for out, seed in zip(hashes, seeds):
            out.append(span_hashes(part, starts, ends, seed))
    bounds[np.searchsorted(offsets, len(data)) :] = held
    return np.diff(bounds), *(np.concatenate([np.empty(0, np.uint64), *out]) for out in hashes)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of data[start:end] for each span: eight bytes at a time, each step mixed with all before it."""
    sizes = ends - starts
    out = mix(sizes.astype(np.uint64) * _STEP + np.uint64(seed + 1))
    if not len(starts):
        return out
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left, at = np.flatnonzero(sizes <= LONG_WORD), 0
    left = slice(None) if len(left) == len(sizes) else left
    while True:
        rest = sizes[left] - at
        if at:
            more = np.flatnonzero(rest > 0)
            left = more if isinstance(left, slice) else left[more]
            rest = rest[more]
        if not len(rest):
            break
        out[left] = mix((out[left] + np.uint64(at)) * _MULT ^ (lanes[starts[left] + at] & _MASKS[np.minimum(rest, 8)]))
        at += 8
    if (sizes > LONG_WORD).any():
        import xxhash

        for i in np.flatnonzero(sizes > LONG_WORD).tolist():
            out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes(), seed + 1))
    return out


def same_spans(data: np.ndarray, starts: np.ndarray, others: np.ndarray, sizes: np.ndarray, other_sizes: np.ndarray) -> np.ndarray:
    """Whether each two spans hold the same bytes."""
    same = sizes == other_sizes
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    lanes = np.ndarray((len(data) + 1,), "<u8", padded.data, strides=(1,))
    left, at = np.flatnonzero(same & (starts != others) & (sizes <= LONG_WORD)), 0
    while len(left):
        gap = (lanes[starts[left] + at] ^ lanes[others[left] + at]) & _MASKS[np.minimum(sizes[left] - at, 8)]
        same[left[gap != 0]] = False
        at += 8
        left = left[(gap == 0) & (sizes[left] > at)]
    for i in np.flatnonzero(same & (starts != others) & (sizes > LONG_WORD)).tolist():
        same[i] = data[starts[i] : starts[i] + sizes[i]].tobytes() == data[others[i] : others[i] + sizes[i]].tobytes()
    return same


def row_bounds(rows: np.ndarray, n: int) -> np.ndarray:
    """Offsets into a row-sorted array: entries of row i are [bounds[i], bounds[i + 1])."""
    return np.searchsorted(rows, np.arange(n + 1))


def window_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive entries (row borders are the caller's business)."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    m = len(hashes) - n + 1
    out = np.full(m, n, np.uint64) * _STEP
    for j in range(n):
        out = out * _MULT + hashes[j : j + m]
    return mix(out)


def join_spans(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """data[start:start + length] of all spans, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, data.dtype)
    shift = np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    return data[shift + np.arange(total)]
