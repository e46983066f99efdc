"""Exact removal of repeated byte strings by a distributed, common-prefix-aware suffix merge sort.

A byte goes where a string of ``LENGTH`` bytes around it also starts anywhere else. Instead of every
suffix, only those at synchronising points are sorted: of the 32-byte strings in each window of
``LENGTH`` bytes, the one with the least hash is the window's anchor. Equal windows have equal anchors
at equal places, so every repeat shows among suffixes that begin at anchors, with what stands before
the anchor read backwards after it.

1. Texts become chunks (a table of its own). The windows of an anchor are of two sides, near and far, each
   with a part of 116 bytes or more that all its windows hold. Each chunk sends out the parts' hashes with
   their numbers; a side whose part occurs once in all chunks needs no sorting (this finds out which
   suffixes have distinguishing prefixes, as in prefix doubling).
2. A part that occurs ``HOT`` times or more may still stand in no repeated window, or in few. For these, the
   hashes of whole windows are counted in the same way, and only windows that repeat go on; so a short
   passage in a third of all documents, each time among other words, is gone before anything is sorted.
3. Each chunk sorts the suffixes at its remaining anchors; equal ones become one entry. The sorted runs
   are cut by hash range and exchanged front-coded: per entry the length of the prefix that it shares
   with the one before, and the rest. The hash of the part leads each key, so ranges are even.
4. Each range merges its runs with a loser tree that compares from known common prefixes only. The
   prefix lengths of neighbours bound, for every entry, the windows that can occur elsewhere; those are
   settled on their bytes, so no result rests on a hash.
5. Byte ranges go back to their chunks, which drop them from the texts.

Entries of one run that are equal are merged before anything is sent, so a passage in a third of all
documents is one entry per run. Rows are never dropped. What is settled together shares a part: fewer than
``HOT`` places, or distinct contexts of windows that do repeat.

Defined cases: null and empty texts keep nothing and lose nothing; texts shorter than ``LENGTH`` stay;
repeated rows are repeats like any others and lose all their common bytes; rows that share an id stay
rows of their own; null ids stay null; an empty table gives an empty result; other columns are ignored.
A long text is hashed in overlapping pieces; it is held whole, with its own repeated contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as pk
from . import textbatch as tb
from .chunks import chunk_table, open_text, slices
from .store import cut, drop

LENGTH = 200
KMER = 32
CHUNK_BYTES = 6 << 20
SLICE_BYTES = 1 << 20
#: Windows that begin at most this far before their anchor are its near side, the others its far side.
NEAR = (LENGTH - KMER) // 2
#: Ends a part of a key; it never occurs in UTF-8.
END = b"\xff"
LEAD = 8
#: Places of a part from which on whole windows are counted.
HOT = 64

_MULT = np.uint64(0x9E3779B97F4A7C55)
_BYTES = tb.mix(np.arange(1, 257, dtype=np.uint64) * _MULT)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2**64, at least ``n`` of each."""
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_MULT), -1, 1 << 64))
        for name, base in (("up", _MULT), ("down", inverse)):
            p = np.full(max(n, SLICE_BYTES + 2 * LENGTH), base, dtype=np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    return _POWERS["up"], _POWERS["down"]


def _span_values(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a rolling hash; it only picks anchors and sieves, whatever meets by chance is settled on bytes."""
    up, down = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTES[data] * up[: len(data)], dtype=np.uint64, out=sums[1:])
    return sums, down


def anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows (anchor, first window, last window, hash of the part that they all hold), one for each side of an anchor."""
    n = len(data)
    if n < LENGTH:
        return np.empty((0, 4), np.uint64)
    sums, down = _span_values(data)

    def spans(starts, ends):
        return tb.mix((sums[ends] - sums[starts]) * down[starts])

    width = LENGTH - KMER + 1
    at = np.arange(n - KMER + 1)
    least = (spans(at, at + KMER) >> np.uint64(32) << np.uint64(32)) | at.astype(np.uint64)
    step = 1
    while step * 2 <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < width:
        rest = width - step
        least = np.minimum(least[:-rest], least[rest:])
    cut_off = np.zeros(n + 1, np.int64)
    ends = offsets[1:]
    np.add.at(cut_off, np.maximum(ends - LENGTH + 1, offsets[:-1]), 1)
    np.add.at(cut_off, ends, -1)
    window = np.flatnonzero(np.cumsum(cut_off[: len(least)]) == 0)
    if not len(window):
        return np.empty((0, 4), np.uint64)
    anchor = (least[window] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    far = anchor - window > NEAR
    new = np.ones(len(window), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1) | (far[1:] != far[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(window)) - 1
    a, lo, hi, far = anchor[first], window[first], window[last], far[first]
    part = spans(np.where(far, a - NEAR - 1, a), np.where(far, a + KMER, a + LENGTH - NEAR))
    part = tb.mix(part + far.astype(np.uint64))
    return np.stack((a.astype(np.uint64), lo.astype(np.uint64), hi.astype(np.uint64), part), axis=1)


def chunk_anchors(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """``anchors`` over slices of whole texts, and over overlapping pieces of long ones; places are those in ``data``."""
    out = [np.empty((0, 4), np.uint64)]
    for lo, hi in slices(data, offsets, SLICE_BYTES):
        a, b = int(offsets[lo]), int(offsets[hi])
        own = offsets[lo : hi + 1] - a
        for at in range(a, max(b - LENGTH + 1, a + 1), SLICE_BYTES) if hi == lo + 1 else (a,):
            end = min(b, at + SLICE_BYTES + LENGTH - 1) if hi == lo + 1 else b
            found = anchors(data[at:end], np.array([0, end - at]) if hi == lo + 1 else own)
            found[:, :3] += np.uint64(at)
            out.append(found)
    return np.concatenate(out)


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree before ``at``."""
    n = min(len(a), len(b))
    while at < n:
        x, y = a[at : at + 64], b[at : at + 64]
        if x != y:
            m = min(len(x), len(y))
            gap = int.from_bytes(x[:m], "big") ^ int.from_bytes(y[:m], "big")
            return at + (m - (gap.bit_length() + 7) // 8 if gap else m)
        at += 64
    return n


def front_code(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(shared prefix lengths, lengths of the rests, rests) of sorted strings."""
    shared, rests, before = [], [], b""
    for key in keys:
        n = common(before, key, 0)
        shared.append(n)
        rests.append(key[n:])
        before = key
    return np.array(shared, np.uint32), np.array([len(r) for r in rests], np.uint32), b"".join(rests)


class Run:
    """A front-coded sorted run; ``shared`` is the prefix that its head shares with the last output."""

    __slots__ = ("at", "ends", "key", "prefixes", "raw", "shared")

    def __init__(self, prefixes: np.ndarray, lengths: np.ndarray, raw: bytes):
        self.prefixes, self.ends, self.raw = prefixes.tolist(), np.cumsum(lengths).tolist(), raw
        self.at, self.key, self.shared = -1, b"", 0
        self.advance()

    def advance(self) -> None:
        self.at += 1
        if self.at == len(self.ends):
            self.key = None
            return
        start = self.ends[self.at - 1] if self.at else 0
        self.shared = self.prefixes[self.at]
        self.key = self.key[: self.shared] + self.raw[start : self.ends[self.at]]


class LoserTree:
    """Merge of runs; every comparison starts where two heads are first known to be able to differ."""

    def __init__(self, runs: list[Run]):
        self.runs = runs
        self.size = len(runs)
        self.losers = [-1] * self.size
        self.winner = -1
        for r in runs:
            r.shared = 0
        winners = [-1] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            winners[node], self.losers[node] = self._play(winners[2 * node], winners[2 * node + 1])
        self.winner = winners[1] if self.size > 1 else 0

    def _play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.runs[i], self.runs[j]
        if a.key is None:
            return j, i
        if b.key is None or a.shared > b.shared:
            return i, j
        if a.shared < b.shared:
            return j, i
        n = common(a.key, b.key, a.shared)
        if a.key[n : n + 1] <= b.key[n : n + 1]:
            b.shared = n
            return i, j
        a.shared = n
        return j, i

    def __iter__(self) -> Iterator[tuple[int, int, bytes, int]]:
        """(run, entry, key, prefix shared with the key before) in order."""
        while self.runs[self.winner].key is not None:
            w = self.winner
            run = self.runs[w]
            yield w, run.at, run.key, run.shared
            run.advance()
            node = (w + self.size) // 2
            while node:
                w, self.losers[node] = self._play(w, self.losers[node])
                node //= 2
            self.winner = w


def settle(group: list[tuple[bytes, int, int]], times: list[int]) -> list[list[tuple[int, int]]]:
    """For each distinct key of one anchor string: the windows (as distances from the anchor) that occur twice.

    ``group`` has (key, prefix shared with the key before, prefix shared with the key after).
    """
    out, open_ = [], []
    lefts = []
    for key, before, after in group:
        end = key.index(END, LEAD)
        right, left = key[LEAD:end], key[end + 1 : -1]
        lefts.append((left, len(lefts)))
        out.append([])
        most = min(max(before, after) - LEAD, len(right))
        # Windows near..far: near is set by how much stands right of the anchor, far by what is left.
        open_.append([LENGTH - len(right), len(left), right, left, LENGTH - most])
    lefts.sort()
    shared = [0] + [common(x[0], y[0], 0) for x, y in zip(lefts, lefts[1:])] + [0]
    for k, (_, i) in enumerate(lefts):
        open_[i].append(max(shared[k], shared[k + 1]))
    tried: dict[int, list[int]] = {}
    for i, (near, far, _, _, least, most) in enumerate(open_):
        if times[i] > 1:
            out[i] = [(near, far)]
        for o in range(max(near, least), min(far, most) + 1):
            tried.setdefault(o, []).append(i)
    single: list[list[int]] = [[] for _ in group]
    for o in sorted(tried):
        who: dict[tuple[bytes, bytes], list[int]] = {}
        for i in tried[o]:
            who.setdefault((open_[i][2][: LENGTH - o], open_[i][3][:o]), []).append(i)
        for same in who.values():
            if len(same) > 1:
                for i in same:
                    if times[i] == 1:
                        single[i].append(o)
    for i, found in enumerate(single):
        for o in found:
            if out[i] and out[i][-1][1] == o - 1:
                out[i][-1] = (out[i][-1][0], o)
            else:
                out[i].append((o, o))
    return out


def _packets(values: np.ndarray, times: np.ndarray, buckets: int):
    """Rising 64-bit hashes with their numbers by range: (range, numbers, hashes)."""
    bounds = pk.bounds_of(values, buckets)
    for j in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[j], bounds[j + 1])
        yield j, pk.pack(times[part]), pk.pack_rising(values[part] >> np.uint64(8))


def _count(level):
    """For a range of hashes: what ``level`` makes of the total number of each, back to the chunks in their order."""

    def run(table: pa.Table) -> pa.Table:
        tb.tidy()
        values = [pk.unpack_rising(x.as_py()) for x in table.column("hashes")]
        times = np.concatenate([pk.unpack(x.as_py()) for x in table.column("times")])
        everything = np.concatenate(values)
        order = np.argsort(everything)
        new = np.concatenate(([True], np.diff(everything[order]) != 0))
        total = np.add.reduceat(times[order], np.flatnonzero(new))
        found = np.empty(len(order), np.uint8)
        found[order] = level(total)[np.cumsum(new) - 1]
        ends = np.cumsum([len(v) for v in values])
        back = [pk.pack(found[e - len(v) : e]) for v, e in zip(values, ends)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "level": pa.array(back, pa.binary())})

    return run


def _levels(table: pa.Table) -> np.ndarray:
    return np.concatenate([np.empty(0, np.uint64), *(pk.unpack(x.as_py()) for x in table.sort_by("bucket").column("level"))])


def _distinct(hashes: np.ndarray, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes as they are told apart after the exchange, with their numbers."""
    known, where = np.unique(hashes >> np.uint64(8) << np.uint64(8), return_inverse=True)
    return known, np.bincount(where, times, len(known)).astype(np.int64)


def _entry(lead: int, right: bytes, left: bytes) -> bytes:
    """The key of a suffix: its part, what follows the anchor, and what stands before it read backwards."""
    return lead.to_bytes(8, "big") + right + END + left + END


def _entries(raw: bytes, rows: np.ndarray) -> dict[bytes, list[int]]:
    """Keys of anchor rows, with the places of their anchors."""
    out: dict[bytes, list[int]] = {}
    for a, lo, hi, lead in rows.tolist():
        out.setdefault(_entry(lead, raw[a : hi + LENGTH], raw[lo:a][::-1]), []).append(a)
    return out


def _coded(entries: dict[bytes, list[int]], keys: list[bytes]):
    """Columns of a front-coded run: shared, lengths, rests, times, places."""
    import zstandard

    shared, lengths, rests = front_code(keys)
    times = np.array([len(entries[k]) for k in keys], np.uint64)
    places = np.array([p for k in keys for p in entries[k]], np.uint64)
    return pk.pack(shared), pk.pack(lengths), zstandard.compress(rests, 3), pk.pack(times), pk.pack(places)


def _run_rows(entries: dict[bytes, list[int]], buckets: int):
    """Front-coded runs by hash range: (bucket, shared, lengths, rests, times, places)."""
    keys = sorted(entries)
    leads = np.array([int.from_bytes(k[:LEAD], "big") for k in keys], np.uint64)
    bounds = pk.bounds_of(leads, buckets)
    for j in np.flatnonzero(np.diff(bounds)).tolist():
        yield j, *_coded(entries, keys[bounds[j] : bounds[j + 1]])


def _decoded(run: pa.Table) -> Iterator[tuple[bytes, list[int]]]:
    """Keys and places of a front-coded run."""
    import zstandard

    shared, lengths, times, places = (pk.unpack(run.column(c)[0].as_py()).astype(np.int64) for c in ("shared", "lengths", "times", "places"))
    reader = Run(shared, lengths, zstandard.decompress(run.column("rests")[0].as_py()))
    ends = np.cumsum(times)
    for lo, hi in zip(ends - times, ends):
        yield reader.key, places[lo:hi].tolist()
        reader.advance()


def _window_hashes(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows in the contexts of ``keys``, the first ones first, and their number by key."""
    contexts = []
    for key in keys:
        end = key.index(END, LEAD)
        contexts.append(key[end + 1 : -1][::-1] + key[LEAD:end])
    hashes, sizes = [np.empty(0, np.uint64)], np.array([len(c) - LENGTH + 1 for c in contexts], np.int64)
    for lo in range(0, len(contexts), 2048):
        part = contexts[lo : lo + 2048]
        data = np.frombuffer(b"".join(part), np.uint8)
        sums, down = _span_values(data)
        begin = np.cumsum([0, *map(len, part[:-1])])
        at = np.repeat(begin, sizes[lo : lo + 2048]) + np.arange(sizes[lo : lo + 2048].sum())
        at -= np.repeat(np.cumsum(sizes[lo : lo + 2048]) - sizes[lo : lo + 2048], sizes[lo : lo + 2048])
        hashes.append(tb.mix((sums[at + LENGTH] - sums[at]) * down[at]))
    return np.concatenate(hashes), sizes


_RUN = ["shared", "lengths", "rests", "times", "places"]
_ROW = ["kind", "chunk", "bucket", *_RUN, "hashes"]
_ROW_TYPES = [pa.string(), pa.int64(), pa.int32(), *[pa.binary()] * 6]
_ROW_SCHEMA = "kind string, chunk long, bucket int, shared binary, lengths binary, rests binary, times binary, places binary, hashes binary"


def _table(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [()] * len(_ROW)
    return pa.table([pa.array(c, t) for c, t in zip(columns, _ROW_TYPES)], names=_ROW)


def merge(runs: list[Run], times: list[np.ndarray]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """(run, entry, repeated windows) for all entries of front-coded runs that have any."""
    group: list[list] = []  # [key, prefix before, prefix after, times, [(run, entry)]]

    def close():
        if len(group) > 1 or (group and group[0][3] > 1):
            found = settle([(g[0], g[1], g[2]) for g in group], [g[3] for g in group])
            for g, windows in zip(group, found):
                if windows:
                    for r, e in g[4]:
                        yield r, e, windows

    for r, e, key, shared in LoserTree(runs):
        if group and shared >= LEAD + KMER:
            last = group[-1]
            if shared == len(key) == len(last[0]):
                last[3] += int(times[r][e])
                last[4].append((r, e))
                continue
            last[2] = shared
            group.append([key, shared, 0, int(times[r][e]), [(r, e)]])
        else:
            yield from close()
            group = [[key, 0, 0, int(times[r][e]), [(r, e)]]]
    yield from close()


def removed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, hot: int = HOT) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with ``keep_text`` also kept (bytes)."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    buckets = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = chunk_table(base, CHUNK_BYTES, "suffix-chunks")
    packets = "chunk long, bucket int, times binary, hashes binary"

    def scan(batches):
        for batch in batches:
            for chunk, sizes, text in zip(*(batch.column(c) for c in ("chunk", "sizes", "text"))):
                made = list(_packets(*_distinct(chunk_anchors(*open_text(text, sizes))[:, 3]), buckets))
                columns = list(zip(*made)) or [()] * 3
                kinds = (pa.int32(), pa.binary(), pa.binary())
                arrays = [pa.array([chunk.as_py()] * len(made), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, kinds))]
                yield pa.RecordBatch.from_arrays(arrays, names=["chunk", "bucket", "times", "hashes"])

    def sort(chunk: pa.Table, back: pa.Table) -> pa.Table:
        """Runs of the sides whose parts repeat; of frequent parts, the contexts and the hashes of their windows."""
        if not chunk.num_rows:
            return _table([])
        number = chunk.column("chunk")[0].as_py()
        data, offsets = open_text(chunk.column("text")[0], chunk.column("sizes")[0])
        found = chunk_anchors(data, offsets)
        known, _ = _distinct(found[:, 3])
        level = _levels(back)[np.searchsorted(known, found[:, 3] >> np.uint64(8) << np.uint64(8))] if len(found) else np.empty(0)
        raw = data.tobytes()
        rows = [("run", number, *r, None) for r in _run_rows(_entries(raw, found[level == 1]), buckets)]
        entries = _entries(raw, found[level == 2])
        if entries:
            keys = sorted(entries)
            rows.append(("hot", number, 0, *_coded(entries, keys), None))
            hashes, sizes = _window_hashes(keys)
            times = np.repeat([len(entries[k]) for k in keys], sizes)
            rows += [("window", number, j, None, None, None, t, None, h) for j, t, h in _packets(*_distinct(hashes, times), buckets)]
        return _table(rows)

    def sort_hot(hot: pa.Table, back: pa.Table) -> pa.Table:
        """Runs of the windows of frequent parts that do repeat."""
        if not hot.num_rows:
            return _table([])
        entries = {k: p for k, p in _decoded(hot)}
        keys = list(entries)
        hashes, sizes = _window_hashes(keys)
        known, _ = _distinct(hashes)
        repeated = _levels(back)[np.searchsorted(known, hashes >> np.uint64(8) << np.uint64(8))] > 0
        ends = np.cumsum(sizes)
        out: dict[bytes, list[int]] = {}
        for key, lo, hi in zip(keys, ends - sizes, ends):
            end = key.index(END, LEAD)
            right, left, lead = key[LEAD:end], key[end + 1 : -1], int.from_bytes(key[:LEAD], "big")
            flips = np.flatnonzero(np.diff(np.concatenate(([0], repeated[lo:hi].astype(np.int8), [0])))).tolist()
            for x, y in zip(flips[::2], flips[1::2]):  # windows that begin len(left) - x to len(left) - y + 1 before the anchor
                out.setdefault(_entry(lead, right[: LENGTH - (len(left) - y + 1)], left[: len(left) - x]), []).extend(entries[key])
        number = hot.column("chunk")[0].as_py()
        return _table([("run", number, *r, None) for r in _run_rows(out, buckets)])

    def merge_range(table: pa.Table) -> pa.Table:
        import zstandard

        tb.tidy()
        take = lambda c: [pk.unpack(x.as_py()).astype(np.int64) for x in table.column(c)]
        times = take("times")
        rests = [zstandard.decompress(x.as_py()) for x in table.column("rests")]
        runs = [Run(s, n, r) for s, n, r in zip(take("shared"), take("lengths"), rests)]
        places = take("places")
        firsts = [np.concatenate(([0], np.cumsum(t))) for t in times]
        found: list[tuple[list, list]] = [([], []) for _ in runs]
        for r, e, windows in merge(runs, times):
            at = places[r][firsts[r][e] : firsts[r][e + 1]]
            for near, far in windows:
                found[r][0].append(at - far)
                found[r][1].append(at - near + LENGTH)
        out = [(c.as_py(), np.concatenate(f[0]), np.concatenate(f[1])) for c, f in zip(table.column("chunk"), found) if f[0]]
        return pa.table(
            {
                "chunk": pa.array([o[0] for o in out], pa.int64()),
                "starts": pa.array([pk.pack(o[1]) for o in out], pa.binary()),
                "ends": pa.array([pk.pack(o[2]) for o in out], pa.binary()),
            }
        )

    level = "chunk long, bucket int, level binary"
    parts = chunks.select("chunk", "sizes", "text").mapInArrow(scan, packets)
    parts = parts.groupBy("bucket").applyInArrow(_count(lambda n: (n > 1).astype(np.uint8) + (n >= hot)), level)
    rows = chunks.select("chunk", "sizes", "text").groupBy("chunk").cogroup(parts.groupBy("chunk")).applyInArrow(sort, _ROW_SCHEMA)
    rows = cut(rows, "suffix-runs")
    windows = rows.where("kind = 'window'").select("chunk", "bucket", "times", "hashes")
    windows = windows.groupBy("bucket").applyInArrow(_count(lambda n: n > 1), level)
    more = rows.where("kind = 'hot'").groupBy("chunk").cogroup(windows.groupBy("chunk")).applyInArrow(sort_hot, _ROW_SCHEMA)
    runs = rows.where("kind = 'run'").unionByName(more).select("chunk", "bucket", *_RUN)
    ranges = cut(runs.groupBy("bucket").applyInArrow(merge_range, "chunk long, starts binary, ends binary"), "suffix-ranges")
    del parts, windows, more, runs
    drop(rows)  # with the exchanges before it

    def finish(chunk: pa.Table, ranges: pa.Table) -> pa.Table:
        data, offsets = open_text(chunk.column("text")[0], chunk.column("sizes")[0])
        cover = np.zeros(len(data) + 1, np.int32)
        for s, e in zip(ranges.column("starts"), ranges.column("ends")):
            np.add.at(cover, pk.unpack(s.as_py()).astype(np.int64), 1)
            np.add.at(cover, pk.unpack(e.as_py()).astype(np.int64), -1)
        gone = np.cumsum(cover[:-1]) > 0
        rows, kept = [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            own = gone[a:b]
            starts = int(own[:1].sum()) + int((own[1:] & ~own[:-1]).sum())
            left = data[a:b][~own].tobytes()
            rows.append((b - a, int(own.sum()), starts, hashlib.sha256(left).hexdigest()))
            if keep_text:
                kept.append(left)
        out = {"doc_id": chunk.column("ids").combine_chunks()[0].values}
        out |= dict(zip(("n_bytes", "n_removed", "n_spans", "kept_sha256"), map(pa.array, zip(*rows))))
        if keep_text:
            out["kept"] = pa.array(kept, pa.binary())
        return pa.table(out)

    schema = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text
    return chunks.groupBy("chunk").cogroup(ranges.groupBy("chunk")).applyInArrow(finish, schema)
