"""The words of documents as numbers: distinct words of chunks, dealt out by hash so that equal words meet.

One scan gives each chunk's list of distinct words by hash range, and a head row with the number of the
word at each place. Equal words are found by hash and compared byte by byte, so two words are never
taken for one. The head row goes through the same exchange as the lists, so that all rows of a chunk come
from one reading of its documents; check sums prove it where a lost executor had rows read again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import packing as pk
from . import textbatch as tb

HEAD = ["docs", "sizes", "stream", "owners", "sums"]
LIST = ["sum", "lengths", "words", "times"]


def head_schema(docs: DataFrame) -> str:
    kind = docs.schema["doc_id"].dataType.simpleString()
    return f"chunk long, bucket int, docs array<{kind}>, sizes binary, stream binary, owners binary, sums binary"


def number_words(data: np.ndarray, spans: Iterator[tuple[int, int, np.ndarray, np.ndarray]]):
    """(number of each word, starts, ends, numbers of occurrences and hashes of the distinct words), frequent words first.

    ``spans`` has pieces [lo, hi) of the buffer with the starts and ends of their words. What is held for
    each word, besides one piece, is 4 bytes.
    """
    parts = []
    for lo, hi, starts, ends in spans:
        piece = data[lo:hi]
        hashes = tb.span_hashes(piece, starts - lo, ends - lo)
        known, where, back, often = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
        exact = tb.same_spans(piece, starts - lo, starts[where][back] - lo, ends - starts, (ends - starts)[where][back])
        if not exact.all():
            where, back, often = _by_bytes(piece, starts - lo, ends - lo)
            known = hashes[where]
        parts.append((known, starts[where], ends[where], back.astype(np.uint32), often))
    if not parts:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint32), none, none, none, np.empty(0, np.uint64)
    hashes, lo, hi, often = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2, 4))
    known, where, back = np.unique(hashes, return_index=True, return_inverse=True)
    if not tb.same_spans(data, lo, lo[where][back], hi - lo, (hi - lo)[where][back]).all():
        where, back, _ = _by_bytes(data, lo, hi)
        known = hashes[where]
    often = np.bincount(back, often, len(known)).astype(np.int64)
    order = np.lexsort((lo[where], known, -often))
    number = np.empty(len(order), np.uint32)
    number[order] = np.arange(len(order))
    number = number[back]
    stream, at = [], 0
    for p in parts:
        stream.append(number[at : at + len(p[0])][p[3]])
        at += len(p[0])
    where = where[order]
    return np.concatenate(stream), lo[where], hi[where], often[order], known[order]


def _by_bytes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """Distinct spans where two of them have one hash: (first places, index of each, numbers)."""
    raw, first = data.tobytes(), {}
    back = np.array([first.setdefault(raw[a:b], len(first)) for a, b in zip(starts.tolist(), ends.tolist())], np.int64)
    return np.unique(back, return_index=True)[1], back, np.bincount(back)


def _sums(known: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One number per list that depends on its words and their order."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(tb.mix(known + np.arange(len(known), dtype=np.uint64)), dtype=np.uint64)))
    return (total[bounds[1:]] - total[bounds[:-1]]).view(np.int64)


def gather(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches of about ``limit`` bytes of text, gathered over the batches of the partition; no row is split."""
    held, size, rows = [], 0, 0
    for batch in batches:
        for part in tb.slices(iter([batch]), "text", limit):
            held.append(part)
            size += int(pc.sum(pc.binary_length(part.column("text"))).as_py() or 0)
            rows += part.num_rows
            if size >= limit or 2 * rows >= 1 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def word_lists(docs: DataFrame, split: Callable, buckets: int, chunk_bytes: int) -> DataFrame:
    """Rows by chunk and bucket of documents (doc_id, text): heads (``HEAD``) and lists (``LIST``).

    ``split(data, offsets)`` gives the buffer in which words are looked up and its pieces as
    ``number_words`` takes them. A head's ``stream`` has the word number at each place, its ``owners`` the
    bucket of each number; a list holds the words of its bucket in the order of their numbers.
    """

    def scan(batches):
        import zstandard
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 20
        for at, chunk in enumerate(gather(batches, chunk_bytes)):
            tb.tidy()
            data, offsets = tb.text_buffer(chunk.column("text"))
            data, pieces = split(data, offsets)
            sizes = np.zeros(len(offsets) - 1, np.int64)

            def counted(pieces, sizes=sizes, offsets=offsets):
                for lo, hi, starts, ends in pieces:
                    sizes += np.diff(np.searchsorted(starts, offsets))
                    yield lo, hi, starts, ends

            stream, lo, hi, often, hashes = number_words(data, counted(pieces))
            bucket = (hashes % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
            sums = _sums(hashes[order], bounds)
            full = np.flatnonzero(np.diff(bounds)).tolist()
            parts = [order[bounds[j] : bounds[j + 1]] for j in full]
            n, none = len(full), [None] * len(full)
            ids = chunk.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([first + at] * (n + 1), pa.int64()),
                    pa.array([(first + at) % buckets, *full], pa.int32()),
                    pa.concat_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.nulls(n, pa.list_(ids.type))]),
                    pa.array([pk.pack(sizes), *none], pa.binary()),
                    pa.array([pk.pack_skewed(stream), *none], pa.binary()),
                    pa.array([pk.pack(bucket), *none], pa.binary()),
                    pa.array([zstandard.compress(sums[full].tobytes()), *none], pa.binary()),
                    pa.array([None, *sums[full]], pa.int64()),
                    pa.array([None, *(pk.pack((hi - lo)[p]) for p in parts)], pa.binary()),
                    pa.array([None, *(zstandard.compress(tb.join_spans(data, lo[p], (hi - lo)[p]).tobytes(), 3) for p in parts)], pa.binary()),
                    pa.array([None, *(pk.pack(often[p]) for p in parts)], pa.binary()),
                ],
                names=["chunk", "bucket", *HEAD, *LIST],
            )

    return docs.mapInArrow(scan, head_schema(docs) + ", sum long, lengths binary, words binary, times binary")


def parted(table: pa.Table) -> tuple[pa.Table, pa.Table]:
    """(heads, lists) of a group."""
    return table.filter(pc.is_valid(table.column("stream"))), table.filter(pc.is_null(table.column("stream")))


def with_heads(heads: pa.Table, lists: pa.Table) -> pa.Table:
    """Lists with other columns in place of ``LIST``, and the heads passed on beside them."""
    extra = [f for f in lists.schema if f.name not in ("chunk", "bucket", "sum")]
    none = heads.select(["chunk", "bucket", *HEAD, "sum"])
    for field in extra:
        none = none.append_column(field, pa.nulls(heads.num_rows, field.type))
    for name in HEAD:
        lists = lists.append_column(heads.schema.field(name), pa.nulls(lists.num_rows, heads.schema.field(name).type))
    return pa.concat_tables([none, lists.select(none.column_names)])


def list_words(lists: pa.Table) -> list[list[bytes]]:
    import zstandard

    out = []
    for lengths, words in zip(lists.column("lengths"), lists.column("words")):
        ends = np.cumsum(pk.unpack(lengths.as_py()).astype(np.int64)).tolist()
        raw = zstandard.decompress(words.as_py())
        out.append([raw[a:b] for a, b in zip([0, *ends], ends)])
    return out


def unite(table: pa.Table) -> tuple[pa.Table, pa.Table, np.ndarray]:
    """(head, lists, slot of each word number in the lists' words, one list after the other) of a chunk's group."""
    import zstandard

    heads, lists = parted(table)
    lists = lists.sort_by("bucket")
    sums = [np.frombuffer(zstandard.decompress(x.as_py()), np.int64) for x in heads.column("sums")]
    if len(sums) != 1 or not np.array_equal(lists.column("sum").to_numpy(), sums[0]):
        raise RuntimeError("rows of a chunk come from two different readings; write the input to a table first")
    owners = pk.unpack(heads.column("owners")[0].as_py())
    slot = np.empty(len(owners), np.int64)
    slot[np.argsort(owners, kind="stable")] = np.arange(len(owners))
    return heads, lists, slot
