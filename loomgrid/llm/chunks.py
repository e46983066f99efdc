"""Documents as a table of chunks: whole texts, one after the other, compressed.

A chunk has a fixed number and fixed rows, so any number of passes may refer to a document by its chunk
and its place there, even where the input hands out its rows in another order each time it is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packing as pk
from . import textbatch as tb
from .store import cut

#: A chunk has fewer rows than this, and a partition fewer chunks, so that three numbers make one.
ROWS = 1 << 20


def chunk_table(docs: DataFrame, chunk_bytes: int, label: str) -> DataFrame:
    """(chunk, ids, sizes, text) of documents (doc_id, text); a longer text is a chunk by itself."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import zstandard
        from pyspark import TaskContext

        first = TaskContext.get().partitionId() << 20
        number, ids, sizes, texts, held, rows = 0, [], [], [], 0, 0

        def flush():
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + number], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, rows], pa.int32()), pa.chunked_array(ids).combine_chunks()),
                    pa.array([pk.pack(np.concatenate(sizes))], pa.binary()),
                    pa.array([zstandard.compress(b"".join(texts), 3)], pa.binary()),
                ],
                names=["chunk", "ids", "sizes", "text"],
            )

        for batch in batches:
            for part in tb.slices(iter([batch]), "text", chunk_bytes // 4):
                data, offsets = tb.text_buffer(part.column("text"))
                if held and held + len(data) > 2 * chunk_bytes:
                    yield flush()
                    number, ids, sizes, texts, held, rows = number + 1, [], [], [], 0, 0
                ids.append(part.column("doc_id"))
                sizes.append(np.diff(offsets))
                texts.append(data.tobytes())
                held, rows = held + len(data), rows + part.num_rows
                if held >= chunk_bytes or 2 * rows >= ROWS:
                    yield flush()
                    number, ids, sizes, texts, held, rows = number + 1, [], [], [], 0, 0
        if ids:
            yield flush()

    return cut(docs.mapInArrow(run, f"chunk long, ids array<{kind}>, sizes binary, text binary"), label)


def open_text(text: pa.Scalar, sizes: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a chunk."""
    import zstandard

    tb.tidy()
    data = np.frombuffer(zstandard.decompress(text.as_buffer()), np.uint8)
    return data, np.concatenate(([0], np.cumsum(pk.unpack(sizes.as_py()).astype(np.int64))))


def slices(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of text; no row is split."""
    lo = 0
    while lo < len(offsets) - 1:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi
        lo = hi
