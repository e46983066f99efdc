"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, verified on the text.

Texts are normalised by lower-casing A-Z and taking words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
A benchmark item gives every window of ``window`` consecutive words, or all its words as one window
if it has fewer. Every document is scanned once; a word window whose hash is in the set counts only
if its words equal those of an item.

Defined cases: a null or empty document has no words and is clean; benchmark rows without words give no
windows; rows with a null id have theirs hit and cut like all others, but no id to be listed; repeated rows and
items change nothing, and items that share an id are one; null document ids stay null; an empty benchmark
leaves all documents clean, an empty table gives an empty result; other columns of the documents are passed
through or ignored, whatever their names.

Size: window sets are broadcast in blocks of at most ``block_bytes`` of item text (the size is measured first),
which take about ten times that in memory; one is built after the other. A longer item is a block by itself.
A benchmark of several blocks is scanned block by block; what each finds is a small row per document with a
hit, keyed by a digest of the text, and these are merged. A long text is scanned in pieces that overlap by a
window; what is held of it is about 40 bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .store import cut

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Rows of hits that are broadcast at most, and bytes of their places; more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 1 << 20, 32 << 20


class WindowSet:
    """Windows of benchmark items by length, in flat arrays: a hash of each, and where its words stand."""

    def __init__(self, texts: pa.Array, items: pa.Array, window: int = WINDOW):
        data, offsets = tb.text_buffer(texts)
        self.data = tb.LOWER[data]
        self.starts, self.ends, rows = tb.words(self.data, offsets, tb.ALNUM)
        names = items.dictionary_encode()
        self.names = names.dictionary.to_pylist()
        codes = names.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.bincount(rows, minlength=len(texts))
        hashes = [tb.span_hashes(self.data, self.starts, self.ends, seed) for seed in (0, 1)]
        # For each length: hashes in order, a second hash, the first word and the item.
        self.lengths = []
        for n in sorted({min(window, c) for c in counts.tolist()} - {0}):
            at = np.flatnonzero(rows[: len(rows) - n + 1] == rows[n - 1 :])
            at = at[np.minimum(counts[rows[at]], window) == n]
            one, two = (tb.window_hashes(h, n)[at] for h in hashes)
            order = np.lexsort((codes[rows[at]], two, one))
            one, two, at, item = one[order], two[order], at[order], codes[rows[at]][order]
            new = np.ones(len(one), bool)
            new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1]) | (item[1:] != item[:-1])
            self.lengths.append((n, one[new], two[new], at[new].astype(np.int32), item[new]))
        self.starts, self.ends = self.starts.astype(np.int32), self.ends.astype(np.int32)

    def words(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n]))


def scan(data: np.ndarray, offsets: np.ndarray, windows: WindowSet):
    """Per row: word count, covered word runs and items. ``data`` holds the texts as they are.

    Returns (word starts, word ends, bounds of each row's words, covered mask, item numbers by row).
    """
    starts, ends, hashes = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for lo, hi in tb.pieces(data, tb.ALNUM | (tb.LOWER != np.arange(256))):
        low = tb.LOWER[data[lo:hi]]
        first, last = np.searchsorted(offsets, [lo, hi])
        a, b, _ = tb.words(low, np.concatenate(([0], offsets[first:last] - lo, [hi - lo])), tb.ALNUM)
        starts.append(a + lo)
        ends.append(b + lo)
        hashes.append(tb.span_hashes(low, a, b))
    starts, ends, hashes = np.concatenate(starts), np.concatenate(ends), np.concatenate(hashes)
    bounds = np.searchsorted(starts, offsets)
    rows = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(bounds))
    covered = np.zeros(len(starts) + 1, np.int32)
    items: dict[int, set[int]] = {}
    for n, known, second, at, item in windows.lengths:
        found = tb.window_hashes(hashes, n)
        if not len(found):
            continue
        place = np.searchsorted(known, found)
        hit = np.flatnonzero((known[np.minimum(place, len(known) - 1)] == found) & (rows[: len(found)] == rows[n - 1 :]))
        tried: dict[tuple[int, bytes], set[int] | None] = {}
        for i in hit.tolist():
            lo = int(place[i])
            words = b" ".join(tb.LOWER[data[a:b]].tobytes() for a, b in zip(starts[i : i + n], ends[i : i + n]))
            if (lo, words) not in tried:
                # Of the windows with this hash (one, but for chance), those of the same words.
                who, same, k = set(), False, lo
                while k < len(known) and known[k] == known[lo]:
                    if k == lo or second[k] != second[k - 1]:
                        equal = windows.words(int(at[k]), n) == words
                    if equal:
                        same = True
                        who.add(int(item[k]))
                    k += 1
                tried[lo, words] = who if same else None
            who = tried[lo, words]
            if who is not None:
                covered[i] += 1
                covered[i + n] -= 1
                items.setdefault(int(rows[i]), set()).update(who)
    return starts, ends, bounds, np.cumsum(covered[:-1]) > 0, items


def _runs(mask: np.ndarray) -> np.ndarray:
    """[start, end) pairs of the true runs, flat."""
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))


def load_blocks(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> Iterator[WindowSet]:
    """Window sets of at most about ``block_bytes`` of text each, one after the other; the total is measured first."""
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).where("text is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n)))
    for i in range(n):
        part = rows.where(F.col("block") == i).select("item", "text").toArrow()
        yield WindowSet(part.column("text").combine_chunks(), part.column("item").combine_chunks(), window)


def _digest(n_words: int, n_hit: int, names: list[str]) -> tuple:
    return n_words, n_hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), n_hit > 0


def _names(items, windows: WindowSet) -> list[str]:
    return sorted(windows.names[i] for i in items if i >= 0)


def _key(column: str):
    return F.unhex(F.sha2(F.coalesce(F.col(column), F.lit("")), 256))


def _block_hits(docs: DataFrame, text_col: str, shared) -> DataFrame:
    """(key, words, items) of the documents that one block hits: hit word places, and ids."""

    def run(batches):
        for part in tb.slices(batches, "text"):
            data, offsets = tb.text_buffer(part.column("text"))
            _, _, bounds, covered, items = scan(data, offsets, shared.value)
            hit = sorted(items)
            if hit:
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key").take(pa.array(hit)),
                        pa.array([np.flatnonzero(covered[bounds[i] : bounds[i + 1]]) for i in hit], pa.list_(pa.int64())),
                        pa.array([_names(items[i], shared.value) for i in hit], pa.list_(pa.string())),
                    ],
                    names=["key", "words", "items"],
                )

    return docs.select(_key(text_col).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, "key binary, words array<long>, items array<string>")


def _all_hits(docs: DataFrame, text_col: str, blocks: Iterator[WindowSet]) -> DataFrame:
    """(key, words, items) over all blocks, one row for each distinct text with a hit."""
    tables = []
    for block in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(block)
        tables.append(cut(_block_hits(docs, text_col, shared), "benchmark-hits"))
        shared.destroy()
    found = tables[0]
    for other in tables[1:]:
        found = found.unionByName(other)
    # A text's hits are the same in each of its copies, so sets of them stay as small as one copy's.
    merged = found.groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("words")))).alias("words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    merged = cut(merged, "benchmark-found")
    rows, size = merged.agg(F.count("*"), F.coalesce(F.sum(8 * F.size("words") + 32 * F.size("items") + 64), F.lit(0))).first()
    return F.broadcast(merged) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else merged


def report(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated."""
    blocks = load_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    block, more = next(blocks), next(blocks, None)
    if more is None:
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in tb.slices(batches, "text"):
                data, offsets = tb.text_buffer(part.column("text"))
                _, _, bounds, covered, items = scan(data, offsets, shared.value)
                hits = np.concatenate(([0], np.cumsum(covered)))
                made = [
                    _digest(int(bounds[i + 1] - bounds[i]), int(hits[bounds[i + 1]] - hits[bounds[i]]), _names(items.get(i, ()), shared.value))
                    for i in range(part.num_rows)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *map(pa.array, zip(*made))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
                )

        return base.mapInArrow(run, schema)

    merged = _all_hits(base, "text", _chain(block, more, blocks))

    def count(batches):
        for part in tb.slices(batches, "text"):
            data, offsets = tb.text_buffer(part.column("text"))
            n, _ = tb.word_hashes(data, offsets, tb.ALNUM, lower=True)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(n, pa.int64())], names=["doc_id", "key", "n_words"])

    none = F.array().cast("array<string>")
    sized = base.withColumn("key", _key("text")).mapInArrow(count, f"doc_id {kind}, key binary, n_words long")
    return sized.join(merged, "key", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(F.size("words"), F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce(F.size("words"), F.lit(0)) > 0).alias("contaminated"),
    )


def _chain(*parts) -> Iterator[WindowSet]:
    *first, rest = parts
    yield from first
    yield from rest


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, covered: np.ndarray) -> str:
    """A text without its covered words, from the first byte of a run to the last."""
    runs = _runs(covered)
    at, kept = 0, []
    for a, b in zip(runs[::2], runs[1::2]):
        kept.append(data[at : starts[a]])
        at = ends[b - 1]
    kept.append(data[at:])
    return np.concatenate(kept).tobytes().decode()


def clean(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    mode: str = "span",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The documents without benchmark passages, with all their columns.

    ``mode="span"`` cuts each covered run of words out of the text, and where words that a cut brought
    together form a window, that one too, until there is none; ``mode="document"`` drops the documents that
    hold one. Texts without a hit stay as they are, nulls too.
    """
    if mode not in ("span", "document"):
        raise ValueError(f"unknown mode {mode!r}")
    blocks = load_blocks(benchmark, item_col, item_text_col, window, block_bytes)
    block, more = next(blocks), next(blocks, None)
    if more is not None:
        return _clean_by_blocks(docs, _chain(block, more, blocks), text_col, mode, (benchmark, item_col, item_text_col, window, block_bytes))
    shared = docs.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in tb.slices(batches, text_col):
            column = part.column(text_col)
            data, offsets = tb.text_buffer(column)
            starts, ends, bounds, covered, hit = scan(data, offsets, shared.value)
            if not hit:
                yield part
            elif mode == "document":
                yield part.filter(pa.array([i not in hit for i in range(part.num_rows)]))
            else:
                texts = column.to_pylist()
                for i in hit:
                    own = slice(bounds[i], bounds[i + 1])
                    a, b, gone, left = starts[own] - offsets[i], ends[own] - offsets[i], covered[own], data[offsets[i] : offsets[i + 1]]
                    while gone.any():
                        texts[i] = _without(left, a, b, gone)
                        left = np.frombuffer(texts[i].encode(), np.uint8)
                        a, b, _, gone, _ = scan(left, np.array([0, len(left)]), shared.value)
                k = part.schema.get_field_index(text_col)
                arrays = [pa.array(texts, part.schema.field(k).type) if j == k else c for j, c in enumerate(part.columns)]
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def _clean_by_blocks(docs: DataFrame, blocks: Iterator[WindowSet], text_col: str, mode: str, source: tuple) -> DataFrame:
    """``clean`` for a benchmark of several blocks: rounds of scans over all of them, until no text is hit."""
    key, places = "__benchmark_key", "__benchmark_words"
    merged = _all_hits(docs, text_col, blocks).select(F.col("key").alias(key), F.col("words").alias(places))
    keyed = docs.withColumn(key, _key(text_col))
    if mode == "document":
        return keyed.join(merged, key, "left_anti").select(*docs.columns)
    schema = docs.schema

    def run(batches):
        for part in tb.slices(batches, text_col):
            texts = part.column(text_col).to_pylist()
            for i, words in enumerate(part.column(places)):
                if words.is_valid:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    starts, ends, _ = tb.words(tb.LOWER[data], np.array([0, len(data)]), tb.ALNUM)
                    covered = np.zeros(len(starts), bool)
                    covered[words.values.to_numpy()] = True
                    texts[i] = _without(data, starts, ends, covered)
            columns = [pa.array(texts, pa.string()) if f.name == text_col else part.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in schema])

    while not merged.isEmpty():
        docs = cut(keyed.join(merged, key, "left").select(*docs.columns, places).mapInArrow(run, schema), "benchmark-cut")
        keyed = docs.withColumn(key, _key(text_col))
        merged = _all_hits(docs, text_col, load_blocks(*source)).select(F.col("key").alias(key), F.col("words").alias(places))
    return docs
