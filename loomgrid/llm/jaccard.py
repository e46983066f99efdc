"""N-gram Jaccard join with signature trees.

Texts are lower-cased (A-Z) and cut into words ``[^\\x20\\x09-\\x0D]+``; a document's set holds its
distinct shingles of five words, or its whole sequence if it has fewer. Two documents link where
100 * intersection >= 75 * union; the result is each document's connected component.

1. Chunks of documents (a table of its own) send out the leading bits of their distinct shingles' hashes
   by range, once each with the number of documents of the chunk that hold it, so a shingle in a third of
   all documents is one entry of a chunk. The chunks get back in how many others it occurs. Shingles of one
   document only can't be shared, so a set is from there on its size and its shared shingles; a document
   that has fewer of those than a partner must share has no partner and is done.
2. Equal sets become one representative. With shingles sorted rare ones first, two sets that link share
   one of their first ``n - ceil(0.75 n) + 1``; chains of such shared shingles make families, which no
   link leaves.
3. Families are dealt out in bins of about ``BLOCK_BYTES``. In each family a signature tree, whose nodes
   hold OR-combined bitmaps and size ranges, is traversed against itself, and pairs of nodes whose largest
   possible overlap is too small, or that are joined already, are pruned. Surviving pairs are verified.
4. A family beyond ``BLOCK_BYTES`` is first thinned by one round against leaders, then cut into blocks of
   like sizes; trees of each pair of blocks whose sizes are compatible are traversed against each other.
   Sets of its main component are not compared with each other again.

No step gathers a group beyond two blocks or drops a row. In a family of N sets of which none link, each
set is sent to as many blocks as the family fills.

Defined cases: null, empty and wordless texts have an empty set and link with nothing, not even with
each other; rows that share an id are one document (each keeps its own row and size, and all have the
component of whichever text links); a null id stays null and links through its text, and a component of
null ids only has a null component_id; repeated rows are copies; ties between leaders fall to the least
row number; an empty table gives an empty result; other columns are ignored. A long text is hashed in
pieces; what is held at once is 8 bytes for each of its words and shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packing as pk
from . import textbatch as tb
from .chunks import chunk_table, open_text, slices
from .components import components
from .store import cut, drop, files_for

SHINGLE = 5
PERCENT = 75
CHUNK_BYTES = 6 << 20
#: Sets with their prefixes that a file holds, about.
SETS_IN_FILE = 4096
#: Bytes of compressed text whose shingles one hash range counts, about.
RANGE_BYTES = 4 << 20
#: Bytes of shared shingles that one bin or block holds, about.
BLOCK_BYTES = 8 << 20
LEAF, FAN = 16, 8
#: (id, family) rows that are broadcast at most, 16 bytes each; more are joined by a shuffle of the sets.
BROADCAST_ROWS = 4 << 20


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of each text in rising order, one text after the other."""
    n = len(offsets) - 1
    counts, hashes = tb.word_hashes(data, offsets, tb.NON_SPACE, lower=True)
    if n == 1:
        k = min(size, int(counts[0]))
        tokens = np.unique(tb.window_hashes(hashes, k)) if k else np.empty(0, np.uint64)
        return tokens, np.array([0, len(tokens)])
    bounds = np.concatenate(([0], np.cumsum(counts)))
    rows = np.repeat(np.arange(n), counts)
    found = tb.window_hashes(hashes, size)
    whole = rows[: len(found)] == rows[size - 1 :] if len(found) else np.empty(0, bool)
    grams, owner = [found[whole]], [rows[: len(found)][whole]]
    for k in range(1, size):
        short = np.flatnonzero(counts == k)
        grams.append(tb.window_hashes(hashes, k)[bounds[short]])
        owner.append(short)
    tokens, owner = np.concatenate(grams), np.concatenate(owner)
    order = np.lexsort((tokens, owner))
    tokens, owner = tokens[order], owner[order]
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])
    tokens, owner = tokens[first], owner[first]
    return tokens, np.searchsorted(owner, np.arange(n + 1))


def need(n: int | np.ndarray, percent: int = PERCENT):
    """Shingles that a set of ``n`` must share with a partner, at least."""
    return -(-n * percent // 100)


def chunk_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes) of the sets of a chunk."""
    tokens, sizes = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for lo, hi in slices(data, offsets, 2 << 20):
        t, bounds = shingle_sets(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        tokens.append(t)
        sizes.append(np.diff(bounds))
    return np.concatenate(tokens), np.concatenate(sizes)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.LargeListArray.from_arrays(pa.array(bounds, pa.int64()), pa.array(values)).cast(pa.list_(pa.from_numpy_dtype(values.dtype)))


def _binaries(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """One binary of 8-byte numbers for each [bounds[i], bounds[i + 1])."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(bounds * 8, np.int64)), pa.py_buffer(np.ascontiguousarray(values, "<u8"))]
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, buffers).cast(pa.binary())


def shared_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(rid, doc_id, n, key1, key2, held, tokens, prefix), one row for each document, as a table.

    ``rid`` numbers the rows, ``n`` is the size of the set. Only documents that may have a partner have
    keys (equal for equal sets), the ``held`` shingles that they share with others, and a prefix of these,
    rare ones first, of which two sets that link have one in common.
    """
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    chunks = chunk_table(docs, CHUNK_BYTES, "shingle-chunks")
    # Shingles are counted by so many leading bits of their hashes that few of one document meet others by chance.
    whole = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    drop_bits = np.uint64(max(0, 64 - int(whole).bit_length() - 10))
    # Each chunk sends a packet to each range, so there are no more ranges than tasks or their size asks for.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), whole // RANGE_BYTES)

    def scan(batches):
        for batch in batches:
            for chunk, sizes, text in zip(*(batch.column(c) for c in ("chunk", "sizes", "text"))):
                tokens, _ = chunk_sets(*open_text(text, sizes))
                known, times = np.unique(tokens >> drop_bits, return_counts=True)
                bounds = pk.bounds_of(known << drop_bits, buckets)
                full = np.flatnonzero(np.diff(bounds)).tolist()
                parts = [slice(bounds[j], bounds[j + 1]) for j in full]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk.as_py()] * len(full), pa.int64()),
                        pa.array(full, pa.int32()),
                        pa.array([pk.pack(times[p]) for p in parts], pa.binary()),
                        pa.array([pk.pack_rising(known[p] - known[p.start]) for p in parts], pa.binary()),
                        pa.array(known[bounds[full]].view(np.int64)),
                    ],
                    names=["chunk", "bucket", "times", "known", "base"],
                )

    def count(table: pa.Table) -> pa.Table:
        """Back to each chunk: which of its shingles of a range occur in several documents, and in how many."""
        tb.tidy()
        base = table.column("base").to_numpy().view(np.uint64)
        known = [pk.unpack_rising(x.as_py()) + b for x, b in zip(table.column("known"), base)]
        times = np.concatenate([pk.unpack(x.as_py()) for x in table.column("times")])
        everything = np.concatenate(known)
        order = np.argsort(everything)
        new = np.concatenate(([True], np.diff(everything[order]) != 0))
        total = np.add.reduceat(times[order], np.flatnonzero(new))
        often = np.empty(len(order), np.uint64)
        often[order] = total[np.cumsum(new) - 1]
        ends = np.cumsum([len(t) for t in known])
        parts = [often[e - len(t) : e] for t, e in zip(known, ends)]
        return pa.table(
            {
                "chunk": table.column("chunk"),
                "bucket": table.column("bucket"),
                "often": pa.array([pk.pack(p - 1) for p in parts], pa.binary()),
            }
        )

    def finish(chunk: pa.Table, back: pa.Table) -> pa.Table:
        tokens, sizes = chunk_sets(*open_text(chunk.column("text")[0], chunk.column("sizes")[0]))
        n = len(sizes)
        others = np.concatenate([np.empty(0, np.uint64), *(pk.unpack(x.as_py()) for x in back.sort_by("bucket").column("often"))])
        owners = np.repeat(np.arange(n), sizes)
        often = others[np.unique(tokens >> drop_bits, return_inverse=True)[1]]
        shared = often > 0
        owners, tokens, often = owners[shared], tokens[shared], often[shared]
        held = np.bincount(owners, minlength=n)
        may = (sizes > 0) & (held >= need(sizes, percent))
        keep = may[owners]
        own, tokens, often = owners[keep], tokens[keep], often[keep]
        bounds = np.searchsorted(own, np.arange(n + 1))
        rare = np.lexsort((tokens, often, own))
        place = np.arange(len(own)) - bounds[own]
        prefix = rare[place < (held - need(sizes, percent) + 1)[own]]
        rid = (chunk.column("chunk")[0].as_py() << 20) + np.arange(n)
        keys = []
        for k in (1, 2):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(tb.mix(tokens + np.uint64(k)), dtype=np.uint64)))
            key = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
            # A set with shingles of its own equals no other.
            keys.append(pa.array(np.where(held < sizes, rid, key), pa.int64(), mask=~may))
        return pa.table(
            {
                "rid": pa.array(rid, pa.int64()),
                "doc_id": chunk.column("ids").combine_chunks()[0].values,
                "n": pa.array(sizes, pa.int64()),
                "key1": keys[0],
                "key2": keys[1],
                "held": pa.array(held, pa.int64()),
                "tokens": _binaries(tokens, bounds),
                "prefix": _lists(tokens[prefix].view(np.int64), np.searchsorted(own[prefix], np.arange(n + 1))),
            }
        )

    counted = (
        chunks.select("chunk", "sizes", "text")
        .mapInArrow(scan, "chunk long, bucket int, times binary, known binary, base long")
        .groupBy("bucket").applyInArrow(count, "chunk long, bucket int, often binary")
    )
    schema = f"rid long, doc_id {kind}, n long, key1 long, key2 long, held long, tokens binary, prefix array<long>"
    found = cut(chunks.groupBy("chunk").cogroup(counted.groupBy("chunk")).applyInArrow(finish, schema), "shingles")
    del counted
    drop(chunks)
    return found


def signatures(tokens: list[np.ndarray]) -> np.ndarray:
    """One bitmap for each set, four bits or more for each shingle of the largest."""
    sizes = np.array([len(t) for t in tokens])
    width = 64 << max(3, int(4 * sizes.max() // 64).bit_length())
    bits = np.zeros((len(tokens), width), bool)
    bits[np.repeat(np.arange(len(tokens)), sizes), (np.concatenate(tokens) >> np.uint64(7)) % np.uint64(width)] = True
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


class SignatureTree:
    """Bitmaps OR-combined upward with size ranges.

    ``sizes`` are those of the whole sets, ``shared`` of what the bitmaps stand for; ``slack`` is by how
    much the latter outgrows its bitmap.
    """

    def __init__(self, sizes: np.ndarray, shared: np.ndarray, bitmaps: np.ndarray):
        self.order = np.lexsort((*bitmaps.T[:4], sizes))
        self.sizes, self.bits = sizes[self.order], bitmaps[self.order]
        self.slack = shared[self.order] - np.bitwise_count(self.bits).sum(axis=1).astype(np.int64)
        # levels[0] are the leaves: (least size, largest size, largest slack, OR bitmap)
        self.levels = [self._level(self.sizes, self.sizes, self.slack, self.bits, LEAF)]
        while len(self.levels[-1][0]) > 1:
            self.levels.append(self._level(*self.levels[-1], FAN))

    @staticmethod
    def _level(lo, hi, slack, bits, fan):
        at = np.arange(0, len(lo), fan)
        return np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(slack, at), np.bitwise_or.reduceat(bits, at, axis=0)

    def partners(self, other: SignatureTree, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of the two trees that may link, by a traversal of both from their roots."""
        stack = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while stack:
            p, i, q, j = stack.pop()
            if self is other and p == q and j < i:
                continue  # seen from the other side
            a, b = self.levels[p], other.levels[q]
            common = int(np.bitwise_count(a[3][i] & b[3][j]).sum())
            most = min(a[1][i], b[1][j], common + min(a[2][i], b[2][j]))
            if (100 + percent) * most < percent * (a[0][i] + b[0][j]):
                continue
            if p == 0 and q == 0:
                yield from self._leaves(other, i, j, percent)
            elif p >= q:
                for k in range(i * FAN, min((i + 1) * FAN, len(self.levels[p - 1][0]))):
                    stack.append((p - 1, k, q, j))
            else:
                for k in range(j * FAN, min((j + 1) * FAN, len(other.levels[q - 1][0]))):
                    stack.append((p, i, q - 1, k))

    def _leaves(self, other, i, j, percent):
        x = slice(i * LEAF, (i + 1) * LEAF)
        y = slice(j * LEAF, (j + 1) * LEAF)
        common = np.bitwise_count(self.bits[x, None, :] & other.bits[None, y, :]).sum(axis=2).astype(np.int64)
        sx, sy = self.sizes[x, None], other.sizes[None, y]
        most = np.minimum(np.minimum(sx, sy), common + np.minimum(self.slack[x, None], other.slack[None, y]))
        a, b = np.nonzero((100 + percent) * most >= percent * (sx + sy))
        if len(a):
            yield self.order[x][a], other.order[y][b]


def _links(s: np.ndarray, t: np.ndarray, n: int, m: int, percent: int) -> bool:
    """Whether sets of ``n`` and ``m`` shingles link whose shared ones are ``s`` and ``t``, in rising order."""
    if len(s) > len(t):
        s, t = t, s
    at = np.minimum(np.searchsorted(t, s), len(t) - 1)
    both = int((t[at] == s).sum())
    return (100 + percent) * both >= percent * (n + m)


def tree_links(n: np.ndarray, tokens: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int = PERCENT):
    """Links (i, j) that join what ``label`` leaves apart, between two lists of rows; ``label`` follows."""
    label = np.unique(label, return_inverse=True)[1]
    shared = np.array([len(t) for t in tokens], np.int64)
    bits = signatures(tokens)
    one = SignatureTree(n[left], shared[left], bits[left])
    two = one if left is right else SignatureTree(n[right], shared[right], bits[right])
    found = []
    for p, q in one.partners(two, percent):
        p, q = left[p], right[q]
        apart = label[p] != label[q]
        for u, v in zip(p[apart].tolist(), q[apart].tolist()):
            if label[u] != label[v] and _links(tokens[u], tokens[v], int(n[u]), int(n[v]), percent):
                a, b = label[u], label[v]
                label[label == max(a, b)] = min(a, b)
                found.append((u, v))
    return found, label


def _sets_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    tokens = [np.frombuffer(t.as_buffer(), "<u8") for c in table.column("tokens").chunks for t in c]
    return table.column("id").to_numpy(), table.column("n").to_numpy(), tokens


def family_links(rows: DataFrame, bins: int, percent: int = PERCENT) -> DataFrame:
    """(a, b): every set of rows (family, id, n, tokens) that links, with the least set of its component."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("family", "ascending"), ("id", "ascending")]).combine_chunks()
        ids, n, tokens = _sets_of(table)
        family = table.column("family").to_numpy()
        first = np.flatnonzero(np.concatenate(([True], family[1:] != family[:-1])))
        a, b = [], []
        for lo, hi in zip(first, [*first[1:], len(ids)]):
            every = np.arange(hi - lo)
            _, label = tree_links(n[lo:hi], tokens[lo:hi], every, every, every, percent)
            a.append(ids[lo:hi])
            b.append(ids[lo + np.unique(label, return_index=True)[1][np.unique(label, return_inverse=True)[1]]])
        a, b = np.concatenate(a), np.concatenate(b)
        # A least set stands for itself where others link with it.
        keep = (a != b) | np.isin(a, b[a != b])
        return pa.table({"a": a[keep], "b": b[keep]})

    dealt = rows.withColumn("bin", F.pmod(F.xxhash64("family"), F.lit(bins)))
    return dealt.groupBy("bin").applyInArrow(run, "a long, b long")


def verify(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    left = sets.select(F.col("id").alias("a"), F.col("tokens").alias("left"), F.col("n").alias("p"))
    right = sets.select(F.col("id").alias("b"), F.col("tokens").alias("right"), F.col("n").alias("q"))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y, n, m in zip(*(batch.column(c) for c in ("left", "right", "p", "q"))):
                keep.append(_links(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8"), n.as_py(), m.as_py(), percent))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(left, "a").join(right, "b").mapInArrow(run, "a long, b long")


def block_links(rows: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that join what is left apart in large families: rows (family, id, c, n, tokens).

    A cell holds the sets of a family of like size, those of its main component apart from the others;
    it is dealt into blocks. Sets that link differ in size by a cell at most.
    """
    main = rows.groupBy("family", "c").agg(F.count("*").alias("many"))
    main = main.groupBy("family").agg(F.max_by("c", F.struct("many", "c")).alias("main"), F.count("*").alias("parts"))
    rows = rows.join(main.where("parts > 1").drop("parts"), "family")
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    rows = rows.withColumn("cell", 2 * step + (F.col("c") == F.col("main")).cast("int")).drop("main")
    cells = rows.groupBy("family", "cell").agg(F.ceil(F.sum(F.octet_length("tokens") + 64) / block_bytes).cast("int").alias("k"))
    cells = cut(cells, "cells")
    other = cells.select("family", F.col("cell").alias("cell2"), F.col("k").alias("k2"))
    near = F.abs(F.floor(F.col("cell") / 2) - F.floor(F.col("cell2") / 2)) <= 1
    pairs = cells.join(other, "family").where(near & ~((F.col("cell") % 2 == 1) & (F.col("cell2") % 2 == 1)))
    name = lambda cell, place: F.col(cell).cast("long") * (1 << 32) + place
    dealt = rows.join(pairs, ["family", "cell"]).withColumn("own", name("cell", F.pmod(F.xxhash64("id"), F.col("k"))))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k2") - 1))).withColumn("other", name("cell2", F.col("other")))
    dealt = dealt.select("family", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "c", "n", "tokens")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, n, tokens = _sets_of(table)
        own = table.column("own").to_numpy()
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        x, y = np.flatnonzero(own == i), np.flatnonzero(own == j)
        found = []
        if len(x) and len(y):
            found, _ = tree_links(n, tokens, table.column("c").to_numpy(), x, x if i == j else y, percent)
        return pa.table({"a": pa.array([ids[u] for u, _ in found], pa.int64()), "b": pa.array([ids[v] for _, v in found], pa.int64())})

    return dealt.groupBy("family", "i", "j").applyInArrow(run, "a long, b long")


def link_components(sets: DataFrame, tokens: DataFrame, percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, component) of the sets (id, n, held, prefix) that link with another one; ``tokens`` has (id, n, tokens)."""
    rows = sets.select("id", F.explode("prefix").alias("token"))
    leads = rows.groupBy("token").agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead < last").select("token", "lead")
    many_sets = sets.count()
    near = rows.join(leads, "token").where("id <> lead").groupBy("id", "lead").agg(F.count("*").alias("times"))
    near = cut(near.coalesce(files_for(many_sets, SETS_IN_FILE)), "near")
    # A family: sets that chains of shared prefix shingles connect. Links never leave a family.
    family = components(near, "id", "lead")
    named = family.withColumnRenamed("component", "family")
    sized = named.join(sets.select("id", "held"), "id").groupBy("family").agg(F.sum(8 * F.col("held") + 64).alias("weight"), F.count("*").alias("many"))
    sized = cut(sized.coalesce(files_for(many_sets)), "family-sizes")
    total, widest, many = sized.agg(F.sum("weight"), F.max("weight"), F.sum("many")).first()
    if not total:
        drop(near, family, sized)
        return sets.sparkSession.createDataFrame([], "id long, component long")
    bins = max(1, -(-total // block_bytes))
    held = tokens.join(F.broadcast(named) if many <= BROADCAST_ROWS else named, "id")
    if widest <= block_bytes:
        links = cut(family_links(held, bins, percent), "links")
        drop(near, family, sized)
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    held = cut(held, "families")
    large = sized.where(F.col("weight") > block_bytes).select("family")
    small, big = held.join(large, "family", "left_anti"), held.join(large, "family")
    # One round against a leader each, the one with most shared prefix shingles.
    star = near.groupBy(F.col("id").alias("a")).agg(F.max_by("lead", F.struct("times", -F.col("lead"))).alias("b"))
    first = cut(verify(star.join(big.select(F.col("id").alias("a")), "a"), big, percent), "stars")
    found = components(first)
    apart = big.join(found, "id", "left").select("family", "id", "n", "tokens", F.coalesce("component", "id").alias("c"))
    links = family_links(small, bins, percent).unionByName(first).unionByName(block_links(apart, percent, block_bytes))
    links = cut(links, "links")
    drop(near, family, sized, held, first, found)
    return components(links)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    every = shared_sets(base, percent)
    may = every.where("key1 is not null")
    # Of equal sets the first stands for all, and the others' shingles are not exchanged.
    sets = may.groupBy("key1", "key2", "n").agg(F.min("rid").alias("id"), F.min_by(F.struct("held", "prefix"), "rid").alias("s"))
    rows = every.count()
    sets = cut(sets.select("key1", "key2", "n", "id", "s.*").coalesce(files_for(rows, SETS_IN_FILE)), "classes")
    member = may.select("rid", "doc_id", "key1", "key2", "n").join(sets.drop("held", "prefix"), ["key1", "key2", "n"]).select("rid", "doc_id", "id")
    found = link_components(sets, may.select(F.col("rid").alias("id"), "n", "tokens"), percent, block_bytes)
    member = member.join(found, "id", "left").select("rid", "doc_id", F.coalesce("component", "id").alias("class"))
    # Rows that share an id are one document.
    again = every.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("many"), F.min("rid").alias("lead")).where("many > 1")
    again = cut(every.select("rid", "doc_id").join(again, "doc_id").select("rid", "lead"), "repeated")
    if again.limit(1).count():
        links = member.select(F.col("rid").alias("a"), F.col("class").alias("b")).union(again.select("rid", "lead"))
        links = cut(links, "all-links")
        joined = components(links)
        drop(links)
        member = every.select("rid", "doc_id").join(joined, F.col("rid") == F.col("id")).select("rid", "doc_id", F.col("component").alias("class"))
    least = member.groupBy("class").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("many")).where("many > 1")
    named = cut(member.join(least, "class").select("rid", "component_id").coalesce(files_for(rows)), "named")
    drop(sets, found, again)
    return every.select("rid", "doc_id", "n").join(named, "rid", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The documents of which none other of their component has a lesser id, with all their columns."""
    found = join(docs, id_col=id_col, text_col=text_col, percent=percent)
    gone = found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(id_col))
    return docs.join(gone.distinct(), id_col, "left_anti").select(*docs.columns)
